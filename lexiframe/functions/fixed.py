"""Word lists, patterns, formats and limits that results depend on.

Everything in this file is a given of the domain and is stated as plain text in its
natural order.  Logic lives elsewhere.
"""

# --- Fixed values: line patterns (regular expressions, anchored at line start) -------

PAGE_NUMBER_LINE = r"^-\s[0-9]+\s-$"
CHAPTER_LINE = r"^BAB\s[A-Z]+$"
SECTION_LINE = r"^Bagian\s[A-Z][a-z]+$"
SUBSECTION_LINE = r"^Paragraf\s[0-9]+$"
ARTICLE_LINE = r"^Pasal\s[0-9]+$"
BARE_ARTICLE_LINE = r"^Pasal$"
BODY_PARAGRAPH_LINE = r"^\([0-9]+\)$"
ELUCIDATION_PARAGRAPH_LINE = r"^Ayat \([0-9]+\)$"
BODY_LIST_LINE = r"^[a-z]\.$|^[a-z]\.\s[a-zA-Z]|^[0-9]+\.$|^[0-9]+\.\s[a-zA-Z]"
ELUCIDATION_LIST_LINE = (
    r"^[a-z]\.$|^[a-z]\.\s[a-zA-Z]|^[0-9]+\.$|^[0-9]+\.\s[a-zA-Z]"
    r"|^Huruf\s[a-z]$|^Huruf\s[a-z]\s[a-zA-Z]"
)
DOTS_LINE = r"^.+\.\.\.$"
SPACED_DOTS_LINE = r"^.+\.\s\.\s\.$"
BODY_END_MARKER = "Disahkan di Jakarta"
ELUCIDATION_END_MARKER = "TAMBAHAN LEMBARAN NEGARA REPUBLIK INDONESIA NOMOR 5025"
ARTICLE_WORD = "Pasal"

# --- Fixed values: chunk types, source name, expected size ---------------------------

BODY = "body"
ELUCIDATION = "elucidation"
STATUTE_SOURCE = "UU_22_2009_LLAJ"

# --- Fixed values: everyday term -> legal terms, in matching order -------------------

TERM_EXPANSIONS = [
    ("lampu merah", ["Alat Pemberi Isyarat Lalu Lintas", "APILL", "isyarat lalu lintas"]),
    ("lampu lalu lintas", ["Alat Pemberi Isyarat Lalu Lintas", "APILL"]),
    ("traffic light", ["Alat Pemberi Isyarat Lalu Lintas", "APILL"]),
    ("menerobos", ["melanggar aturan perintah atau larangan", "tidak mematuhi"]),
    ("ngebut", ["batas kecepatan", "kecepatan maksimal", "kecepatan tinggi"]),
    ("ugal-ugalan", ["membahayakan", "keselamatan lalu lintas"]),
    ("sim", ["Surat Izin Mengemudi"]),
    ("stnk", ["Surat Tanda Nomor Kendaraan Bermotor"]),
    ("bpkb", ["Buku Pemilik Kendaraan Bermotor"]),
    ("helm", ["helm standar nasional Indonesia"]),
    ("sabuk pengaman", ["sabuk keselamatan"]),
    ("parkir sembarangan", ["parkir", "larangan parkir", "tempat parkir"]),
    ("bahu jalan", ["bahu Jalan", "badan jalan"]),
    ("trotoar", ["trotoar", "fasilitas Pejalan Kaki", "fasilitas pejalan kaki"]),
    ("menyalip", ["melewati Kendaraan", "mendahului"]),
    ("zigzag", ["gerakan lalu lintas", "manuver berbahaya"]),
    ("motor", ["Sepeda Motor", "Kendaraan Bermotor"]),
    ("mobil", ["Kendaraan Bermotor", "kendaraan beroda empat"]),
    ("tilang", ["pidana", "denda", "pelanggaran"]),
    ("denda", ["pidana denda", "sanksi"]),
    ("kaca spion", ["kaca spion", "spion"]),
    ("plat nomor", ["Tanda Nomor Kendaraan Bermotor", "TNKB"]),
    ("lawan arah", ["melawan arus", "arah lalu lintas"]),
    ("jalur busway", ["lajur khusus", "jalur khusus"]),
    ("zebra cross", ["tempat penyeberangan", "penyeberangan Pejalan Kaki"]),
]

# --- Fixed values: special pattern -> ready-made legal query, first match wins --------

SPECIAL_REWRITES = [
    (
        "menerobos lampu merah",
        "Setiap orang yang mengemudikan Kendaraan Bermotor di Jalan yang melanggar aturan"
        " perintah atau larangan yang dinyatakan dengan Alat Pemberi Isyarat Lalu Lintas dipidana",
    ),
    ("parkir di trotoar", "fasilitas Pejalan Kaki trotoar parkir larangan"),
    ("bahu jalan saat macet", "bahu Jalan Kendaraan keadaan darurat lalu lintas"),
    ("helm", "Sepeda Motor helm standar nasional Indonesia dipidana"),
    ("sabuk pengaman", "sabuk keselamatan Pengemudi Penumpang dipidana"),
    ("menyalip zigzag", "gerakan lalu lintas melewati Kendaraan berbahaya dipidana"),
]

# --- Fixed values: retrieval parameters ----------------------------------------------

LEGAL, ORIGINAL, ADDITIONAL = "legal_query", "original_query", "additional"
LIST_WEIGHTS = {LEGAL: 2.0, ORIGINAL: 1.0, ADDITIONAL: 0.8}
UNKNOWN_LIST_WEIGHT = 0.5
RRF_K = 60
VECTOR_TOP_K = 10
ADDITIONAL_TOP_K = 5
MAX_ADDITIONAL_BUILT = 5
MAX_ADDITIONAL_USED = 3
STATIC_TERMS_JOINED = 5
FINAL_TOP_K = 5
MAX_TOP_K = 20
SCORE_THRESHOLD = 0.1
MIN_SIMILARITY = 0.3
MAX_MESSAGE_CHARS = 2000
EMBED_BATCH = 50

# --- Fixed values: conversation parameters and texts ----------------------------------

SESSION_TTL_HOURS = 24
MAX_CONTEXT_MESSAGES = 10
HISTORY_MESSAGES = 6
HISTORY_CHARS = 500
USER_LABEL = "Pengguna"
ASSISTANT_LABEL = "Asisten"
BODY_LABEL = "Isi"
ELUCIDATION_LABEL = "Penjelasan"
NO_CONTEXT = "Tidak ada dokumen yang relevan ditemukan."
NOT_FOUND = (
    "Maaf, informasi mengenai hal tersebut tidak ditemukan dalam"
    " dokumen hukum yang menjadi rujukan saya."
)
NO_RELEVANT_CHUNKS = (
    "Maaf, saya tidak menemukan informasi yang relevan dalam"
    " dokumen hukum lalu lintas untuk menjawab pertanyaan Anda."
    " Silakan coba dengan pertanyaan yang berbeda atau lebih spesifik."
)
PROCESSING_ERROR = (
    "Maaf, terjadi kesalahan saat memproses pertanyaan Anda."
    " Silakan coba lagi."
)
PROMPT_CONTEXT_TITLE = "KUTIPAN DOKUMEN HUKUM LALU LINTAS:"
PROMPT_HISTORY_TITLE = "RIWAYAT PERCAKAPAN:"
PROMPT_QUESTION_TITLE = "PERTANYAAN PENGGUNA:"
PROMPT_CLOSING = (
    "Jawab pertanyaan di atas berdasarkan kutipan dokumen hukum yang diberikan."
    " Ikuti aturan yang telah ditetapkan."
)

# --- Fixed values: term -> related articles -------------------------------------------

RELATED_ARTICLES = [
    ("lampu merah", "25, 95, 103, 106, 287"),
    ("SIM", "77-88, 281, 288"),
    ("STNK", "64-70, 288"),
    ("helm", "57, 106, 291"),
    ("sabuk pengaman", "106, 289"),
    ("parkir", "43-44, 106, 287"),
    ("bahu jalan", "43, 108"),
    ("trotoar", "45, 131"),
    ("menyalip", "109-112, 287"),
    ("ngebut", "106, 115, 287"),
    ("kaca spion", "48, 106, 285"),
    ("plat nomor", "68, 280"),
]

# --- Fixed values: article categories (closed ranges) ----------------------------------

ARTICLE_CATEGORIES = [
    ("Road Infrastructure", 1, 46),
    ("Vehicles", 47, 76),
    ("Drivers", 77, 94),
    ("Traffic Rules", 95, 123),
    ("Traffic Safety", 124, 147),
    ("Transportation", 148, 186),
    ("Impact & Environment", 187, 219),
    ("Development", 220, 243),
    ("Enforcement", 244, 273),
    ("Penalties", 274, 317),
    ("Transitional", 318, 326),
]

# --- Fixed values: acceptance questions -> expected articles (lo, hi, paragraph) --------

ACCEPTANCE_QUESTIONS = [
    ("Apakah menerobos lampu merah melanggar aturan?", [(106, 106, 4), (287, 287, 2)]),
    (
        "Apakah berhenti sebentar pada tempat yang dilarang parkir melanggar aturan?",
        [(106, 106, 4), (287, 287, 3)],
    ),
    (
        "Pada situasi macet, apakah boleh menggunakan bahu jalan?",
        [(108, 108, None), (287, 287, None)],
    ),
    (
        "Bagaimana aturan tentang motor yang menaiki trotoar?",
        [(45, 45, None), (106, 106, None), (284, 284, None)],
    ),
    ("Apakah trotoar boleh dijadikan tempat parkir?", [(43, 43, None), (45, 45, None)]),
    ("Apakah menyalip secara zigzag melanggar aturan?", [(106, 106, 4), (109, 112, None)]),
    ("Apakah pinggir jalan boleh dijadikan tempat parkir?", [(43, 43, None), (287, 287, None)]),
]
