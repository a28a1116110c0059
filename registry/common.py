"""Inputs shared by the registered queries and SQL fragments shared by their oracles."""

from pyspark.sql import functions as F

from lexiframe.functions import fixed
from lexiframe.functions.text import WHITESPACE
from lexiframe.operators.chunks import hash_embed, to_chunks
from lexiframe.session import scratch_path
from lexiframe.sources.index import bootstrap_index, read_index
from lexiframe.sources.tables import read_table, spread


def table(spark, folder, name):
    return spread(read_table(spark, folder, name))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_WS = quoted(WHITESPACE)
SQL_BREAK = r"'\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
SQL_SPACE = (
    r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"
)


def sql_lines(column: str) -> str:
    """List of stripped, non-blank lines."""
    return (
        f"list_filter(list_transform(string_split_regex({column}, {SQL_BREAK}),"
        f" lambda x: trim(x, {SQL_WS})), lambda x: x <> '')"
    )


def sql_words(column: str) -> str:
    return f"list_filter(string_split_regex({column}, {SQL_SPACE}), lambda x: x <> '')"


def sql_strip(column: str) -> str:
    return f"trim({column}, {SQL_WS})"


def document_segments(spark, folder):
    """Documents as segments: article = doc_id, paragraph 1 for odd ids, none for even ones."""
    docs = table(spark, folder, "documents")
    even = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("doc_id").alias("article_number"),
        F.when(~even, F.lit(1).cast("bigint")).alias("paragraph_number"),
        F.when(even, fixed.BODY).otherwise(fixed.ELUCIDATION).alias("chunk_type"),
        "text",
    )


def document_chunks(spark, folder):
    """Chunk index of all documents: embedded once, written, read back."""
    path = scratch_path(spark, "chunks")
    bootstrap_index(hash_embed(to_chunks(document_segments(spark, folder))), path)
    return read_index(spark, path)


CHUNKS_SQL = f"""
    SELECT 'art' || doc_id || CASE WHEN doc_id % 2 = 1 THEN '_p1' ELSE '' END || '_' ||
             CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'elucidation' END AS chunk_id,
           '{fixed.STATUTE_SOURCE}' AS source,
           doc_id AS article_number,
           CASE WHEN doc_id % 2 = 1 THEN 1 END AS paragraph_number,
           CASE WHEN doc_id % 2 = 0 THEN 'body' ELSE 'elucidation' END AS chunk_type,
           text
    FROM documents
"""


def sql_embeddings(name: str, source: str, key: str, text: str) -> str:
    """CTEs giving ``name(key, embedding)``: hashed token counts of unit length."""
    return f"""
    {name}_tokens AS (
        SELECT {key}, unnest({sql_words(f"lower({text})")}) AS w FROM {source}),
    {name}_counts AS (
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS b, count(*) AS n
        FROM {name}_tokens GROUP BY ALL),
    {name}_norms AS (
        SELECT {key}, sqrt(sum(n * n)) AS norm, map_from_entries(list((b, n))) AS m
        FROM {name}_counts GROUP BY ALL),
    {name} AS (
        SELECT s.{key}, list_transform(range(64),
                 lambda b: (coalesce(m[b], 0) / coalesce(norm, 1.0))::FLOAT)::DOUBLE[] AS embedding
        FROM (SELECT DISTINCT {key} FROM {source}) s LEFT JOIN {name}_norms USING ({key}))"""


def sql_cosine(a: str, b: str) -> str:
    """Cosine rounded to 9 decimals; 0 for a zero vector."""
    dot = f"list_dot_product({a}, {b})"
    lengths = f"sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"
    return f"round(CASE WHEN {lengths} > 0 THEN {dot} / {lengths} ELSE 0 END, 9)"


def user_questions(spark, folder):
    """User messages of all conversations as questions."""
    return (
        table(spark, folder, "conversations")
        .where("role = 'user'")
        .select(
            F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("query_id"),
            "conv_id",
            "turn",
            F.col("text").alias("message"),
        )
    )


QUESTIONS_SQL = """
    SELECT conv_id || '-' || turn AS query_id, conv_id, turn, text AS message
    FROM conversations WHERE role = 'user'
"""
