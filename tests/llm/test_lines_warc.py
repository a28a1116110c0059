"""Line dedup and WARC archives on small tables."""

import base64
import gzip
import hashlib

import pytest

from lexiframe.llm import line_dedup, warc

PAGES = "page_id long, url string, html string"


def page(i, host, *lines):
    return (i, f"http://{host}/p{i}", "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>")


def test_boilerplate_goes_on_its_host_only(spark):
    pages = [page(i, "A.example", f"own {i}", "footer", "shared") for i in range(6)]
    pages += [page(10 + i, "b.example", f"text {i}", "footer" if i == 0 else f"end {i}") for i in range(6)]
    got = {r["page_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(pages, PAGES)).collect()}
    assert got[0]["host"] == "a.example"
    assert got[3]["text"] == "own 3" and got[3]["n_dropped"] == 2 and got[3]["n_lines"] == 3
    assert got[10]["text"] == "text 0\nfooter"


def test_ratio_and_least_pages(spark):
    pages = [page(i, "h", f"own {i}", *(["some"] if i < 3 else [])) for i in range(10)]
    pages += [page(100, "lonely", "only line"), page(101, "pair", "x"), page(102, "pair", "x")]
    df = spark.createDataFrame(pages, PAGES)
    at = {r["page_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df, max_ratio=0.3).collect()}
    assert at[0] == 0 and at[100] == 0 and at[101] == 0  # 3 of 10 is not above 0.3; two pages are too few
    at = {r["page_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(df, max_ratio=0.29).collect()}
    assert at[0] == 1 and at[5] == 0


def test_odd_pages(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    pages = [
        (1, None, "<p>a</p>"),
        (2, "no address", None),
        (3, "http://u@H.Example:80/x?y#z", "<script>var a='<p>no</p>'</script><b>in</b>line<br>next"),
        (3, "http://h.example/", ""),
        (None, "http://h.example/", long),
        (5, "http://h.example/", "same<br>same<br>same"),
    ]
    df = spark.createDataFrame(pages, PAGES).selectExpr("*", "'clash' as lines", "1 as host", "2 as drop")
    rows = line_dedup.dedup_lines(df).collect()
    assert len(rows) == 6
    by = {(r["page_id"], r["host"]): r for r in rows}
    assert by[1, ""]["text"] == "a" and by[2, ""]["n_lines"] == 0 and by[2, ""]["text"] == ""
    assert {r["text"] for r in rows if r["page_id"] == 3} == {"inline\nnext", ""}
    assert by[None, "h.example"]["text"] == ("word " * 50_000).strip()
    assert by[5, "h.example"]["n_lines"] == 3
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []


def round_trip(spark, rows, path, **parameters):
    warc.write_archives(spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest"), path, **parameters)
    return warc.page_captures(warc.assemble(warc.read_records(spark, path, keep_payload=False))).collect()


def test_pages_come_back(spark, tmp_path):
    rows = [
        (5, "http://a/x y", "same ä\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
        (2, "http://a/1", "same ä\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
        (9, None, None),
        (7, "", ""),
        (-3, "http://b/\r\nX: y", "<p>" * 100_000),
        (11, "http://c/", "\r\n\r\n"),
        (12, "http://c/", "once"),
        (12, "http://c/", "once"),
        (None, "http://d/", "nobody's"),
    ]
    got = round_trip(spark, rows, str(tmp_path / "w"))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        for r in by[page_id]:
            assert r["payload_bytes"] == len(payload)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = {i: [(r["record_type"], r["refers_to"]) for r in rs] for i, rs in by.items()}
    assert kind[2] == [("response", None)] and kind[5] == [("revisit", 2)]
    assert kind[7] == [("response", None)] and kind[9] == [("revisit", 7)]
    assert kind[12] == [("response", None)] * 2
    assert kind[-3] == [("response", None)] and kind[None] == [("response", None)]


def test_small_payloads_can_be_kept_out_of_revisits(spark, tmp_path):
    rows = [(1, "http://a", "tiny"), (2, "http://a", "tiny"), (3, "http://a", "x" * 50), (4, "http://a", "x" * 50)]
    got = {r["page_id"]: r["record_type"] for r in round_trip(spark, rows, str(tmp_path / "w"), min_bytes=10)}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], PAGES)
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.page_captures(warc.assemble(warc.read_records(spark, str(tmp_path / "w")))).collect() == []


def test_archives_are_valid_records(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "http://a/b?c", "hello")], PAGES).coalesce(1), str(tmp_path / "w"))
    (name,) = (tmp_path / "w").glob("*.gz")
    data = gzip.open(name).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and data.endswith(b"\r\n\r\n")
    records = list(warc._records(data, True))
    assert [r["type"] for r in records] == ["request", "response", "metadata"]
    assert records[1]["payload"] == b"hello"
    assert b"GET /b?c HTTP/1.1\r\nHost: a\r\n" in data


@pytest.mark.parametrize("reverse", [False, True])
def test_assembly_follows_either_side(spark, tmp_path, reverse):
    """Requests and metadata that name the response, or a response that names its request."""

    def record(kind, name, concurrent, block):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n"
        head += f"WARC-Concurrent-To: <{concurrent}>\r\n" if concurrent else ""
        head += "Content-Type: application/warc-fields\r\n" if kind == "metadata" else ""
        return gzip.compress((head + f"Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n").encode())

    members = [
        record("warcinfo", "info", None, "software: x\r\n"),
        record("request", "q1", None if reverse else "r1", "GET / HTTP/1.1\r\n\r\n"),
        record("response", "r1", "q1" if reverse else None, "HTTP/1.1 200 OK\r\n\r\nbody"),
        record("metadata", "m1", "q1" if reverse else "r1", "via: somewhere\r\n"),
        record("request", "q2", "lost", "GET / HTTP/1.1\r\n\r\n"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    records = warc.read_records(spark, str(tmp_path)).where("type <> 'warcinfo'")
    rows = {r["capture"]: r for r in warc.assemble(records).collect()}
    assert set(rows) == {"<r1>", "<lost>"}
    full = rows["<r1>"]
    assert bytes(full["response"]["payload"]) == b"body" and full["request"]["record_id"] == "<q1>"
    assert full["metadata"]["fields"] == {"via": "somewhere"} and full["copies"] == 1
    assert rows["<lost>"]["response"] is None and rows["<lost>"]["request"]["record_id"] == "<q2>"
