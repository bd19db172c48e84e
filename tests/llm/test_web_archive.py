"""ARC to WARC and back."""

import base64
import gzip
import hashlib
import pathlib

import pytest

from tickerloom.llm import web_archive
from tickerloom.llm.staging import shared_folder

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    out, first = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        key = html or ""
        out.append((page, len(key.encode()), digest(html), "revisit" if key in first else "response", first.get(key)))
        first.setdefault(key, page)
    return sorted(out, key=repr)


def found(df):
    rows = df.collect()
    assert all(r.digest_ok for r in rows)
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=repr)


ODD = [
    (3, "http://a.example/with space x", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "", None), (7, "http://a/", ""), (5, "http://b/\r\nx", "a\r\n\r\nb\n\n"),
    (9, "http://c/é", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (10, "filedesc://x", "http://x 0.0.0.0 20240101000000 text/html 5\nabcde\n"),
    (11, "http://d", "HTTP/1.1 200 OK\r\n\r\nnested"), (12, "http://e", "\n" * 7), (None, "http://f", "<p>one</p>"), (None, "http://f", "alone \x00 é \U0001f600"),
    (13, "http://g", "x" * 3_000_000), (14, "http://g", "line\n" * 300_000), (-4, "http://h", "<p>one</p>"),
]


@pytest.mark.parametrize("parts", [1, 6])
def test_round_trip(spark, parts):
    extra = spark.createDataFrame([(*r, "mine", b"x") for r in ODD], SCHEMA + ", record_id string, block binary").repartition(parts)
    assert found(web_archive.archived(extra)) == expected(ODD)
    assert web_archive.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_small_payloads(spark):
    rows = [(i % 50, f"http://x/{i}", f"page {i % 3}") for i in range(200)]
    got = web_archive.archived(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 200 and sum(r.record_type == "response" for r in got) == 3
    assert {(r.payload_digest, r.refers_to) for r in got if r.refers_to is not None} == {(digest(f"page {k}"), 0) for k in range(3)}
    same = spark.createDataFrame([(1, "u", "same")] * 40, SCHEMA).repartition(8)
    assert sorted(r.record_type for r in web_archive.archived(same).collect()) == ["response"] + ["revisit"] * 39
    small = web_archive.archived(spark.createDataFrame(rows, SCHEMA), least_bytes=7).collect()
    assert {r.record_type for r in small} == {"response"}


def test_archives_are_what_they_say(spark):
    root = f"{shared_folder(spark)}/archives"
    web_archive.write_arc(spark.createDataFrame(ODD, SCHEMA).repartition(4), f"{root}/arc")
    files = sorted(pathlib.Path(f"{root}/arc".removeprefix("file://")).glob("*.gz"))
    heads = {gzip.open(f).read(4000).split(b"\n")[1][:1] for f in files}
    assert heads == {b"1", b"2"}
    arc = {r.page_id: r for r in web_archive.read_arc(spark, f"{root}/arc").collect() if r.page_id is not None}
    assert arc[3].url == "http://a.example/with space x" and arc[1].url == "-" and arc[5].url == "http://b/%0D%0Ax"
    assert arc[3].date == "2024-01-01T00:00:00Z" and arc[13].block.endswith(b"\r\n\r\n" + b"x" * 3_000_000)
    web_archive.convert(spark, f"{root}/arc", f"{root}/warc")
    warc = {r.page_id: r for r in web_archive.read_warc(spark, f"{root}/warc").collect() if r.page_id is not None}
    assert warc[3].record_type == "revisit" and warc[3].refers_to_id == warc[-4].record_id and warc[3].payload == b""
    assert {k: r.record_id for k, r in arc.items()} == {k: r.record_id for k, r in warc.items()}
    assert bytes(warc[9].payload).decode() == ODD[5][2] and warc[9].url == "http://c/é"


def test_foreign_archives(spark, tmp_path):
    """Headers of both versions as other writers have them: content without HTTP, blank lines, short dates, parameters of the version block."""
    one = b"1 0 Some Org\nURL IP-address Archive-date Content-type Archive-length\n"
    two = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n\n"
    v1 = b"filedesc://a.arc 0.0.0.0 19961107 text/plain %d\n" % len(one) + one + b"\ndns:x.example 1.2.3.4 199611 text/dns 5\nx A 1\n\n\n"
    v1 += b"http://x/ 1.2.3.4 19961107123456 text/html 21\nHTTP/1.0 200\r\n\r\n\nab\n\n"
    v2 = b"filedesc://b.arc 0.0.0.0 2001 text/plain 200 - - 0 b.arc %d\n" % len(two) + two
    v2 += b"http://y/ 1.2.3.4 2001 text/html 404 - - 9 b.arc 0\n\n"
    for name, data in (("a", v1), ("b", v2)):
        (tmp_path / f"{name}.arc").write_bytes(data)
    rows = {r.url: r for r in web_archive.read_arc(spark, str(tmp_path)).collect()}
    assert rows["dns:x.example"].date == "1996-11-01T00:00:00Z" and bytes(rows["dns:x.example"].block) == b"x A 1"
    assert bytes(rows["http://x/"].block) == b"HTTP/1.0 200\r\n\r\n\nab\n\n"[:21] and rows["http://y/"].payload_bytes == 0
    web_archive.convert(spark, str(tmp_path), f"{shared_folder(spark)}/foreign")
    kinds = {r.url: (r.record_type, r.digest_ok) for r in web_archive.read_warc(spark, f"{shared_folder(spark)}/foreign").collect()}
    assert kinds["dns:x.example"] == ("resource", True) and kinds["http://x/"] == ("response", True)


@pytest.mark.parametrize("data", [b"no version\n", b"filedesc://a 0 2024 text/plain 4\n3 0\n", b"filedesc://a 0 2024 text/plain 4\n1 0\nhttp://x 0 2024 t 99\nshort\n"])
def test_broken_archives_fail(spark, tmp_path, data):
    (tmp_path / "x.arc").write_bytes(data)
    with pytest.raises(Exception, match="version|ends"):
        web_archive.read_arc(spark, str(tmp_path)).collect()
