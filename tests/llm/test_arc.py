import gzip
from datetime import datetime

import pytest

from termforge.llm import arc

PAGE = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"


def archive(version: int, records: list[tuple[str, bytes]], fields: tuple[str, ...] | None = None) -> bytes:
    """An ARC file of (url, body), with header lines of the given fields."""
    fields = fields or (arc.V2 if version == 2 else arc.V1)
    own = {"IP-address": "10.0.0.1", "Archive-date": "20010203040506", "Content-type": "text/html", "Result-code": "200", "Checksum": "abc", "Location": "-", "Offset": "0", "Filename": "f.arc"}

    def record(url: str, body: bytes) -> bytes:
        values = {**own, "URL": url, "Archive-length": str(len(body))}
        return " ".join(values[f] for f in fields).encode() + b"\n" + body + b"\n"

    first = f"{version} 0 someone\n{' '.join(fields)}\n\n".encode()
    return record("filedesc://f.arc", first) + b"".join(record(u, b) for u, b in records)


def test_both_versions_and_named_fields():
    for version, fields in ((1, None), (2, None), (1, ("URL", "Archive-date", "Archive-length"))):
        data = archive(version, [("http://a.example/x y", PAGE), ("dns:a.example", b"10.0.0.1"), ("metadata:a", b"note")], fields)
        if fields:  # a description's own header line always has all fields of its version
            data = archive(version, [])[: archive(version, []).index(b"\n")].rsplit(b" ", 1)[0] + b" " + str(len(f"1 0 someone\n{' '.join(fields)}\n\n")).encode() + data[data.index(b"\n") :]
        found = list(arc.convert("f.arc", data))
        assert [r[13] for r in found] == [None] * 4
        assert [r[3] for r in found] == ["warcinfo", "response", "resource", "metadata" if fields is None else "resource"]
        assert found[0][7] == datetime(2001, 2, 3, 4, 5, 6) and {r[2] for r in found} == {version}
        assert found[1][5] == "http://a.example/x y" and found[1][12] == PAGE and found[1][9] == len(PAGE)
        assert found[1][10] == arc.digest(PAGE) and found[1][11] == arc.digest(b"<p>hi</p>")
        assert [data[r[1] :].split(b" ", 1)[0].split(b":")[0] for r in found] == [b"filedesc", b"http", b"dns", b"metadata"]


def test_lengths_rule_whatever_the_body_holds():
    tricky = b"HTTP/1.1 200 OK\r\n\r\nhttp://b.example 1.1.1.1 20010101000000 text/html 3\nabc\n"
    found = list(arc.convert("f", archive(1, [("http://a.example", tricky), ("http://c.example", PAGE)])))
    assert [r[5] for r in found] == [None, "http://a.example", "http://c.example"]


def test_gzip_members_are_the_same_records():
    data = archive(2, [("http://a.example", PAGE), ("http://b.example", PAGE)])
    cut = data.index(b"http://b.example")
    assert list(arc.convert("f", gzip.compress(data[:cut]) + gzip.compress(data[cut:]))) == list(arc.convert("f", data))


def test_bad_headers_and_lengths_are_errors_and_reading_goes_on():
    data = archive(1, [("http://a.example", PAGE)]) + b"nonsense here\nhttp://b.example 1.1.1.1 20010101000000 text/html 999999\nshort\n" + archive(1, [("http://c.example", PAGE)])
    found = list(arc.convert("f", data))
    assert [r[13] for r in found if r[13]] == ["header", "length", "header"]
    assert [r[5] for r in found if r[3] == "response"] == ["http://a.example", "http://c.example"]
    assert list(arc.convert("f", None)) == [] == list(arc.convert("f", b""))


@pytest.mark.parametrize("digits,expected", [("20010203040506", datetime(2001, 2, 3, 4, 5, 6)), ("2001", datetime(2001, 1, 1)), ("20011399", None), ("x", None), ("200", None), ("", None)])
def test_dates(digits, expected):
    assert arc.parse_date(digits) == expected


def test_identifiers_are_stable_and_distinct():
    ids = {arc.record_id(f, o, "u") for f in "ab" for o in range(50)}
    assert len(ids) == 100 and all(len(i) == 47 for i in ids) and arc.record_id("a", 1, "u") in ids


def test_frames_with_nulls_repeats_extra_columns_and_long_bodies(spark, tmp_path):
    long = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (9 << 20)
    data = archive(1, [("http://a.example", long)] + [("http://b.example", PAGE)] * 2)
    files = spark.createDataFrame([("f", bytearray(data), "e"), ("f", bytearray(data), "e"), (None, bytearray(b""), None), ("n", None, "e")], "path string, content binary, error string")
    found = arc.arc_to_warc(files).drop("block").collect()
    assert len(found) == 8 and len({r["record_id"] for r in found}) == 4 and not any(r["error"] for r in found)
    assert arc.arc_to_warc(files.limit(0)).count() == 0
    (tmp_path / "x.arc").write_bytes(data)
    (tmp_path / "y.arc.gz").write_bytes(gzip.compress(data))
    assert arc.read_arc(spark, str(tmp_path)).count() == 8


def test_a_written_record_reads_back(spark):
    records = arc.arc_to_warc(spark.createDataFrame([("f", bytearray(archive(1, [("http://a.example", PAGE)])))], "path string, content binary"))
    text = bytes(records.where("warc_type = 'response'").select(arc.warc_text(records).alias("w")).first()["w"])
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert fields["WARC-Type"] == "response" and fields["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert rest == PAGE + b"\r\n\r\n" and int(fields["Content-Length"]) == len(PAGE)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, None, "<p>"), (2, "http://a.example", None), (None, "http://a.example", "x")], "page_id bigint, url string, html string")
    found = arc.arc_to_warc(arc.pages_as_arc(pages)).collect()
    assert len(found) == 4 and sum(r["warc_type"] == "response" for r in found if r["warc_type"]) >= 1
