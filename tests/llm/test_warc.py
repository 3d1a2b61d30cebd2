"""Archives: what is written comes back; damage is found."""

import io
import struct

import pytest
import zstandard

from windspan.llm import warc
from windspan.session import new_table_dir

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/", "<p>same</p>"),
    (2, "http://b.example/ x\r\ny", "<p>same</p>"),
    (3, None, "<p>other é</p>"),
    (4, "http://c.example/", None),
    (5, "http://d.example/", ""),
    (6, "http://e.example/", "<p>" + "long " * 200_000 + "</p>"),
    (7, "http://f.example/", "repeated row"),
    (7, "http://f.example/", "repeated row"),
    (None, "http://g.example/", "<p>other é</p>"),
    (None, "http://h.example/", "nameless"),
    (None, "http://h.example/", "nameless"),
]


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        largest = max(same, default=None)
        revisit = len(body) >= least and page_id != largest
        out.append(
            (
                page_id,
                len(body),
                warc.base32_sha1(body),
                "revisit" if revisit else "response",
                largest if revisit else None,
            )
        )
    return sorted(out, key=str)


def digest(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' as payload", "1 as length")
    assert digest(warc.round_trip(spark, pages, least)) == expected(ROWS, least)


def test_payloads(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = warc.write_archives(pages, new_table_dir(spark, "warc"))
    found = warc.read_archives(made).filter("record_type = 'response'")
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in found.collect():
        assert bytes(r.payload) == html[r.page_id]
    assert made.agg({"records": "sum"}).first()[0] == pages.count()


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def archive(n=300, dictionary=True):
    """Records, and the bytes of their archive."""
    records = []
    for i in range(n):
        body = b"<html>page %d %s</html>" % (i, b"text " * 40)
        row = {"page_id": i, "url": "http://x/", "payload": body, "length": len(body)}
        records.append(warc.record_bytes(row | {"digest": warc.base32_sha1(body)}))
    held = warc.train(records) if dictionary else None
    packer = zstandard.ZstdCompressor(dict_data=held)
    head = b""
    if held is not None:
        head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held.as_bytes()
    return records, head, [packer.compress(r) for r in records], held


def test_frames_with_and_without_dictionary():
    for dictionary in (True, False):
        records, head, parts, _ = archive(dictionary=dictionary)
        assert bool(head) == dictionary
        assert list(warc.frames(io.BytesIO(head + b"".join(parts)).read)) == records


def test_compressed_dictionary_and_other_skippable_frames():
    records, _, parts, held = archive()
    packed = zstandard.compress(held.as_bytes())
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    other = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    data = head + parts[0] + other + b"".join(parts[1:])
    assert list(warc.frames(io.BytesIO(data).read)) == records


@pytest.mark.parametrize("cut", [2, 9, -1])
def test_cut_off(cut):
    _, head, parts, _ = archive()
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(io.BytesIO((head + b"".join(parts))[:cut]).read))


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Type", b"WARC-Tipe"),
        lambda r: r[:-1],
        lambda r: r + b"x",
        lambda r: r.replace(b"text text", b"text tixt"),
        lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1),
        lambda r: r.replace(b"sha1:", b"md5:"),
    ],
)
def test_damaged_record(change):
    record = archive(2, False)[0][0]
    assert warc.parse_record(record)["page_id"] == 0
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(change(record))


def test_damaged_archive_fails_or_is_told(spark, tmp_path):
    _, head, parts, _ = archive()
    (tmp_path / "bad.warc.zst").write_bytes(head + b"".join(parts[:5]) + b"nonsense")
    paths = spark.createDataFrame([(str(tmp_path / "bad.warc.zst"),)], "path string")
    found = warc.read_archives(paths, strict=False).collect()
    assert len(found) == 6 and [r.problem for r in found if r.problem]
    with pytest.raises(Exception, match="bad.warc.zst, record 5"):
        warc.read_archives(paths).collect()
