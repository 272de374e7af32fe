from __future__ import annotations

import pytest

from meshwork.llm.warc import archive_round_trip, chunked, digest_of, members, parse, read_archives, reassemble, record, unchunked, write_archives


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n", "'x' AS hex", "2 AS first")


def test_round_trip(spark):
    big = "<p>é🙂" * 30000
    rows = [(3, "http://a/", "same"), (1, "http://b/\r\nX: y", "same"), (2, None, None), (7, "u", ""), (5, "u", big), (6, "u", big), (8, "u", "x" * 9000), (None, "u", "same"), (9, "u", "a\r\n\r\nb")]
    got = {r.page_id: r for r in archive_round_trip(pages_of(spark, rows), segment_bytes=5000, chunk_bytes=1000, file_bytes=20000).collect()}
    assert len(got) == len(rows) and all(r.error is None for r in got.values())
    for i, _, html in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((html or "").encode()), digest_of((html or "").encode()))
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 7: ("revisit", 2), 5: ("response", None), 6: ("revisit", 5), 8: ("response", None), 9: ("response", None)}


@pytest.mark.parametrize("copies", [100_000, 2])
def test_string_ids_and_hot_payloads(spark, copies):
    """Ids with any signs come back; the copies of a payload are dealt to several tasks."""
    ids = ["a:b", "null", "", "n", "v:x", "%3A", "a b>", "ü", None]
    rows = spark.createDataFrame([(i, "u", "same") for i in ids] + [("z", "u", "other")], "page_id string, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in archive_round_trip(rows, copies=copies).collect())
    assert got == sorted([(str(i), "response" if i == "" else "revisit", "None" if i == "" else "") for i in ids] + [("z", "response", "None")])


def test_least_size_repeats_and_empty(spark):
    rows = [(1, "u", "short"), (2, "u", "short"), (3, "u", "long" * 10), (4, "u", "long" * 10), (4, "u", "long" * 10), (None, "u", "only"), (None, "u", "only")]
    got = sorted((str(r.page_id), r.record_type) for r in archive_round_trip(pages_of(spark, rows), min_revisit_bytes=20).collect())
    assert got == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit"), ("4", "revisit"), ("None", "response"), ("None", "response")]
    same = archive_round_trip(pages_of(spark, rows[-2:])).collect()
    assert [r.record_type for r in same] == ["response", "response"]
    assert archive_round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_manifest(spark, tmp_path):
    manifest = write_archives(pages_of(spark, [(i, "u", f"page {i}" * 50) for i in range(40)]).select("page_id", "url", "html"), f"file://{tmp_path}/w", segment_bytes=200, file_bytes=2000)
    assert manifest.count() > 1 and read_archives(manifest).where("error IS NULL").count() == 40


def test_framing():
    for text in (b"", b"a", b"abc" * 1000):
        assert unchunked(chunked(text, 7)) == text
    assert unchunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            unchunked(bad)


def test_reassembly_errors():
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    part = lambda k, data, total=None: {"page_id": "1", "record_id": "<o>", "type": "response" if k == 1 else "continuation", "refers_to": None, "payload_digest": digest_of(b"hello") if k == 1 else None, "segment": k, "total": total, "block": data}
    whole = [part(3, block[20:], len(block)), part(1, block[:10]), part(2, block[10:20])]
    assert reassemble(whole)["error"] is None and reassemble(whole)["payload_bytes"] == 5
    assert "missing" in reassemble(whole[:2])["error"]
    assert "total" in reassemble([part(1, block[:10]), part(2, block[10:], 99)])["error"]
    assert "missing" in reassemble([part(2, block[10:], 5)])["error"]


def test_members():
    import io

    raw = record([("WARC-Type", "x")], b"one") + record([("WARC-Type", "y")], b"two")
    assert [parse(m)[1] for m in members(io.BytesIO(raw), 7)] == [b"one", b"two"]
