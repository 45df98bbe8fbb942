import gzip
import hashlib

from lumenveil.llm import warc as W
from lumenveil.llm._common import fresh_path

BIG = "x" * 150


def archive(spark):
    rows = [(3, "http://a/", BIG), (1, None, BIG), (2, "http://b c\r\n", BIG), (4, "u", "small"), (5, "u", "small"), (6, "v", None), (7, "w", ""), (8, "é", "ÀÉ😀" * 99), (None, "n", BIG), (9, "z", "y" * 5_000_000)]
    path = fresh_path(spark, "warc-test")
    W.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    return rows, path


def test_round_trip(spark):
    rows, path = archive(spark)
    got = {r["record_id"]: r for r in W.read_archive(spark, path).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        r = got[W.record_id(i)]
        data = (html or "").encode()
        revisit = html == BIG and i != 1
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (W.record_id(1) if revisit else None)
        if not revisit:
            assert bytes(r["payload"]) == data and r["computed_digest"] == r["payload_digest"]
        else:
            assert r["payload"] is None
    assert got["urn:page:2"]["target_uri"] == "http://b%20c%0D%0A"


def test_push_down_and_skipping(spark, monkeypatch):
    _, path = archive(spark)
    df = W.read_archive(spark, path, ["record_id", "record_type", "payload"])
    assert df.filter("record_type = 'revisit'").count() == 3
    assert {r["record_id"] for r in df.filter("record_id IN ('urn:page:4', 'urn:page:9') AND length(payload) > 10").collect()} == {"urn:page:9"}
    reader = W.WarcReader(path, ["record_type", "payload"])
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("payload",), b"x")]))
    assert [f.attribute for f in left] == [("payload",)]
    inflated = []
    monkeypatch.setattr(W.WarcReader, "_inflate", staticmethod(lambda *a: inflated.append(a) or (_ for _ in ()).throw(AssertionError("a payload was inflated"))))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3 and not inflated


def test_members_are_plain_gzip_and_foreign_files_are_read(spark, tmp_path):
    data = W.head("response", "urn:page:1", "http://a/", "d", None, 3) + b"abc\r\n\r\n"
    assert gzip.decompress(W.member(data) * 2) == data * 2
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(data) + gzip.compress(data))
    got = W.read_archive(spark, f"file://{tmp_path}").collect()
    assert [bytes(r["payload"]) for r in got] == [b"abc", b"abc"]


def test_empty(spark):
    path = fresh_path(spark, "warc-test")
    W.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert W.read_archive(spark, path, ["record_id"]).count() == 0
