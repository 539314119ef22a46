import base64
import hashlib
import zlib
from collections import Counter

from tessera.llm import warc as V
from tessera.llm.common import new_path

SCHEMA = "page_id long, url string, html string, digest string, size string"


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw, last = (h or "").encode(), best.get(h or "")
        again = len(raw) >= least and last is not None and (i is None or i < last)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last if again else None))
    return Counter(out)


def trip(spark, rows, least=0, chunk_bytes=1 << 20, file_chunks=32, with_payload=False, compression="gzip"):
    path = new_path(spark, "warc")
    df = spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA).repartition(3)
    V.write_warc(df, path, least_bytes=least, chunk_bytes=chunk_bytes, file_chunks=file_chunks, compression=compression)
    return V.transactions(V.read_records(spark, path, with_payload)), path


ROWS = [(i, f"http://h/{i}", f"<p>{i % 7} é\r\n\r\nWARC/1.1\r\n</p>") for i in range(40)]
ROWS += [(50, None, None), (51, "u", ""), (52, "a\r\nb", "x" * 200_000), (3, ROWS[3][1], ROWS[3][2]), (None, "n", "only here"), (None, "n", ROWS[1][2]), (53, "", "tail\r\n"), (54, "t", "\r\n\r\n"), (60, "u", "twice"), (60, "u", "twice")]


def test_round_trip(spark):
    for least, chunk_bytes, file_chunks, compression in ((0, 1 << 20, 32, "gzip"), (30, 1, 7, None), (30, 2000, 2, "gzip")):
        t, _ = trip(spark, ROWS, least, chunk_bytes, file_chunks, compression=compression)
        got = Counter((x.response.page_id, x.payload_bytes, x.payload_digest, x.response.type, int(x.response.refers_to[5:]) if x.response.refers_to else None) for x in t.collect())
        assert got == brute(ROWS, least)


def test_nested_rows_and_payload(spark):
    t, path = trip(spark, ROWS, with_payload=True)
    rows = t.collect()
    assert len(rows) == len(ROWS) and all(x.request and x.metadata for x in rows)
    assert all(x.metadata.fields == f"page-id: {'' if x.response.page_id is None else x.response.page_id}".strip() for x in rows)
    texts = {(i, h or "") for i, _, h in ROWS}
    assert all((x.response.page_id, x.response.payload) in texts for x in rows if x.response.type == "response")


def test_files(spark):
    """Any reader's view: a gzip member a record, or plain records; bounded files; records of over 16 MB."""
    big = [(70, "u", "0123456789" * 1_700_000), (71, "u", "é" * 9_000_000)]
    for compression in ("gzip", None):
        t, path = trip(spark, ROWS + big, chunk_bytes=3000, file_chunks=4, with_payload=True, compression=compression)
        data = [bytes(x.content) for x in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
        assert sum(len(list(V.parse_warc(V.open_warc(x)))) for x in data) == 3 * len(ROWS + big) and len(data) >= 4
        if compression:
            sizes = []
            for x in data:
                while x:
                    z = zlib.decompressobj(31)
                    record, x = z.decompress(x), z.unused_data
                    assert z.eof and (not record or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n"))
                    sizes.append(len(record))
            assert sum(n > 0 for n in sizes) == 3 * len(ROWS + big) and sizes.count(0) == 2
        assert {x.response.page_id: x.response.payload for x in t.where("response.page_id >= 70").collect()} == {i: h for i, _, h in big}


def test_empty(spark):
    assert trip(spark, [])[0].count() == 0
