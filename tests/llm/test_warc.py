"""Archives written and read back against a brute-force plan of the records."""

import base64
import hashlib

from optrail.llm.common import fresh_path
from optrail.llm.warc import coalesce_ranges, read_archives, round_trip, write_archives


def expected(rows):
    first, out = {}, []
    for k, _, h in rows:
        body = (h or "").encode()
        if k is not None:
            first[body] = min(k, first.get(body, k))
    for k, _, h in rows:
        body = (h or "").encode()
        ref = first.get(body)
        ref = None if ref is None or ref == k else ref
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


ROWS = [(3, "u3", "same"), (1, "u1\r\nX: y", "same"), (2, None, "other é\r\n\r\nWARC/1.1"), (4, "u", None), (5, "u", ""), (None, "u", "lonely"), (6, "u", "same"), (2, None, "other é\r\n\r\nWARC/1.1"), (7, "u", "long " * 200_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, digest string")
    got = round_trip(df).collect()
    assert sorted(((r.key, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(ROWS)
    assert all(r.digest_ok is (True if r.record_type == "response" else None) for r in got)
    assert round_trip(df.limit(0)).count() == 0


def test_selected_records_and_payloads(spark):
    rows = [(i, f"u{i}", f"page {i} " * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = fresh_path(spark, "warc")
    index = write_archives(df, root)
    assert index.count() == 300
    chosen = index.where("record_key % 7 = 0")
    got = {r.key: bytes(r.payload).decode() for r in read_archives(chosen, root).collect()}
    assert got == {i: h for i, _, h in rows if i % 7 == 0}
    assert coalesce_ranges(index, most=1 << 30).count() <= 3
    assert 20 < coalesce_ranges(chosen, gap=0).count() <= chosen.count()


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcd"), (4, "", "abcd")], "page_id long, url string, html string")
    got = {r.key: r.record_type for r in round_trip(df, least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
