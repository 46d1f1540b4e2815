import gzip
import hashlib
from pathlib import Path

import pytest

from driftledger.llm import warc
from driftledger.llm.storage import new_path, open_filesystem

PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (6, "http://e\r\nEvil: 1", "é" * 80), (7, "http://f", "é" * 80), (None, "http://g", "x" * 200)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", __import__("pyspark").sql.functions.lit("clash"))
    folder = new_path(spark, "test-warc")
    warc.write_archives(pages, folder, archive_bytes=300)
    found = {r.page_id: r for r in warc.read_archives(spark, folder, with_payload=True).collect()}
    assert len(found) == len(PAGES) and all(r.kind == "record" for r in found.values())
    for page_id, _, html in PAGES:
        raw, r = (html or "").encode(), found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {k: r.refers_to for k, r in found.items() if r.record_type == "revisit"} == {2: 1, 7: 6, None: 1}


def test_no_pages(spark):
    folder = new_path(spark, "test-warc")
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder) == 0
    assert warc.read_archives(spark, folder).count() == 0


def parts(n=5):
    return [warc.record(k, f"http://{k}", f"payload {k} ".encode() * 20) for k in range(n)]


def pages_of(found):
    return [warc._page(x.fields["warc-record-id"]) for x in found if x.kind == "record"]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_in_the_middle(packed):
    raw = [gzip.compress(p, mtime=0) if packed else p for p in parts()]
    broken = bytearray(raw[2])
    broken[-30] ^= 0xFF  # in the payload, which the digests cover
    data = b"".join([*raw[:2], bytes(broken), *raw[3:]])
    found = list(warc.salvage(data))
    assert pages_of(found) == [0, 1, 3, 4]
    (gap,) = [x for x in found if x.kind == "gap"]
    assert (gap.start, gap.end) == (sum(map(len, raw[:2])), sum(map(len, raw[:3]))) and gap.reason


def test_truncation_garbage_and_mixed_packing():
    raw = [gzip.compress(p, mtime=0) for p in parts()]
    data = b"junk\x1f\x8b\x08junk" + raw[0] + b"\x00" * 9 + parts()[1] + raw[2] + raw[3][:-5]
    found = list(warc.salvage(data))
    assert pages_of(found) == [0, 1, 2, 3] and found[-1].reason == "damaged member: truncated member"  # the last one's digest agrees
    covered = sorted({(x.start, x.end) for x in found})
    assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))


def test_several_records_in_a_member():
    first, second, third = parts(3)
    data = gzip.compress(first + second.replace(b"payload 1", b"payl0ad 1", 1) + third, mtime=0)
    found = list(warc.salvage(data))
    assert pages_of(found) == [0, 2] and [x.reason for x in found if x.kind == "gap"] == ["block digest differs"]


def test_read_logs_gaps(spark):
    folder = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").coalesce(1), folder)
    path = max(Path(open_filesystem(folder)[1]).glob("*.warc.gz"), key=lambda p: p.stat().st_size)
    path.write_bytes(path.read_bytes() + b"trailing noise")
    gaps = warc.read_archives(spark, folder).where("kind = 'gap'").collect()
    assert len(gaps) == 1 and gaps[0].archive == path.name and gaps[0].end - gaps[0].start == 14


@pytest.mark.parametrize("cut", [4, 60, 300])
def test_records_before_the_fault_of_a_member_are_kept(cut):
    import random

    r = random.Random(3)
    records = [warc.record(k, f"http://{k}", r.randbytes(400)) for k in range(5)]
    whole = gzip.compress(b"".join(records), mtime=0)
    found = list(warc.salvage(whole[:-cut] + gzip.compress(records[0], mtime=0)))
    assert pages_of(found)[:4] == [0, 1, 2, 3] and pages_of(found)[-1] == 0
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0x10  # stored bytes: only the digest of one record and the member's sum differ
    found = list(warc.salvage(bytes(flipped)))
    assert len(pages_of(found)) == 4 and any(x.kind == "gap" for x in found)


def test_records_without_a_digest_do_not_count_in_a_damaged_member():
    import re

    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", parts(1)[0])
    whole = gzip.compress(bare, mtime=0)
    assert pages_of(warc.salvage(whole)) == [0] and pages_of(warc.salvage(whole[:-6])) == []


def test_heavy_damage_takes_linear_time():
    import time

    record, began = parts(1)[0], time.perf_counter()
    data = b"".join(b"WARC/1.1\r\nbroken\r\n\r\n" + bytes(20) for _ in range(40_000)) + record
    assert pages_of(warc.salvage(data)) == [0] and time.perf_counter() - began < 30


def test_the_query_on_damaged_archives(spark):
    """What is damaged is logged and missing, everything else is as the undamaged archives have it."""
    import random

    from driftledger.llm.queries import table

    r, folder = random.Random(8), new_path(spark, "test-warc")
    warc.write_archives(table(spark, "/root/testdata/sf0.001", "pages"), folder, archive_bytes=40_000)
    whole = {x.page_id: x for x in warc.read_archives(spark, folder).collect()}
    hurt = {}
    for path in sorted(Path(open_filesystem(folder)[1]).glob("*.warc.gz")):
        raw = bytearray(path.read_bytes())
        starts = sorted({x.start for x in warc.salvage(bytes(raw))})
        for k in r.sample(range(len(starts)), len(starts) // 10):
            raw[starts[k] + 40] ^= 0xFF
            hurt.setdefault(path.name, set()).add(starts[k])
        path.write_bytes(bytes(raw))
    found = warc.read_archives(spark, folder).collect()
    gaps = {}
    for x in found:
        if x.kind == "gap":
            gaps.setdefault(x.archive, set()).add(x.start)
    assert gaps == hurt
    left = {x.page_id: x for x in found if x.kind == "record"}
    want = {k: x for k, x in whole.items() if x.start not in hurt.get(x.archive, ())}
    assert left == want and 0 < len(left) < len(whole)


def test_repeated_payloads_dealt_by_digest_give_the_same(spark):
    pages, found = spark.createDataFrame(PAGES, "page_id long, url string, html string"), []
    for most in (0, 8 << 20):
        folder = new_path(spark, "test-warc")
        warc.write_archives(pages, folder, most_bytes=most)
        found.append(sorted(((x.page_id, x.record_type, x.refers_to, x.payload_digest) for x in warc.read_archives(spark, folder).collect()), key=repr))
    assert found[0] == found[1]


def test_a_very_long_page(spark):
    html = "<p>\u4e2d long page</p>" * 200_000
    pages = spark.createDataFrame([(1, "http://a", html), (2, "http://b", html), (3, "http://c", "x")], "page_id long, url string, html string")
    folder = new_path(spark, "test-warc")
    warc.write_archives(pages, folder)
    found = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    raw = html.encode()
    assert (found[1].payload_bytes, found[1].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest()) and found[2].refers_to == 1
