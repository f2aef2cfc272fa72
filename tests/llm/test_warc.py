"""Operator 1: damaged archives, revisits and round trips."""

import base64
import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

from martmend.llm import queries, warc


def records(n=6):
    return [warc.make_record(f"http://x/{i}", warc.record_id(i, 0), f"payload {i} ".encode() * (1 + 40 * i), None) for i in range(n)]


def ids(data):
    return [x[2]["warc-record-id"] for x in warc.salvage(data) if x[2]]


def gaps(data):
    return [(x[0], x[1], x[4]) for x in warc.salvage(data) if not x[2]]


def test_sound_archives_of_both_kinds():
    for pack in (warc.gzip_member, bytes):
        data = b"".join(map(pack, records()))
        assert ids(data) == [warc.record_id(i, 0) for i in range(6)] and not gaps(data)
    assert list(warc.salvage(b"")) == []


def test_damage_is_skipped_and_logged():
    for pack in (warc.gzip_member, bytes):
        parts = list(map(pack, records()))
        start = sum(map(len, parts[:2]))
        broken = bytearray(b"".join(parts))
        broken[start + len(parts[2]) // 2] ^= 0x55
        assert ids(bytes(broken)) == [warc.record_id(i, 0) for i in (0, 1, 3, 4, 5)]
        ((a, b, _),) = gaps(bytes(broken))
        assert (a, b) == (start, start + len(parts[2]))
        cut = b"".join(parts)[:-9]
        # Without its last bytes a member still holds its record; a plain record is incomplete.
        assert ids(cut) == [warc.record_id(i, 0) for i in range(6 if pack is warc.gzip_member else 5)] and gaps(cut)[-1][1] == len(cut)
        junk = b"\x1f\x8b\x08 no member WARC/1.1 no record " + b"".join(parts)
        assert len(ids(junk)) == 6 and gaps(junk)[0][0] == 0


def test_random_damage_never_loses_sound_neighbours():
    rng = random.Random(7)
    parts = list(map(warc.gzip_member, records(8)))
    for _ in range(60):
        bad = rng.randrange(8)
        at = sum(map(len, parts[:bad])) + rng.randrange(len(parts[bad]))
        data = bytearray(b"".join(parts))
        data[at] ^= 1 << rng.randrange(8)
        got = ids(bytes(data))
        assert [warc.record_id(i, 0) for i in range(8) if i != bad] == [x for x in got if x != warc.record_id(bad, 0)]


def test_revisits_nulls_ties_and_repeats(spark):
    rows = [(1, "http://a", "x"), (5, "http://b\nc", "x"), (3, None, "x"), (3, None, "x"), (7, "u", None), (8, "u", ""), (None, "u", "y"), (9, "u", "z"), (9, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("copy", F.lit("c"))
    got = warc.archived_pages(spark, pages).where("gap_reason is null").select(warc.page_of(F.col("record_id")).alias("p"), "payload_bytes", "payload_digest", "warc_type", warc.page_of(F.col("refers_to_id")).alias("r")).collect()
    table = sorted((str(r.p), r.warc_type, str(r.r)) for r in got)
    assert table == sorted([("1", "revisit", "5"), ("5", "response", "None"), ("3", "revisit", "5"), ("3", "revisit", "5"), ("7", "revisit", "8"), ("8", "response", "None"), ("None", "response", "None"), ("9", "response", "None"), ("9", "revisit", "9")])
    assert {r.payload_digest for r in got if r.p in (1, 3, 5)} == {base64.b32encode(hashlib.sha1(b"x").digest()).decode()}
    assert {r.payload_bytes for r in got if r.p in (7, 8)} == {0}
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0
    assert warc.archived_pages(spark, pages, min_revisit=2).where("warc_type = 'revisit'").count() == 0


def test_whole_payloads_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    back = warc.archived_pages(spark, pages).where("warc_type = 'response'").select(warc.page_of(F.col("record_id")).alias("page_id"), F.col("payload").cast("string").alias("html"))
    assert back.exceptAll(pages.select("page_id", "html")).count() == 0
    assert queries.op1_warc(spark, "/root/testdata/sf0.001").count() == pages.count()


def test_records_after_a_bad_one_in_a_member_are_found():
    parts = records()
    for bad in ({0}, {2}, {0, 1, 4}, {5}):
        for damage in (lambda r: r.replace(b"payload", b"Payload", 1), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 9")):
            content = b"".join(damage(r) if i in bad else r for i, r in enumerate(parts))
            data = warc.gzip_member(content) + warc.gzip_member(warc.make_record("u", "last", b"x", None))
            assert ids(data) == [warc.record_id(i, 0) for i in range(6) if i not in bad] + ["last"]
            lost = [tuple(map(int, x[2].split("bytes ")[1].rstrip(")").split(" to "))) for x in gaps(data)]
            starts = [sum(map(len, parts[:i])) for i in range(7)]
            shift = len(content) - starts[-1]
            assert sum(b - a for a, b in lost) == sum(len(parts[i]) for i in bad) + shift


def test_sound_records_of_a_truncated_member_are_found():
    rng = random.Random(9)
    parts = [warc.make_record("u", warc.record_id(i, 0), bytes(rng.randrange(256) for _ in range(3000)), None) for i in range(6)]
    member, last = warc.gzip_member(b"".join(parts)), warc.gzip_member(warc.make_record("u", "last", b"x", None))
    cut_off = member[: len(member) * 9 // 10]
    assert ids(cut_off) == [warc.record_id(i, 0) for i in range(5)]
    assert [x[:2] for x in gaps(cut_off)] == [(0, len(cut_off))]
    began = time.time()
    assert ids(warc.GZIP * 20_000 + last) == ["last"]
    assert time.time() - began < 10


def random_records(n, size, seed):
    rng = random.Random(seed)
    return [warc.make_record("u", warc.record_id(i, 0), bytes(rng.randrange(256) for _ in range(size)), None) for i in range(n)]


def test_a_truncated_member_before_a_sound_one_keeps_its_records():
    parts, last = random_records(6, 3000, 10), warc.gzip_member(warc.make_record("u", "last", b"x", None))
    member = warc.gzip_member(b"".join(parts))
    cut_off = member[: len(member) * 2 // 3]
    whole = [i for i in range(6) if sum(map(len, parts[: i + 1])) < len(b"".join(parts)) * 2 // 3 - 200]
    assert len(whole) >= 3 and ids(cut_off + last) == [warc.record_id(i, 0) for i in whole] + ["last"]
    assert [x[:2] for x in gaps(cut_off + last)] == [(0, len(cut_off))]
    text = warc.gzip_member(b"".join(records(6)))
    got = ids(text[: len(text) * 9 // 10] + last)
    assert got[-1] == "last" and got[:-1] == [warc.record_id(i, 0) for i in range(len(got) - 1)] and len(got) > 3


def test_stored_blocks_of_a_truncated_member_give_each_record_once():
    parts, last = random_records(4, 2000, 11), warc.gzip_member(warc.make_record("u", "last", b"x", None))
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the records stand in the archive as they are
    member = packer.compress(b"".join(parts)) + packer.flush()
    cut_off = member[: len(member) - len(parts[3]) // 2]
    for data, tail in ((cut_off, []), (cut_off + last, ["last"])):
        assert ids(data) == [warc.record_id(i, 0) for i in range(3)] + tail
        assert [x[:2] for x in gaps(data)] == [(0, len(cut_off))]


def test_digests_prove_records_of_a_member_with_a_wrong_crc():
    parts, last = random_records(3, 1000, 12), warc.gzip_member(warc.make_record("u", "last", b"x", None))
    member = warc.gzip_member(b"".join(parts))
    for damage in (b"\0\0\0\0", bytes(b ^ 0xFF for b in member[-8:-4])):
        data = member[:-8] + damage + member[-4:] + last
        assert ids(data) == [warc.record_id(i, 0) for i in range(3)] + ["last"] and [x[:2] for x in gaps(data)] == [(0, len(member))]
    bad = bytearray(b"".join(parts))
    bad[len(parts[0]) + 500] ^= 1
    crc = warc.gzip_member(b"".join(parts))[-8:-4]
    damaged = warc.gzip_member(bytes(bad))
    assert ids(damaged[:-8] + crc + damaged[-4:]) == [warc.record_id(i, 0) for i in (0, 2)]


def test_version_lines_without_a_blank_line_take_linear_time():
    last = warc.make_record("u", "last", b"x", None)
    for filler in (b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"x WARC/1.1\r\n"):
        for pack in (bytes, warc.gzip_member):
            began = time.time()
            assert ids(pack(filler * 100_000 + b"\r\n" + last)) == ["last"]
            assert ids(pack(filler * 100_000)) == []
            assert time.time() - began < 4
