"""Operator 9 against a plain version."""

import hashlib

import regex
import xxhash

from pyspark.sql import functions as F

from martmend.llm import queries, winnow


def test_guarantee_ties_and_odd_texts(spark):
    shared = " ".join(f"w{i}" for i in range(winnow.K + winnow.W - 1))
    texts = [None, "", "...", "one two", "a b c d e f", "x " * 50, f"left {shared} right", f"other {shared} end of text", "字" * 40, "z" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", winnow.marks(F.coalesce("text", F.lit(""))).alias("m"))
    got = {r.doc_id: r for r in docs.select("doc_id", winnow.hashes(F.col("m")).alias("h"), winnow.fingerprint(F.col("m")).alias("f")).collect()}
    assert got[0].f == got[1].f == ""
    assert all(len(got[i].h) == 1 for i in (2, 3))
    assert set(got[6].h) & set(got[7].h)
    assert len(got[5].h) == 1 and [int(x.split(":")[1]) for x in got[5].f.split()][0] == winnow.W - 1  # the rightmost of equal hashes
    assert len(got[9].h) == 1


def test_edited_text_and_neighbours(spark):
    texts = {5: "abcdefgh" * 4, 1: "éa" * 7, 9: "short", 3: None, 7: "the end of it all, twice over"}
    docs = spark.createDataFrame([*texts.items(), (9, "short")], "doc_id long, text string").withColumn("edited", F.lit("clash"))
    got = {r.doc_id: r for r in winnow.with_neighbours(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for i, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        assert got[k].edited == t[: len(t) - half] + nxt[:half]
    assert winnow.with_neighbours(docs.limit(0)).count() == 0
    one = winnow.with_neighbours(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].marks == one[0].next_marks


def test_query(spark):
    got = {r.doc_id: r for r in queries.op9_winnow(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert len(got) == len(docs)
    alike, following = [], []
    for d, nxt in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(d.text) // 2
        edited = d.text[: len(d.text) - half] + nxt.text[:half]
        assert got[d.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d.doc_id].n_chars == len(d.text)
        alike.append(got[d.doc_id].near_edited)
        following.append(got[d.doc_id].near_next)
    assert sum(alike) / len(alike) > 0.2 > 0.05 > sum(following) / len(following)


def plain_marks(text):
    """[(hash, position)] of a text: k-grams hashed one after the other, the least of each window, the rightmost of equal ones."""
    if not text:
        return []
    units = regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]{1,8}", text.lower()) or [text]
    hashes = []
    for i in range(max(1, len(units) - winnow.K + 1)):
        seed = 42
        for u in units[i : i + winnow.K] if len(units) >= winnow.K else units:
            seed = xxhash.xxh64_intdigest(u.encode(), seed=seed)
        signed = seed - 2**64 if seed >= 2**63 else seed
        hashes.append(signed >> winnow.PLACES)
    out = []
    for i in range(max(1, len(hashes) - winnow.W + 1)):
        window = hashes[i : i + winnow.W]
        at = max(j for j, h in enumerate(window) if h == min(window))
        if (mark := (window[at], i + at)) not in out:
            out.append(mark)
    return out


def plain_text(marks):
    return " ".join(f"{h & (1 << 36) - 1:X}:{i}" for h, i in marks)


def test_query_against_a_plain_version(spark):
    got = {r.doc_id: r for r in queries.op9_winnow(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda r: r.doc_id)
    texts = [d.text or "" for d in docs]
    marks = [plain_marks(t) for t in texts]
    for i, d in enumerate(docs):
        nxt, half = (i + 1) % len(docs), len(texts[i]) // 2
        edited = plain_marks(texts[i][: len(texts[i]) - half] + texts[nxt][:half])
        row = got[d.doc_id]
        assert row.fingerprint == plain_text(marks[i]) and row.edited_fingerprint == plain_text(edited)
        for likeness, other in ((row.near_edited, edited), (row.near_next, marks[nxt])):
            a, b = {h for h, _ in marks[i]}, {h for h, _ in other}
            assert abs(likeness - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
