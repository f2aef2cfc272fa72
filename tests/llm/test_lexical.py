import random
import re
from collections import Counter
from math import floor, log

from martmend.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Brute force: {(item_id, text): [(doc_id, score)]}."""
    split = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n, length = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(x for _, t in split for x in set(t))
    out = {}
    for item, text in set(items):
        scored = []
        for d, t in split:
            tf, score = Counter(t), 0
            for x in TERM.findall((text or "").translate(LOWER)):
                if tf[x]:
                    m = 100 - 75 + (75 * len(t) * n) // length
                    score += floor(1000 * log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out[item, text] = [(None if none else d, -s) for s, none, d in sorted(scored)[:k]]
    return out


def test_search_with_odd_rows_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)] + ["Ünï", "éa", "a-b", "İx", "K"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 30)))) for i in range(150)]
    docs += [(i, docs[i % 7][1]) for i in range(200, 230)] + [docs[3], docs[3], (None, docs[5][1]), (900, None), (901, ""), (902, "--- ..."), (903, "w1 " * 60_000)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(30)] + [(3, "w1 w1 W2"), (3, "w1 w1 W2"), (40, None), (41, ""), (42, "nowhere"), (None, "w4")]
    expected = sorted((str(i), r, str(d), s) for (i, _), best in plain(docs, items).items() for r, (d, s) in enumerate(best, 1))
    frames = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int"), spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, score int")
    for most in (lexical.POSTINGS, 40):
        found = lexical.search(*frames, most=most)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in found.collect()) == expected
    assert lexical.search(frames[0].limit(0), frames[1]).count() == 0 and lexical.search(frames[0], frames[1].limit(0)).count() == 0


def test_slices_are_bounded(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i))) for i in range(60)], "item_id long, text string")
    dealt, n = lexical.slices(lexical.postings(items), 100)
    sizes = dealt.groupBy("slice").count().collect()
    assert n > 1 and max(r["count"] for r in sizes) <= 100 and sum(r["count"] for r in sizes) == sum(range(60))


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{path}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    expected = sorted((i, r, d, s) for (i, _), best in plain(docs, items).items() for r, (d, s) in enumerate(best, 1))
    assert sorted(map(tuple, queries.op12_lexical(spark, path).collect())) == expected
