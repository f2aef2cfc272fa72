"""Operators 2, 3, 8 and 10 against plain versions."""

import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from martmend.llm import bpe, graph, langid, mixing, ngram, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path(queries.RANKS))


def test_bpe_equals_tiktoken(spark, ranks, monkeypatch):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "  a 　b\n\n c \x1c\x85", "it's I'll we'd 'S", "日本語 テスト 🙂🙂 é́", "a" * 5000, "ab" * 3000 + " x", "!" * 700, "<|endoftext|>", "ÿ" * 60, "=" * 96, "aaaa aaaaa aaaaaa"]
    texts += ["".join(rng.choice("abcdeth  '.,!12éß\n日") for _ in range(rng.randrange(80))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("codes_", F.lit(1)).withColumn("IDS", F.lit(2))
    got = bpe.encode(df, ranks, public_tokenizers.PATTERN).withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert list(r.ids) == plain.encode_ordinary(text), text[:40]
        assert bytes(r.back) == text.encode()
        assert r.codes_ == 1
    assert bpe.encode(df.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_small_batches_and_new_dictionaries(spark, ranks, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_WORDS", 50)
    monkeypatch.setattr(bpe, "BOOK_WORDS", 100)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect():
        assert list(r.ids) == plain.encode_ordinary(r.text)


def test_heap_equals_fold(ranks):
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abcehint") for _ in range(rng.randrange(1, 120)))
        assert bpe.heap_ids(word.encode(), ranks) == plain.encode_ordinary(word)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = rng.sample(words, 30)
    rows = [(None, "no id"), (900, None), (901, ""), (902, " \t"), (903, "A b c"), (904, "a B c"), (905, "one"), (906, "one"), (906, "one")]
    base = [rng.sample(words, 60) for _ in range(12)]
    for i in range(260):
        own = list(base[i % 12]) if i % 3 else rng.sample(words, rng.randrange(1, 60)) + passage
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r for r in ngram.join(spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(0)).withColumn("n", F.lit(0))).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    for i in names:
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), root(i)), i
    assert got[None].component_id is None
    empty = ngram.join(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def family(rng, words, n, low, high):
    base = rng.sample(words, 80)
    out = []
    for _ in range(n):
        own = list(base)
        for j in rng.sample(range(80), rng.randrange(low, high)):
            own[j] = rng.choice(words)
        out.append(" ".join(own))
    return out


def test_opened_groups_carry_the_links_that_minima_miss(spark, monkeypatch):
    """With a single minimum few sets meet their like at once; the token unions must find the rest, and the result stays exact."""
    monkeypatch.setattr(ngram, "MINIMA", 1)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for _ in range(8) for t in family(rng, words, 14, 1, 4)] + family(rng, words, 30, 2, 5)
    made: dict[str, set] = {"first": set(), "opened": set(), "asked": set()}
    met, opened, compare = ngram.open_met, ngram.open_groups, ngram.compare

    def first(pairs, *rest):
        out = ngram.cut(compare(pairs, *rest), "seen")
        made["first"] |= {(r.a, r.b) for r in out.collect()}
        return out

    def through(function):
        def call(near, *rest, **names):
            monkeypatch.setattr(ngram, "compare", compare)
            out = ngram.cut(function(near, *rest, **names), "seen")
            made["asked"] |= {(r.ga, r.gb) for r in near.select("ga", "gb").collect()}
            made["opened"] |= {(r.a, r.b) for r in out.collect()}
            return out

        return call

    monkeypatch.setattr(ngram, "compare", first)
    monkeypatch.setattr(ngram, "open_met", through(met))
    monkeypatch.setattr(ngram, "open_groups", through(opened))
    got = {r.doc_id: r.component_id for r in ngram.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(texts)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                ra, rb = sorted((root(x), root(y)))
                parent[rb] = ra
    assert got == {i: root(i) for i in range(len(texts))}
    print({k: len(v) for k, v in made.items()})
    assert len(made["opened"]) > 2 * len(made["first"]) and not made["opened"] & made["first"]


def test_unions_bound_overlaps(spark):
    tokens = spark.createDataFrame([(1, t) for t in range(10)] + [(2, t) for t in range(5, 15)] + [(3, t) for t in range(8)] + [(9, t) for t in range(90, 99)], "sid long, token long")
    inside = spark.createDataFrame([(2, 2, 10), (3, 2, 8), (9, 9, 9)], "b long, gb long, nb int")
    queries_ = spark.createDataFrame([(1, 10, 2), (1, 10, 9)], "a long, na int, gb long")
    # 1 has 5 tokens of 2 and 8 of 3: all of its ten are in their union, none in 9.
    assert [(r.a, r.gb) for r in ngram.qualifying(queries_, inside, tokens).collect()] == [(1, 2)]


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent: dict = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for v in parent}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.op8_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and n > 40").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_sizes_and_scores_equal_a_plain_version(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))

    def size(book, text):
        raw = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=3)
        return len(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False, write_checksum=False).compress(text))

    for r in docs.select("text", langid.classify(F.col("text"), model).alias("r")).limit(60).collect():
        text = (r.text or "").lower().encode()
        if any(map(str.isalpha, r.text or "")):
            sizes = sorted((size(b, text) + (size(b[: len(b) // 2], text) + size(b[len(b) // 2 :], text)) / 2, k) for k, b in model.items())
            assert (r.r.lang_pred, r.r.score) == (sizes[0][1], 1 - sizes[0][0] / sizes[1][0])
            assert r.r.rejected == (r.r.score < langid.MARGIN)


def test_language_odd_texts(spark):
    train = spark.createDataFrame([("the and of the house", "en"), ("der die und das haus", "de"), (None, "fr"), ("x", None), ("123", "es")], "text string, lang string")
    model = langid.train(train)
    assert set(model) == {"en", "de"}
    texts = [None, "", "12 !?", "the house and the house", "DAS HAUS UND DIE", "long " * 50000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", langid.classify(F.col("text"), model).alias("r")).orderBy("i").collect()
    assert [r.r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "de"]
    assert [r.r.rejected for r in got[:3]] == [True] * 3
    assert spark.range(1).select(langid.classify(F.lit("a"), {}).alias("r")).first().r.lang_pred == "und"
    assert langid.train(train.limit(0)) == {}


def test_mixing(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "b").alias("source"), F.lit(1).alias("n"), F.lit(2).alias("u_"))
    mixed = mixing.replicate(docs, {"a": 3.0, "b": 0.0}, seed=3, size=2.0)
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"a", None} and 5600 < n["a"] < 6400 and 1800 < n[None] < 2200
    again = mixing.replicate(docs.repartition(7), {"a": 3.0, "b": 0.0}, seed=3, size=2.0)
    assert mixed.exceptAll(again).count() == again.exceptAll(mixed).count() == 0
    counts = mixed.where("source = 'a'").groupBy("doc_id").count().groupBy("count").count().collect()
    share = {r[0]: r[1] / 1000 for r in counts}
    assert abs(share[6] - 0.1606) < 0.05  # Poisson with mean 6
    hot = mixing.replicate(docs.where("doc_id < 8"), {"a": 1.0}, size=40.0)
    assert hot.count() > 200
    assert mixing.replicate(docs.limit(0)).count() == 0
    places = [r.place for r in mixing.shuffled(mixed).select("place").collect()]
    assert places == sorted(places)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(con.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall(), key=repr)
    assert got == want


def test_mixing_draws_the_whole_mean(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    mixed = mixing.replicate(docs, seed=5, size=200.0)
    got = mixed.groupBy("doc_id").count().agg(F.avg("count").alias("mean"), F.var_samp("count").alias("variance")).first()
    assert abs(got["mean"] - 200) < 4 and 140 < got["variance"] < 270  # Poisson with mean 200; deviations 0.7 and 14


def test_op3_query_equals_tiktoken(spark, ranks):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in docs:
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_bpe_list_of_common_words_changes_no_ids(spark, ranks, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    monkeypatch.setattr(bpe, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(bpe, "COMMON_WORDS", 50)
    assert {r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()} == whole


def test_languages_of_long_texts_only_are_learned(spark):
    rng = random.Random(4)
    tongues = {"a": ["tola", "miro", "sena", "kulo"], "b": ["grab", "stum", "flek", "dorn"]}
    rows = [(i, " ".join(rng.choices(tongues[k], k=n)), k, 1) for i in range(40) for k, n in (("a", 30), ("b", 400))]
    df = spark.createDataFrame(rows, "h long, text string, lang string, n int")
    model = langid.train(df, longest=500, per_language=3)
    assert set(model) == {"a", "b"} and 3 * 500 <= len(model["b"]) < 3 * 500 + 2500
    got = df.select("lang", langid.classify(F.col("text"), model).alias("r")).collect()
    assert all(r.lang == r.r.lang_pred for r in got)
    assert langid.train(df.limit(0)) == {}


def test_bpe_plan_has_no_map_of_pairs(spark, ranks):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    assert len(encoded._jdf.queryExecution().toString()) < 20_000


def test_small_batches_share_a_map_of_pairs(spark, ranks, monkeypatch):
    assert bpe.BATCH_BYTES <= 4 << 20
    setting, passed, folded = "spark.sql.execution.arrow.maxBytesPerBatch", [], bpe.folded
    monkeypatch.setattr(bpe, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(bpe, "folded", lambda df, *a: passed.append((df, a)) or folded(df, *a))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"{chr(97 + i % 26)}qzx{chr(97 + i // 26)} some words " * (i % 7) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set(setting, "2000")
    try:
        for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select("doc_id", "ids").collect():
            assert list(r.ids) == plain.encode_ordinary(texts[r.doc_id])
        numbered, (pairs, news, _) = passed[-1]
        given = numbered.select(F.size(news).alias("n"), F.col(pairs).isNotNull().alias("p")).collect()
        assert len(given) == 300 and sum(r.p for r in given) == 1 and all(r.p == (r.n > 0) for r in given)
    finally:
        spark.conf.unset(setting)


def test_bpe_takes_no_column_that_is_not_kept_through_python(spark, ranks):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"some words, {i} of them", "en") for i in range(50)] + [(50, None, None)], "doc_id long, text string, lang string")
    spark.conf.unset(setting)
    got = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    assert got.columns == ["doc_id", "ids"] and int(spark.conf.get(setting)) == bpe.BATCH_BYTES
    steps = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x]
    assert len(steps) == 2 and not any("text" in x or "lang" in x for x in steps)
    whole = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert {r.doc_id: r.ids for r in got.collect()} == whole
    # A smaller setting is left alone.
    spark.conf.set(setting, "1000000")
    bpe.small_batches(spark)
    assert spark.conf.get(setting) == "1000000"
    spark.conf.unset(setting)


def test_mixing_shuffles_no_document_for_the_rates(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(sha2(string(id), 256), 4) as text", "concat('s', id % 3) as source")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(setting)
    spark.conf.set(setting, "64k")
    try:
        plan = mixing.replicate(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, held)
    assert "Exchange hashpartitioning" not in plan
