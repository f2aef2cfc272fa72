"""Mixing sources to target weights (operator 10): Poisson replication.

The expected number of copies of a document is its source's target share of the output over its share of the input. The
number itself inverts the Poisson distribution at a uniform number that a hash of seed and document gives, so it is the
same in every run and on every machine; each copy then goes to a place of the global order that a hash of seed,
document and copy number gives. Only counts of sources are gathered; the table of sources is joined by Spark, which
broadcasts it only if it is small.

Defined results: a null source is a source of its own; sources without a target get weight 1 (0 drops a source);
documents are told apart by id and, for repeated or null ids, also by text, so equal rows are replicated alike; an empty
table stays empty; a text of any length is copied whole and only hashed; other columns stay. A mean of ``MOST`` or more is cut into equal parts below it, and the count is the sum of a Poisson number
for each, drawn from a hash of its own, which is Poisson with the whole mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Means below this are inverted at once; the terms hold their distribution to double precision.
MOST, TERMS = 9, 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def poisson_terms(mean: Column) -> Column:
    """P(X = 0), P(X = 1), ... for the mean."""
    return F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)), lambda k: F.exp(-mean) * F.pow(mean, k.cast("double")) / F.get(F.array(*[F.lit(float(math.factorial(i))) for i in range(TERMS)]), k))


def cumulated(terms: Column) -> Column:
    """P(X <= 0), P(X <= 1), ...: sums of the terms, rounded to 15 places."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(terms, start, lambda s, t: F.struct((s["sum"] + t).alias("sum"), F.concat(s["out"], F.array(F.round(s["sum"] + t, 15))).alias("out")))["out"]


def rates(docs: DataFrame, source: str, weights: dict[str, float] | None, size: float = 1.0) -> DataFrame:
    """Source, its mean number of copies, the parts of the mean, and the sums of a part's distribution. size: rows out for each row in."""
    per = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    per = per.withColumn("w", weight)
    total = per.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    unit = float(size * total.n / total.w) if total.w else 0.0
    per = per.withColumn("mean", F.lit(unit) * F.col("w") / F.col("n"))
    parts = F.floor(F.col("mean") / MOST).cast("int") + 1
    return per.select("mix_source", "mean", parts.alias("parts"), cumulated(poisson_terms(F.col("mean") / parts)).alias("sums"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, size: float = 1.0, doc_id: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy_no", place: str = "place") -> DataFrame:
    """docs with each row repeated by its count; copy: its number from 1, place: its place in the global order, in [0, 1)."""
    key = [F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")))]
    per = cut(rates(docs, source, weights, size), "mixing-rates")  # as a table it has a size: Spark shuffles docs for the join only if it is large
    u = free_name(docs, "u_")
    drawn = docs.withColumn(u, uniform(seed, *key)).join(per, F.col(source).eqNullSafe(F.col("mix_source")), "inner")
    more = F.transform(F.sequence(F.lit(2), F.col("parts")), lambda i: uniform(seed, *key, F.concat(F.lit("part "), i.cast("string"))))
    draws = F.when(F.col("parts") == 1, F.array(u)).otherwise(F.concat(F.array(u), more))
    count = F.aggregate(draws, F.lit(0), lambda n, x: n + F.size(F.filter("sums", lambda s: s <= x)))
    out = drawn.where(count > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), count)).alias(copy))
    return out.withColumn(place, uniform(seed + 1, *key, F.col(copy)))


def shuffled(mixed: DataFrame, place: str = "place") -> DataFrame:
    """The global shuffle: rows ordered by place over all partitions."""
    return mixed.repartitionByRange(F.col(place)).sortWithinPartitions(place)
