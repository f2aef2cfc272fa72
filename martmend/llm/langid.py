"""Language ID by compression (operator 8): each language has a zstandard raw-content dictionary of training text, a text
is compressed with each, and the smallest result names the language. Letters are lower-cased first. As sizes are whole bytes, which
is coarse for a text of a few words, the mean size over the two halves of the dictionary is added to that with the whole.

Training takes ``per_language`` distinct labelled texts of each language, those with the least hashes among texts of at most
``longest`` characters, whole; of a language that has longer ones only, as many of these as have that many characters in all. The
sample is bounded by these documented parameters. Prediction reads every whole text.

Defined results: a null text and a text without letters get ``und``, score 0, rejected; equal sizes go to the language
that comes first by name; the score is 1 - smallest/second smallest (1 with a single language); a text is rejected if
its score is below ``margin``. Repeated rows are judged alike; an empty training set makes everything ``und``; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = 3
#: Relative gap between the two smallest sizes below which a text is rejected.
MARGIN = 0.001


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 400, longest: int = 4000) -> dict[str, bytes]:
    """A dictionary of raw content for each non-null language of df."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("n") <= longest, F.col("h"))).alias("short"), F.approx_count_distinct("h").alias("all")).collect()
    short, other = {r.lang: r.short for r in found if r.short}, {r.lang: r.all for r in found if not r.short}
    chosen = _short(rows.where(F.col("n") <= longest), short, per_language) if short else []
    if other:
        chosen += _long(rows.where(F.col("lang").isin(list(other))), other, per_language, per_language * longest)
    parts: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, r.h)):
        parts.setdefault(r.lang, []).append(r.text.lower().encode())
    return {k: b"\n".join(v) for k, v in sorted(parts.items())}


def _likely(rows: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """The rows with hashes so small that each language has about four times the texts needed, or all."""
    most = F.lit(2.0**63)
    for name, n in counts.items():
        most = F.when(F.col("lang") == name, 2.0**64 * min(1.0, 4 * per_language / max(1, n)) - 2.0**63).otherwise(most)
    return rows.where(F.col("h") <= most)


def _short(rows: DataFrame, counts: dict[str, int], per_language: int) -> list:
    """The texts with the least hashes of each language."""
    few = _likely(rows, counts, per_language).groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    return few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("lang", "h", "text").collect()


def _long(rows: DataFrame, counts: dict[str, int], per_language: int, characters: int) -> list:
    """The texts with the least hashes of each language, up to the one with which they have so many characters. The texts are read
    when their hashes are chosen."""
    order = Window.partitionBy("lang").orderBy("h")
    rows = _likely(rows, counts, per_language)
    least = rows.select("lang", "h", "n").distinct().withColumn("sum", F.sum("n").over(order)).where(F.col("sum") - F.col("n") < characters)
    return rows.join(least.select("lang", "h"), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text")).collect()


def classify(text: Column, model: dict[str, bytes], margin: float = MARGIN) -> Column:
    """Struct of lang_pred, score and rejected for a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        def coder(raw: bytes) -> zstandard.ZstdCompressor:
            book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False, write_checksum=False)

        coders = {lang: coder(raw) for lang, raw in model.items()}
        halves = {lang: [coder(raw[: len(raw) // 2] or raw), coder(raw[len(raw) // 2 :])] for lang, raw in model.items()}
        out = []
        for t in texts:
            if not coders or not isinstance(t, str) or not any(map(str.isalpha, t)):
                out.append(("und", 0.0, True))
                continue
            raw = t.lower().encode()
            sizes = sorted((len(c.compress(raw)) + sum(len(h.compress(raw)) for h in halves[lang]) / 2, lang) for lang, c in coders.items())
            score = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
            out.append((sizes[0][1], score, score < margin))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return judge(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
