"""Personal data by weak supervision (operator 4). DataFrame and SQL functions only.

Base spans come from fixed patterns. Other candidates (national ids, account numbers, local telephone numbers, names) come
from loose patterns. Labelers of three sorts vote on every candidate, base spans among them: form (does it match the strict
form or its check digits), gazetteer (given names, country codes) and context (cue words before it, a text of prose around it).
The votes of the whole table are counted by pattern. On these counts, whose number is fixed by that of labelers and kinds,
expectation-maximisation estimates each labeler's reliability and each pattern's probability; a logistic model of votes and
shape is fitted to those probabilities, and decides on the loose candidates. Base spans always stay.

Positions: regexp_extract_all gives the matches, split by the same pattern the gaps between them; their lengths add up to
the positions. Patterns are written with possessive repeats and look-behinds so that long runs take linear time and no
stack; they match what the plain patterns match.

Defined results: null is the empty text; spans count code points, ends exclusive; an empty table gives an empty model,
under which only base spans are found; loose candidates that overlap a base span are dropped; rows that repeat others are counted
and scanned like them; a long text is scanned whole; other columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
#: The patterns asked for, with a cheap test of whether a text can hold a match at all.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "national": r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local": r"(?<![\w.+(-])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "name": r"(?<!\w)[A-Z][a-z]+ [A-Z][a-z]+(?!\w)",
}
#: Gazetteers and cue words.
GIVEN_NAMES = "Anna Antonio Carlos Carmen Charles Claire Daniel David Elizabeth Emma Francisco Hans Isabel James Jean John Jose Juan Julia Karl Klaus Laura Linda Louis Lucia Maria Marie Mary Michael Michel Patricia Paul Peter Pierre Robert Sarah Sofia Stefan Susan Thomas William"
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR"
CUES = r"(?i)\b(?:account|address|born|call|contact|email|fax|iban|id|mail|mobile|mr|mrs|ms|dr|name|passport|phone|ssn|tel|telephone)\b[^\n]{0,24}$"
LABELERS = ("form", "gazetteer", "context")
AROUND = 40
#: Items of a chunk of a long array.
CHUNK = 64


def chunked(items: Column) -> Column:
    """The array cut into arrays of ``CHUNK`` items."""
    cut_up = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(items) > 0, cut_up).otherwise(F.slice(F.array(items), F.lit(1), F.lit(0)))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of all matches. Places add up within chunks and then over chunks, as adding to a long array copies it."""
    span = "struct<start:int,end:int,found:string>"

    def within(chunk: Column) -> Column:
        def add(state: Column, pair: Column) -> Column:
            begin = state["at"] + pair["gap"]
            end = begin + F.length(pair["found"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("found")))).alias("out"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), add)

    def follow(state: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["found"].alias("found")))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def place(found: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        pairs = F.zip_with(found, gaps, lambda f, g: F.struct(f.alias("found"), g.alias("gap")))
        chunks = let(pairs, lambda p: F.transform(chunked(p), within))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span}>>").alias("out")), follow)["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return let(digits(found), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, found), by kind as in ``KINDS``, then by start."""
    parts = []
    for kind, (pattern, hint) in BASE.items():
        spans = F.filter(located(text, pattern), _passing(kind))
        spans = F.transform(spans, _named(kind))
        parts.append(F.when(text.rlike(hint), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")))
    return F.concat(*parts)


def _passing(kind: str):
    return lambda s: passes(kind, s["found"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))


def loose_spans(text: Column, base: Column) -> Column:
    """Candidates of the loose patterns that overlap no base span."""
    any_of = "|".join(LOOSE.values())

    def kind(found: Column) -> Column:
        named = F.lit("name")
        for k in ("local", "account", "national"):
            form = {"national": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "account": r"^[A-Z]{2}[0-9]{2}", "local": r"^[(0-9]"}[k]
            named = F.when(found.rlike(form), F.lit(k)).otherwise(named)
        return named

    spans = F.transform(located(text, any_of), lambda s: F.struct(kind(s["found"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    def overlap(x: Column, y: Column) -> Column:
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def bounds(chunk: Column) -> Column:
        return F.struct(F.array_min(F.transform(chunk, lambda b: b["start"])).alias("start"), F.array_max(F.transform(chunk, lambda b: b["end"])).alias("end"), chunk.alias("own"))

    # Base spans in order of place, so that a candidate looks into the chunks around it only.
    by_place = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    near = F.transform(let(by_place, chunked), bounds)
    free = let(near, lambda n: F.filter(spans, lambda s: ~F.exists(n, lambda c: overlap(c, s) & F.exists(c["own"], lambda b: overlap(b, s)))))
    return F.when(text.rlike(any_of), free).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>"))


def votes(text: Column, span: Column) -> Column:
    """Text of the span's votes (+ yes, - no, 0 none) in the order of ``LABELERS``, then a shape digit."""
    kind, found = span["kind"], span["found"]
    before = F.substring(text, F.greatest(span["start"] - AROUND, F.lit(0)) + 1, F.least(span["start"], F.lit(AROUND)))
    number = digits(found)
    form = F.when(kind.isin(*KINDS), "+").when(kind == "national", F.when(number.rlike("^(?:000|666|9)|^.{3}00|0000$"), "-").otherwise("+")).when(kind == "local", F.when(number.rlike("^[01]|^.{3}[01]"), "-").otherwise("+")).when(kind == "account", F.when(F.length(found).between(15, 34), "+").otherwise("-")).otherwise("0")
    first = F.substring_index(found, " ", 1)
    gazetteer = F.when(kind == "name", F.when(first.isin(*GIVEN_NAMES.split()), "+").otherwise("-")).when(kind == "account", F.when(F.substring(found, 1, 2).isin(*COUNTRIES.split()), "+").otherwise("-")).otherwise("0")
    context = F.when(before.rlike(CUES), "+").when(kind == "name", "-").otherwise("0")
    shape = F.when(F.length(number) >= F.length(found) * 0.7, "2").when(F.length(number) > 0, "1").otherwise("0")
    return F.concat(kind, F.lit("|"), form, gazetteer, context, shape)


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability of each vote pattern to be personal data, by expectation-maximisation over the counts (Dawid-Skene with two classes)."""
    if not counts:
        return {}
    prior = 0.5
    right = {(j, v): (0.7 if v == "+" else 0.2 if v == "-" else 0.1) for j in range(len(LABELERS)) for v in "+-0"}
    wrong = {(j, v): (0.2 if v == "+" else 0.7 if v == "-" else 0.1) for j in range(len(LABELERS)) for v in "+-0"}
    split = {p: p.partition("|")[2][: len(LABELERS)] for p in counts}
    q: dict[str, float] = {}
    for _ in range(rounds):
        for p, v in split.items():
            a, b = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                a, b = a + math.log(right[j, x]), b + math.log(wrong[j, x])
            q[p] = 1 / (1 + math.exp(min(50.0, max(-50.0, b - a))))
        total = sum(counts.values())
        yes = sum(counts[p] * q[p] for p in counts)
        prior = min(0.95, max(0.05, yes / total))
        for j in range(len(LABELERS)):
            for x in "+-0":
                # Two counts of prior belief that a labeler is better than chance keep the classes from being swapped.
                good, bad = {"+": (1.4, 0.4), "-": (0.4, 1.4), "0": (0.2, 0.2)}[x]
                right[j, x] = (sum(counts[p] * q[p] for p in counts if split[p][j] == x) + good) / (yes + 2)
                wrong[j, x] = (sum(counts[p] * (1 - q[p]) for p in counts if split[p][j] == x) + bad) / (total - yes + 2)
    return q


def _features(pattern: str) -> list[float]:
    v = pattern.partition("|")[2]
    out = [1.0]
    for x in v[: len(LABELERS)]:
        out += [float(x == "+"), float(x == "-")]
    return [*out, float(v[-1] == "2"), float(v[-1] == "1")]


def train(counts: dict[str, int], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of the logistic model fitted to the estimated probabilities of the patterns."""
    q = estimate(counts)
    if not q:
        return []
    total = sum(counts.values())
    rows = [(_features(p), q[p], counts[p] / total) for p in sorted(counts)]
    weights = [0.0] * len(rows[0][0])
    for _ in range(rounds):
        slope = [1e-3 * w for w in weights]
        for x, y, share in rows:
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            gap = share * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - y)
            slope = [s + gap * a for s, a in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def probability(pattern: Column, weights: list[float]) -> Column:
    if not weights:
        return F.lit(0.0)
    z = F.lit(weights[0])
    after = F.substring_index(pattern, "|", -1)
    for j in range(len(LABELERS)):
        x = F.substring(after, j + 1, 1)
        z = z + F.when(x == "+", weights[1 + 2 * j]).when(x == "-", weights[2 + 2 * j]).otherwise(0.0)
    shape = F.substring(after, len(LABELERS) + 1, 1)
    return 1 / (1 + F.exp(-(z + F.when(shape == "2", weights[-2]).when(shape == "1", weights[-1]).otherwise(0.0))))


def candidates(docs: DataFrame, text: str = "text", base: str = "base", loose: str = "loose") -> DataFrame:
    """docs with the arrays base and loose."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(base, base_spans(whole)).withColumn(loose, loose_spans(whole, F.col(base)))


def fit(found: DataFrame, text: str = "text", base: str = "base", loose: str = "loose") -> list[float]:
    """The model from the vote patterns of all candidates of a table that ``candidates`` made."""
    some = found.where((F.size(base) > 0) | (F.size(loose) > 0))
    patterns = some.select(F.explode(F.transform(F.concat(base, loose), lambda s: votes(F.col(text), s))).alias("p"))
    return train({r.p: r["count"] for r in patterns.groupBy("p").count().collect()})


def accepted(text: Column, loose: Column, weights: list[float]) -> Column:
    return F.filter(loose, lambda s: probability(votes(text, s), weights) > 0.5)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", spans: str = "pii", base: str = "base") -> DataFrame:
    """docs with base (kind, start, end, found) and pii, the same followed by accepted candidates."""
    found = candidates(docs, text, base, "loose_")
    weights = fit(found, text, base, "loose_")
    more = F.array_sort(accepted(F.col(text), F.col("loose_"), weights))
    return found.withColumn(spans, F.concat(base, more)).drop("loose_")
