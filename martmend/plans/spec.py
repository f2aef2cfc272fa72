"""Mart specifications: filter, inner and left equi-joins, one grouping by a single key."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions that can fail or differ from run to run, and operators that can fail, have no place in a predicate.
_PARTIAL = re.compile(r"(?i)\b(rand|randn|random|uuid|now|current_timestamp|current_date|cast|try_cast|raise_error|assert_true|monotonically_increasing_id)\b|[/%]|::|\bdiv\b|\bmod\b")


class Unsupported(ValueError):
    """A change for which candidate keys are not derived; the mart must be rebuilt."""


@dataclass(frozen=True)
class Join:
    """A step: the source ``name`` joined to what is there, equal on the pairs (column there, column of the source)."""

    name: str
    on: tuple[tuple[str, str], ...]
    how: str = "inner"


@dataclass(frozen=True)
class MartSpec:
    """One row per key. filters: a SQL predicate on each filtered source; aggregates: output name to SQL aggregate."""

    driver: str
    key: str
    aggregates: tuple[tuple[str, str], ...]
    joins: tuple[Join, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()

    def filter_of(self, name: str) -> str | None:
        return dict(self.filters).get(name)

    def with_filter(self, name: str, predicate: str) -> MartSpec:
        return replace(self, filters=tuple({**dict(self.filters), name: predicate}.items()))

    def names(self) -> list[str]:
        return [self.driver, *[j.name for j in self.joins]]


def check_predicate(text: str | None) -> None:
    if text and _PARTIAL.search(text):
        raise Unsupported(f"PREDICATE_NOT_TOTAL: {text}")


def check_spec(spec: MartSpec, sources: dict[str, DataFrame]) -> None:
    """Guards: known sources, inner and left equi-joins, total predicates, no column name in two sources."""
    if len(set(spec.names())) != len(spec.names()):
        raise Unsupported("SOURCE_TWICE")
    seen: set[str] = set()
    for name in spec.names():
        if name not in sources:
            raise Unsupported(f"UNKNOWN_SOURCE: {name}")
        if clash := seen & set(sources[name].columns):
            raise Unsupported(f"AMBIGUOUS_COLUMN: {sorted(clash)}")
        seen |= set(sources[name].columns)
    if spec.key not in seen:
        raise Unsupported("KEY_NOT_FOUND")
    for j in spec.joins:
        if j.how not in ("inner", "left") or not j.on:
            raise Unsupported(f"JOIN_NOT_SUPPORTED: {j.name}")
    for _, predicate in spec.filters:
        check_predicate(predicate)


def filtered(spec: MartSpec, sources: dict[str, DataFrame], name: str) -> DataFrame:
    predicate = spec.filter_of(name)
    return sources[name].where(predicate) if predicate else sources[name]


def equal(on: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(True)
    for a, b in on:
        out = out & (F.col(a) == F.col(b))
    return out


def joined(spec: MartSpec, sources: dict[str, DataFrame]) -> DataFrame:
    rows = filtered(spec, sources, spec.driver)
    for j in spec.joins:
        rows = rows.join(filtered(spec, sources, j.name), equal(j.on), j.how)
    return rows


def grouped(spec: MartSpec, rows: DataFrame) -> DataFrame:
    return rows.groupBy(spec.key).agg(*[F.expr(e).alias(n) for n, e in spec.aggregates])


def build_mart(spec: MartSpec, sources: dict[str, DataFrame]) -> DataFrame:
    """The mart: one row per key."""
    check_spec(spec, sources)
    return grouped(spec, joined(spec, sources))


def restricted(spec: MartSpec, sources: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """The sources limited to the keys wherever a source carries the key or a column joined to it.

    A semi-join never multiplies rows, however many origins a key has. Catalyst would push it to the driver side only; here
    it reaches every source that shares the key through the joins.
    """
    alias = {spec.key}
    for j in spec.joins:
        for a, b in j.on:
            if a in alias or b in alias:
                alias |= {a, b}
    keys = keys.select(F.col(keys.columns[0]).alias("__key")).where("__key is not null").distinct()
    out = {}
    for name, df in sources.items():
        own = [c for c in df.columns if c in alias]
        out[name] = df.join(keys, df[own[0]] == keys["__key"], "left_semi") if own and name in spec.names() else df
    return out


def targeted(spec: MartSpec, sources: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The mart's rows for the keys only. For a key on the driver side or joined to it this equals the mart restricted to them."""
    check_spec(spec, sources)
    own = [c for c in sources[spec.driver].columns if c == spec.key]
    limited = restricted(spec, sources, keys) if own or all(j.how == "inner" for j in spec.joins) else sources
    only = keys.select(F.col(keys.columns[0]).alias("__key")).where("__key is not null").distinct()
    rows = joined(spec, limited)
    return grouped(spec, rows.join(only, rows[spec.key] == only["__key"], "left_semi"))
