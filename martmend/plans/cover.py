"""Candidate keys of definition changes: supersets of the keys whose rows can differ, never subsets.

A cover is a set of rows that contains every row that differs between the old and the new definition. It starts as the rows
whose filter decision flips, and is carried through joins up to the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import union_all
from .spec import MartSpec, Unsupported, check_spec, equal, filtered

COMPILED, NO_CHANGE, REBUILD = "COMPILED", "NO_CHANGE", "FULL_REBUILD_REQUIRED"


@dataclass(frozen=True)
class Candidates:
    """status, the keys (None if they could not be derived: the whole population then), and the reasons."""

    status: str
    keys: DataFrame | None
    reasons: tuple[str, ...] = ()


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def differs(old: Column | str, new: Column | str) -> Column:
    return ~_column(old).eqNullSafe(_column(new))


def flips(old: Column | str, new: Column | str) -> Column:
    """True where a filter decides otherwise; null and false are the same decision."""
    return differs(F.coalesce(_column(old), F.lit(False)), F.coalesce(_column(new), F.lit(False)))


def flip_rows(df: DataFrame, old: Column | str, new: Column | str) -> DataFrame:
    return df.where(flips(old, new))


def changed_expr_rows(df: DataFrame, pairs: list[tuple[Column | str, Column | str]]) -> DataFrame:
    """Rows on which any pair of expressions differs, null-safely."""
    return df.where(reduce(lambda a, b: a | b, [differs(o, n) for o, n in pairs], F.lit(False)))


#: The same test on the arguments of an unchanged aggregate, before grouping.
changed_agg_input_rows = changed_expr_rows


def changed_agg_keys(df: DataFrame, key: str, old: Column | str, new: Column | str) -> DataFrame:
    """Keys for which two different aggregates differ."""
    return df.groupBy(key).agg(_column(old).alias("__old"), _column(new).alias("__new")).where(differs(F.col("__old"), F.col("__new"))).select(key).where(F.col(key).isNotNull())


def having_flip_keys(df: DataFrame, key: str, aggregates: dict[str, Column | str], old: str, new: str) -> DataFrame:
    """Keys whose HAVING decision flips."""
    if not key:
        raise Unsupported("HAVING_WITHOUT_GROUP")
    return df.groupBy(key).agg(*[_column(e).alias(n) for n, e in aggregates.items()]).where(flips(old, new)).select(key).where(F.col(key).isNotNull())


def join_condition_changed_keys(left: DataFrame, right: DataFrame, old_on: tuple, new_on: tuple, key: str, left_id: str, right_id: str) -> DataFrame:
    """Keys of match pairs that only one of two equi-join conditions gives, and of left rows that gained or lost all matches with them."""
    pairs = [left.join(right, equal(on)).select(left_id, right_id) for on in (old_on, new_on)]
    changed = union_all(pairs[0].exceptAll(pairs[1]), pairs[1].exceptAll(pairs[0]))
    if key in left.columns:
        return left.join(changed, left_id, "left_semi").select(key).where(F.col(key).isNotNull()).distinct()
    return right.join(changed, right_id, "left_semi").select(key).where(F.col(key).isNotNull()).distinct()


def join_type_changed_keys(left: DataFrame, right: DataFrame, on: tuple, key: str) -> DataFrame:
    """Keys of left rows without a match: those an inner join drops and a left join keeps."""
    return terminal_keys(left.join(right, equal(on), "left_anti"), key)


def cover_project(cover: DataFrame, names: dict[str, str]) -> DataFrame:
    """The cover through renames {old: new}; anything but a column of the cover is refused."""
    if missing := [c for c in names if c not in cover.columns]:
        raise Unsupported(f"COMPUTED_COLUMN: {missing}")
    return cover.select(*[F.col(a).alias(b) for a, b in names.items()])


def cover_filter(cover: DataFrame) -> DataFrame:
    """A later filter keeps the cover: it stays a superset."""
    return cover


def cover_inner(cover: DataFrame, fixed: DataFrame, on: tuple, side: str = "left") -> DataFrame:
    """One covered input of an inner join; on is written from the left input's view."""
    return cover.join(fixed, equal(on)) if side == "left" else fixed.join(cover, equal(on))


def cover_left_from_left(cover: DataFrame, right: DataFrame, on: tuple) -> DataFrame:
    return cover.join(right, equal(on), "left")


def cover_left_from_right(left: DataFrame, cover: DataFrame, old_right: DataFrame, new_right: DataFrame, on: tuple) -> DataFrame:
    """A covered right input of a left join: left rows that it can reach, joined with both the old and the new right input.

    The old side is needed for rows whose last match vanishes, the new one for rows that gain a first match.
    """
    reached = cover.select(*[F.col(b) for _, b in on]).dropna().distinct()
    hit = left.join(reached, equal(on), "left_semi")
    return union_all(hit.join(old_right, equal(on), "left"), hit.join(new_right, equal(on), "left")).distinct()


def terminal_keys(cover: DataFrame, key: str) -> DataFrame:
    return cover.select(key).where(F.col(key).isNotNull()).distinct()


def candidate_union(*keys: DataFrame) -> DataFrame:
    """Candidates of several changes; the columns are taken by place."""
    return union_all(*keys, by_name=False).distinct()


def candidate_keys(old: MartSpec, new: MartSpec, sources: dict[str, DataFrame]) -> Candidates:
    """Keys that a changed filter may affect. Exactly one source's filter may differ and all else must be equal; otherwise the
    result says that the mart must be rebuilt, never that nothing changed."""
    try:
        for spec in (old, new):
            check_spec(spec, sources)
        if (old.driver, old.key, old.aggregates, old.joins) != (new.driver, new.key, new.aggregates, new.joins):
            raise Unsupported("MORE_THAN_A_FILTER_CHANGED")
        changed = [n for n in new.names() if old.filter_of(n) != new.filter_of(n)]
        if not changed:
            return Candidates(NO_CHANGE, sources[new.driver].sparkSession.createDataFrame([], sources_key(new, sources)), ())
        if len(changed) > 1:
            raise Unsupported("TWO_TAINTED_JOIN_INPUTS")
        (name,) = changed
        cover = flip_rows(sources[name], old.filter_of(name) or "true", new.filter_of(name) or "true")
        whole = None if name == new.driver else filtered(new, sources, new.driver)
        for j in new.joins:
            fixed = filtered(new, sources, j.name)
            if j.name == name:
                before = whole
                if j.how == "inner":
                    cover = cover_inner(cover, before, j.on, "right")
                else:
                    cover = cover_left_from_right(before, cover, filtered(old, sources, name), fixed, j.on)
                whole = None
            elif whole is not None:
                whole = whole.join(fixed, equal(j.on), j.how)
            else:
                cover = cover.join(fixed, equal(j.on), j.how)
        return Candidates(COMPILED, terminal_keys(cover, new.key), ())
    except Unsupported as why:
        return Candidates(REBUILD, None, (str(why),))


def sources_key(spec: MartSpec, sources: dict[str, DataFrame]):
    from pyspark.sql import types as T

    field = next(df.schema[spec.key] for n, df in sources.items() if n in spec.names() and spec.key in df.columns)
    return T.StructType([T.StructField(spec.key, field.dataType)])


def discovery_counts(flipped: DataFrame, key: str) -> DataFrame:
    """Source rows and distinct keys of a flip, in one pass."""
    return flipped.agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct(F.col(key)).alias("candidate_keys"))
