"""Entity keys from change events, their origins and order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.frames import union_all
from .workspace import Workspace, settled


@dataclass(frozen=True)
class Route:
    """How events of a source reach the mart's key.

    kind: direct, same_row, path, unresolved or invalid. tables and hops (table, column) say the way: for same_row one
    table with the change key and the mart's key, for path consecutive hops, equal columns joining one table to the next.
    """

    kind: str
    change_key: str = ""
    hops: tuple[tuple[str, str], ...] = ()


EVENT, SQL_CHANGE = "event", "sql_change"


def route_direct(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("entity_value"))


def route_same_row(events: DataFrame, source: DataFrame, change_key: str, key: str) -> DataFrame:
    """event_id and the key of every source row whose change key is the event's value."""
    rows = source.select(F.col(change_key).cast("string").alias("__change"), F.col(key).cast("string").alias("entity_value")).where("entity_value is not null")
    return events.select("event_id", F.col("entity_value").alias("__change")).join(rows, "__change").select("event_id", "entity_value").distinct()


def route_path(events: DataFrame, tables: dict[str, DataFrame], hops: tuple[tuple[str, str], ...]) -> DataFrame:
    """event_id and key along the hops: [(a, x), (a, y), (b, z)] reads y where a.x is the event's value, then b.z = a.y."""
    reached = events.select("event_id", F.col("entity_value").alias("__at"))
    for (here, a), (there, b) in zip(hops, hops[1:], strict=False):
        if here == there:
            step = tables[here].select(F.col(a).cast("string").alias("__at"), F.col(b).cast("string").alias("__next"))
        else:
            step = tables[there].select(F.col(b).cast("string").alias("__at"), F.col(b).cast("string").alias("__next"))
        reached = reached.join(step.where("__next is not null").distinct(), "__at").select("event_id", F.col("__next").alias("__at")).distinct()
    return reached.select("event_id", F.col("__at").alias("entity_value"))


def route_before_image(events: DataFrame) -> DataFrame:
    return events.where("prior_entity_value is not null").select("event_id", F.col("prior_entity_value").alias("entity_value"))


def steps_of(route: Route, key: str) -> list[tuple[str, str, str]]:
    """The lookups (table, column that is searched, column that is read) of a route; a hop into a table that is read next needs none."""
    if route.kind == "direct":
        return []
    hops = route.hops if route.kind == "path" else ((route.hops[0][0], route.change_key), (route.hops[0][0], key))
    out = [(there, a, b) if here == there else (there, b, b) for (here, a), (there, b) in zip(hops, hops[1:], strict=False)]
    return [s for s, after in zip(out, [*out[1:], ("", "", "")], strict=True) if not (s[1] == s[2] and s[:2] == after[:2])]


def hop_order(ways: dict[str, list[tuple[str, str, str]]]) -> list[tuple[tuple[str, str, str], dict[str, int]]]:
    """Lookups in an order in which each route meets its own one after the other, with the routes that take each and their step. Routes
    share a lookup where they can; a route that comes back to one, or meets it in another order, makes it twice."""
    at, out = dict.fromkeys(ways, 0), []
    while any(at[n] < len(w) for n, w in ways.items()):
        waiting = [w[at[n]] for n, w in ways.items() if at[n] < len(w)]
        later = {s for n, w in ways.items() for s in w[at[n] + 1 :]}
        step = next((s for s in waiting if s not in later), waiting[0])
        takers = {n: at[n] for n, w in ways.items() if at[n] < len(w) and w[at[n]] == step}
        out.append((step, takers))
        for n in takers:
            at[n] += 1
    return out


def affected_entities(events: DataFrame, routes: dict[str, Route], tables: dict[str, DataFrame], key: str, entity: str, show_ids: bool = True, work: Workspace | None = None) -> DataFrame:
    """entity_value and reason, one row per key.

    The first reason wins: sources by their first event, events in the order of ``position``, an event's routed keys before
    its before-image, and the before-images of direct sources last. A source without a usable route is an error.

    All routes go through one graph of lookups: the rows of every route that takes a lookup are joined to its table at once, on
    the column in its own type, and filters reach its scan. With ``work``, what a shared lookup gives to routes that part there is put
    into a work table, so each table is read once for a lookup however many routes take it.
    """
    usable = {n: r for n, r in routes.items() if r.kind not in ("unresolved", "invalid")}
    name = F.col("source_model")
    known = F.coalesce(name.isin(list(usable)), F.lit(False))
    firsts = [F.min(F.when(name == n, F.col("position"))).alias(f"at_{i}") for i, n in enumerate(usable)]
    facts = events.agg(F.count(F.when(~known, 1)).alias("bad"), F.min(F.when(~known, F.coalesce(name, F.lit("")))).alias("which"), *firsts).first()
    if facts.bad:
        raise ValueError(f"ROUTE_UNRESOLVED: source '{facts.which}' has no verified route to {key}")
    place = F.coalesce(*[F.when(name == n, F.lit(facts[f"at_{i}"])) for i, n in enumerate(usable)])
    text = F.col("entity_value").cast("string")
    rows = events.select(name.alias("__route"), "event_id", "position", place.cast("bigint").alias("__source_at"), text.alias("__changed"), text.alias("__value"))
    ways = {n: steps_of(r, key) for n, r in usable.items()}
    # Each step takes the rows of its routes out of what waits for it; a row's step is the number of lookups it has made.
    waiting = {n: rows.where(F.col("__route") == n) for n, w in ways.items() if not w}
    fresh = rows.where(F.col("__route").isin([n for n, w in ways.items() if w]))
    arrived: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}  # what a route's last lookup gave, and the routes that took it
    for number, ((table, search, read), takers) in enumerate(hop_order(ways)):
        starting = [n for n, step in takers.items() if step == 0]
        parts = [fresh.where(F.col("__route").isin(starting))] if starting else []
        for rows_, names in {arrived[n][1]: arrived[n] for n, step in takers.items() if step}.values():
            parts.append(rows_.where(F.col("__route").isin([n for n in names if n in takers])))
        found = looked_up(union_all(*parts), tables[table], search, read)
        if work is not None and len(takers) > 1:
            found = work.put(f"lookup-{number}", found)
        arrived |= dict.fromkeys(takers, (found, tuple(takers)))
    ends = [found.where(F.col("__route").isin([n for n in names if arrived[n][1] == names])) for names, (found, _) in {g[1]: g for g in arrived.values()}.items()]
    routed = union_all(*ends, *waiting.values())
    reason = F.coalesce(*[F.when(F.col("__route") == n, scalars.direct_reason(entity) if r.kind == "direct" else scalars.routed_reason(r.change_key, F.col("__changed"), entity, show_ids)) for n, r in usable.items()])
    routed = routed.select(F.col("__value").alias("entity_value"), reason.alias("reason"), F.lit(0).alias("__late"), "__source_at", "position", F.lit(0).alias("__step"))
    late = F.when(name.isin([n for n, r in usable.items() if r.kind == "direct"]), 1).otherwise(0)
    prior = events.where("prior_entity_value is not null").select(F.col("prior_entity_value").cast("string").alias("entity_value"), scalars.before_image_reason(entity).alias("reason"), late.alias("__late"), F.when(late == 1, 0).otherwise(place).cast("bigint").alias("__source_at"), "position", F.lit(1).alias("__step"))
    rank = F.struct("__late", "__source_at", "position", "__step", "reason")
    return union_all(routed, prior).groupBy("entity_value").agg(F.min_by("reason", rank).alias("reason"))


def looked_up(rows: DataFrame, table: DataFrame, search: str, read: str) -> DataFrame:
    """rows with ``__value`` looked up: what the table has in ``read`` where ``search`` is the value. Values are brought to the column's
    type, and only where their text is that of the typed value, so 007 does not find 7."""
    kind = table.schema[search].dataType
    typed = F.col("__value").try_cast(kind)
    held = rows.withColumn("__typed", F.when(typed.cast("string") == F.col("__value"), typed)).where("__typed is not null")
    if search == read:
        return held.join(table.select(F.col(search).alias("__typed")), "__typed", "left_semi").drop("__typed")
    step = table.select(F.col(search).alias("__typed"), F.col(read).cast("string").alias("__next")).where("__next is not null")
    return held.drop("__value").join(step, "__typed").drop("__typed").withColumnRenamed("__next", "__value")


def affected_keys(event_keys: DataFrame | None = None, change_keys: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Key and origin (event or sql_change), distinct, without nulls. No input at all is an error."""
    parts = [(df, origin) for df, origin in ((event_keys, EVENT), (change_keys, SQL_CHANGE)) if df is not None]
    if not parts:
        raise ValueError("NO_CANDIDATES: neither events nor a definition change gave keys")
    name = name or parts[0][0].columns[0]
    frames = [df.select(F.col(df.columns[0]).alias(name)).where(F.col(name).isNotNull()).withColumn("origin", F.lit(origin)) for df, origin in parts]
    return union_all(*frames).distinct()


def origin_counts(keys: DataFrame) -> DataFrame:
    key = keys.columns[0]
    return keys.agg(
        F.count_distinct(F.when(F.col("origin") == EVENT, F.col(key))).alias("event_keys"),
        F.count_distinct(F.when(F.col("origin") == SQL_CHANGE, F.col(key))).alias("change_keys"),
        F.count_distinct(F.col(key)).alias("union_keys"),
    )


def merge_keys(*frames: DataFrame) -> DataFrame:
    """Distinct keys of several lists, each with the number of the first list that has it; blanks dropped."""
    parts = [df.select(scalars.blank_to_null(F.col(df.columns[0]).cast("string")).alias("entity_value"), F.lit(i).alias("first_list")) for i, df in enumerate(frames)]
    return union_all(*parts).where("entity_value is not null").groupBy("entity_value").agg(F.min("first_list").alias("first_list"))


def entity_rank(c: Column) -> list[Column]:
    """Sort keys: integers by value, then other texts."""
    whole = c.rlike(r"^-?[0-9]+$")
    return [whole.desc(), F.when(whole, c.try_cast("decimal(38,0)")), c]


def order_entities(df: DataFrame, key: str = "entity_value") -> DataFrame:
    return df.orderBy(*entity_rank(F.col(key)))


def placed(df: DataFrame, key: str = "entity_value", place: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the order of ``order_entities``: ranges of keys are ranked side by side, and each
    range begins after the rows of those before it. The ranges are written once, as they are drawn by a sample."""
    ranges = df.repartitionByRange(*entity_rank(F.col(key))).withColumn("__range", F.spark_partition_id())
    ranges = settled(ranges)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*entity_rank(F.col(key))))
    return ranges.join(offsets, "__range").select(*df.columns, (F.col("__before") + own).alias(place))


def unresolved_events(events: DataFrame, routed: DataFrame) -> DataFrame:
    """Events that gave no key: not direct, no before-image, no routed key (routed: event_id, entity_value)."""
    return events.where("prior_entity_value is null").join(routed, "event_id", "left_anti")


def pick_canonical(df: DataFrame) -> DataFrame:
    """Of candidate queries (fingerprint, name, downstream): the most downstream of each fingerprint, then the largest by (downstream, name)."""
    best = df.groupBy("fingerprint").agg(F.max("downstream").alias("downstream"), F.max_by("name", F.struct("downstream", "name")).alias("name"))
    return best.orderBy(F.desc("downstream"), F.desc("name")).limit(1)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group in the given order."""
    at = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(at)).where("__r = 1").drop("__r")
