"""Readers of events and lineage, pinned inputs, and the assessment sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.frames import union_all

#: Names under which the event fields may come.
ALIASES = {
    "event_id": ("event_id", "eventId"),
    "source_model": ("source_model", "sourceModel"),
    "operation": ("operation",),
    "entity_key": ("entity_key", "entityKey"),
    "entity_value": ("entity_value", "entityValue"),
}
PRIOR = ("prior_entity_value", "priorEntityValue", "prior_entity_id")


def change_events(raw: DataFrame) -> DataFrame:
    """The five required fields and prior_entity_value, blanks as null, from any of the known names."""

    def first(names) -> F.Column:
        found = [scalars.blank_to_null(F.col(f"`{n}`").cast("string")) for n in names if n in raw.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    prior = [*PRIOR, *sorted(c for c in raw.columns if c.startswith("prior_") and c not in PRIOR)]
    return raw.select(*[first(names).alias(n) for n, names in ALIASES.items()], first(prior).alias("prior_entity_value"))


def read_change_events(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Events of a CSV file with a header. An incomplete row or, if required, an empty file is an error."""
    events = change_events(spark.read.csv(path, header=True))
    broken = " or ".join(f"{n} is null" for n in ALIASES)
    facts = events.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(broken), 1)).alias("bad")).first()
    if facts.bad:
        raise ValueError(f"{facts.bad} change events lack a required field")
    if required and not facts.n:
        raise ValueError("the file has no change events")
    return events


def identity_tree(spark: SparkSession, path: str) -> DataFrame:
    """part (folder below path, empty for path itself), files and digest of every folder: a tree of hashes.

    A file's hash is that of its name, size and time. The files of a folder are hashed in 256 bundles by their own hash, the bundles
    and the digests of its folders in order, and so on up to the path itself; so no step gathers all files, and a changed file
    changes the digests on its way up only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    below = F.regexp_replace(F.expr(f"substring(path, {len(_qualified(spark, path)) + 1})"), "^/+", "")
    named = files.select(F.when(below == "", F.element_at(F.split("path", "/"), -1)).otherwise(below).alias("below"), "length", F.unix_micros("modificationTime").alias("at"))
    leaf = named.select(F.regexp_replace("below", "/?[^/]*$", "").alias("part"), F.sha2(F.concat_ws("|", "below", "length", "at"), 256).alias("h"))
    bundles = leaf.groupBy("part", F.substring("h", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"), F.count(F.lit(1)).alias("files"))
    # Each folder, whether it has files or only folders.
    own = bundles.select("part", F.struct(F.concat(F.lit("file "), "b").alias("name"), "h").alias("child"), "files")
    deepest = leaf.agg(F.max(F.when(F.col("part") == "", 0).otherwise(F.size(F.split("part", "/"))))).first()[0] or 0
    out = None
    for depth in range(deepest, -1, -1):
        depth_of = F.when(F.col("part") == "", 0).otherwise(F.size(F.split("part", "/")))
        here = own.where(depth_of == depth)
        if out is not None:
            up = out.where(depth_of == depth + 1)
            up = up.select(F.regexp_replace("part", "/?[^/]*$", "").alias("part"), F.struct(F.concat(F.lit("folder "), F.element_at(F.split("part", "/"), -1)).alias("name"), F.col("digest").alias("h")).alias("child"), "files")
            here = union_all(here, up)
        level = here.groupBy("part").agg(F.sum("files").alias("files"), F.sha2(F.to_json(F.sort_array(F.collect_list("child"))), 256).alias("digest"))
        out = level if out is None else union_all(out, level)
    return out


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as the reader names it: with scheme, without a slash at the end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def source_identity(spark: SparkSession, path: str) -> str:
    """The digest at the top of the identity tree."""
    return identity_tree(spark, path).where("part = ''").first().digest


PINS = "name string, path string, identifier string, parts map<string,string>"


def pin(spark: SparkSession, sources: dict[str, str], target: str | None = None) -> DataFrame:
    """name, path, identifier and parts (folders with their digests) of each source; the target is pinned like any other. A missing
    path is not pinned (null)."""
    rows = []
    for name, path in {**sources, **({"__target": target} if target else {})}.items():
        try:
            parts = {r.part: r.digest for r in identity_tree(spark, path).collect()}  # a row for each folder
            rows.append((name, path, parts[""], parts))
        except Exception as why:
            if "PATH_NOT_FOUND" not in str(why):
                raise
            rows.append((name, path, None, None))
    return spark.createDataFrame(rows, PINS)


def changed_parts(pins: DataFrame, name: str) -> DataFrame:
    """part and change (added, removed, modified) of the folders of a source that are not as they were pinned. A folder is modified if
    something below it is; the deepest ones say what."""
    row = pins.where(F.col("name") == name).first()
    was = pins.where(F.col("name") == name).select(F.explode("parts").alias("part", "was"))
    now = identity_tree(pins.sparkSession, row.path).select(F.col("part"), F.col("digest").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return was.join(now, "part", "full_outer").select("part", change.alias("change")).where("change is not null")


def read_pinned(pins: DataFrame, name: str) -> DataFrame:
    """The source, after its identity has been checked again."""
    row = pins.where(F.col("name") == name).first()
    if row is None or row.identifier is None:
        raise ValueError(f"SOURCE_NOT_PINNED: {name}")
    if source_identity(pins.sparkSession, row.path) != row.identifier:
        where = ", ".join(r.part or "." for r in changed_parts(pins, name).orderBy(F.desc(F.length("part")), "part").limit(5).collect())
        raise ValueError(f"SOURCE_CHANGED: {name} in {where}")
    return pins.sparkSession.read.parquet(row.path)


def verify_pin(pins: DataFrame) -> bool:
    """Are all sources bound, and unchanged since?"""
    return all(r.identifier is not None and source_identity(pins.sparkSession, r.path) == r.identifier for r in pins.collect())


def pin_consistent(phases: DataFrame) -> DataFrame:
    """run_id and whether every phase read one and the same snapshot (run_id, phase, identifier)."""
    return phases.groupBy("run_id").agg(((F.count_distinct("identifier") == 1) & (F.count("identifier") == F.count(F.lit(1)))).alias("consistent"))


def write_assessment(metrics: DataFrame, entities: DataFrame, path: str, secret: str | None, project: str, entity: str, key: str, raw_ids: bool = False) -> None:
    """metrics and entities (entity_value, reason) as JSON; ids as pseudonyms unless raw ids are allowed."""
    if not raw_ids:
        if not secret:
            raise ValueError("ids can be written only under a secret, or raw if that is allowed")
        hidden = F.regexp_replace("reason", r"^(\w+(?: \w+)*?) \S+ belongs to ", "$1 belongs to ")
        entities = entities.select(scalars.pseudonymize(F.col("entity_value"), secret, project, entity, key).alias("entity_value"), hidden.alias("reason"))
    metrics.write.json(f"{path}/metrics")
    entities.write.json(f"{path}/entities")


def read_lineage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON file with a map ``nodes`` of unique_id to name, resource_type and depends_on.nodes."""
    node = "struct<unique_id:string,name:string,resource_type:string,depends_on:struct<nodes:array<string>>,columns:map<string,struct<name:string>>,compiled_code:string,raw_code:string>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<nodes:map<string,{node}>>").alias("m"))
    nodes = text.select(F.explode("m.nodes").alias("unique_id", "n")).select("unique_id", "n.name", "n.resource_type", F.map_keys("n.columns").alias("columns"), F.coalesce("n.compiled_code", "n.raw_code").alias("definition"), F.col("n.depends_on.nodes").alias("parents"))
    return nodes.drop("parents"), nodes.select(F.explode("parents").alias("parent"), F.col("unique_id").alias("child"))
