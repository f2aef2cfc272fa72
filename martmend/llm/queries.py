"""Queries of this subpackage: each numbered operator with production parameters over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lexical, lines, mining, mixing, ngram, pii, secrets, warc, winnow, wrapper

RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived_pages(spark, _table(spark, sf_dir, "pages")).where("gap_reason is null")
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to_id")).alias("refers_to"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.join(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = F.sha2(bpe.decode(F.col("ids"), ranks), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *number, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.find(F.col("text"), secrets.thresholds(docs)).alias("s"))
    base = F.filter("s", lambda s: s["kind"] != "random")
    number = [F.size(F.expr(f"filter(s, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *number[:3], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("s")).alias("spans"), number[3])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", F.col("removed_lines").cast("long").alias("removed_lines"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), langid.classify(F.col("text"), model).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score", "r.rejected")


def op9_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = winnow.with_neighbours(_table(spark, sf_dir, "documents")).withColumn("edited_marks", winnow.marks(F.col("edited")))
    own, edited, following = (winnow.hashes(F.col(c)) for c in ("marks", "edited_marks", "next_marks"))
    return near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), winnow.fingerprint(F.col("marks")).alias("fingerprint"), winnow.fingerprint(F.col("edited_marks")).alias("edited_fingerprint"), winnow.likeness(own, edited).alias("near_edited"), winnow.likeness(own, following).alias("near_next"))


#: Target weights of the mixing query; other sources have weight 1. With twenty sources of equal size src1 has a mean of ten copies.
WEIGHTS = {"src0": 0.5, "src1": 20.0, "src2": 3.0, "src3": 0.0}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(_table(spark, sf_dir, "documents"), weights=WEIGHTS, seed=10)
    return mixing.shuffled(mixed).select("doc_id", "source", "text", "copy_no", "place")


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.mine(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label=label)


OP10_SQL = """
with d as (select doc_id, source, text, md5(coalesce(text, '')) as h from documents),
r as (select source, count(*)::double as n, case source when 'src0' then 0.5 when 'src1' then 20.0 when 'src2' then 3.0 when 'src3' then 0.0 else 1.0 end::double as w from d group by source),
m as (select source, (select count(*) from d)::double / (select sum(w) from r) * w / n as mean from r),
p as (select source, mean, floor(mean / 9)::int + 1 as parts from m),
t as (select source, k, round(sum(exp(-(mean / parts)) * pow(mean / parts, k::double) / gamma(k + 1.0)) over (partition by source order by k), 15) as s
      from p, (select unnest(range(0, 64)) as k)),
q as (select d.*, unnest(range(1, p.parts + 1)) as i from d join p on d.source is not distinct from p.source),
u as (select *, ('0x' || substr(md5(concat_ws('|', '10', coalesce(cast(doc_id as varchar), '~'), h, case when i > 1 then 'part ' || i end)), 1, 13))::bigint / 4503599627370496.0::double as u from q),
c as (select u.doc_id, u.source, u.text, u.h, count(*) filter (where t.s <= u.u)::int as n
      from u join t on u.source is not distinct from t.source group by all),
e as (select doc_id, source, text, h, unnest(range(1, n + 1))::int as copy_no from c)
select doc_id, source, text, copy_no,
       ('0x' || substr(md5(concat_ws('|', '11', coalesce(cast(doc_id as varchar), '~'), h, copy_no::varchar)), 1, 13))::bigint / 4503599627370496.0::double as place
from e
"""

OP2_SQL = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
      else list_distinct([list_aggregate(w[i:i + 4], 'string_agg', ' ') for i in range(1, len(w) - 3)]) end as g from t),
d as (select g, min(doc_id) as rep, len(g) as n from (select doc_id, list_sort(g) as g from s) where len(g) > 0 group by g),
x as (select rep, n, unnest(g) as k from d),
p as (select a.rep as a, b.rep as b from x a join x b on a.k = b.k and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union select b, a from p union select rep, rep from d),
r as (select a as v, b as c from e union select r.v, e.b from r join e on r.c = e.a),
m as (select v, min(c) as c from r group by v)
select s.doc_id, len(s.g)::bigint as n_shingles, coalesce(m.c, s.doc_id) as component_id
from s left join d on list_sort(s.g) = d.g left join m on d.rep = m.v
"""

OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h from p),
l as (select *, max(page_id) over (partition by h) as lead from d),
s as (select *, '000' || list_aggregate([printf('%04s', bin(('0x' || h[i])::int)) for i in range(1, 41)], 'string_agg', '') as bits from l)
select page_id, n::bigint as payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || replace(substr(substr(bits, 4), 1 + 5 * j, 5), ' ', '0'))::int + 1, 1) for j in range(0, 32)], 'string_agg', '') as payload_digest,
       case when page_id = lead then 'response' else 'revisit' end as record_type,
       case when page_id = lead then null else lead end as refers_to
from s
"""

OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
qn as (select item_id, t, count(*)::bigint as times from q group by item_id, t),
c as (select count(*) filter (where len(ts) > 0)::bigint as n_docs, sum(len(ts))::bigint as total from d),
x as (select doc_id, len(ts)::bigint as n, unnest(ts) as t from d),
f as (select doc_id, n, t, count(*)::bigint as tf from x where t in (select t from qn) group by doc_id, n, t),
w as (select t, floor(1000 * ln(((2 * n_docs + 2)::double) / ((2 * count(*) + 1)::double)))::bigint as w from f, c group by t, n_docs),
s as (select item_id, doc_id, sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // total))))::bigint as score
      from f join w using (t) join qn using (t), c group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""

OP13_SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as score
      from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_ngram_join, op3_bpe, op4_pii, op5_secrets, op6_line_dedup, op7_ann, op8_langid, op9_winnow, op10_mixing, op11_extract, op12_lexical, op13_mining)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_ngram_join": OP2_SQL, "op10_mixing": OP10_SQL, "op12_lexical": OP12_SQL, "op13_mining": OP13_SQL}
