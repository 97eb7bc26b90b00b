"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contamination
from .embeddings import near_duplicates as near_vectors
from .html import main_text
from .licenses import licenses
from .minhash import near_duplicates
from .packing import pack
from .quality import quality
from .secrets import secrets
from .toxicity import toxicity
from .warc import round_trip


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
with item as (select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
win as (
  select item_id, unnest([w[i:i + 12] for i in range(1, greatest(len(w) - 13, 0) + 2)]) as g from item where len(w) >= 1
),
sizes as (select distinct len(g) as k from win),
doc as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
gram as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as p, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) as g
  from doc, sizes where len(w) >= k
),
hit as (select doc_id, p, k, item_id from gram join win using (g)),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from hit)) group by 1),
found as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join pos using (doc_id) left join found using (doc_id)
"""


OP3_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select a as vec_id, min(b) as component_id from reach group by 1),
many as (select a as vec_id, count(*) as n from link group by 1)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, component_id = vec_id as kept from root left join many using (vec_id)
"""

OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
s as (select doc_id, unnest(case when len(w) >= 3 then list_distinct([w[i:i + 2] for i in range(1, len(w) - 1)]) when len(w) > 0 then [w] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on r.b = l.a),
root as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, component_id = doc_id as kept from root left join n using (doc_id)
"""

OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, n, min(page_id) as first from p where n >= 100 group by d, n)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (d, n)
"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return pack(_read(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, _read(spark, sf_dir, "pages"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_read(spark, sf_dir, "pages"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_read(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_packing, op3_embedding_near_dedup, op4_quality_classifier, op5_warc, op6_html_extraction, op7_secret_scans, op8_minhash_near_dedup, op9_toxicity, op10_license_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op8_minhash_near_dedup": OP8_SQL}
