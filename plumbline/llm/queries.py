"""The operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, hard_negatives, language_id, media, ngram_join, packing, quality, revisits, suffix_dedup, token_counts, toxicity


#: Passages that op5 reports besides: repeated runs of so many bytes and words at least.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85, 100)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400, keep_first=False, passage=PASSAGE_BYTES, passage_words=PASSAGE_WORDS)
    span_bytes = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("repeated").cast("long").alias("n_passages"),
        span_bytes("repeated").alias("n_passage_bytes"),
        span_bytes("later").alias("n_later_bytes"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.bpe_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_revisits, op2_ngram_join, op3_decontamination, op4_media, op5_suffix_dedup, op6_toxicity, op7_packing, op8_quality, op9_token_counts, op10_language, op11_exact_dedup, op12_hard_negatives, op13_conversation_repair, pipeline)}

_CANONICAL = """
case when length(h0) > 0 then h0 || p0 || case when len(q0) > 0 then '?' || array_to_string(q0, '&') else '' end end
"""

_OP1 = r"""
with captures as (
  select page_id, md5(html) as m, coalesce(url, '') as url, strlen(html) as n, page_id % 9 as st, 1700000000 + page_id * 60 as base, unnest(['r','a','b','c','d']) as k
  from pages where url is not null and html is not null
), records as (
  select page_id || '-' || k as record_id,
    case when k = 'd' then regexp_replace(url, '^https?://', 'HTTP://www.') || '#part' else url end as url,
    base + case k when 'r' then 0 when 'a' then 86400 when 'b' then 172800 when 'c' then -86400 else 259200 end as t,
    k, substr(m, 1, 12) as tag, 't' || st as lm, n, page_id
  from captures where k in ('r','a') or (k = 'b' and page_id % 3 = 0) or (k = 'c' and page_id % 5 = 0) or (k = 'd' and page_id % 7 = 0)
), cut as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from records
), parts as (
  select *,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') as h0,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/(index\.(html?|php))?$', '') as p0,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' and split_part(x, '=', 1) not in ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid','sessionid'))) as q0
  from cut
), paged as (
  select *, """ + _CANONICAL + r""" as page from parts
), ranked as (
  select v.*, r.record_id as rid, r.t as rt, r.tag as rtag, r.lm as rlm, r.n as rn,
    row_number() over (partition by v.record_id order by r.t desc, r.record_id desc) as rk
  from (select * from paged where k <> 'r') v left join (select * from paged where k = 'r') r on v.page = r.page and r.t < v.t
), judged as (
  select *, case when rid is null then 'no_response' when k in ('a','c') then case when tag = rtag then 'resolved' else 'changed' end
    when k = 'b' then case when 'x' || tag = rtag then 'resolved' else 'changed' end
    else case when lm = rlm then 'resolved' else 'changed' end end as outcome
  from ranked where rk = 1
)
select record_id, page, to_timestamp(t)::timestamp as ts, outcome, rid as response_id, t - rt as age_s,
  case when outcome = 'resolved' then
    case when k in ('a','c') then 'cache-control: max-age=600' || chr(10) || 'content-length: ' || rn || chr(10) || 'content-type: text/html' || chr(10) || 'date: d' || (page_id % 100) || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'last-modified: ' || rlm || chr(10) || 'server: a'
    when k = 'b' then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || rn || chr(10) || 'content-type: text/html' || chr(10) || 'etag: "x' || tag || '"' || chr(10) || 'last-modified: ' || lm || chr(10) || 'server: a'
    else 'cache-control: max-age=60' || chr(10) || 'content-length: ' || rn || chr(10) || 'content-type: text/html' || chr(10) || 'etag: "' || rtag || '"' || chr(10) || 'last-modified: ' || lm || chr(10) || 'server: a' || chr(10) || 'vary: accept' end
  end as headers
from judged
"""

_OP11 = r"""
with squeezed as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as s from documents
), placed as (
  select *, row_number() over (partition by s order by points desc, doc_id nulls last) as place, count(*) over (partition by s) as group_size,
    first_value(doc_id) over (partition by s order by points desc, doc_id nulls last) as keep_id
  from squeezed
)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(s) as text_sha256 from placed
"""

_OP12 = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id))::int as rank,
  n.vec_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on p.anchor_id = n.anchor_id and not n.same and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) <= 10
"""

ORACLE_SQL: dict[str, str] = {"op1_revisits": _OP1, "op11_exact_dedup": _OP11, "op12_hard_negatives": _OP12}
