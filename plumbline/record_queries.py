"""Record queries over the given tables: events read as runs of questions, conversations as episodes of turns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.profile import column_profile
from .plans import verbal
from .functions import ordered
from .records import answers, episodes, evaluation, filters, manifests, tables, traces, training
from .scratch import shared_dir
from .sources import records
from .sources.tables import read_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = _WITH + sql


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight events make a question's runs; the first is gold. Answers of one bucket of values differ by 0.08 at most."""
    e = table(spark, sf_dir, "events")
    answer = F.round(F.floor(F.col("value") / 12) * 12 + (F.col("event_id") % 3) * 0.04, 2)
    return e.select(
        "event_id",
        F.floor(F.col("event_id") / 8).alias("question_id"),
        (F.col("event_id") % 8).alias("idx"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") != "error", answer).alias("number"),
        F.when(F.col("event_type") != "error", answer).cast("string").alias("answer"),
        F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("dataset"),
        F.col("event_type").alias("template"),
        F.element_at(F.array(*map(F.lit, ("EASY", "MEDIUM", "HARD", "VERY_HARD"))), (F.floor(F.col("event_id") / 8) % 4 + 1).cast("int")).alias("difficulty"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("value").alias("elapsed"),
        "ts",
        "user_id",
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("idx = 0")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.answer_distribution(runs(spark, sf_dir).where("idx > 0"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.classify_failures(votes(spark, sf_dir), gold(spark, sf_dir))


_WITH = r"""with runs as (
  select event_id, event_id // 8 as question_id, event_id % 8 as idx, event_type <> 'error' as success,
    case when event_type <> 'error' then floor(value / 12) end as bucket,
    case when event_type <> 'error' then round(floor(value / 12) * 12 + (event_id % 3) * 0.04::double, 2) end as number,
    'd' || (user_id % 10) as dataset, event_type as template, (['EASY', 'MEDIUM', 'HARD', 'VERY_HARD'])[(event_id // 8) % 4 + 1] as difficulty,
    (props->>'$.k')::bigint as k, value as elapsed, ts, user_id
  from events
), gold as (select * from runs where idx = 0),
clusters as (select question_id, bucket, count(*) as n, min(idx) as first, arg_min(number, idx) as answer from runs where idx > 0 and bucket is not null group by 1, 2),
ranked as (select *, row_number() over (partition by question_id order by n desc, first) as place from clusters),
votes as (
  select q.question_id, q.total, q.succeeded, q.total - q.succeeded as failed, coalesce(c.n_clusters, 0) as n_clusters, coalesce(c.entropy, 0) as entropy,
    coalesce(c.top / nullif(q.succeeded, 0), 0) as confidence, m.answer as majority, m.bucket as majority_bucket, coalesce(m.n, 0) as majority_votes
  from (select question_id, count(*) as total, count(bucket) as succeeded from runs where idx > 0 group by 1) q
  left join (select question_id, count(*) as n_clusters, max(n) as top, sum(-(n / t) * log2(n / t)) as entropy from (select *, sum(n) over (partition by question_id) as t from clusters) group by 1) c using (question_id)
  left join (select * from ranked where place = 1) m using (question_id)
), classes as (
  select v.*, g.success as gold_success, r.place - 1 as gold_cluster, g.template, g.dataset,
    case when r.place = 1 then 'good' when v.failed > v.succeeded then 'execution_failure' when not coalesce(g.success, false) and v.succeeded > 0 then 'hint_necessary'
      when v.n_clusters >= 2 and v.entropy > 0.8 then 'ambiguous' when v.confidence > 0.5 then 'too_hard' when g.success and v.succeeded < v.total * 0.5 then 'hint_necessary' else 'ambiguous' end as category,
    case when r.place = 1 then v.confidence when v.failed > v.succeeded then v.failed / v.total when not coalesce(g.success, false) and v.succeeded > 0 then 0.8
      when v.n_clusters >= 2 and v.entropy > 0.8 then least(1.0, v.entropy / 1.5) when v.confidence > 0.5 then v.confidence when g.success and v.succeeded < v.total * 0.5 then 1 - v.succeeded / v.total else 0.5 end as class_confidence
  from votes v left join gold g using (question_id) left join ranked r on r.question_id = v.question_id and r.bucket = g.bucket
), entries as (
  select event_id as line_no, substr(sha256(user_id || ':' || event_type), 1, 16) as fingerprint, event_type as template_name, 'd' || (user_id % 10) as dataset,
    case when event_id % 2 = 0 then 'synthetic' else 'llm' end as type, case when value > 20 then 'failure' else 'success' end as status, 'm' || (event_id % 3) as model from events
), turns as (
  select * from (select conv_id, turn as turn_index, role, text, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn)) where role = 'assistant'
), questions as (
  select conv_id, min(text) filter (where turn = 0) as question_text, conv_id % 3 = 0 as verified from conversations group by 1
)
"""

# --- answers and votes

query(
    "rec_answer_votes",
    lambda s, d: votes(s, d).select("question_id", "total", "succeeded", "failed", F.col("n_clusters").cast("long").alias("n_clusters"), F.round("entropy", 4).alias("entropy"), F.round("confidence", 4).alias("confidence"), F.col("majority").cast("double").alias("majority"), "majority_votes"),
    "select question_id, total, succeeded, failed, n_clusters, round(entropy, 4) + 0.0 as entropy, round(confidence, 4) as confidence, majority, majority_votes from votes",
)
query(
    "rec_failure_classes",
    lambda s, d: classes(s, d).select("question_id", "gold_success", F.col("gold_cluster").cast("long").alias("gold_cluster"), "category", F.round("class_confidence", 4).alias("class_confidence")),
    "select question_id, coalesce(gold_success, false) as gold_success, gold_cluster, category, round(class_confidence, 4) as class_confidence from classes",
)
query(
    "rec_failure_breakdown",
    lambda s, d: evaluation.failure_breakdown(classes(s, d).join(gold(s, d).select("question_id", "template"), "question_id"), "template"),
    "select template as grp, count(*) as total, " + ", ".join(f"count(*) filter (where category = '{c}') as {c}" for c in ("good", "ambiguous", "too_hard", "hint_necessary", "execution_failure")) + ", round(avg(entropy), 4) as avg_entropy from classes where template is not null group by 1",
)
query(
    "rec_triangulation",
    lambda s, d: answers.triangulation(votes(s, d), gold(s, d)),
    "select question_id, total as n_runs, succeeded as n_succeeded, substr(sha256(majority::varchar), 1, 16) as majority_hash, majority_votes as majority_count, coalesce(g.bucket = majority_bucket, false) as verified from votes left join gold g using (question_id)",
)
query(
    "rec_ground_truth_verdicts",
    lambda s, d: answers.ground_truth_verdicts(
        runs(s, d).where("idx > 0").select("question_id", "idx", "success", "answer"),
        answers.valid_answers(gold(s, d).select("question_id", F.lit(0).alias("place"), "answer")),
    ).select("question_id", "idx", "matched", "error"),
    """select r.question_id, r.idx, case when r.success and g.number is not null then r.bucket = g.bucket end as matched,
    case when not r.success then 'run failed' when g.number is null then 'no ground truth' when r.bucket <> g.bucket then 'answer mismatch' end as error
    from runs r left join gold g using (question_id) where r.idx > 0""",
)
query(
    "rec_verification_by_runs",
    lambda s, d: answers.verification_by_runs(runs(s, d), gold(s, d)),
    """, ks as (select unnest(range(1, 8)) as k), firsts as (
      select question_id, ks.k, bucket, count(*) as n, min(idx) as first from runs join ks on idx <= ks.k where idx > 0 and bucket is not null group by 1, 2, 3
    ), tops as (select question_id, k, bucket from (select *, row_number() over (partition by question_id, k order by n desc, first) as p from firsts) where p = 1),
    all_k as (select g.question_id, ks.k, g.bucket from gold g join (select question_id, max(idx) as n from runs where idx > 0 group by 1) using (question_id) join ks on ks.k <= n where g.bucket is not null)
    select k, count(*) as total, count(*) filter (where a.bucket = t.bucket) as verified, round((count(*) filter (where a.bucket = t.bucket)) / count(*), 4) as rate
    from all_k a left join tops t using (question_id, k) group by 1""",
)
query(
    "rec_answer_hashes",
    lambda s, d: runs(s, d).select("event_id", answers.answer_hash(F.col("answer")).alias("hash"), answers.number_hash(F.col("number")).alias("number_hash")),
    "select event_id, substr(sha256(number::varchar), 1, 16) as hash, substr(sha256(number::varchar), 1, 16) as number_hash from runs",
)


def _object(a: str, b: str, name: str):
    """An answer of two groups as JSON."""
    return F.to_json(F.struct(F.col(a).alias("mean1"), F.col(b).alias("mean2"), F.col(name).alias("group1")))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers of a run, and both somewhat off."""
    off = lambda c, n, step: F.col(c) + (F.col("event_id") % n) * step
    r = runs(spark, sf_dir).select("event_id", "elapsed", "template", "dataset", off("elapsed", 4, 3.0).alias("other"))
    return r.withColumns({"near": off("elapsed", 5, 0.04), "beside": off("other", 3, 0.08), "one": off("elapsed", 7, 0.06)})


query(
    "rec_answer_objects_match",
    lambda s, d: shifted(s, d).select("event_id", answers.answers_match(_object("elapsed", "other", "template"), _object("beside", "near", "dataset")).alias("swapped"), answers.answers_match(_object("elapsed", "other", "template"), F.col("one").cast("string")).alias("inside"), answers.answers_match(F.col("elapsed").cast("string"), F.col("near").cast("string")).alias("scalar")),
    """select event_id, (abs(elapsed - beside) <= 0.1 and abs(other - near) <= 0.1) or (abs(elapsed - near) <= 0.1 and abs(other - beside) <= 0.1) as swapped,
      abs(elapsed - one) <= 0.1 or abs(other - one) <= 0.1 as inside, abs(elapsed - near) <= 0.1 as scalar
    from (select event_id, elapsed, other, elapsed + (event_id % 5) * 0.04::double as near, other + (event_id % 3) * 0.08::double as beside, elapsed + (event_id % 7) * 0.06::double as one
      from (select event_id, elapsed, elapsed + (event_id % 4) * 3.0::double as other from runs))""",
)


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected answers, and actual ones under other names of keys, some without a key or no object."""
    r = shifted(spark, sf_dir).withColumn("text", F.concat(F.lit(" "), F.upper("template"), F.lit(" ")))
    want = F.to_json(F.struct(F.col("elapsed").alias("association_score"), F.array("template", "dataset").alias("columns"), (F.col("event_id") % 3).alias("n_influential")))
    named = lambda score, n: F.to_json(F.struct(F.col("near").alias(score), F.array("dataset", "template").alias("pair"), (F.col("event_id") % 3).alias(n), F.lit("x").alias("more")))
    kind = F.col("event_id") % 5
    given = F.when(kind == 0, named("Corr", "n-significant")).when(kind == 1, named("Association-Score", "N_Influential")).when(kind == 2, named("spearman_rho", "n")).when(kind == 3, F.col("near").cast("string")).otherwise(named("rho", "how_many"))
    return r.select("event_id", want.alias("expected"), given.alias("actual"))


def _episode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    sources = F.element_at(F.array(*map(F.lit, (*episodes.SOURCES, "other"))), (F.col("question_id") % 4 + 1).cast("int"))
    questions = r.select("question_id", "difficulty").distinct().withColumn("source", sources)
    return episodes.assemble(questions, r)


query(
    "rec_episodes",
    lambda s, d: _episode_records(s, d).select("question_id", "source", "verified", "triangulation.n_runs", "triangulation.n_succeeded", "triangulation.majority_count", F.size("timing.elapsed").cast("long").alias("n_times"), F.round("timing.gold_elapsed", 3).alias("gold_elapsed"), F.round("timing.total_elapsed", 3).alias("total_elapsed"), F.round("timing.avg_elapsed", 6).alias("avg_elapsed"), "error"),
    """select q.question_id, q.source, coalesce(abs(g.number - v.majority) <= 0.1, false) as verified, coalesce(v.total, 0)::bigint as n_runs, coalesce(v.succeeded, 0)::bigint as n_succeeded, coalesce(v.majority_votes, 0)::bigint as majority_count,
      t.n_times, round(t.gold, 3) as gold_elapsed, round(t.total, 3) as total_elapsed, round(t.total / (1 + t.n_times), 6) as avg_elapsed, case when q.source = 'other' then 'unknown source: other' end as error
    from (select question_id, (['llm_gen', 'template', 'procedural', 'other'])[question_id % 4 + 1] as source from runs group by 1) q
    left join gold g on g.question_id = q.question_id left join votes v on v.question_id = q.question_id
    left join (select question_id, count(*) filter (where idx > 0) as n_times, coalesce(max(elapsed) filter (where idx = 0), 0) as gold, sum(elapsed) as total from runs group by 1) t on t.question_id = q.question_id""",
)
query(
    "rec_runs_wanted",
    lambda s, d: runs(s, d).groupBy("question_id", "difficulty").agg(F.count("*").alias("n")).select("question_id", episodes.runs_wanted(F.lower("difficulty"), 3, {"EASY": 2, "HARD": 7, "VERY_HARD": 0}).cast("long").alias("wanted"), (F.col("n") - 1).alias("have")),
    "select question_id, case any_value(difficulty) when 'EASY' then 2 when 'HARD' then 7 when 'VERY_HARD' then 1 else 3 end::bigint as wanted, count(*) - 1 as have from runs group by 1",
)
query(
    "rec_top_with_ties",
    lambda s, d: ordered.top_with_ties(runs(s, d).where("number is not null").groupBy("number").agg(F.count("*").alias("n")), "n", 7).unionAll(ordered.top_with_ties(runs(s, d).groupBy("number").agg((F.count("*") % 5).alias("n")), "n", 3, False)),
    """select number, n from (select number, count(*) as n, rank() over (order by count(*) desc) as r from runs where number is not null group by 1) where r <= 7
    union all select number, n from (select number, count(*) % 5 as n, rank() over (order by count(*) % 5) as r from runs group by 1) where r <= 3""",
)
query(
    "rec_report_json",
    lambda s, d: evaluation.report_json({"kinds": runs(s, d).groupBy("template").agg(F.count("*").alias("n"), F.round(F.avg("elapsed"), 3).alias("mean")), "sets": evaluation.counts_by(runs(s, d), ["dataset"])}, {"kinds": ["template"], "sets": ["grp"]}, "Runs").select(F.from_json("value", "title string, kinds array<struct<template:string,n:long,mean:double>>, sets array<struct<dimension:string,grp:string,n:long>>").alias("r")).select("r.title", F.posexplode("r.kinds").alias("place", "k"), F.size("r.sets").cast("long").alias("n_sets")).select("title", F.col("place").cast("long").alias("place"), "k.*", "n_sets"),
    "select 'Runs' as title, row_number() over (order by template) - 1 as place, template, count(*) as n, round(avg(elapsed), 3) as mean, (select count(distinct dataset) from runs) as n_sets from runs group by template",
)
query(
    "rec_alias_match",
    lambda s, d: answers.with_alias_match(_renamed(s, d), "expected", "actual").select("event_id", "matched", "reason"),
    """select event_id, reason = 'match' as matched, reason from (
      select event_id, case event_id % 5 when 2 then 'missing keys: n_influential' when 3 then 'actual answer is not an object' when 4 then 'missing keys: association_score, n_influential'
        else case when abs(elapsed - (elapsed + (event_id % 5) * 0.04::double)) <= 0.1 then 'match' else 'value mismatch' end end as reason from runs)""",
)
def _prices(spark: SparkSession, sf_dir: str, off: float, less: str = "false") -> DataFrame:
    """Results of two ways to one table: sums a customer, columns the other way about, off by a share."""
    o = table(spark, sf_dir, "orders").where(f"not ({less})")
    total = F.sum("o_totalprice").cast("double")
    return o.groupBy("o_custkey").agg((total * (1 + off)).alias("total"), F.count("*").alias("n")).select("total", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("name"), "n", "o_custkey")


def _table_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _prices(spark, sf_dir, 0.0).select("o_custkey", "n", "name", "total")
    cases = {"close": (_prices(spark, sf_dir, 0.01), 0.02), "far": (_prices(spark, sf_dir, 0.05), 0.02), "fewer": (_prices(spark, sf_dir, 0.0, "o_custkey % 7 = 0"), 0.02), "columns": (a.drop("n"), 0.02)}
    return reduce(DataFrame.unionAll, (tables.tables_match(a, b, t).select(F.lit(name).alias("case_name"), "matched", "reason", "rows_a", "rows_b", "different_rows") for name, (b, t) in cases.items()))


query(
    "rec_tables_match",
    _table_cases,
    """select * from (with totals as (select o_custkey as k, sum(o_totalprice)::double as t, count(*) as n from orders group by 1)
    select 'close' as case_name, n_far = 0 as matched, case when n_far = 0 then 'match' else 'other values' end as reason, n as rows_a, n as rows_b, n_far as different_rows
      from (select count(*) as n, count(*) filter (where t - t * 1.01 < -0.02 - 0.02 * t * 1.01) as n_far from totals)
    union all select 'far', n_far = 0, case when n_far = 0 then 'match' else 'other values' end, n, n, n_far
      from (select count(*) as n, count(*) filter (where t - t * 1.05 < -0.02 - 0.02 * t * 1.05) as n_far from totals)
    union all select 'fewer', false, 'other number of rows', count(a.k), count(b.k), count(*) filter (where a.name is distinct from b.name) from
      (select *, row_number() over (order by n, name, k, t) as i from (select k, n, 'c' || k as name, t from totals)) a full join
      (select *, row_number() over (order by n, name, k, t) as i from (select k, n, 'c' || k as name, t from totals where k % 7 <> 0)) b using (i)
    union all select 'columns', false, 'other columns', null, null, null)""",
)
query(
    "rec_result_as_answer",
    lambda s, d: answers.normalized(runs(s, d).groupBy("template").agg(F.count("*").alias("n")).orderBy("template")).select(F.from_json("answer", "map<string,long>").alias("m")).select(F.explode("m").alias("template", "n")),
    "select template, count(*) as n from runs group by 1",
)

# --- turns


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty events make a trace of turns; an error event is a turn that raised."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.floor(F.col("event_id") / 40).alias("trace_id"),
        (F.col("event_id") % 40).alias("turn_index"),
        (~failed).alias("success"),
        F.concat(F.lit("x = "), F.col("user_id").cast("string"), F.lit("\n  y = "), (F.col("event_id") % 3).cast("string"), F.lit("\n")).alias("code"),
        F.when(failed, F.concat(F.lit("Traceback (most recent call last):\n  File 'a'\nKeyError: 'a'\nValueError: user "), F.col("user_id").cast("string"))).otherwise("").alias("stderr"),
    )


query(
    "rec_self_corrections",
    lambda s, d: traces.self_corrections(steps(s, d)).select("trace_id", "turn_index", "corrects_turn", "error_type", "error_message", "attempts", F.array_join("removed", "|").alias("removed"), F.array_join("added", "|").alias("added")),
    """, s as (select event_id // 40 as trace_id, event_id % 40 as turn_index, event_type <> 'error' as success, user_id as x, event_id % 3 as y from events),
    w as (select *, max(case when not success then turn_index end) over v as f, max(case when success then turn_index end) over v as o from s window v as (partition by trace_id order by turn_index rows between unbounded preceding and 1 preceding))
    select w.trace_id, w.turn_index, w.f as corrects_turn, 'ValueError' as error_type, 'user ' || p.x as error_message, w.turn_index - w.f as attempts,
    concat_ws('|', case when p.x <> w.x then 'x = ' || p.x end, case when p.y <> w.y then 'y = ' || p.y end) as removed, concat_ws('|', case when p.x <> w.x then 'x = ' || w.x end, case when p.y <> w.y then 'y = ' || w.y end) as added
    from w join s p on p.trace_id = w.trace_id and p.turn_index = w.f where w.success and w.f is not null and (w.o is null or w.f > w.o) and (p.x <> w.x or p.y <> w.y)""",
)


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of each event: a hook line, for some a broken one, an unmarked one and a submission."""
    r = runs(spark, sf_dir)
    line = lambda mark, body: F.concat(F.lit(mark + " "), body)
    hook = F.to_json(F.struct(F.lit(True).alias(traces.HOOK_KEY), F.concat(F.lit("v"), F.col("idx").cast("string")).alias("variable_name"), F.lit("v = df.x.mean()").alias("code_line"), F.col("k").alias("value"), F.concat(F.lit("h"), (F.col("k") % 5).cast("string")).alias("value_hash")))
    parts = [
        F.lit("some text"),
        line(traces.HOOK_MARK, hook),
        F.when(F.col("event_id") % 3 == 0, line(traces.HOOK_MARK, F.lit('{"broken'))),
        F.when(F.col("event_id") % 4 == 0, line(traces.HOOK_MARK, F.lit('{"value": 1}'))),
        F.when(F.col("success"), line(traces.SUBMIT_MARK, F.concat(F.lit(f'{{"{traces.ANSWER_KEY}": '), F.col("answer"), F.lit("}")))),
    ]
    return r.select(F.col("event_id").alias("run_id"), F.concat_ws("\n", *parts).alias("stdout"), "question_id", "idx", "k")


def found_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.hooks(traces.output_records(outputs(spark, sf_dir)))


query("rec_output_hooks", lambda s, d: found_hooks(s, d).select("run_id", "variable_name", "code_line", "value", "value_hash"), "select event_id as run_id, 'v' || idx as variable_name, 'v = df.x.mean()' as code_line, k::varchar as value, 'h' || (k % 5) as value_hash from runs")
query("rec_output_submissions", lambda s, d: traces.submissions(traces.output_records(outputs(s, d))).select("run_id", F.col("answer").cast("double").alias("answer"), "n_submissions"), "select event_id as run_id, number as answer, 1::bigint as n_submissions from runs where success")


def _hook_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = found_hooks(spark, sf_dir).select((F.floor(F.col("run_id") / 8)).alias("q"), (F.col("run_id") % 8).alias("idx"), "value_hash")
    side = lambda low, high: h.where(F.col("idx").between(low, high)).select(F.col("q").alias("run_id"), "value_hash")
    return side(0, 3), side(4, 7)


_SIDES = ", hk as (select question_id as run_id, idx, 'h' || (k % 5) as h from runs), a as (select run_id, h from hk where idx < 4), e as (select run_id, h from hk where idx >= 4)"
query(
    "rec_hook_scores",
    lambda s, d: traces.hook_scores(*_hook_sides(s, d)),
    _SIDES + """, p as (select coalesce(x.run_id, y.run_id) as run_id, count(x.h) as n_actual, count(y.h) as n_expected, count(*) filter (where x.h is not null and y.h is not null) as matches
    from (select distinct * from a) x full join (select distinct * from e) y on x.run_id = y.run_id and x.h = y.h group by 1)
    select run_id, matches, n_actual, n_expected, round(coalesce(matches / nullif(n_expected, 0), 0), 4) as recall, round(coalesce(matches / nullif(n_actual, 0), 0), 4) as "precision" from p""",
)
query(
    "rec_hook_rewards",
    lambda s, d: traces.hook_rewards(*_hook_sides(s, d), gold(s, d).select(F.col("question_id").alias("run_id"), F.col("success").alias("matched"))),
    _SIDES + " select g.question_id as run_id, coalesce(n, 0) as n_hits, round(coalesce(n, 0) * 0.1::double + case when g.success then 1.0 else 0.0 end, 4) as reward from gold g left join (select run_id, count(*) as n from a where exists (select 1 from e where e.run_id = a.run_id and e.h = a.h) group by 1) h on h.run_id = g.question_id",
)
query("rec_trace_metrics", lambda s, d: traces.trace_metrics(table(s, d, "conversations")), "select conv_id, count(*) filter (where role = 'assistant') as n_turns, coalesce(sum(length(text)), 0)::bigint as n_chars, coalesce(sum(length(text)), 0)::bigint // 4 as est_tokens from conversations group by 1")
query(
    "rec_hook_grounding",
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", traces.grounded(F.regexp_replace(F.split("text", "\n")[0], " ", "  "), F.col("text")).alias("exact"), traces.grounded_anywhere(F.substring("text", 3, 12), F.col("text")).alias("anywhere")),
    r"select conv_id, turn, regexp_matches(split_part(text, chr(10), 1), '\S') as exact, regexp_matches(substr(text, 3, 12), '\S') as anywhere from conversations",
)
query(
    "rec_code_cells",
    lambda s, d: _cells(s, d).select("conv_id", "turn", F.size(traces.code_cells(F.col("m"))).cast("long").alias("n_cells"), F.md5(F.array_join(traces.code_cells(F.col("m")), "|")).alias("cells"), traces.reasoning(F.col("m")).alias("reasoning"), traces.cell_feedback(F.col("m")).alias("feedback")),
    """select conv_id, turn, (case when turn % 4 in (1, 3) then 1 when turn % 4 = 2 then 2 else 0 end)::bigint as n_cells,
    md5(case when turn % 4 in (1, 3) then 'x = ' || conv_id || chr(10) when turn % 4 = 2 then 'x = ' || conv_id || chr(10) || '|' || 'y' || chr(10) else '' end) as cells,
    case when turn % 4 = 0 and conv_id % 2 = 0 then 'think' || chr(10) || '```python' || chr(10) || 'x' else 'think' end as reasoning, case when turn % 4 = 2 then 'several code blocks' when turn % 4 = 0 and conv_id % 2 = 0 then 'code block without end' when turn % 4 = 0 then 'no code block' end as feedback from conversations""",
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda code: F.concat(F.lit("```python\n"), code, F.lit("\n```"))
    x = F.concat(F.lit("x = "), F.col("conv_id").cast("string"))
    kind = F.col("turn") % 4
    text = F.when(kind.isin(1, 3), F.concat(F.lit("think\n"), cell(x))).when(kind == 2, F.concat(F.lit("think\n"), cell(x), F.lit("\nand\n"), cell(F.lit("y")))).when(F.col("conv_id") % 2 == 0, F.lit("think\n```python\nx")).otherwise("think")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("m"))


# --- evaluation


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select(((F.col("k") % 3) == 0).alias("matched"), F.col("success").alias("executed"), F.col("k").alias("n_turns"), "elapsed", "template", "difficulty", (F.col("k") % 5 / 4).alias("recall"), (F.col("k") % 7 / 6).alias("precision"), F.concat(F.lit("procedural_"), F.element_at(F.array(*map(F.lit, ("mean_age", "filter_sum", "groupby_count_x", "x", "sort_first"))), (F.col("k") % 5 + 1).cast("int"))).alias("name"))


_RES = ", res as (select *, k % 3 = 0 as matched, 'procedural_' || (['mean_age', 'filter_sum', 'groupby_count_x', 'x', 'sort_first'])[k % 5 + 1] as name, (['mean', 'filter>sum', 'groupby>count', '', 'sort>first'])[k % 5 + 1] as seq from runs)"
_ACC = "count(*) as total, count(*) filter (where matched) as correct, round((count(*) filter (where matched)) / count(*), 4) as accuracy"
query("rec_accuracy", lambda s, d: evaluation.accuracy(results(s, d), "difficulty"), _RES + f" select coalesce(difficulty, '(all)') as grp, {_ACC}, round((count(*) filter (where success)) / count(*), 4) as execution_rate, round(avg(k), 3) as avg_turns, round(avg(elapsed), 3) as avg_elapsed from res group by rollup(difficulty)")
query("rec_synthetic_accuracy", lambda s, d: evaluation.synthetic_accuracy(results(s, d), ["difficulty", "template"]), _RES + " " + " union all ".join(f"select '{n}' as dimension, {g} as grp, {_ACC}, round(avg((k % 5) / 4), 4) as avg_recall, round(avg((k % 7) / 6), 4) as avg_precision from res group by 1, 2" for n, g in (("all", "'(all)'"), ("difficulty", "difficulty"), ("template", "template"))))
for _how, _keys in (("prefix", "'procedural'"), ("sequence", "seq"), ("both", "both")):
    _p, _s = ("prefix" if _how != "sequence" else "null::varchar as prefix"), ("sequence" if _how != "prefix" else "null::varchar as sequence")
    _g = {"prefix": "(prefix)", "sequence": "(sequence)", "both": "(prefix, sequence)"}[_how]
    query(
        f"rec_pass_rates_by_{_how}",
        lambda s, d, h=_how: evaluation.grouped_pass_rates(results(s, d), "name", "matched", h),
        _RES + f" select {_p}, {_s}, count(*) as total, count(*) filter (where matched) as passed, count(*) filter (where not matched) as failed, round((count(*) filter (where matched)) / count(*), 4) as pass_rate from (select 'procedural' as prefix, seq as sequence, matched from res) group by grouping sets ({_g}, ())",
    )


def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's runs as one episode row with what the label counts look at."""
    g = gold(spark, sf_dir).select("question_id", F.col("success").alias("gold_success"), F.col("answer").alias("gold_answer"), F.when(F.col("k") % 2 == 0, F.col("k")).otherwise(0).alias("n_hooks"), (F.col("k") > 80).alias("gold_exec_error"), (F.col("k") % 11 == 0).cast("int").alias("n_silent_turns"), (F.col("k") % 3 == 0).alias("verified"), "elapsed", "template", "dataset", "difficulty", "ts")
    v = votes(spark, sf_dir).select("question_id", F.col("total").alias("n_runs"), F.col("succeeded").alias("n_succeeded"), F.col("majority_votes").alias("majority_count"))
    return g.join(v, "question_id", "left")


_EP = ", ep as (select g.*, case when k % 2 = 0 then k else 0 end as n_hooks, k > 80 as exec_error, k % 11 = 0 as silent, k % 3 = 0 as verified, v.total as n_runs, v.succeeded as n_succeeded, v.majority_votes from gold g left join votes v using (question_id))"


def _counted(tests: dict[str, str]) -> str:
    return _EP + " select label, n, round(n * 100 / t, 1) as pct from (" + " union all ".join(f"select '{k}' as label, count(*) filter (where {c}) as n, count(*) as t from ep" for k, c in tests.items()) + ") where n > 0"


query("rec_quality_labels", lambda s, d: evaluation.quality_labels(episode_rows(s, d)), _counted({"gold_no_answer": "number is null", "all_consistency_failed": "n_runs > 0 and n_succeeded = 0", "verified_but_no_gold_answer": "verified and number is null", "gold_no_hooks": "n_hooks = 0", "code_but_no_output": "silent"}))
query("rec_failure_labels", lambda s, d: evaluation.failure_labels(episode_rows(s, d)), _counted({"gold_failed": "not success", "gold_no_answer": "number is null", "gold_exec_error": "exec_error", "gold_no_hooks": "n_hooks = 0", "consistency_all_failed": "n_runs > 0 and n_succeeded = 0", "low_agreement": "n_runs > 0 and majority_votes < n_runs // 2 + 1", "unverified": "not verified"}))
query("rec_throughput", lambda s, d: evaluation.throughput(runs(s, d), "template", "ts"), "select template as grp, count(*) as n, case when max(ts) > min(ts) then round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1e6) * 3600, 3) end as per_hour from runs group by 1")
query(
    "rec_seconds_per_trace",
    lambda s, d: evaluation.seconds_per_trace(episode_rows(s, d).withColumn("total_elapsed", F.col("elapsed")), "difficulty", {"EASY": 400, "HARD": 100, "MEDIUM": 10**9}),
    _EP + " select difficulty as grp, count(*) as n, round(avg(elapsed / (1 + coalesce(n_runs, 0))), 4) as avg_seconds, case difficulty when 'EASY' then greatest(400 - count(*), 0) when 'HARD' then greatest(100 - count(*), 0) when 'MEDIUM' then greatest(1000000000 - count(*), 0) end as remaining from ep group by 1",
)
query("rec_two_arms", lambda s, d: evaluation.two_arms(runs(s, d).withColumn("arm", F.col("k") % 2 == 0), "arm", "success"), ", t as (select count(*) filter (where k % 2 = 0) as n_with, count(*) filter (where k % 2 <> 0) as n_without, count(*) filter (where k % 2 = 0 and success) as a, count(*) filter (where k % 2 <> 0 and success) as b from runs) select n_with, n_without, round(a / n_with, 4) as rate_with, round(b / n_without, 4) as rate_without, round(a / n_with - b / n_without, 4) as difference from t")
_DIMS = ("dataset", "difficulty", "template")
query("rec_counts_by", lambda s, d: evaluation.counts_by(runs(s, d), list(_DIMS)), "" + " union all ".join(f"select '{c}' as dimension, {c} as grp, count(*) as n from runs group by 1, 2" for c in _DIMS))
query("rec_top_counts", lambda s, d: evaluation.counts_by(runs(s, d), list(_DIMS), 3), "select dimension, grp, n from (select *, row_number() over (partition by dimension order by n desc, grp) as p from (" + " union all ".join(f"select '{c}' as dimension, {c} as grp, count(*) as n from runs group by 1, 2" for c in _DIMS) + ")) where p <= 3")

# --- manifests


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest line for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("line_no"),
        manifests.short_hash(F.concat_ws(":", F.col("user_id").cast("string"), "event_type")).alias("fingerprint"),
        F.col("event_type").alias("template_name"),
        F.concat(F.lit("d"), (F.col("user_id") % 10).cast("string")).alias("dataset"),
        F.when(F.col("event_id") % 2 == 0, "synthetic").otherwise("llm").alias("type"),
        F.when(F.col("value") > 20, "failure").otherwise("success").alias("status"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
    )


_LATEST = ", last as (select * from (select *, row_number() over (partition by fingerprint order by line_no desc) as p from entries) where p = 1)"
query("rec_manifest_latest", lambda s, d: manifests.latest(entries(s, d), ["fingerprint"], ["line_no"]), _LATEST + " select line_no, fingerprint, template_name, dataset, type, status, model from last")
query(
    "rec_manifest_datasets",
    lambda s, d: manifests.dataset_summary(entries(s, d)).withColumn("models", F.array_join("models", ",")),
    "select dataset, " + ", ".join(f"count(*) filter (where type = '{t}' and status = '{x}') as {t}_{x}" for t in ("synthetic", "llm") for x in ("success", "failure")) + ", string_agg(distinct model, ',' order by model) as models from entries group by 1",
)
query("rec_manifest_templates", lambda s, d: manifests.template_summary(entries(s, d)), "select template_name as template, count(*) filter (where status = 'success') as success, count(*) filter (where status <> 'success') as failure from entries where type = 'synthetic' group by 1")
query("rec_manifest_models", lambda s, d: manifests.model_summary(entries(s, d)), "select model, count(*) filter (where type = 'synthetic') as synthetic, count(*) filter (where type = 'llm') as llm, count(*) as total from entries group by 1")
for _retry in (False, True):
    query(
        "rec_uncached" + "_retrying" * _retry,
        lambda s, d, r=_retry: manifests.uncached(entries(s, d).select("fingerprint", "dataset", "template_name").distinct(), entries(s, d).where("line_no % 3 = 0"), r),
        f"select distinct fingerprint, dataset, template_name from entries where fingerprint not in (select fingerprint from entries where line_no % 3 = 0{' and status = $$success$$' if _retry else ''})",
    )
query(
    "rec_coverage_gaps",
    lambda s, d: manifests.coverage_gaps(table(s, d, "customer").select(F.col("c_custkey").alias("dataset")), table(s, d, "orders").select(F.col("o_custkey").alias("dataset")), table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("dataset"))),
    "select c_custkey as dataset, case when c_custkey not in (select o_custkey from orders) then 'no questions' else 'no episodes' end as gap from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
)
query(
    "rec_template_changes",
    lambda s, d: manifests.changes(table(s, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") % 7).alias("fingerprint")), table(s, d, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("name"), (F.col("l_quantity") % 7).cast("long").alias("fingerprint"))),
    """, e as (select distinct l_partkey as name, (l_quantity % 7)::bigint as fingerprint from lineitem where l_partkey % 3 <> 0)
    select p_partkey as name, case when p_partkey not in (select name from e) then 'new' else 'changed' end as change from part where not exists (select 1 from e where e.name = p_partkey and e.fingerprint = p_partkey % 7)""",
)
query(
    "rec_upsert",
    lambda s, d: manifests.upsert(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit("old").alias("state"), "lang"), table(s, d, "labels").select(F.col("doc_id").alias("id"), F.lit("new").alias("state"), F.col("quality").cast("string").alias("lang"))),
    "select doc_id as id, 'old' as state, lang from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'new', quality::varchar from labels",
)
query(
    "rec_with_paths",
    lambda s, d: manifests.with_paths(runs(s, d).select("event_id", "dataset"), s.range(7).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("dataset"), F.concat(F.lit("/data/"), F.col("id").cast("string"), F.lit(".csv")).alias("csv_path"))),
    "select event_id, dataset, '/data/' || substr(dataset, 2) || '.csv' as csv_path from runs where substr(dataset, 2)::int < 7",
)
query(
    "rec_unlocked_sources",
    lambda s, d: manifests.unlocked(table(s, d, "supplier").select(F.col("s_suppkey").alias("csv_source"), "s_nationkey"), table(s, d, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("csv_source"))),
    "select s_suppkey as csv_source, s_nationkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49 and l_discount > 0.09)",
)
query(
    "rec_question_fingerprints",
    lambda s, d: table(s, d, "benchmark").select("item_id", manifests.folded_question(F.col("text")).alias("folded"), manifests.question_fingerprint(F.col("text"), F.lit("abc")).alias("fingerprint")),
    r""", f as (select item_id, trim(regexp_replace(regexp_replace(lower(text), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+', ' ', 'g')) as folded from benchmark) select item_id, folded, substr(sha256(folded || chr(1) || 'abc'), 1, 16) as fingerprint from f""",
)
query(
    "rec_template_fingerprints",
    lambda s, d: table(s, d, "part").select("p_partkey", manifests.template_fingerprint(F.col("p_name"), F.array("p_brand", "p_type"), F.lit("{}"), F.lit("abc")).alias("fingerprint")),
    "select p_partkey, substr(sha256(p_name || chr(1) || p_brand || chr(2) || p_type || chr(1) || '{}' || chr(1) || 'abc'), 1, 16) as fingerprint from part",
)
query("rec_dataset_hash", lambda s, d: manifests.dataset_hash(table(s, d, "lineitem")))
query(
    "rec_quota_selection",
    lambda s, d: manifests.quota_selection(runs(s, d).select("event_id", "difficulty"), "event_id", "difficulty", manifests.quotas(1000, {"EASY": 0.35, "MEDIUM": 0.35, "HARD": 0.2, "VERY_HARD": 0.1})),
    "select event_id, difficulty from (select event_id, difficulty, row_number() over (partition by difficulty order by substr(md5(event_id::varchar), 1, 12), event_id) as p from runs) where p <= case difficulty when 'EASY' then 350 when 'MEDIUM' then 350 when 'HARD' then 200 else 100 end",
)
query(
    "rec_last_failures",
    lambda s, d: manifests.last_failures(runs(s, d).select("question_id", "idx", "success", F.concat(F.lit("e"), F.col("k").cast("string")).alias("error"))).select("question_id", "idx", "last_error"),
    "select question_id, idx, last_value(case when not success then 'e' || k end ignore nulls) over (partition by question_id order by idx rows between unbounded preceding and 1 preceding) as last_error from runs",
)
query(
    "rec_hash_sets",
    lambda s, d: runs(s, d).select("dataset", "template").distinct().exceptAll(runs(s, d).where("k > 95").select("dataset", "template").distinct()).unionByName(runs(s, d).where("k > 98").select("template", "dataset").distinct().intersect(runs(s, d).where("k < 1").select("template", "dataset").distinct())),
    "(select distinct dataset, template from runs except select dataset, template from runs where k > 95) union all (select dataset, template from runs where k > 98 intersect select dataset, template from runs where k < 1)",
)

# --- filters


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.lit(1).alias("one"), F.nullif("l_linenumber", F.col("l_linenumber")).alias("gone"))
    n = line.agg(F.count("*").alias("n_rows"))
    return column_profile(line).select("column", "kind", "missing_pct", "unique_count", F.col("column").rlike("(?i)(^id$|_id$|orderkey$)").alias("index_like")).crossJoin(F.broadcast(n))


_COLUMN = lambda c, kind: f"select '{c}' as \"column\", '{kind}' as kind, avg(({c} is null)::int) * 100 as missing, count(distinct {c}) as d, regexp_matches('{c}', '(?i)(^id$|_id$|orderkey$)') as index_like, count(*) as n from wide"
query(
    "rec_eligible_columns",
    lambda s, d: filters.eligible_columns(_profile(s, d)),
    """select "column", kind, case when missing >= 95 then 'heavy_missingness' when d <= 1 then 'zero_variance' when index_like or (n > 0 and d >= greatest(2, floor(n * 0.98))) then 'id_like_column' end as reason
    from (with wide as (select *, 1 as one, nullif(l_linenumber, l_linenumber) as gone from lineitem) """
    + " union all ".join(_COLUMN(c, k) for c, k in (("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_returnflag", "categorical"), ("one", "numeric"), ("gone", "numeric")))
    + ")",
)
query("rec_table_fitness", lambda s, d: filters.table_reason(_profile(s, d)), "select count(*) as n_rows, 6::bigint as n_columns, 3::bigint as n_eligible, case when count(*) < 50 then 'too_few_rows' end as reason from lineitem")
_TERMS = " or ".join(f"contains(low, '{t}')" for t in filters.METHOD_TERMS)
_NAMES = ["haus", "casa", "the", "that", "dans", "lein"]
query(
    "rec_question_fitness",
    lambda s, d: table(s, d, "documents").select("doc_id", filters.question_reason(F.col("text"), _NAMES).alias("reason")),
    f""", q as (select doc_id, lower(text) as low, text from documents) select doc_id, case when {_TERMS} then 'forbidden_method_terms' when {" or ".join(f"contains(low, '{n}')" for n in _NAMES if len(n) > 3)} then 'mentions_column_names'
    when len(regexp_extract_all(regexp_split_to_array(text, 'Return as JSON|e\\.g\\.:')[1], '[.!?]')) > 3 then 'too_many_sentences' end as reason from q""",
)
query(
    "rec_fit_programs",
    lambda s, d: filters.fit_programs(runs(s, d).select(F.col("event_id").alias("program_id"), F.when(F.col("idx") < 3, "scalar").when(F.col("idx") < 6, "test").otherwise("ranking").alias("kind"), (F.col("k") % 9).alias("n_ops"), F.lit(True).alias("submitted"), "answer", F.col("k").alias("n_rows"), F.when(F.col("idx").between(3, 5), F.col("k") / 1000).alias("p_value"), F.col("elapsed").alias("value"), (F.col("k") % 2 == 0).alias("tied"))),
    """, p as (select event_id as program_id, case when idx < 3 then 'scalar' when idx < 6 then 'test' else 'ranking' end as kind, k % 9 as n_ops, number, k, case when idx between 3 and 5 then k / 1000 end as p_value, elapsed from runs)
    select program_id, round(n_ops * n_ops + coalesce((1 - p_value) * 100, least(10 * ln(1 + abs(elapsed)), 100), 0), 4) as score from p
    where number is not null and (kind <> 'scalar' or k >= 30) and (kind <> 'test' or p_value <= 0.05) and (kind <> 'ranking' or k % 2 <> 0) order by score desc, program_id limit 50""",
)
query(
    "rec_output_fitness",
    lambda s, d: runs(s, d).select("event_id", filters.output_reason(F.when(F.col("k") % 10 == 0, "NaN").when(F.col("k") % 10 == 1, "[]").otherwise(F.col("answer")), F.col("k")).alias("reason")),
    "select event_id, case when k % 10 = 0 then 'nan_answer' when k % 10 = 1 then 'empty_answer' when number is null then 'no_answer_submitted' when k < 30 then 'too_few_rows' end as reason from runs",
)
query(
    "rec_statistical_format",
    lambda s, d: runs(s, d).select("event_id", filters.statistical_format(F.concat(F.when(F.col("k") % 2 == 0, "Yes").when(F.col("k") % 3 == 0, "no").otherwise("maybe"), F.when(F.col("k") % 5 == 0, ", p-value small").otherwise(F.concat(F.lit(", p = 0.0"), F.col("k").cast("string"))))).alias("ok")),
    "select event_id, (k % 2 = 0 or k % 3 = 0) and k % 5 <> 0 as ok from runs",
)


def _question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return r.select(
        F.col("event_id").alias("question_id"),
        F.when(F.col("k") % 13 > 0, F.col("event_id").cast("string")).alias("id"),
        F.element_at(F.array(*map(F.lit, ("llm_gen", "template", "procedural", "other"))), (F.col("k") % 4 + 1).cast("int")).alias("source"),
        "dataset",
        F.when(F.col("k") % 5 > 0, F.lit("What is it?")).alias("question_text"),
        F.when(F.col("k") % 7 > 0, F.lit("Calculate it.")).alias("question_mechanical"),
        "difficulty",
        (F.col("k") % 3).alias("n_steps"),
        F.lit("x").alias("code"),
        F.lit("1").alias("ground_truth"),
    )


query(
    "rec_contract_issues",
    lambda s, d: filters.contract_issues(_question_rows(s, d)).select("question_id", F.array_join("issues", "; ").alias("issues")),
    "select event_id as question_id, concat_ws('; ', 'no column hint', case when k % 13 = 0 then 'id is empty' end, case when k % 4 = 3 then 'unknown source' end, case when k % 3 = 0 then 'n_steps below 1' end, case when k % 35 = 0 then 'no text' end) as issues from runs",
)
query(
    "rec_fit_questions",
    lambda s, d: filters.fit_questions(_question_rows(s, d), None, []).select("question_id", "reason"),
    "select event_id as question_id, case when k % 4 in (1, 2) and k % 5 = 0 and k % 7 <> 0 then 'forbidden_method_terms' end as reason from runs",
)

# --- training rows


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)}).where("role = 'assistant'")
    hook = F.array(F.struct(F.lit("x = 1").alias("code_line"), F.when(F.col("turn") % 4 == 1, F.lit("x")).alias("variable_name"), F.length("text").cast("string").alias("value"), F.lit("h").alias("value_hash")))
    turns = pairs.select(
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("turn_index"),
        F.substring("text", 1, 20).alias("reasoning"),
        F.col("text").alias("code"),
        F.when(F.col("next_role") == "user", F.col("next_text")).alias("stdout"),
        F.lit(None).cast("string").alias("stderr"),
        F.when(F.col("conv_id") % 2 == 0, hook).alias("hooks"),
        F.when(F.col("turn") >= 3, F.lit("42")).alias("submitted"),
    )
    questions = c.groupBy(F.col("conv_id").alias("episode_id")).agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("question_text")).select("episode_id", "question_text", F.when(F.col("episode_id") % 5 == 0, "look").alias("hint"), (F.col("episode_id") % 3 == 0).alias("verified"), F.lit("abcd").alias("answer_hash"))
    return training.episodes(turns, questions)


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("episode_id", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "\u0001")).alias("content"))


_BLOCK = "(case when coalesce(substr(text, 1, 20), '') <> '' then substr(text, 1, 20) || chr(10) || chr(10) else '' end || case when coalesce(text, '') <> '' then '```python' || chr(10) || text || chr(10) || '```' else '' end)"
_ASKED = "coalesce(question_text, '') || case when conv_id % 5 = 0 then chr(10) || chr(10) || 'Hint: look' else '' end"
_SYSTEM = training.SYSTEM_PROMPT


def _chat_sql(extra: str, after: str) -> str:
    return rf""", m as (
      select conv_id, 0 as a, 0 as b, 'system' as role, '{_SYSTEM}' || {extra} as content from questions union all select conv_id, 0, 1, 'user', {_ASKED} from questions
      union all select conv_id, turn_index + 1, 0, 'assistant', regexp_replace({_BLOCK}, '^\s+|\s+$', '', 'g') from turns {after}
    ), o as (select *, row_number() over (partition by conv_id order by a desc, b desc) as back from m where conv_id in (select conv_id from turns))
    select conv_id as episode_id, count(*) as n_messages, md5(string_agg(role || '|' || content, chr(1) order by a, b)) as content from o where not (back = 1 and role = 'user') group by 1"""


_OUT = "case when next_role = 'user' then coalesce(next_text, '') else '' end"
query("rec_chat", lambda s, d: _told(training.training_rows(_episodes(s, d), "sft-standard")), _chat_sql("''", f"union all select conv_id, turn_index + 1, 1, 'user', regexp_replace('[stdout]:' || chr(10) || {_OUT}, '^\\s+|\\s+$', '', 'g') from turns where {_OUT} <> ''"))
query(
    "rec_interleaved_chat",
    lambda s, d: _told(training.training_rows(_episodes(s, d), "sft-interleaved")),
    _chat_sql(
        "chr(10) || chr(10) || 'After writing code, predict what values will be computed before seeing the output.'",
        f"""union all select conv_id, turn_index + 1, 1, 'user', 'Predict the intermediate values:' from turns where conv_id % 2 = 0
        union all select conv_id, turn_index + 1, 2, 'assistant', case when turn_index % 4 = 1 then 'x' else 'result' end || ' = ' || length(text) from turns where conv_id % 2 = 0
        union all select conv_id, turn_index + 1, 3, 'user', 'Predict the submitted answer:' from turns where turn_index >= 3 union all select conv_id, turn_index + 1, 4, 'assistant', '42' from turns where turn_index >= 3
        union all select conv_id, turn_index + 1, 5, 'user', '[actual output]:' || chr(10) || {_OUT} from turns where {_OUT} <> ''""",
    ),
)
query(
    "rec_scored_steps",
    lambda s, d: training.training_rows(_episodes(s, d), "prm").select("episode_id", F.col("turn_index").cast("long").alias("turn_index"), "step_type", "variable_name", "value", "value_hash", "label", F.size(F.from_json("prefix", "array<struct<role:string,content:string>>")).cast("long").alias("n_prefix")),
    f""", t as (select *, row_number() over (partition by conv_id order by turn_index) - 1 as i, 2 + coalesce(sum(1 + ({_OUT} <> '')::int) over (partition by conv_id order by turn_index rows between unbounded preceding and 1 preceding), 0) as n_prefix from turns)
    select conv_id as episode_id, i as turn_index, 'hook' as step_type, case when turn_index % 4 = 1 then 'x' end as variable_name, length(text)::varchar as value, 'h' as value_hash, case when conv_id % 3 = 0 then 1.0 else 0.0 end::double as label, n_prefix::bigint as n_prefix from t where conv_id % 2 = 0
    union all select conv_id, i, 'submit', 'answer', '42', 'abcd', case when conv_id % 3 = 0 then 1.0 else 0.0 end::double, n_prefix::bigint from t where turn_index >= 3""",
)
query(
    "rec_verification_records",
    lambda s, d: training.verification_records(_episodes(s, d)).select("episode_id", F.md5("prompt").alias("prompt"), "expected_hash", F.col("n_hooks").cast("long").alias("n_hooks")),
    f"select conv_id as episode_id, md5({_ASKED}) as prompt, 'abcd' as expected_hash, case when conv_id % 2 = 0 then (select count(*) from turns t where t.conv_id = q.conv_id) else 0 end as n_hooks from questions q where verified",
)
_STDOUT = f"""'some text' || chr(10) || '{traces.HOOK_MARK} ' || '{{"{traces.HOOK_KEY}":true,"variable_name":"v' || idx || '","code_line":"v = df.x.mean()"' || coalesce(',"value":' || k || ',"value_hash":"h' || (k % 5) || '"', '') || '}}'
  || case when event_id % 3 = 0 then chr(10) || '{traces.HOOK_MARK} {{"broken' else '' end || case when event_id % 4 = 0 then chr(10) || '{traces.HOOK_MARK} {{"value": 1}}' else '' end
  || case when success then chr(10) || '{traces.SUBMIT_MARK} {{"{traces.ANSWER_KEY}": ' || number || '}}' else '' end"""
query(
    "rec_truncated_outputs",
    lambda s, d: outputs(s, d).select("run_id", F.length("stdout").cast("long").alias("n"), F.md5(traces.truncated_output(F.col("stdout"), 60)).alias("text")),
    f"""select event_id as run_id, length(o) as n, md5(case when length(o) <= 60 then o else substr(o, 1, 60) || chr(10) || '... [' || (length(o) - 60) || ' characters left out]'
      || case when success then chr(10) || '{traces.SUBMIT_MARK} {{"{traces.ANSWER_KEY}": ' || number || '}}' else '' end end) as text from (select *, {_STDOUT} as o from runs)""",
)
query(
    "rec_chain_descriptions",
    lambda s, d: runs(s, d).select("event_id", verbal.mechanical(F.slice(F.array(*map(F.lit, ("select_numeric_cols", "pick_numeric_by_variance", "top_n", "mean"))), F.lit(1), (F.col("k") % 5).cast("int"))).alias("chain"), verbal.question(F.when(F.col("k") % 3 == 0, "winner").when(F.col("k") % 3 == 1, "comparison").otherwise("total"), F.lit("mean"), F.col("template"), F.col("dataset")).alias("question")),
    """select event_id, case when k % 5 = 0 then '' else 'First ' || array_to_string((['look at the numeric columns', 'take the one that varies most', 'top n', 'report the mean'])[1:k % 5], ', then ') || '.' end as chain,
    case k % 3 when 0 then 'Which ' || dataset || ' has the highest mean of ' || template || '?' when 1 then 'How does the mean of ' || template || ' differ between values of ' || dataset || '?' else 'What is the mean of ' || template || '?' end as question from runs""",
)

# --- records in text


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON lines, every 17th broken, with blank lines between."""
    c = table(spark, sf_dir, "conversations")
    whole = F.to_json(F.struct("conv_id", "turn", "role", F.length("text").alias("n")))
    line = F.when((F.col("conv_id") * 31 + F.col("turn")) % 17 == 0, F.substring(whole, 1, 14)).otherwise(whole)
    return c.select(F.explode(F.array(line, F.lit("  "))).alias("value"))


_FIELDS = "conv_id long, turn long, role string, n long"
query("src_json_lines", lambda s, d: records.parse_lines(_lines(s, d), _FIELDS), "select conv_id, turn, role, length(text) as n from conversations where (conv_id * 31 + turn) % 17 <> 0")
query("src_json_lines_counted", lambda s, d: records.parse_lines(_lines(s, d), _FIELDS, "counted").groupBy(F.col("_malformed").alias("malformed")).agg(F.count("*").alias("n"), F.sum("n").alias("chars")), "select (conv_id * 31 + turn) % 17 = 0 as malformed, count(*) as n, sum(case when (conv_id * 31 + turn) % 17 <> 0 then length(text) end)::bigint as chars from conversations group by 1")
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as CSV with line breaks in quotes, read again."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(folder)
    return read_csv(spark, folder)


query(
    "src_csv_scan",
    lambda s, d: _csv(s, d).select("conv_id", "turn", "role", F.md5("text").alias("text")),
    "select conv_id, turn, role, md5(nullif(text, '')) as text from conversations",
)


def _array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in one JSON array, some of them replaced by new ones, read again."""
    at = f"{shared_dir(spark)}/questions-{uuid.uuid4().hex}.json"
    kind = "id string, dataset string, elapsed double"
    rows = runs(spark, sf_dir).where("idx = 0").select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("id"), "dataset", "elapsed")
    records.write_json_array(rows, at, ["id"])
    records.upsert_json_array(spark, at, rows.where("elapsed > 50").withColumn("dataset", F.lit("new")), kind)
    return records.read_json_array(spark, at, kind)


query(
    "src_json_array_file",
    lambda s, d: _array_file(s, d).select("place", "id", "dataset", "elapsed"),
    "select (row_number() over (order by id) - 1)::int as place, id, dataset, elapsed from (select 'q' || question_id as id, case when elapsed > 50 then 'new' else dataset end as dataset, elapsed from gold)",
)
query(
    "src_json_array",
    lambda s, d: records.json_array(table(s, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("file")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("source"))))).alias("value")), "id long, source string").select("file", F.col("place").cast("long").alias("place"), "id", "source"),
    "select event_id // 50 as file, row_number() over (partition by event_id // 50 order by event_id) - 1 as place, event_id as id, event_type as source from events",
)
query(
    "src_chat_json",
    lambda s, d: _chats(s, d).select("event_id", records.chat_field(F.col("m"), "source").alias("source"), F.get_json_object(records.chat_json(F.col("m")), "$.n").cast("long").alias("n")),
    "select event_id, case when event_id % 5 < 4 then event_type end as source, case when event_id % 5 < 3 then k end as n from (select *, (props->>'$.k')::bigint as k from events)",
)


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    whole = F.to_json(F.struct(F.col("event_type").alias("source"), F.col("k").alias("n")))
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```\ndone")))
        .when(kind == 1, F.concat(F.lit("The answer is "), whole, F.lit(" as asked.")))
        .when(kind == 2, F.concat(F.lit("It is {'source': '"), F.col("event_type"), F.lit("', 'n': "), F.col("k").cast("string"), F.lit(", 'ok': True}")))
        .when(kind == 3, F.concat(F.lit('broken {"source": "'), F.col("event_type"), F.lit('", ')))
        .otherwise("nothing")
    )
    return e.select("event_id", text.alias("m"))


query(
    "src_dataset_names",
    lambda s, d: records.dataset_names(table(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/x/"), "p_brand", F.lit("/data.csv"))).otherwise(F.concat(F.lit("/x/"), "p_brand", F.lit(".csv"))).alias("path"))).distinct(),
    "select distinct case when p_partkey % 2 = 0 then '/x/' || p_brand || '/data.csv' else '/x/' || p_brand || '.csv' end as path, p_brand as dataset from part",
)
query(
    "src_descriptions",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(records.description(F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("subtitle"), F.when(F.col("doc_id") % 3 < 2, F.lit("T")).alias("title"))), F.col("text"))).alias("told")),
    r"select doc_id, md5(case when doc_id % 3 = 0 then coalesce(lang, 'T') when doc_id % 3 = 1 then 'T' else nullif(trim(array_to_string(string_split(text, '.')[1:3], '.'), ' '), '') end) as told from documents",
)
