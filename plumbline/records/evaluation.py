"""Summaries of evaluated records: accuracy by any grouping, hook scores, quality issues, failure labels, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of template names that are operators.
OPERATOR_WORDS = ("mean", "max", "min", "sum", "count", "std", "var", "median", "filter", "groupby", "sort", "first", "last", "agg", "apply", "join", "merge", "pivot", "melt", "drop", "rename", "select")


def name_prefix(name: Column) -> Column:
    """What stands before a template name's first _, 'unknown' without a name."""
    return F.coalesce(F.substring_index(name, "_", 1), F.lit("unknown"))


def operator_sequence(name: Column) -> Column:
    """The operator words that follow a template name's prefix, joined by >, up to the first other word; '' if none."""
    words = F.slice(F.split(name, "_"), 2, 100)
    others = F.transform(words, lambda w: ~w.isin(*OPERATOR_WORDS))
    n = F.coalesce(F.nullif(F.array_position(others, True), F.lit(0)) - 1, F.size(words))
    return F.coalesce(F.array_join(F.slice(words, F.lit(1), n.cast("int")), ">"), F.lit(""))


def grouped_pass_rates(df: DataFrame, name: str, passed: str, how: str = "both") -> DataFrame:
    """(prefix, sequence, total, passed, failed, pass_rate) by name prefix, operator sequence or both, and over all (nulls
    in the columns that a row does not group by)."""
    keys = {"prefix": ["prefix"], "sequence": ["sequence"], "both": ["prefix", "sequence"]}[how]
    ok = F.coalesce(F.col(passed).cast("boolean"), F.lit(False))
    rows = df.select(name_prefix(F.col(name)).alias("prefix"), operator_sequence(F.col(name)).alias("sequence"), ok.alias("ok"))
    sums = rows.groupingSets([[F.col(k) for k in keys], []], *keys).agg(F.count("*").alias("total"), F.count_if("ok").alias("passed")).where("total > 0")
    told = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("prefix", "sequence")]
    return sums.select(*told, "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(F.col("passed") / F.col("total"), 4).alias("pass_rate"))


def accuracy(results: DataFrame, by: str) -> DataFrame:
    """results(matched, executed, n_turns, elapsed, `by`) -> a row for each value of `by` and one, '(all)', for all: total, correct,
    accuracy, execution_rate, avg_turns, avg_elapsed. Nulls count as not matched and not executed; of nothing, no row."""
    rows = results.select(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp"), F.coalesce("matched", F.lit(False)).alias("m"), F.coalesce("executed", F.lit(False)).alias("x"), "n_turns", "elapsed")
    sums = rows.rollup("grp").agg(F.count("*").alias("total"), F.count_if("m").alias("correct"), F.count_if("x").alias("ran"), F.avg("n_turns").alias("t"), F.avg("elapsed").alias("e")).where("total > 0")
    share = lambda c: F.round(F.col(c) / F.col("total"), 4)
    return sums.select(F.coalesce("grp", F.lit("(all)")).alias("grp"), "total", "correct", share("correct").alias("accuracy"), share("ran").alias("execution_rate"), F.round("t", 3).alias("avg_turns"), F.round("e", 3).alias("avg_elapsed"))


def synthetic_accuracy(results: DataFrame, by: list[str]) -> DataFrame:
    """results(matched, recall, precision, the columns of by) -> (dimension, grp, total, correct, accuracy, avg_recall,
    avg_precision) for each column of `by` and for all. One pass: the columns are unpivoted."""
    sides = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("(all)").alias("grp")), *(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("grp")) for c in by))
    rows = results.select(F.explode(sides).alias("g"), F.coalesce("matched", F.lit(False)).alias("m"), "recall", "precision").select("g.*", "m", "recall", "precision")
    sums = rows.groupBy("dimension", "grp").agg(F.count("*").alias("total"), F.count_if("m").alias("correct"), F.avg("recall").alias("r"), F.avg("precision").alias("p"))
    return sums.select("dimension", "grp", "total", "correct", F.round(F.col("correct") / F.col("total"), 4).alias("accuracy"), F.round("r", 4).alias("avg_recall"), F.round("p", 4).alias("avg_precision"))


def _labels(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    sums = rows.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(k) for k, c in tests.items()))
    each = sums.select("_n", F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in tests))).alias("x")).select("x.*", "_n")
    return each.where("n > 0").select("label", "n", F.round(F.col("n") * 100 / F.col("_n"), 1).alias("pct"))


def quality_labels(episodes: DataFrame) -> DataFrame:
    """episodes(verified, gold_answer, n_hooks, n_runs, n_succeeded, n_silent_turns) -> (label, n, pct) of those that occur:
    gold_no_answer, all_consistency_failed, verified_but_no_gold_answer, gold_no_hooks, code_but_no_output."""
    none = F.col("gold_answer").isNull()
    return _labels(episodes, {"gold_no_answer": none, "all_consistency_failed": (F.col("n_runs") > 0) & (F.col("n_succeeded") == 0), "verified_but_no_gold_answer": F.coalesce("verified", F.lit(False)) & none, "gold_no_hooks": F.coalesce("n_hooks", F.lit(0)) == 0, "code_but_no_output": F.col("n_silent_turns") > 0})


def failure_labels(episodes: DataFrame) -> DataFrame:
    """episodes(verified, gold_success, gold_answer, gold_exec_error, n_hooks, n_runs, n_succeeded, majority_count) -> (label, n, pct) of
    those that occur; low_agreement is a majority of under n_runs // 2 + 1 runs."""
    tests = {
        "gold_failed": ~F.coalesce("gold_success", F.lit(False)),
        "gold_no_answer": F.col("gold_answer").isNull(),
        "gold_exec_error": F.coalesce("gold_exec_error", F.lit(False)),
        "gold_no_hooks": F.coalesce("n_hooks", F.lit(0)) == 0,
        "consistency_all_failed": (F.col("n_runs") > 0) & (F.col("n_succeeded") == 0),
        "low_agreement": (F.col("n_runs") > 0) & (F.col("majority_count") < F.floor(F.col("n_runs") / 2) + 1),
        "unverified": ~F.coalesce("verified", F.lit(False)),
    }
    return _labels(episodes, tests)


def failure_breakdown(classes: DataFrame, by: str) -> DataFrame:
    """classes(category, entropy, `by`) -> (grp, total, good, ambiguous, too_hard, hint_necessary, execution_failure, avg_entropy)."""
    names = ("good", "ambiguous", "too_hard", "hint_necessary", "execution_failure")
    return classes.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp")).agg(F.count("*").alias("total"), *(F.count_if(F.col("category") == n).alias(n) for n in names), F.round(F.avg("entropy"), 4).alias("avg_entropy"))


def throughput(records: DataFrame, by: str, ts: str) -> DataFrame:
    """(grp, n, per_hour): records an hour between a group's first and last time; null for fewer than two times."""
    sums = records.where(F.col(ts).isNotNull()).groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp")).agg(F.count("*").alias("n"), F.min(F.col(ts).cast("timestamp")).alias("a"), F.max(F.col(ts).cast("timestamp")).alias("b"))
    seconds = (F.unix_micros("b") - F.unix_micros("a")) / 1e6
    return sums.select("grp", "n", F.when(seconds > 0, F.round(F.col("n") / seconds * 3600, 3)).alias("per_hour"))


def seconds_per_trace(episodes: DataFrame, by: str, wanted: dict[str, int]) -> DataFrame:
    """episodes(total_elapsed, n_runs, `by`) -> (grp, n, avg_seconds, remaining): mean seconds of a trace (gold and its runs), and how
    many episodes the group lacks to those wanted of it (null if none are)."""
    goal = F.try_element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("grp")) if wanted else F.lit(None).cast("int")
    rows = episodes.select(F.coalesce(F.col(by).cast("string"), F.lit("(null)")).alias("grp"), (F.col("total_elapsed") / (1 + F.coalesce("n_runs", F.lit(0)))).alias("s"))
    sums = rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("s").alias("s"))
    return sums.select("grp", "n", F.round("s", 4).alias("avg_seconds"), F.when(goal.isNotNull(), F.greatest(goal - F.col("n"), F.lit(0))).cast("long").alias("remaining"))


def two_arms(results: DataFrame, arm: str, passed: str) -> DataFrame:
    """One row: n, pass rate with (arm true) and without, and their difference."""
    with_, ok = F.coalesce(F.col(arm).cast("boolean"), F.lit(False)), F.coalesce(F.col(passed).cast("boolean"), F.lit(False))
    sums = results.agg(F.count_if(with_).alias("n_with"), F.count_if(~with_).alias("n_without"), F.count_if(with_ & ok).alias("a"), F.count_if(~with_ & ok).alias("b"))
    rate = lambda k, n: F.coalesce(F.col(k) / F.nullif(n, F.lit(0)), F.lit(0.0))
    a, b = rate("a", "n_with"), rate("b", "n_without")
    return sums.select("n_with", "n_without", F.round(a, 4).alias("rate_with"), F.round(b, 4).alias("rate_without"), F.round(a - b, 4).alias("difference"))


def counts_by(records: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """(dimension, grp, n): how many records each value of each column has; of a column the `top` most frequent ones if given
    (ties by value). Only a row a value is ranked."""
    from pyspark.sql import Window

    sides = F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias("grp")) for c in columns))
    sums = records.select(F.explode(sides).alias("g")).select("g.*").groupBy("dimension", "grp").agg(F.count("*").alias("n"))
    if top is None:
        return sums
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "grp"))
    return sums.withColumn("_p", place).where(F.col("_p") <= top).drop("_p")


def report_json(sections: dict[str, DataFrame], order: dict[str, list[str]], title: str = "") -> DataFrame:
    """(value): one row with a report as a JSON object: its title, and each section's rows as an array of objects, sorted by
    `order`. For summaries: a section comes together in one row. write_text and any JSON reader take it from there."""
    out = None
    for name, rows in sections.items():
        keys = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order[name])))
        each = F.collect_list(F.struct(keys.alias("k"), F.struct(*rows.columns).alias("r")))
        one = rows.agg(F.transform(F.sort_array(each), lambda x: x["r"]).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    assert out is not None, "a report has a section"
    return out.select(F.to_json(F.struct(F.lit(title).alias("title"), *sections), {"ignoreNullFields": "false"}).alias("value"))


def report(summary: DataFrame, title: str, most: int = 200) -> str:
    """A small summary table as Markdown; of a larger one the first `most` rows, which is said."""
    rows = summary.limit(most + 1).collect()
    names = summary.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
    return "\n".join([*lines, *(["", f"Only the first {most} rows."] if len(rows) > most else []), ""])
