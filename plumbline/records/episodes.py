"""Episodes: a question with what its gold run and its other runs gave, as one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answers import FLOAT_TOLERANCE, answer_distribution, answer_hash, answers_match

# Where questions may come from.
SOURCES = ("llm_gen", "template", "procedural")


def assemble(questions: DataFrame, traces: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """questions(question_id, source, ...), traces(question_id, idx, success, answer, elapsed), idx 0 being gold -> the questions'
    columns, episode_id, verified, gold_answer_hash, triangulation, timing and error, a row a question.

    triangulation: how many other runs there are and succeeded, the hash and votes of their majority, and whether gold agrees
    with it, which makes the episode verified. timing: seconds of gold, of the other runs in order, in all and on
    average; null times are 0. Of several gold runs the first by answer counts. episode_id is a hash of question and source, so that
    assembling twice gives the same. error names a source that is not among SOURCES. A question without runs has zeros.
    An episode holds the times of its runs in one row, by its purpose.
    """
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("answer").isNotNull()
    spent = F.coalesce(F.col("elapsed").cast("double"), F.lit(0.0))
    gold = traces.where("idx = 0").groupBy("question_id").agg(F.min(F.when(good, F.col("answer"))).alias("gold_answer"), F.max(spent).alias("gold_elapsed"))
    runs = traces.where("idx > 0")
    times = runs.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", spent.alias("s")))), lambda x: x["s"]).alias("others"))
    votes = answer_distribution(runs, tolerance).select("question_id", "total", "succeeded", "majority", "majority_votes")
    rows = questions.join(gold, "question_id", "left").join(times, "question_id", "left").join(votes, "question_id", "left")
    agrees = answers_match(F.col("gold_answer"), F.col("majority"), tolerance)
    rows = rows.withColumns({"_agrees": agrees, "_hash": answer_hash(F.col("majority")), "gold_answer_hash": answer_hash(F.col("gold_answer"))})
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    others = F.coalesce("others", F.array().cast("array<double>"))
    first = F.coalesce("gold_elapsed", F.lit(0.0))
    total = first + F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
    return rows.select(
        *questions.columns,
        F.sha2(F.concat_ws("\u0001", F.col("question_id").cast("string"), "source"), 256).substr(1, 32).alias("episode_id"),
        F.col("_agrees").alias("verified"),
        "gold_answer_hash",
        F.struct(number("total").alias("n_runs"), number("succeeded").alias("n_succeeded"), F.col("_hash").alias("majority_hash"), number("majority_votes").alias("majority_count"), F.col("_agrees").alias("gold_matches_majority")).alias("triangulation"),
        F.struct(first.alias("gold_elapsed"), others.alias("elapsed"), total.alias("total_elapsed"), (total / (1 + F.size(others))).alias("avg_elapsed")).alias("timing"),
        F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("(null)")))).alias("error"),
    )


def runs_wanted(difficulty: Column, default: int, by_difficulty: dict[str, int] | None = None) -> Column:
    """How many runs a question is to get: what its difficulty (in capitals, null as empty) asks for, else default; one at least."""
    if not by_difficulty:
        return F.lit(max(1, default))
    known = F.create_map(*(F.lit(x) for kv in by_difficulty.items() for x in kv))
    return F.greatest(F.lit(1), F.coalesce(F.try_element_at(known, F.upper(F.coalesce(difficulty, F.lit("")))), F.lit(default)))
