"""What is fit to be asked: columns, tables, questions, program results, records that keep their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of method that a question must not use.
METHOD_TERMS = ("calculate", "group by", "groupby", "use pandas", "pandas", ".sort", ".value_counts", ".agg", "apply", "lambda")
# Limits.
MIN_ROWS, MIN_COLUMNS, MAX_MISSING, HEAVY_MISSING, ID_SHARE, MAX_SENTENCES, MIN_STAT_ROWS = 50, 2, 95.0, 95.0, 0.98, 3, 30


def column_reason(missing_pct: Column, unique_count: Column, index_like: Column, n_rows: Column) -> Column:
    """Why a column is no subject of questions, null if it is one: heavy_missingness, zero_variance or id_like_column."""
    ids = index_like | ((n_rows > 0) & (unique_count >= F.greatest(F.lit(2), F.floor(n_rows * ID_SHARE))))
    return F.when(missing_pct >= HEAVY_MISSING, "heavy_missingness").when(unique_count <= 1, "zero_variance").when(ids, "id_like_column")


def eligible_columns(profile: DataFrame) -> DataFrame:
    """profile(column, kind, missing_pct, unique_count, index_like, n_rows) -> column, kind and reason; datetimes are
    no subject either (reason unsupported_kind)."""
    reason = column_reason(F.col("missing_pct"), F.col("unique_count"), F.col("index_like"), F.col("n_rows"))
    return profile.select("column", "kind", F.when(~F.col("kind").isin("numeric", "categorical"), "unsupported_kind").otherwise(reason).alias("reason"))


def table_reason(profile: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, n_eligible and why the table is unfit, null if it is fit: too_few_rows, too_few_cols,
    all_heavy_missing or no_eligible_columns. A profile without rows is too_few_rows."""
    rows = profile.withColumn("ok", column_reason(F.col("missing_pct"), F.col("unique_count"), F.col("index_like"), F.col("n_rows")).isNull() & F.col("kind").isin("numeric", "categorical"))
    sums = rows.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_columns"), F.count_if("ok").alias("n_eligible"), F.count_if(F.col("missing_pct") >= MAX_MISSING).alias("_heavy"))
    reason = F.when(F.col("n_rows") < MIN_ROWS, "too_few_rows").when(F.col("n_columns") < MIN_COLUMNS, "too_few_cols").when(F.col("_heavy") == F.col("n_columns"), "all_heavy_missing").when(F.col("n_eligible") == 0, "no_eligible_columns")
    return sums.select("n_rows", "n_columns", "n_eligible", reason.alias("reason"))


def question_reason(text: Column, columns: list[str]) -> Column:
    """Why a question is unfit: forbidden_method_terms, mentions_column_names (of four letters or more) or
    too_many_sentences (marks . ! ? before 'Return as JSON' or 'e.g.:'); null if it is fit."""
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    names = [c.strip().lower() for c in columns if len(c.strip()) >= 4]
    asked = F.split(text, r"Return as JSON|e\.g\.:", 2)[0]
    return F.when(has(METHOD_TERMS), "forbidden_method_terms").when(has(names), "mentions_column_names").when(F.regexp_count(asked, F.lit("[.!?]")) > MAX_SENTENCES, "too_many_sentences")


def output_reason(answer: Column, n_rows: Column) -> Column:
    """Why a program's answer (JSON text) is unfit: no_answer_submitted, nan_answer, empty_answer or too_few_rows."""
    bare = F.trim(answer)
    return F.when(answer.isNull() | (bare == "null"), "no_answer_submitted").when(bare.isin("NaN", "nan"), "nan_answer").when(bare.isin("", '""', "[]", "{}"), "empty_answer").when(F.coalesce(n_rows, F.lit(0)) < MIN_STAT_ROWS, "too_few_rows")


def fit_questions(questions: DataFrame, profile_reason: str | None, columns: list[str]) -> DataFrame:
    """questions(question_id, source, question_text, question_mechanical) -> those and reason. An unfit table makes every
    question unfit; only template and procedural questions are read for their words."""
    text = F.coalesce(F.nullif("question_text", F.lit("")), F.col("question_mechanical"))
    own = F.when(F.col("source").isin("template", "procedural") & (F.coalesce(text, F.lit("")) != ""), question_reason(text, columns))
    return questions.withColumn("reason", F.lit(profile_reason) if profile_reason else own)


def interestingness(n_ops: Column, p_value: Column, value: Column) -> Column:
    """Length of the chain squared, and 100 (1 - p) of a test or else 10 ln(1 + |value|), 100 at most."""
    size = F.least(10 * F.log1p(F.abs(value)), F.lit(100.0))
    return n_ops * n_ops + F.coalesce((1 - p_value) * 100, size, F.lit(0.0))


def fit_programs(programs: DataFrame, alpha: float = 0.05, most: int = 50) -> DataFrame:
    """programs(program_id, kind, n_ops, submitted, answer, n_rows, p_value, value, tied) -> program_id and score of the
    `most` best fit ones (a report of the top; ties by program_id).

    Fit: submitted; an answer that is no NaN and not empty; scalar programs of MIN_STAT_ROWS rows; tests of a p_value
    of alpha at most; rankings without a tie.
    """
    whole = F.col("answer").isNotNull() & ~F.trim("answer").isin("NaN", "nan", "null", "", '""', "[]", "{}")
    ok = F.coalesce("submitted", F.lit(False)) & whole
    ok &= (F.col("kind") != "scalar") | (F.coalesce("n_rows", F.lit(0)) >= MIN_STAT_ROWS)
    ok &= (F.col("kind") != "test") | F.coalesce(F.col("p_value") <= alpha, F.lit(False))
    ok &= (F.col("kind") != "ranking") | ~F.coalesce("tied", F.lit(False))
    return programs.where(ok).select("program_id", F.round(interestingness(F.col("n_ops"), F.col("p_value"), F.col("value")), 4).alias("score")).orderBy(F.desc("score"), "program_id").limit(most)


def statistical_format(text: Column) -> Column:
    """Whether an answer reads as a test's: a yes or no, and a p value after it."""
    return F.coalesce(F.rlike(F.lower(text), F.lit(r"^\s*(yes|no)\b.*\bp\s*[=<>]\s*(0?\.\d+|[01](\.0*)?)")), F.lit(False))


#: Fields that a question must have, and of these the ones that must not be empty.
CONTRACT, REQUIRED = ("id", "source", "dataset", "question_text", "question_mechanical", "hint", "code", "ground_truth", "difficulty", "n_steps"), ("id", "source", "dataset")
SOURCES, DIFFICULTIES = ("llm_gen", "template", "procedural"), ("EASY", "MEDIUM", "HARD", "VERY_HARD")


def contract_issues(questions: DataFrame) -> DataFrame:
    """questions -> their columns and issues array<string>: missing columns and empty fields, unknown source or difficulty,
    a number of steps below 1, neither text nor mechanical description."""
    have = set(questions.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    absent = lambda c: F.coalesce(F.trim(col(c)), F.lit("")) == ""
    checks = [(F.lit(True), f"no column {c}") for c in CONTRACT if c not in have]
    checks += [(absent(c), f"{c} is empty") for c in REQUIRED if c in have]
    checks += [(~absent("source") & ~col("source").isin(*SOURCES), "unknown source"), (~absent("difficulty") & ~col("difficulty").isin(*DIFFICULTIES), "unknown difficulty")]
    checks += [(F.coalesce(col("n_steps").try_cast("int") < 1, F.lit(False)), "n_steps below 1"), (absent("question_text") & absent("question_mechanical"), "no text")]
    return questions.withColumn("issues", F.array_compact(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks))))
