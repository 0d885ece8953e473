"""Runs turn by turn: what output lines say, errors and their corrections, code differences, hooks, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Marks of hook and submission lines in output.
HOOK_MARK, SUBMIT_MARK = "📍 Hook:", "✓ Submitted:"
#: The keys that make such lines valid, unless others are given.
HOOK_KEY, ANSWER_KEY = "__hook__", "__answer__"
# What shows that a run raised.
ERROR_SIGNS = ("Traceback (most recent call last):", "Error:", "Exception:")

_FENCE = r"(?s)```python\n(.*?)```"
_RAISED = r"(\w+%s): (.+)"


def code_cells(text: Column) -> Column:
    """The contents of a message's fenced python blocks, in order."""
    return F.regexp_extract_all(text, F.lit(_FENCE), F.lit(1))


def reasoning(text: Column) -> Column:
    """A message's text before its first fenced block."""
    return strip(F.regexp_replace(text, r"(?s)```python\n.*?```.*$", ""))


def cell_feedback(text: Column) -> Column:
    """What is wrong with a message's shape: no block, an open block, or several; null if it has just one."""
    n, fences = F.size(code_cells(text)), F.regexp_count(text, F.lit("```"))
    return F.when(n > 1, "several code blocks").when((n == 0) & (fences > 0), "code block without end").when(n == 0, "no code block")


def raised(output: Column) -> Column:
    """Whether an output shows an error."""
    out = F.lit(False)
    for sign in ERROR_SIGNS:
        out = out | F.contains(F.coalesce(output, F.lit("")), F.lit(sign))
    return out


def last_error(stderr: Column) -> Column:
    """struct<error_type, error_message> of the innermost error: the last line of the form SomethingError: message, else
    SomethingException: message; nulls if there is none."""
    kinds = []
    for suffix in ("Error", "Exception"):
        lines = F.regexp_extract_all(stderr, F.lit(_RAISED % suffix), F.lit(0))
        line = F.try_element_at(lines, F.lit(-1))
        kinds.append(F.when(line.isNotNull(), F.struct(F.regexp_extract(line, r"^(\w+): ", 1).alias("error_type"), strip(F.regexp_extract(line, r"^\w+: (.+)$", 1)).alias("error_message"))))
    return F.coalesce(*kinds, F.struct(F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message")))


def _lines(code: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(code, F.lit("")), r"\R"), strip), lambda x: x != ""))


def code_diff(before: Column, after: Column) -> Column:
    """struct<removed, added>: the trimmed lines that only one of two codes has, sorted."""
    return F.struct(F.sort_array(F.array_except(_lines(before), _lines(after))).alias("removed"), F.sort_array(F.array_except(_lines(after), _lines(before))).alias("added"))


def output_records(outputs: DataFrame, hook_key: str = HOOK_KEY, answer_key: str = ANSWER_KEY) -> DataFrame:
    """outputs(run_id, stdout, ...) -> (run_id, line, kind, payload): the hook and submission lines whose JSON is valid and has
    its marker key, hook_key being true or answer_key being there. kind is hook or submit, payload the JSON text. Other lines, malformed JSON and null outputs give no rows."""
    each = outputs.select("run_id", F.posexplode(F.split("stdout", "\n")).alias("line", "text"))
    kind = F.when(F.contains("text", F.lit(HOOK_MARK)), "hook").when(F.contains("text", F.lit(SUBMIT_MARK)), "submit")
    rows = each.withColumns({"kind": kind, "payload": F.regexp_extract("text", r"(\{.*)$", 1)}).where("kind is not null")
    whole = F.try_parse_json("payload")
    marked = F.when(F.col("kind") == "hook", F.coalesce(F.try_variant_get(whole, f"$.{hook_key}", "boolean"), F.lit(False))).otherwise(F.get_json_object("payload", f"$.{answer_key}").isNotNull())
    return rows.where(whole.isNotNull() & marked).select("run_id", "line", "kind", "payload")


def hooks(records: DataFrame) -> DataFrame:
    """output_records -> (run_id, line, variable_name, code_line, value, value_hash) of its hooks; value is JSON text."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return records.where("kind = 'hook'").select("run_id", "line", get("variable_name").alias("variable_name"), F.coalesce(get("code_line"), F.lit("")).alias("code_line"), get("value").alias("value"), F.coalesce(get("value_hash"), F.lit("")).alias("value_hash"))


def submissions(records: DataFrame, answer_key: str = ANSWER_KEY) -> DataFrame:
    """output_records -> (run_id, answer, n_submissions): each run's first submission."""
    rows = records.where("kind = 'submit'").groupBy("run_id").agg(F.min_by("payload", "line").alias("payload"), F.count("*").alias("n_submissions"))
    return rows.select("run_id", F.get_json_object("payload", f"$.{answer_key}").alias("answer"), "n_submissions")


def self_corrections(turns: DataFrame) -> DataFrame:
    """turns(trace_id, turn_index, success, code, stderr) -> (trace_id, turn_index, corrects_turn, error_type, error_message,
    attempts, removed, added): turns that succeed after a failed one, if they changed the code.

    Only the latest failure since the last success counts, so every success takes up at most one. Without a known
    error the type is Unknown and the message the first 100 characters of stderr. A trace's turns meet in one window.
    """
    by = Window.partitionBy("trace_id").orderBy("turn_index")
    failed = F.when(~F.col("success"), F.struct("turn_index", "code", "stderr"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumns({"_f": F.last(failed, ignorenulls=True).over(before), "_s": F.max(F.when(F.col("success"), F.col("turn_index"))).over(before)})
    hit = rows.where(F.col("success") & F.col("_f").isNotNull() & (F.col("_s").isNull() | (F.col("_f.turn_index") > F.col("_s"))))
    out = hit.withColumns({"_e": last_error(F.col("_f.stderr")), "_d": code_diff(F.col("_f.code"), F.col("code"))})
    return out.where((F.size("_d.removed") > 0) | (F.size("_d.added") > 0)).select(
        "trace_id",
        "turn_index",
        F.col("_f.turn_index").alias("corrects_turn"),
        F.coalesce("_e.error_type", F.lit("Unknown")).alias("error_type"),
        F.coalesce("_e.error_message", F.substring("_f.stderr", 1, 100)).alias("error_message"),
        (F.col("turn_index") - F.col("_f.turn_index")).alias("attempts"),
        F.col("_d.removed").alias("removed"),
        F.col("_d.added").alias("added"),
    )


def trace_metrics(messages: DataFrame) -> DataFrame:
    """messages(conv_id, role, text) -> (conv_id, n_turns, n_chars, est_tokens): assistant turns, characters of all
    messages, a token for every four of them."""
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n_turns"), chars.alias("n_chars"), F.floor(chars / 4).alias("est_tokens"))


def hook_scores(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """actual and expected (run_id, value_hash) -> (run_id, matches, n_actual, n_expected, recall, precision) over the
    distinct hashes that are not null or empty, for every run of either; a share of nothing is 0."""
    sides = [df.where("coalesce(value_hash, '') <> ''").select("run_id", "value_hash").distinct().withColumns({"a": F.lit(a), "e": F.lit(1 - a)}) for df, a in ((actual, 1), (expected, 0))]
    pairs = sides[0].unionAll(sides[1]).groupBy("run_id", "value_hash").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    sums = pairs.groupBy("run_id").agg(F.sum(F.col("a") * F.col("e")).alias("matches"), F.sum("a").alias("n_actual"), F.sum("e").alias("n_expected"))
    every = actual.select("run_id").unionAll(expected.select("run_id")).distinct()
    share = lambda k: F.round(F.coalesce(F.col("matches") / F.nullif(k, F.lit(0)), F.lit(0.0)), 4)
    return every.join(sums, "run_id", "left").select("run_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("matches", "n_actual", "n_expected")), share("n_expected").alias("recall"), share("n_actual").alias("precision"))


def hook_rewards(actual: DataFrame, expected: DataFrame, final: DataFrame, each: float = 0.1, last: float = 1.0) -> DataFrame:
    """(run_id, n_hits, reward) for the runs of final(run_id, matched): `each` for every actual hook, repeated ones too,
    whose hash is expected in the run, and `last` for a right final answer."""
    wanted = expected.where("value_hash is not null").select("run_id", "value_hash").distinct()
    hits = actual.join(wanted, ["run_id", "value_hash"], "left_semi").groupBy("run_id").agg(F.count("*").alias("n_hits"))
    rows = final.join(hits, "run_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    return rows.select("run_id", "n_hits", F.round(F.col("n_hits") * each + F.when(F.coalesce("matched", F.lit(False)), last).otherwise(0.0), 4).alias("reward"))


def grounded(code_line: Column, code: Column) -> Column:
    """Whether every line of code_line, white space runs as one blank, is a line of the executed code; false for none."""
    fold = lambda x: F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\R"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    own = fold(code_line)
    return (F.size(own) > 0) & (F.size(F.array_except(own, fold(code))) == 0)


def grounded_anywhere(code_line: Column, code: Column) -> Column:
    """The looser rule of old records: code_line occurs in the code once white space runs are single blanks."""
    fold = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    return (fold(code_line) != "") & F.contains(fold(code), fold(code_line))


def truncated_output(output: Column, limit: int) -> Column:
    """An output of at most about `limit` characters: its head, a note, and the submission line if the cut would lose it."""
    line = F.regexp_extract(output, rf"(?m)^.*{SUBMIT_MARK}.*$", 0)
    head = F.substring(output, 1, limit)
    note = F.concat(F.lit("\n... ["), (F.length(output) - limit).cast("string"), F.lit(" characters left out]"))
    lost = (line != "") & ~F.contains(head, line)
    return F.when(F.length(output) <= limit, output).otherwise(F.concat(head, note, F.when(lost, F.concat(F.lit("\n"), line)).otherwise("")))
