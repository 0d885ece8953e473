"""Training examples from episodes: chats, chats that predict values, scored steps, verification records.

An episode is a row with its question and its turns as an array; a row never needs another one, so all of it is
higher-order functions inside one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SYSTEM_PROMPT = "You answer questions about a table with Python code, step by step."
PREDICT = "\n\nAfter writing code, predict what values will be computed before seeing the output."

#: The turns of an episode.
TURNS = "array<struct<reasoning:string,code:string,stdout:string,stderr:string,hooks:array<struct<code_line:string,variable_name:string,value:string,value_hash:string>>,submitted:string>>"


def episodes(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """turns(episode_id, turn_index, reasoning, code, stdout, stderr, hooks, submitted), questions(episode_id, question_text, hint,
    verified, answer_hash) -> an episode a row, with `turns` as TURNS in order of turn_index. Episodes without turns have
    an empty array. An episode's turns come together in one row."""
    body = F.struct("reasoning", "code", "stdout", "stderr", "hooks", "submitted")
    by = turns.groupBy("episode_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", body.alias("t")))), lambda x: x["t"]).cast(TURNS).alias("turns"))
    return questions.join(by, "episode_id", "left").withColumn("turns", F.coalesce("turns", F.array().cast(TURNS)))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _opening(extra: str = "") -> list[Column]:
    asked = F.concat(F.coalesce("question_text", F.lit("")), F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("\n\nHint: "), "hint")).otherwise(""))
    return [message("system", F.lit(SYSTEM_PROMPT + extra)), message("user", asked)]


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _code(t: Column) -> Column:
    said = F.when(_given(t["reasoning"]), F.concat(t["reasoning"], F.lit("\n\n"))).otherwise("")
    return strip(F.concat(said, F.when(_given(t["code"]), F.concat(F.lit("```python\n"), t["code"], F.lit("\n```"))).otherwise("")))


def _without_last_user(messages: Column) -> Column:
    return F.when(F.element_at(messages, -1)["role"] == "user", F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)


def _chat(rows: DataFrame, opening: list[Column], turn) -> DataFrame:
    full = F.concat(F.array(*opening), F.flatten(F.transform("turns", lambda t: F.array_compact(F.array(*turn(t))))))
    return rows.where(F.size("turns") > 0).select("episode_id", _without_last_user(full).alias("messages"))


def chat(rows: DataFrame) -> DataFrame:
    """episodes -> (episode_id, messages): system, question with hint, then each turn's reasoning with code and its output.
    A last message of the user goes; episodes without turns give none."""

    def turn(t: Column) -> list[Column]:
        out = F.concat_ws("\n", F.when(_given(t["stdout"]), F.concat(F.lit("[stdout]:\n"), t["stdout"])), F.when(_given(t["stderr"]), F.concat(F.lit("[stderr]:\n"), t["stderr"])))
        return [message("assistant", _code(t)), F.when(out != "", message("user", strip(out)))]

    return _chat(rows, _opening(), turn)


def interleaved_chat(rows: DataFrame) -> DataFrame:
    """As chat, but after the code come a request and a prediction of the hooks' values and of the submitted answer."""

    def turn(t: Column) -> list[Column]:
        hooks = F.array_join(F.transform(t["hooks"], lambda h: F.concat(F.coalesce(h["variable_name"], F.lit("result")), F.lit(" = "), F.coalesce(h["value"], F.lit("null")))), "\n")
        some, done = F.coalesce(F.size(t["hooks"]), F.lit(0)) > 0, t["submitted"].isNotNull()
        return [
            message("assistant", _code(t)),
            F.when(some, message("user", F.lit("Predict the intermediate values:"))),
            F.when(some, message("assistant", hooks)),
            F.when(done, message("user", F.lit("Predict the submitted answer:"))),
            F.when(done, message("assistant", t["submitted"])),
            F.when(_given(t["stdout"]), message("user", F.concat(F.lit("[actual output]:\n"), t["stdout"]))),
        ]

    return _chat(rows, _opening(PREDICT), turn)


def scored_steps(rows: DataFrame) -> DataFrame:
    """episodes -> (episode_id, turn_index, step_type, code_line, variable_name, value, value_hash, label, prefix): a row for each
    hook and each submission, with the messages before its turn as JSON; label is 1.0 if the episode is verified."""

    def told(t: Column) -> Column:
        shown = F.when(_given(t["stdout"]), message("user", F.concat(F.lit("[stdout]:\n"), t["stdout"])))
        return F.array_compact(F.array(message("assistant", F.concat(F.lit("```python\n"), F.coalesce(t["code"], F.lit("")), F.lit("\n```"))), shown))

    each = rows.select("*", F.posexplode("turns").alias("turn_index", "t"))
    prefix = F.to_json(F.concat(F.array(*_opening()), F.flatten(F.transform(F.slice("turns", F.lit(1), F.col("turn_index")), told))))
    hook = F.transform(F.coalesce("t.hooks", F.array()), lambda h: F.struct(F.lit("hook").alias("step_type"), F.coalesce(h["code_line"], F.lit("")).alias("code_line"), h["variable_name"].alias("variable_name"), h["value"].alias("value"), h["value_hash"].alias("value_hash")))
    submit = F.struct(F.lit("submit").alias("step_type"), F.lit("submit(...)").alias("code_line"), F.lit("answer").alias("variable_name"), F.col("t.submitted").alias("value"), F.col("answer_hash").alias("value_hash"))
    steps = F.concat(hook, F.array_compact(F.array(F.when(F.col("t.submitted").isNotNull(), submit))))
    label = F.when(F.coalesce("verified", F.lit(False)), 1.0).otherwise(0.0)
    return each.select("episode_id", "turn_index", prefix.alias("prefix"), label.alias("label"), F.explode(steps).alias("s")).select("episode_id", "turn_index", "s.*", "label", "prefix")


FORMATS = {"sft-standard": chat, "sft-interleaved": interleaved_chat, "prm": scored_steps}


def training_rows(rows: DataFrame, kind: str) -> DataFrame:
    """episodes in the format of that name."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; there are {', '.join(FORMATS)}")
    return FORMATS[kind](rows)


def verification_records(rows: DataFrame) -> DataFrame:
    """episodes -> (episode_id, prompt, expected_hash, n_hooks) of verified episodes, for reinforcement by checked answers."""
    hooks = F.aggregate("turns", F.lit(0), lambda n, t: n + F.greatest(F.coalesce(F.size(t["hooks"]), F.lit(0)), F.lit(0)))
    return rows.where(F.coalesce("verified", F.lit(False))).select("episode_id", _opening()[1]["content"].alias("prompt"), F.col("answer_hash").alias("expected_hash"), hooks.alias("n_hooks"))
