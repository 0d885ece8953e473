"""Manifests of what has been run: fingerprints, the latest entry of each, what is still to do, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ASCII punctuation, which question texts lose before they are hashed.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def folded_question(text: Column) -> Column:
    """A question in lower case without punctuation, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), r"\s+", " "))


def question_fingerprint(text: Column, dataset_hash: Column) -> Column:
    """Hash of a question however it is spaced and punctuated, and of its data set."""
    return short_hash(F.concat_ws("\u0001", F.coalesce(folded_question(text), F.lit("")), F.coalesce(dataset_hash, F.lit(""))))


def template_fingerprint(template: Column, alternates: Column, params: Column, dataset_hash: Column) -> Column:
    """Hash of a template's definition, its alternates (array), its parameters (JSON text) and the data set."""
    parts = [template, F.array_join(F.coalesce(alternates, F.array().cast("array<string>")), "\u0002"), params, dataset_hash]
    return short_hash(F.concat_ws("\u0001", *(F.coalesce(p, F.lit("")) for p in parts)))


def dataset_hash(df: DataFrame) -> DataFrame:
    """One row: n_rows and a hash of the table's content, whatever the order of its rows (null for no rows).

    The rows' 64-bit hashes are added up modulo 2^63 and xored, so that no row has to meet another.
    """
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in df.columns)) if df.columns else F.lit(0).cast("long")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    return sums.select("n_rows", F.when(F.col("n_rows") > 0, short_hash(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("x").cast("string"), F.col("s").cast("string")))).alias("dataset_hash"))


def latest(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key by `order`, the last column breaking ties. Map-side partial aggregates: a hot key's
    entries never meet in one task."""
    others = [c for c in entries.columns if c not in keys]
    place = F.struct(*order)
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("_e")).select(*keys, *(F.col(f"_e.{c}").alias(c) for c in others)).select(*entries.columns)


def uncached(questions: DataFrame, entries: DataFrame, retry_failed: bool = False) -> DataFrame:
    """questions(fingerprint, ...) that no entry(fingerprint, status) covers; failures count as done unless retried."""
    done = entries.where("status = 'success'") if retry_failed else entries
    return questions.join(done.select("fingerprint").distinct(), "fingerprint", "left_anti")


def unlocked(sources: DataFrame, episodes: DataFrame, regenerate: bool = False) -> DataFrame:
    """sources(csv_source, ...) that have no episode yet; all of them when regenerating."""
    return sources if regenerate else sources.join(episodes.select("csv_source").distinct(), "csv_source", "left_anti")


def coverage_gaps(datasets: DataFrame, questions: DataFrame, episodes: DataFrame) -> DataFrame:
    """(dataset, gap): data sets without a question, and those with questions but no episode."""
    names = datasets.select("dataset").distinct()
    asked = questions.select("dataset").distinct()
    none = names.join(asked, "dataset", "left_anti").select("dataset", F.lit("no questions").alias("gap"))
    idle = names.join(asked, "dataset", "left_semi").join(episodes.select("dataset").distinct(), "dataset", "left_anti")
    return none.unionAll(idle.select("dataset", F.lit("no episodes").alias("gap")))


def changes(current: DataFrame, entries: DataFrame) -> DataFrame:
    """current(name, fingerprint), entries(name, fingerprint) -> (name, change) of names that need a run: new if no entry has
    the name, changed if none of its entries has the fingerprint."""
    known = entries.select("name").distinct().withColumn("_known", F.lit(True))
    same = entries.select("name", "fingerprint").distinct().withColumn("_same", F.lit(True))
    rows = current.join(known, "name", "left").join(same, ["name", "fingerprint"], "left")
    return rows.where("_same is null").select("name", F.when(F.col("_known").isNull(), "new").otherwise("changed").alias("change"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """existing with the rows of new in place of those with their key; rows without a key all stay."""
    stay = existing.join(new.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*existing.columns)
    return stay.unionByName(new, allowMissingColumns=True)


def with_paths(tasks: DataFrame, sources: DataFrame) -> DataFrame:
    """tasks(dataset, ...) with the csv_path of sources(dataset, csv_path); tasks of unknown data sets go."""
    return tasks.join(sources.select("dataset", "csv_path").distinct(), "dataset", "inner")


def dataset_summary(entries: DataFrame) -> DataFrame:
    """entries(type, status, dataset, model) -> (dataset, synthetic_success, synthetic_failure, llm_success, llm_failure, models)."""
    ok = F.col("status") == "success"
    counts = {f"{t}_{s}": F.count_if((F.col("type") == t) & (ok if s == "success" else ~ok)) for t in ("synthetic", "llm") for s in ("success", "failure")}
    return entries.groupBy("dataset").agg(*(c.alias(n) for n, c in counts.items()), F.sort_array(F.collect_set(F.nullif("model", F.lit("")))).alias("models"))


def template_summary(entries: DataFrame) -> DataFrame:
    """(template, success, failure) of synthetic entries; without a name it is 'unknown'."""
    rows = entries.where("type = 'synthetic'").groupBy(F.coalesce(F.nullif("template_name", F.lit("")), F.lit("unknown")).alias("template"))
    return rows.agg(F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") != "success").alias("failure"))


def model_summary(entries: DataFrame) -> DataFrame:
    """(model, synthetic, llm, total); without a name it is 'unknown'."""
    rows = entries.groupBy(F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model"))
    return rows.agg(F.count_if(F.col("type") == "synthetic").alias("synthetic"), F.count_if(F.col("type") == "llm").alias("llm"), F.count("*").alias("total"))


def quotas(n: int, shares: dict[str, float]) -> dict[str, int]:
    """n split by shares: whole parts, then one each to the largest remainders (the first of equals)."""
    total = sum(shares.values())
    exact = {k: n * v / total for k, v in shares.items()} if total else dict.fromkeys(shares, 0.0)
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(shares, key=lambda k: out[k] - exact[k])[: n - sum(out.values()) if total else 0]:
        out[k] += 1
    return out


def quota_selection(rows: DataFrame, key: str, by: str, quota: dict[str, int], strict: bool = False) -> DataFrame:
    """quota[value] rows of each value of `by`, those of the smallest hashes of key. If strict and any value has fewer rows
    than its quota, nothing."""
    from .splits import hash_places

    wanted = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)) if quota else F.create_map().cast("map<string,int>")
    placed = hash_places(rows, key, by).withColumn("_q", F.coalesce(F.try_element_at(wanted, F.col(by)), F.lit(0)))
    out = placed.where(F.col("_at") < F.col("_q"))
    if strict:
        short = {r[by]: r["n"] for r in rows.where(F.col(by).isin(*quota)).groupBy(by).agg(F.count("*").alias("n")).collect()}  # a row a value of the quota
        if any(short.get(k, 0) < v for k, v in quota.items()):
            out = out.where(F.lit(False))
    return out.select(*rows.columns)


def last_failures(runs: DataFrame) -> DataFrame:
    """runs(question_id, idx, success, error) with last_error: the error of the latest failed run before each one. A question's
    runs meet in one window."""
    before = Window.partitionBy("question_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("last_error", F.last(F.when(~F.col("success"), F.col("error")), ignorenulls=True).over(before))
