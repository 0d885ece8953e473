"""Answers of runs as JSON text: canonical form, hashes, comparison within tolerances, votes and failure classes.

An answer becomes a flat table of leaves in canonical form, and two such tables are laid over each other; Spark deals out
the pairs and the votes. Other names of keys are resolved before, in the JVM. Votes look at the distinct answers of a
question with their counts, so that a question's many equal answers never travel apart.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

FLOAT_TOLERANCE, P_TOLERANCE, PRECISION = 0.1, 0.002, 2

# Keys of an answer that say how it was found and not what it is.
IGNORED_KEYS = frozenset({"z_threshold", "max_iterations", "iterations_used", "const", "grouping_column", "group1", "group2"})
# Keys that change places when two groups are named in the other order.
PAIRED_KEYS = (("mean1", "mean2"), ("median1", "median2"), ("n1", "n2"), ("group1_n", "group2_n"), ("std1", "std2"), ("var1", "var2"), ("count1", "count2"))
# Keys whose text names a method; keys that make a dictionary a test result, and its significance; dashes.
METHOD_KEYS = frozenset({"test_used", "effect_size_type", "method_choice", "effect_size_kind"})
TEST_KEYS, SIGNIFICANCE_KEYS = frozenset({"answer", "p_value", "significance_score"}), ("p_value", "significance_score")
DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")


def parsed(text: str | None) -> Any:
    """The answer that a JSON text holds; text that is no JSON is the answer itself."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return text


def rounded(value: Any, digits: int) -> Any:
    if isinstance(value, float):
        return round(value, digits) if math.isfinite(value) else value
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, list) else value


def digest(text: str | None, digits: int = PRECISION) -> str | None:
    """16 hex digits of the SHA-256 of the answer's JSON with floats rounded and keys sorted; none for no answer."""
    if text is None:
        return None
    return hashlib.sha256(json.dumps(rounded(parsed(text), digits), sort_keys=True).encode()).hexdigest()[:16]


#: A leaf of an answer: its kind (number, text, null, object, list), its content, and how it is compared.
Leaf = tuple[str, Any, str]
_MATES = {x: y for pair in PAIRED_KEYS for x, y in (pair, pair[::-1])}


def _folded(text: str, named: bool) -> str:
    """Text in one Unicode form with one dash; names of methods besides without case, remarks, marks and the word test."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text).translate(DASHES)
    return "".join(re.findall("[a-z0-9]+", re.sub(r"\(.*?\)|\btest\Z", " ", text.lower().strip()))) if named else text


def leaves(value: Any, strip: bool = False, unordered: frozenset[str] = frozenset()) -> dict[tuple, Leaf]:
    """An answer as a flat table from path to leaf, in canonical form: text that holds an object or truth value stands for
    it, text is folded, lists of text (and lists under `unordered` keys) are sorted. What is left to compare is one
    leaf with another, by the way that the leaf itself names: number, signed, significance, exact, ignored or any."""
    out: dict[tuple, Leaf] = {}
    todo: list[tuple[tuple, str, str, Any]] = [((), "", "", value)]
    while todo:
        path, key, way, x = todo.pop()
        if isinstance(x, str):
            x = x.strip() if strip else x
            held = parsed(x) if x[:1] == "{" and x[-1:] == "}" else None
            x = held if isinstance(held, dict) else {"true": True, "false": False}.get(x.lower(), x)
        if way == "significance" and not isinstance(x, dict | list):
            with contextlib.suppress(TypeError, ValueError):
                x = float(x)
        if way == "verdict":
            out[path] = ("text", str(x).lower().strip(), "exact")
        elif isinstance(x, int | float):
            signed = any(word in key.lower() for word in ("correlation", "association"))
            out[path] = ("number", float(x), way or ("signed" if signed else "number"))
        elif isinstance(x, str):
            out[path] = ("text", _folded(x, key.lower() in METHOD_KEYS), way or "exact")
        elif isinstance(x, list):
            out[path] = ("list", None, way or "exact")
            if key in unordered:
                x = sorted(x, key=str)
            elif all(isinstance(y, str) for y in x):
                x = sorted(x, key=lambda y: _folded(y, key.lower() in METHOD_KEYS))
            todo += [((*path, i), key, way, y) for i, y in enumerate(x)]
        elif isinstance(x, dict):
            result = not TEST_KEYS.isdisjoint(x)
            out[path] = ("object", "result" if result else None, way or "exact")
            known = next((k for k in SIGNIFICANCE_KEYS if k in x), None)
            for k, y in x.items():
                if result:
                    todo.append(((*path, k), "", "verdict" if k == "answer" else "significance" if k == known else "any" if k in SIGNIFICANCE_KEYS else "", y))
                else:
                    todo.append(((*path, k), k, "ignored" if k in IGNORED_KEYS else "", y))
        else:
            out[path] = ("null", None, way or "exact")
    return out


class Comparison:
    """Whether two parsed answers say the same: their tables of leaves are laid over each other."""

    def __init__(self, tolerance: float = FLOAT_TOLERANCE, p_tolerance: float = P_TOLERANCE, strip: bool = False, unordered: frozenset[str] = frozenset()):
        self.near = {"number": tolerance, "signed": tolerance, "significance": p_tolerance}
        self.form = {"strip": strip, "unordered": unordered}

    def __call__(self, a: Any, b: Any) -> bool:
        return self.agree(leaves(a, **self.form), leaves(b, **self.form))

    def _same(self, x: Leaf | None, y: Leaf | None) -> bool:
        if x is None or y is None:
            return False
        if "any" in (x[2], y[2]):
            return True
        if x[0] == y[0] == "number":
            size = abs if "signed" in (x[2], y[2]) else float
            return abs(size(x[1]) - size(y[1])) <= self.near.get(x[2], self.near["number"])
        return x[:2] == y[:2]

    def _inside(self, table: dict[tuple, Leaf], path: tuple, number: Leaf) -> bool:
        """Whether the object at path holds the number as one of its values."""
        own = (v for p, v in table.items() if len(p) == len(path) + 1 and p[:-1] == path and v[0] == "number")
        return any(abs(v[1] - number[1]) <= self.near["number"] for v in own)

    def agree(self, a: dict[tuple, Leaf], b: dict[tuple, Leaf]) -> bool:
        """Leaves of a path must agree. Of an object with pairs of keys, all leaves below those may instead agree
        crosswise; an object agrees with a number that it holds."""
        met = {p for p in a.keys() & b.keys() if {a[p][0], b[p][0]} == {"object", "number"} and (self._inside(a, p, b[p]) if a[p][0] == "object" else self._inside(b, p, a[p]))}
        ways: dict[tuple, list[bool]] = {}
        for p in a.keys() | b.keys():
            straight = self._same(a.get(p), b.get(p))
            if straight and _MATES.keys().isdisjoint(p):  # nothing above may change this
                continue
            above = [p[:i] for i in range(len(p) + 1)]
            if any(q in met or "ignored" in (a.get(q, b.get(q))[2], b.get(q, a.get(q))[2]) for q in above if q in a or q in b):
                continue
            turn = next((i for i in reversed(range(len(p))) if p[i] in _MATES and a.get(p[:i], ("",))[:2] == ("object", None) and all((*p[:i], _MATES[p[i]]) in t for t in (a, b))), None)
            if turn is not None:
                crossed = self._same(a.get(p), b.get((*p[:turn], _MATES[p[turn]], *p[turn + 1 :])))
                so_far = ways.setdefault(p[:turn], [True, True])
                ways[p[:turn]] = [so_far[0] and straight, so_far[1] and crossed]
            elif not straight:
                return False
        return all(map(any, ways.values()))


def answer_hash(answer: Column, digits: int = PRECISION) -> Column:
    """Hash of an answer in JSON; null for null. Equal up to rounding, equal hash."""

    ship()

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: digest(x, digits), na_action="ignore")

    return of(answer)


def number_hash(number: Column, digits: int = PRECISION) -> Column:
    """answer_hash of a double column, without leaving the JVM."""
    return F.substring(F.sha2(F.round(number, digits).cast("string"), 256), 1, 16)


def answers_match(a: Column, b: Column, tolerance: float = FLOAT_TOLERANCE, p_tolerance: float = P_TOLERANCE, strip: bool = False, unordered: Iterable[str] = ()) -> Column:
    """Whether two answers in JSON agree: numbers within tolerance, significances within p_tolerance, text after
    folding of Unicode forms and dashes (and without white space around it if strip), lists of texts in any order and lists
    under `unordered` keys too, groups in either order. False if either is null."""

    ship()
    keys = frozenset(unordered)

    @F.pandas_udf("boolean")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        same = Comparison(tolerance, p_tolerance, strip, keys)
        for left, right in batches:
            yield pd.Series([x is not None and y is not None and (x == y or same(parsed(x), parsed(y))) for x, y in zip(left, right, strict=True)], dtype=bool)

    return of(a, b)


# Other names under which answers give what a key of the expected answer asks for, the first that is there counts.
KEY_ALIASES = {
    "target": ["target_column", "target_col"],
    "predictor": ["predictor_column", "best_predictor", "most_correlated_column"],
    "association_score": ["correlation", "absolute_correlation", "abs_correlation", "corr", "spearman_rho"],
    "columns": ["pair"],
    "grouping_column": ["group_col", "group_column"],
    "test_statistic": ["t_statistic", "t_stat", "t", "u_statistic", "f_statistic", "f_stat", "f", "chi_squared", "ks_statistic", "levene_statistic"],
    "significance_score": ["p_value", "p"],
    "fit_score": ["r_squared", "r2", "r2_score"],
    "fit_score_adj": ["adj_r_squared", "adj_r2"],
    "n_influential": ["n_significant"],
    "method_choice": ["test_used"],
    "effect_size_kind": ["effect_size_type"],
    "effect_size": ["eta_squared"],
    "df": ["degrees_of_freedom"],
    "original_association": ["original_correlation"],
    "clean_association": ["clean_correlation"],
    "log_association": ["log_correlation"],
    "mean1": ["group1_mean", "mean_low_group"],
    "mean2": ["group2_mean", "mean_high_group"],
    "significant": ["significant_at_0.05", "is_significant"],
}
# Keys whose lists have no order.
UNORDERED_KEYS = ("columns", "predictors", "pair")
_ENTRIES = "map<string,variant>"


def _folded_key(key: Column) -> Column:
    return F.translate(F.lower(key), "-‑", "__")


def _with_entries(df: DataFrame, answers: Mapping[str, str]) -> DataFrame:
    """df with, under each name, the values of the folded keys of an answer; of keys that fold alike the last counts. Null unless
    the answer is an object. Each step is a column of its own, so that a text is read once and not once a use."""
    df = df.withColumns({f"{name}_held": F.try_parse_json(F.col(answer)) for name, answer in answers.items()})
    objects = {f"{name}_object": F.when(F.col(answer).rlike(r"^[ \t\r\n]*\{"), F.col(f"{name}_held").cast(_ENTRIES)) for name, answer in answers.items()}
    df = df.withColumns(objects)
    df = df.withColumns({f"{name}_names": F.transform(F.map_keys(f"{name}_object"), _folded_key) for name in answers})

    def entries(name: str) -> Column:
        names, values = F.col(f"{name}_names"), F.map_values(f"{name}_object")
        last = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: ~F.array_contains(F.slice(names, i + 1, F.size(names)), F.element_at(names, i)))
        alike = F.map_from_arrays(F.transform(last, lambda i: F.element_at(names, i)), F.transform(last, lambda i: F.element_at(values, i)))
        return F.when(F.size(F.array_distinct(names)) < F.size(names), alike).when(names.isNotNull(), F.map_from_arrays(names, values))

    return df.withColumns({name: entries(name) for name in answers}).drop(*(f"{name}_{step}" for name in answers for step in ("held", "object", "names")))


def resolve_keys(df: DataFrame, expected: str, actual: str, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """df with `wanted`, `given` and `missing` of two answers in JSON: both with folded keys, and of `actual` what stands
    under the keys that `expected` has, or else under the first of their aliases that is there.

    missing names, sorted, the expected keys without a value. Keys that are not expected go. An answer that is no object
    gives null. All of it is expressions; the aliases are a map in the plan.
    """
    aliases = KEY_ALIASES if aliases is None else aliases
    fold = lambda key: key.lower().translate(dict.fromkeys(map(ord, "-‑"), "_"))
    table = F.create_map(*(x for k, names in aliases.items() for x in (F.lit(fold(k)), F.array(*(F.lit(fold(n)) for n in names))))) if aliases else F.create_map().cast("map<string,array<string>>")
    read = _with_entries(df, {"_want": expected, "_have": actual}).withColumn("_have", F.map_filter("_have", lambda _, v: ~F.is_variant_null(v)))
    read = read.withColumn("_held", F.coalesce(F.map_keys("_have"), F.array().cast("array<string>")))
    names = lambda key: F.concat(F.array(key), F.coalesce(F.try_element_at(table, key), F.array().cast("array<string>")))
    first = lambda key: F.try_element_at(F.array_intersect(names(key), F.col("_held")), F.lit(1))
    read = read.withColumn("_found", F.transform(F.map_keys("_want"), lambda key: F.struct(key.alias("key"), first(key).alias("name"))))
    there = F.filter("_found", lambda e: e["name"].isNotNull())
    canonical = F.map_from_entries(F.transform(there, lambda e: F.struct(e["key"].alias("key"), F.element_at("_have", e["name"]).alias("value"))))
    missing = F.array_sort(F.transform(F.filter("_found", lambda e: e["name"].isNull()), lambda e: e["key"]))
    return read.withColumns({"wanted": F.to_json("_want"), "given": F.when(F.col("_have").isNotNull(), F.to_json(canonical)), "missing": missing}).drop("_want", "_have", "_held", "_found")


def with_alias_match(df: DataFrame, expected: str, actual: str, aliases: Mapping[str, Sequence[str]] | None = None, unordered: Iterable[str] = UNORDERED_KEYS, tolerance: float = FLOAT_TOLERANCE, p_tolerance: float = P_TOLERANCE) -> DataFrame:
    """df with `matched` and `reason`: whether the answer in column `actual` says what the one in `expected` does, if keys may
    have other names. An expected object asks for an object with all its keys; more keys do not matter. Other answers
    are compared as they are. No answer matches nothing."""
    r = resolve_keys(df, expected, actual, aliases)
    # where a reason stands already, nothing is compared
    whole = lambda resolved, given: F.when(F.col("wanted").isNull(), F.col(given)).when(F.size("missing") == 0, F.col(resolved))
    r = r.withColumn("_close", answers_match(whole("wanted", expected), whole("given", actual), tolerance, p_tolerance, True, unordered))
    lacks = F.concat(F.lit("missing keys: "), F.array_join("missing", ", "))
    asked = F.col("wanted").isNotNull()
    reason = F.when(asked & F.col("given").isNull(), "actual answer is not an object").when(asked & (F.size("missing") > 0), lacks).when(F.col("_close"), "match").otherwise("value mismatch")
    return r.withColumn("reason", reason).withColumn("matched", F.col("reason") == "match").drop("wanted", "given", "missing", "_close")


def normalized(df: DataFrame) -> DataFrame:
    """A result table as one answer in JSON, by its shape: no rows {}, one value that value, one column a list, two
    columns an object from the first to the second, otherwise a list of records. For tables of an answer's size."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    if len(names) == 1:
        values = F.to_json(F.collect_list("c0"))
        out = rows.agg(F.when(F.count("*") == 0, "{}").when(F.count("*") == 1, values.substr(F.lit(2), F.length(values) - 2)).otherwise(values).alias("answer"))
    elif len(names) == 2:
        entries = F.collect_list(F.struct(F.col("c0").cast("string"), "c1"))
        out = rows.where("c0 is not null").agg(F.to_json(F.map_from_entries(entries)).alias("answer"))
    else:
        out = df.agg(F.when(F.count("*") == 0, "{}").otherwise(F.to_json(F.collect_list(F.struct("*")))).alias("answer"))
    return out


_CLUSTERS = "array<struct<answer:string,votes:long,members:array<long>>>"


def _clustered(tolerance: float):
    ship()

    @F.pandas_udf(_CLUSTERS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        same = Comparison(tolerance)
        for s in batches:
            out = []
            for answers in s:
                clusters: list[tuple[Any, dict]] = []
                for x in answers if answers is not None else ():
                    value = parsed(x["answer"])
                    home = next((c for v, c in clusters if c["answer"] == x["answer"] or same(v, value)), None)
                    if home is None:
                        home = {"answer": x["answer"], "votes": 0, "members": []}
                        clusters.append((value, home))
                    home["votes"] += x["votes"]
                    home["members"].append(x["first"])
                out.append(sorted((c for _, c in clusters), key=lambda c: -c["votes"]))
            yield pd.Series(out, dtype=object)

    return of


def answer_distribution(traces: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """traces(question_id, idx, success, answer) -> (question_id, total, succeeded, failed, clusters, n_clusters, entropy,
    confidence, majority, majority_votes), a row a question.

    An answer joins the first cluster, in order of arrival (idx), whose first answer it matches; clusters stand by
    votes, earlier ones first among equals. Runs without success or answer fail. entropy is that of the votes in bits;
    confidence the share of the largest cluster. `members` lists where each distinct answer of a cluster first came.
    Without answers: no cluster, entropy and confidence 0, majority null. One row of a question holds its distinct
    answers, not its runs.
    """
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("answer").isNotNull()
    rows = traces.select("question_id", "idx", F.when(good, F.col("answer")).alias("answer"))
    votes = rows.groupBy("question_id", "answer").agg(F.count("*").alias("votes"), F.min("idx").cast("long").alias("first"))
    told = F.when(F.col("answer").isNotNull(), F.struct("first", "answer", "votes"))
    by = votes.groupBy("question_id").agg(F.sum("votes").alias("total"), F.coalesce(F.sum(F.when(F.col("answer").isNotNull(), F.col("votes"))), F.lit(0)).alias("succeeded"), F.sort_array(F.collect_list(told)).alias("answers"))
    out = by.withColumn("clusters", _clustered(tolerance)("answers"))
    share = lambda c: c["votes"] / F.col("succeeded")
    entropy = F.aggregate("clusters", F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    top = F.try_element_at("clusters", F.lit(1))
    return out.select(
        "question_id",
        "total",
        "succeeded",
        (F.col("total") - F.col("succeeded")).alias("failed"),
        "clusters",
        F.size("clusters").alias("n_clusters"),
        (entropy + 0.0).alias("entropy"),
        F.coalesce(top["votes"] / F.nullif("succeeded", F.lit(0)), F.lit(0.0)).alias("confidence"),
        top["answer"].alias("majority"),
        F.coalesce(top["votes"], F.lit(0)).alias("majority_votes"),
    )


def classify_failures(distribution: DataFrame, gold: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """distribution (of answer_distribution), gold(question_id, success, answer) -> the distribution's columns,
    gold_success, gold_cluster (0 is the majority, null none), category and class_confidence.

    In this order: good (gold answers as the majority), execution_failure (more runs fail than succeed),
    hint_necessary (gold fails, others don't), ambiguous (entropy over 0.8), too_hard (over half agree on something
    else), hint_necessary (gold succeeds, under half of the others do), ambiguous. Questions without gold count as failed gold.
    """
    g = gold.groupBy("question_id").agg(F.max(F.struct(F.coalesce("success", F.lit(False)).alias("s"), "answer")).alias("g")).select("question_id", F.col("g.s").alias("gold_success"), F.col("g.answer").alias("gold_answer"))
    rows = distribution.join(g, "question_id", "left").withColumn("gold_success", F.coalesce("gold_success", F.lit(False)))
    each = rows.select("question_id", "gold_answer", F.posexplode("clusters").alias("place", "c")).where("gold_answer is not null")
    met = each.where(answers_match(F.col("gold_answer"), F.col("c.answer"), tolerance)).groupBy("question_id").agg(F.min("place").alias("gold_cluster"))
    few = F.col("succeeded") < F.col("total") * 0.5
    rules = [
        (F.col("gold_cluster") == 0, "good", F.col("confidence")),
        (F.col("failed") > F.col("succeeded"), "execution_failure", F.col("failed") / F.nullif("total", F.lit(0))),
        (~F.col("gold_success") & (F.col("succeeded") > 0), "hint_necessary", F.lit(0.8)),
        ((F.col("n_clusters") >= 2) & (F.col("entropy") > 0.8), "ambiguous", F.least(F.lit(1.0), F.col("entropy") / 1.5)),
        (F.col("confidence") > 0.5, "too_hard", F.col("confidence")),
        (F.col("gold_success") & few, "hint_necessary", 1 - F.col("succeeded") / F.nullif("total", F.lit(0))),
    ]
    category, sure = F, F
    for ok, name, value in rules:
        category, sure = category.when(ok, F.lit(name)), sure.when(ok, value)
    return rows.join(met, "question_id", "left").withColumns({"category": category.otherwise("ambiguous"), "class_confidence": sure.otherwise(0.5)})


def triangulation(distribution: DataFrame, gold: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """(question_id, n_runs, n_succeeded, majority_hash, majority_count, verified): gold against the runs' majority."""
    g = gold.select("question_id", F.when(F.coalesce("success", F.lit(False)), F.col("answer")).alias("gold"))
    rows = distribution.join(g, "question_id", "left")
    return rows.select("question_id", F.col("total").alias("n_runs"), F.col("succeeded").alias("n_succeeded"), answer_hash(F.col("majority")).alias("majority_hash"), F.col("majority_votes").alias("majority_count"), answers_match(F.col("gold"), F.col("majority"), tolerance).alias("verified"))


def ground_truth_verdicts(traces: DataFrame, truth: DataFrame, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """traces(question_id, idx, success, answer), truth(question_id, ground_truth, hashes array<string>) -> the traces'
    columns, matched and error. A run is right if its hash is a valid one or its answer matches the truth."""
    rows = traces.join(truth, "question_id", "left").withColumn("hash", answer_hash(F.col("answer")))
    none = F.coalesce(F.size("hashes"), F.lit(0)) <= 0
    ran = F.coalesce(F.col("success"), F.lit(False))
    right = F.coalesce(F.array_contains("hashes", F.col("hash")), F.lit(False)) | answers_match(F.col("ground_truth"), F.col("answer"), tolerance)
    error = F.when(~ran, "run failed").when(none, "no ground truth").when(~right, "answer mismatch")
    return rows.select(*traces.columns, F.when(ran & ~none, right).alias("matched"), error.alias("error"))


def valid_answers(variants: DataFrame) -> DataFrame:
    """variants(question_id, place, answer) -> (question_id, ground_truth, hashes): a question's tied and alternative
    answers, each hash once in order of place, the first answer being the truth."""
    rows = variants.where("answer is not null").withColumn("hash", answer_hash(F.col("answer")))
    first = rows.groupBy("question_id", "hash").agg(F.min("place").alias("place"), F.min_by("answer", "place").alias("answer"))
    return first.groupBy("question_id").agg(F.min_by("answer", "place").alias("ground_truth"), F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]).alias("hashes"))


def verification_by_runs(traces: DataFrame, gold: DataFrame, most: int = 7, tolerance: float = FLOAT_TOLERANCE) -> DataFrame:
    """(k, total, verified, rate): for every k up to `most`, the questions with k runs and an answering gold, and how many
    of them the majority of the first k runs confirms. Runs count by idx from 1."""
    g = gold.where("answer is not null").select("question_id", F.col("answer").alias("gold"))
    runs = traces.join(g, "question_id", "left_semi").where(F.col("idx").between(1, most))
    n = runs.groupBy("question_id").agg(F.max("idx").alias("n"))
    # question and k together name a question of their own
    each = runs.join(n, "question_id").withColumn("k", F.explode(F.expr(f"sequence(cast(idx as int), least(cast(n as int), {most}))")))
    each = each.select(F.struct("question_id", "k").alias("question_id"), "idx", "success", "answer")
    said = answer_distribution(each, tolerance).select("question_id.question_id", "question_id.k", "majority").join(g, "question_id")
    sums = said.withColumn("ok", answers_match(F.col("gold"), F.col("majority"), tolerance)).groupBy("k").agg(F.count("*").alias("total"), F.count_if("ok").alias("verified"))
    return sums.select("k", "total", "verified", F.round(F.col("verified") / F.col("total"), 4).alias("rate"))
