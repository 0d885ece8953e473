"""Operator chains in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What operators do, in a few words; others are named by themselves.
PHRASES = {
    "select_numeric_cols": "look at the numeric columns",
    "select_categorical_cols": "look at the categorical columns",
    "pick_numeric_by_variance": "take the one that varies most",
    "pick_numeric_by_skew": "take the most skewed one",
    "pick_categorical_by_cardinality": "take the one with most values",
    "zscore": "standardise it",
    "log1p": "take logarithms",
    "abs": "take absolute values",
    "groupby_mean": "average it by group",
    "argmax_group": "find the group with the largest mean",
    "argmin_group": "find the group with the smallest mean",
    "mean": "report the mean",
    "median": "report the median",
    "std": "report the standard deviation",
    "sum": "report the sum",
    "correlation": "report the correlation",
}


def mechanical(ops: Column) -> Column:
    """array<string> of operators -> 'first ..., then ..., then ...'; '' for none."""
    known = F.create_map(*(F.lit(x) for kv in PHRASES.items() for x in kv))
    words = F.transform(ops, lambda o: F.coalesce(F.try_element_at(known, o), F.regexp_replace(o, "_", " ")))
    return F.when(F.coalesce(F.size(ops), F.lit(0)) > 0, F.concat(F.lit("First "), F.array_join(words, ", then "), F.lit("."))).otherwise("")


def question(pattern: Column, statistic: Column, subject: Column, group: Column) -> Column:
    """One of three sentences: of a group (winner), of groups (comparison), otherwise of the whole table."""
    return F.when(pattern == "winner", F.format_string("Which %s has the highest %s of %s?", group, statistic, subject)).when(pattern == "comparison", F.format_string("How does the %s of %s differ between values of %s?", statistic, subject, group)).otherwise(F.format_string("What is the %s of %s?", statistic, subject))
