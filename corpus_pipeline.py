"""A corpus made fit for training: toxic documents go, one of each near-duplicate group stays, repeated passages
are cut to their first copy, documents with benchmark items go, and the rest is packed into windows.

Every stage decides about rows, by doc_id and text together: a doc_id may stand on several texts or be null. Rows
that repeat both count as one document. Null texts are empty ones and stay, as far as no stage has a reason against
them; texts of any length are taken whole; an empty table goes through every stage. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from plumbline.llm.queries import table, tokenizer
from plumbline.llm.runtime import forget, keep, kept_tables, keyed, once, row_key, without

#: Bytes of a repeated passage. Passages of over 50 words are longer unless their words are very short (see README).
PASSAGE_BYTES = 200


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose chance of being toxic is 0.5 or more; learns from the labels of these documents. Without labels
    of both kinds nothing is dropped; repeated rows fare alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return without(docs, toxicity.score(keyed(docs), model).where("score >= 0.5"), "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id (null last, ties by a hash of the text) of each group linked at 0.8 over
    five-word shingles; of rows that repeat doc_id and text one. Texts without words are in no group."""
    single = once(docs, "single")
    groups = ngram_join.jaccard_components(keyed(single), 5, 80, 100).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    member = groups.join(single.select(row_key(single).alias("_row"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")).alias("place")), "_row")
    best = member.groupBy("component_id").agg(F.min_by("_row", "place").alias("_best"))
    return without(single, member.join(best, "component_id").where("_row <> _best").select(F.col("_row").alias("doc_id")), "copies")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of PASSAGE_BYTES or more that stand earlier in the corpus; whole characters only; n_chars follows. A text
    that is cut away whole stays as an empty one, a null text becomes one."""
    out = suffix_dedup.remove_repeats(docs, PASSAGE_BYTES, keep_first=True, whole_chars=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept").cast("string"), "n_chars": F.length(F.col("kept").cast("string")).cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, as it is or with other numbers, names or units."""
    return without(docs, decontaminate.contaminated(keyed(docs), table(spark, sf_dir, "benchmark")), "leaks")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows; empty texts are their end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontaminated), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written to the shared folder and read again. Once they are, what the
    stage has read and kept is deleted, so that the last stage's rows alone are left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with kept_tables() as made:
            done = keep(stage(spark, docs, sf_dir), name)
        forget(docs, *(x for x in made if x is not done))
        docs = done
    return docs
