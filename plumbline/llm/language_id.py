"""Language by compression: the zstandard dictionary of the right language leaves the fewest bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .learning import fold
from .runtime import lean, ship, slices, utf8

#: Pieces of a language's dictionary at most, each from a document of its own, and characters of a piece.
PIECES, PIECE_CHARS = 96, 1024
#: Bytes that are compressed at once, so that a long text's own history doesn't outweigh the dictionary.
CHUNK = 4096
LEVEL = 3
#: A margin (share of the second-best size) below which a guess is rejected.
MARGIN = 0.01


def train(docs: DataFrame, use: Column | None = None) -> dict[str, bytes]:
    """lang -> raw content, of up to PIECES pieces of a language's documents.

    A document is cut into pieces of PIECE_CHARS characters, all of its text; a hash of document and piece draws one of
    them, and the documents with the smallest draws give theirs. Rows with null lang or text, with text that has no
    letter, or that `use` leaves out teach nothing. Ties in the hash break by the piece. A language's share of the rows
    does not matter.
    """
    ok = F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.lit(True) if use is None else use)
    rows = docs.where(ok).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int").alias("last"))
    drawn = F.array_min(F.transform(F.sequence(F.lit(0), "last"), lambda i: F.struct(F.xxhash64("h", i).alias("h"), i.alias("i"))))
    parts = rows.select("lang", "text", drawn.alias("d")).select("lang", F.col("d.h").alias("h"), F.substring("text", F.col("d.i") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    picked = parts.withColumn("rank", rank).where(F.col("rank") <= PIECES).collect()  # PIECES rows a language
    out: dict[str, bytearray] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], -r["rank"])):
        out.setdefault(r["lang"], bytearray()).extend(r["part"].encode() + b"\n")
    return {k: bytes(v) for k, v in out.items()}


def _classify(model: dict[str, bytes]):
    langs = sorted(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        coders = []
        for lang in langs:
            d = z.ZstdCompressionDict(model[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for b in slices(batches):
            data, at = utf8(b.column("text"))
            raw = memoryview(data)
            n = b.num_rows
            best, score, margin = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if langs:
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    parts = [raw[a : min(a + CHUNK, y)] for a in range(x, y, CHUNK)]
                    sizes = [sum(len(c.compress(p)) for p in parts) for c in coders]
                    order = sorted(range(len(langs)), key=lambda j: (sizes[j], j))
                    best[i] = order[0]
                    second = sizes[order[1]] if len(order) > 1 else y - x + 16
                    margin[i] = max(0.0, (second - sizes[order[0]]) / max(1, second))
                    score[i] = margin[i] / (margin[i] + MARGIN) if margin[i] else 0.0
            pred = [langs[j] for j in best.tolist()] if langs else ["und"] * n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("has_letter"), pa.array(pred), pa.array(score), pa.array(margin < MARGIN)], names=["doc_id", "has_letter", "lang", "score", "narrow"])

    return run


def classify(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, lang_pred, score, rejected).

    lang_pred is the language whose dictionary compresses the text best (the first by name among equals), 'und'
    for a null text, a text without a letter, or an empty model. score (0 to 1) grows with the margin over the
    second best; rejected marks a margin under MARGIN and every 'und'. Every byte is compressed, in chunks.
    Repeated rows fare alike, null ids stay, an empty table gives an empty one; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    out = rows.mapInArrow(lean(_classify(model)), "doc_id long, has_letter boolean, lang string, score double, narrow boolean")
    known = F.col("has_letter") & (F.col("lang") != "und") if not model else F.col("has_letter")
    return out.select("doc_id", F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), (~known | F.col("narrow")).alias("rejected"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected; learns from folds 0, 1 and 3 of 4."""
    model = train(docs, fold(4) != 2)
    return classify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
