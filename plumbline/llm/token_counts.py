"""Token counts without tokens: Aho-Corasick matches feed dynamic programming that carries score and piece count only.

The automaton lists the vocabulary's pieces that end at each character, longest first. For a unigram vocabulary
(token_counts) the best score decides: as in public unigram tokenizers, a later candidate replaces the best one only
if its score is strictly larger, candidates come in the order of where they begin, a character without a piece of its
own costs the least score less 10, and its bytes then count one by one.

A BPE model's scores are merge ranks and no log probabilities, so there (bpe_counts) the merges decide: the encoding
of every prefix is unique, and it is that of a shorter prefix followed by the one piece that merging leaves alone next
to that prefix's last piece. The programme finds that piece among the matches and adds one to the shorter count.
Texts are cut where no piece goes across, so that what is left repeats; what two pieces make of each other is read off
the merges that make each of them.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import span_hashes, words
from .runtime import lean, ship, slices, utf8

META = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a Python worker remembers before it starts afresh.
MEMORY = 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model file with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    """Piece counts and scores of words, each with the word-begin mark put before it."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for text, score in pieces:
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[int, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(n):
            best = None
            single = False
            for size, s in ends[e]:
                x = s + score[e + 1 - size]
                if best is None or x > best:
                    best, pieces = x, count[e + 1 - size] + 1
                single |= size == 1
            if not single:
                x = self.unknown + score[e]
                if best is None or x > best:
                    best, pieces = x, count[e] + len(text[e].encode())
            score[e + 1], count[e + 1] = best, pieces
        return count[n], score[n]

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its words, pieces and best score."""
        ws, we, first = words(data, starts)
        if not len(ws):
            zero = np.zeros(len(starts) - 1)
            return zero.astype(np.int64), zero.astype(np.int64), zero
        values, where, which = np.unique(span_hashes(data, ws, we), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.known.clear()
        known, raw, listed = self.known, None, values.tolist()
        for i, h in enumerate(listed):
            if h not in known:
                raw = raw or data.tobytes()
                j = where[i]
                known[h] = self.word(META + raw[ws[j] : we[j]].decode("utf-8", "replace"))
        found = np.array([known[h] for h in listed])[which]
        total = np.concatenate((np.zeros((1, 2)), np.cumsum(found, axis=0)))
        per = total[first[1:]] - total[first[:-1]]
        return np.diff(first), per[:, 0].astype(np.int64), per[:, 1]


class PrefixCounter:
    """Piece counts and scores under a sentencepiece BPE model, by its own normalization and tie rule."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = dict(vocabulary(path))
        self.byte_score = {b: self.model.get_score(i) for i in range(self.model.vocab_size()) if self.model.is_byte(i) for b in [int(self.model.id_to_piece(i)[3:5], 16)]}
        self.valid: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for text in self.scores:
            if META in text.lstrip(META):
                raise ValueError("a piece goes on into the next word")
            self.automaton.add_word(text, (text, len(text), self.scores[text], self.valid[text].get))
        self.automaton.make_automaton()
        self.parting = np.ones((256, 256), bool)  # bytes, the second beginning a character, that stand side by side in no piece
        self.parting[:, 0x80:0xC0] = False
        for text in self.scores:
            b = np.frombuffer(text.encode(), np.uint8)
            self.parting[b[:-1], b[1:]] = False
        self.made: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.known: dict[int, tuple[int, float]] = {}
        self.older: dict[int, tuple[int, float]] = {}

    def _merges(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How merging, best score first, the leftmost of equals, makes piece out of its characters: the score of each merge with
        the first and the last part before it, and those after all. None if it ends with more than one part."""
        if piece not in self.made:
            parts, steps, firsts, lasts = list(piece), [], [], []
            while True:
                best = max(((self.scores[p + q], -i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in self.scores), default=None)
                steps.append(best[0] if best else -math.inf)
                firsts.append(parts[0])
                lasts.append(parts[-1])
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.made[piece] = (steps, firsts, lasts) if len(parts) == 1 else None
        return self.made[piece]

    def _apart(self, before: str, piece: str) -> bool:
        """Whether merging leaves these two pieces side by side; '' before the first. Remembered by piece in self.valid."""
        if self.pairs > 4 * MEMORY:  # the automaton holds on to the tables
            for known in self.valid.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        found = self.valid[piece][before] = self._merges(piece) is not None and (not before or self._merges(before) is not None and self._meet(before, piece))
        return found

    def _meet(self, before: str, piece: str) -> bool:
        """Until something goes across them, each of two pieces is made by its own merges, the better of both next ones first:
        whether none goes across before all are done."""
        (left, _, lasts), (right, firsts, _) = self._merges(before), self._merges(piece)
        scores, i, j = self.scores.get, 0, 0
        while True:
            a, b, across = left[i], right[j], scores(lasts[i] + firsts[j])
            if across is not None and across > a and across >= b:
                return False
            if a == b == -math.inf:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def word(self, text: str) -> tuple[int, float]:
        n = len(text)
        scores, apart = self.scores.get, self._apart
        last, count, score = [""] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        done = 0  # prefixes up to here have their last piece

        def single(e: int) -> None:
            """The character at e, for which no longer piece stood: it may have none of its own, and then its bytes count."""
            piece = text[e]
            if not (self.valid[piece].get(last[e]) or apart(last[e], piece)):
                raise ValueError(f"no encoding of {text!r}")
            own = scores(piece)
            last[e + 1] = piece
            count[e + 1] = count[e] + (1 if own is not None else len(piece.encode()))
            score[e + 1] = score[e] + (own if own is not None else sum(self.byte_score.get(b, 0.0) for b in piece.encode()))

        for end, (piece, size, own, valid) in self.automaton.iter(text):  # by end, the longest first
            if end < done:
                continue
            while done < end:
                single(done)
                done += 1
            at = end + 1 - size
            ok = valid(last[at])
            if ok or (ok is None and apart(last[at], piece)):
                done = end + 1
                last[done], count[done], score[done] = piece, count[at] + 1, score[at] + own
        while done < n:
            single(done)
            done += 1
        return count[n], score[n]

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its words, pieces and their scores."""
        raw, at = data.tobytes(), starts.tolist()
        texts = [self.model.normalize(raw[a:b].decode("utf-8", "replace")).encode() for a, b in zip(at, at[1:])]
        joined = b"".join(texts)
        norm, first = np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        n_words = np.diff(words(data, starts)[2])
        if not len(norm):
            return n_words, np.zeros(len(texts), np.int64), np.zeros(len(texts))
        # a unit begins with a text, with a word mark that follows something else, or between parting bytes: no piece goes across
        mark = np.zeros(len(norm), bool)
        mark[: max(0, len(norm) - 2)] = (norm[:-2] == 0xE2) & (norm[1:-1] == 0x96) & (norm[2:] == 0x81)
        begins = mark.copy()
        begins[3:] &= ~mark[:-3]
        begins[1:] |= self.parting[norm[:-1], norm[1:]]
        begins[first[:-1][first[:-1] < len(norm)]] = True
        us = np.flatnonzero(begins)
        ue = np.append(us[1:], len(norm))
        values, where, which = np.unique(span_hashes(norm, us, ue), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:  # those that come again are taken over
            self.older, self.known = self.known, {}
        known, listed = self.known, values.tolist()
        for h, j in zip(listed, where.tolist(), strict=True):
            if h not in known:
                known[h] = self.older.pop(h, None) or self.word(joined[us[j] : ue[j]].decode())
        found = np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, listed)), float, 2 * len(listed)).reshape(-1, 2)[which]
        total = np.concatenate((np.zeros((1, 2)), np.cumsum(found, axis=0)))
        bound = np.searchsorted(us, first)
        per = total[bound[1:]] - total[bound[:-1]]
        return n_words, np.rint(per[:, 0]).astype(np.int64), per[:, 1]


_counters: dict[tuple[str, bool], Counter | PrefixCounter] = {}


def _count(path: str, merges: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, merges) not in _counters:
            _counters[path, merges] = PrefixCounter(path) if merges else Counter(vocabulary(path))
        for b in slices(batches):
            n_words, n_tokens, score = _counters[path, merges](*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n_tokens), pa.array(score)], names=["doc_id", "n_words", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_tokens, score), a row a document.

    Words are runs of bytes other than ASCII white space. n_tokens is how many pieces the best segmentation has,
    score its sum of piece scores over the words; ties go to the candidate that begins first. A null, empty or blank
    text has 0 of each; texts and words of any length are taken whole, an empty table gives an empty one. Repeated rows
    count alike; columns other than doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_count(model_path)), "doc_id long, n_words long, n_tokens long, score double")


def bpe_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_tokens, score), a row a document.

    n_tokens is how many pieces the sentencepiece BPE model makes of the text, its normalization, byte pieces and ties
    included; score sums the file's scores of these pieces, which are merge ranks and no log probabilities. Words are
    as in token_counts. A null or empty text has 0 of each; texts of any length are taken whole, an empty table gives
    an empty one. Repeated rows count alike, null ids stay; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(_count(model_path, merges=True)), "doc_id long, n_words long, n_tokens long, score double")
