import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import fill, pack, patterns

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def rows():
    rnd = random.Random(3)
    pick = ["Hello", "WORLD!!", "naïve", "ǅungla", "it's", "we'll've", "3,14", "<|endoftext|>", "a<|startoftext|>b", "日本語", "é", "́x", "\x1c", " y", "ΣΑΣ", "İx", "​", "🙂", "x" * 50]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (3, "a")]
    out += [(i, "".join(rnd.choice(pick) + rnd.choice([" ", "  ", "\n", "\t", "", " ", "\x0b"]) for _ in range(rnd.choice([1, 5, 60, 900])))) for i in range(4, 80)]
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    out += [(200, "".join("ab"[x] for x in word)), (201, "".join("ba"[x] for x in word)), (None, "null id")]
    return out


def test_round_trip(spark):
    data = rows()
    got = pack(spark.createDataFrame([(d, t, 0) for d, t in data], "doc_id long, text string, length long"), PATH).collect()
    want = []
    for d, t in data:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 2048) + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 60))
def test_fill_is_closest(counts, room):
    sums = {0}
    for k, v in counts.items():
        sums = {s + k * j for s in sums for j in range(v + 1)}
    got = fill(counts, room)
    assert all(v <= counts[k] for k, v in got.items())
    assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=12))
def test_patterns_use_everything(counts):
    used = {}
    for need, times in patterns(counts, 64):
        assert sum(k * v for k, v in need.items()) <= 64
        for k, v in need.items():
            used[k] = used.get(k, 0) + v * times
    assert used == counts
