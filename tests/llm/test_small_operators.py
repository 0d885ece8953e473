import functools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from plumbline.llm import language_id, media, quality, revisits, toxicity
from plumbline.llm.token_counts import META, Counter, PrefixCounter, bpe_counts, token_counts, vocabulary

TEXTS = ["Hello the world", "naïve 日本語 ﷽ 🙂🙂 x", "a\tb\nc  d", "", None, " ", "xxxxxxxxxxxxxxxxxx in-ter.national!", "aaaa" * 30, "\x00\x01 é"]


def test_token_counts_match_the_tokenizer(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(path)
    full = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *pieces]
    t = Tokenizer(models.Unigram(full, 0, True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[ \\t\\n\\r\\x0b\\x0c]+"), "removed"), pre_tokenizers.Metaspace(META, "always", False)])
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(TEXTS)], "doc_id long, text string, score int")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, path).collect()}
    for i, x in enumerate(TEXTS):
        assert got[i] == len(t.encode(x or "").ids), x


def test_bpe_counts_are_the_tokenizers_own(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS, "hello", "  two  spaces \n\n new;\r\n\tx  ", "a▁ b ▁c▁▁ d", "\n", "   ", "<s> </s> <0x0A>", "ﬁ ①　x\u00a0y"]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in bpe_counts(df, path).collect()}
    for i, x in enumerate(texts):
        ids = m.encode(x or "")
        assert got[i].n_tokens == len(ids), x
        assert abs(got[i].score - sum(m.get_score(k) for k in ids)) < 1e-3 * max(1, len(ids)), x
        assert got[i].n_words == len((x or "").encode().split()), x


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabtheer sS▁.,!é日🙂0\n"), max_size=40))
def test_any_text_has_the_tokenizers_count(text):
    c = _counter()
    data = np.frombuffer(text.encode(), np.uint8)
    assert c(data, np.array([0, len(data)]))[1].tolist() == [len(c.model.encode(text))]


@functools.cache
def _counter():
    return PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))


def test_texts_are_cut_where_no_piece_goes_across():
    c = PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    text = " ".join(w + e for w in ("und", "the", "née", "xqz") for e in ("", ".", "!!", "?\n", ";\t", ".\nund", "\r\n-the", "###", "%%é", ","))
    data = np.frombuffer(text.encode(), np.uint8)
    assert c(data, np.array([0, len(data)]))[1].tolist() == [len(c.model.encode(text))]
    assert len(c.known) <= 24  # of 40 words


def test_two_pieces_stay_apart_as_merging_has_it():
    c = _counter()

    def merged(text):
        parts = list(text)
        while found := [(c.scores[p + q], -i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in c.scores]:
            i = -max(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    pieces, rng = sorted(c.scores), np.random.default_rng(9)
    cuts = [(p[:i], p[i:]) for p in rng.choice(pieces, 1500).tolist() for i in range(1, len(p)) if p[:i] in c.scores and p[i:] in c.scores]
    pairs = [*cuts, *zip(rng.choice(pieces, 5000).tolist(), rng.choice(pieces, 5000).tolist()), ("é", "🙂"), ("🙂", "the"), *(("", p) for p in pieces[::50])]
    apart = [c._apart(p, q) for p, q in pairs]
    assert apart == [merged(p + q) == ([p, q] if p else [q]) for p, q in pairs]
    assert 1000 < sum(apart) < len(pairs) - 1000


def test_words_that_come_again_are_counted_once(monkeypatch):
    monkeypatch.setattr("plumbline.llm.token_counts.MEMORY", 3)
    c, made = PrefixCounter(public_tokenizers.path("piece_bpe_32k.model")), []
    monkeypatch.setattr(c, "word", lambda text, word=c.word: made.append(text) or word(text))
    for text in ("the one two three", "the four five six", "the seven eight nine", "the ten one"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert c(data, np.array([0, len(data)]))[1].tolist() == [len(c.model.encode(text))]
    assert made.count("▁the") == 1 and made.count("▁one") == 2 and len(c.known) + len(c.older) <= 12


def test_ties_keep_the_earlier_beginning():
    c = Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -1.0), ("c", -1.0), ("abc", -3.0)])
    assert c.word("abc") == (2, -2.0)
    assert c.word("ab") == (1, -2.0)


def test_media_round_trip_and_carving(spark):
    rows = [(0, None), (1, ""), (2, "x" * 600), (2, "x" * 600), (3, "BM P5\n RIFF é" * 300)]
    got = media.digest(spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, media binary")).collect()
    assert len(got) == 5
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(pad), zlib.crc32(pad[-32:]))
    files = {k: media.store(bytes(range(64)) * 9, k) for k in media.STORED}
    for kind, blob in files.items():
        assert media.samples(blob, kind) == bytes(range(64)) * 9
        found = media.outermost(media.locate(b"junk BM \x89PNG\r\n\x1a\n" + blob + b"tail"))
        assert [(x, y, k) for x, y, k in found if k == kind] == [(16, 16 + len(blob), kind)]
        assert not [x for x in media.locate(blob[:-1]) if x[2] == kind and x[0] == 0]
    out = media.sniff(spark.createDataFrame([(None, "a/b", 1), (bytearray(), "a/b", 2), (bytearray(b"??" + files["audio/wav"]), "image/png", 3)], "media binary, declared string, found int").selectExpr("*", "found as corrected", "found as `a.b`")).collect()
    assert [r.sniffed for r in out] == [None] * 3 and [len(r.found) for r in out] == [0, 0, 1] and [r["a.b"] for r in out] == [1, 2, 3]


def test_classifiers_on_odd_and_empty_rows(spark):
    texts = [None, "", "123", "good words here. all fine", "you zorg! bad zorg", "plain text again", "zorg zorg"] * 12
    df = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, 0 if t and "zorg" in t else 1, int(bool(t and "zorg" in t))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for r in module.digest(df, labels).collect():
            assert 0 <= r.score <= 1
        assert module.digest(df.limit(0), labels.limit(0)).count() == 0
    out = {r.doc_id: r for r in language_id.digest(df).collect()}
    assert all((out[i].lang_pred == "und") == (not t or t == "123") for i, t in enumerate(texts))
    assert language_id.digest(df.limit(0)).count() == 0


def test_revisits(spark):
    rows = [
        ("r1", "http://www.a.com/x/#f", 10, "response", 200, 'ETag: "1"\r\nContent-Length: 9\r\nServer: s'),
        ("r2", "https://a.com/x?utm_source=q", 30, "response", 200, 'ETag: "2"'),
        ("v1", "a.com/x", 20, "revisit", 304, 'etag: W/"1"\r\nContent-Length: 0\r\nServer: t\r\nServer: u'),
        ("v2", "http://A.COM:80/x/", 40, "revisit", 304, 'ETag: "1"'),
        ("v3", "http://a.com/x", 10, "revisit", 304, None),
        ("v4", None, 50, "revisit", 304, "x"),
        ("v5", "http://a.com/x", 60, "revisit", 304, ""),
        ("v1", "a.com/x", 20, "revisit", 304, 'etag: W/"1"'),
    ]
    df = spark.createDataFrame([(*r[:2], r[2], *r[3:], 1) for r in rows], "record_id string, url string, t long, record_type string, status int, http_headers string, page int").selectExpr("*", "timestamp_seconds(t) as ts")
    for buckets in (1, 5, 64):
        out = sorted((r.record_id, r.outcome, r.response_id) for r in revisits.resolve(df, buckets).collect())
        assert out == [("v1", "resolved", "r1"), ("v1", "resolved", "r1"), ("v2", "changed", "r2"), ("v3", "no_response", None), ("v4", "incomplete", None), ("v5", "unchecked", "r2")]
    merged = {r.headers for r in revisits.resolve(df).where("record_id = 'v1'").collect()}
    assert 'content-length: 9\netag: W/"1"\nserver: t' in merged
    assert revisits.resolve(df.limit(0)).count() == 0
