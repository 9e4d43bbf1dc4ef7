import random

import numpy as np
import pyarrow as pa
import pytest

from rillwork.llm import bpe, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "'s", "'", "'re", "é", "ß", "中", "1", "23", "!", "!!", "<|endoftext|>", "<|endo", "|>", "\xa0", " ", "\x1c", "\x85", "😀", "aaaa", "ing", "tion", "\r\n", "x" * 300, " " * 40]


@pytest.fixture(scope="module")
def ours():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def theirs():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_same_ids_and_text_as_the_library(ours, theirs):
    rng = random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        want = theirs.encode(s, add_special_tokens=False).ids
        assert ids(ours.encode(s)) == want, s
        assert ours.decode(ours.encode(s)) == theirs.decode(want, skip_special_tokens=False), s


def test_every_character_splits_alike(ours, theirs):
    chars = [chr(c) for c in [*range(0x3100), *range(0xA000, 0xABFF, 7), *range(0xF900, 0xFFFF, 5), *range(0x10000, 0x1FFFF, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}1{c} {c}" for c in chars]
    for s, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ids(ours.encode(s)) == want.ids, s.encode()


def test_streams_in_any_chunks(ours, theirs):
    rng = random.Random(2)
    for _ in range(1500):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        data = s.encode()
        enc, out, at = bpe.StreamEncoder(ours, hold=rng.choice([2, 5, 100])), b"", 0
        while at < len(data):
            n = rng.randint(1, 9)
            out += enc.feed(data[at : at + n])
            at += n
        assert ids(out + enc.finish()) == theirs.encode(s, add_special_tokens=False).ids, s
        dec = bpe.Decoder(ours)
        data = ours.encode(s)
        cut = rng.randint(0, len(data) // 4) * 4
        assert dec.feed(data[:cut]) + dec.feed(data[cut:]) + dec.finish() == s


def test_runs_of_texts(ours, theirs):
    rng = random.Random(3)
    more = [*PIECES, "don't", "'t", "\u2003", "\u3000", " \n", "A1b2", "--", "…", "<|endoftext|", "'ll've", "\x1f", " 's"]
    for _ in range(300):
        texts = ["".join(rng.choice(more) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 8))]
        column = pa.array([None if not t and rng.random() < 0.5 else t for t in texts], pa.string())
        found = dict((i, b"".join(parts)) for i, parts in bpe.encoded(ours, column))
        assert [ids(found[i]) for i in range(len(texts))] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)], texts


@pytest.mark.parametrize("text", ["ab" * 400_000, "xy " * 300_000, "\u3000" * 200_000, " " * 700_000 + "a", "<|endoftext|>" * 70_000, "12" * 300_000 + "!" * 200_000])
def test_long_texts_stream_in_constant_memory(ours, theirs, monkeypatch, text):
    monkeypatch.setattr(bpe, "RUN", 1 << 16)
    stream, out, held = bpe.StreamEncoder(ours), [], 0
    data = text.encode()
    for at in range(0, len(data), 1000):
        out.append(stream.feed(data[at : at + 1000]))
        window = len(stream.machine.window) if stream.machine else 0
        held = max(held, len(stream.rest) + len(stream.text) + window)
    out.append(stream.finish())
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids(b"".join(out)) == want
    assert held < 4 * stream.hold + 2 * ours.merges.lookahead + 4000
    (row, parts), = bpe.encoded(ours, pa.array([text]))
    assert row == 0 and max(map(len, (parts := list(parts)))) <= 8 * bpe.CHUNK and ids(b"".join(parts)) == want


def test_hashes_that_agree_do_not_mix_pieces(ours, monkeypatch):
    monkeypatch.setattr(bpe.textbytes, "word_hashes", lambda raw, a, b: (b - a).astype(np.uint64))
    text = "one two six ten 123 456 abc; def;"
    assert ours.decode(ours.encode(text)) == text


def test_kept_pieces_are_bounded():
    kept = bpe.Kept(limit=5000)
    for i in range(10_000):
        kept.put(b"%d" % i, b"x" * 8)
        assert len(kept.new) + len(kept.old) < 60
    assert kept.get(b"9999") == b"x" * 8 and kept.get(b"0") is None
    kept.put(b"x" * 1000, b"")
    assert kept.get(b"x" * 1000) is None


def test_window_stays_within_the_lookahead(ours):
    for word in ("ab" * 4000, "the" * 3000, "=" * 9000, "aaaaabaaab" * 900, "éà" * 2000):
        t, most, out = bpe.Transducer(ours.merges), 0, []
        data = word.encode()
        for k in range(0, len(data), 11):
            out += t.feed(data[k : k + 11])
            most = max(most, len(t.window))
        assert out + t.finish() == ours.merges.encode_word(data)
        assert most <= ours.merges.lookahead + ours.merges.longest


def _plain(merges, data):
    """Repeatedly join the pair of the lowest rank, leftmost first."""
    seq = [merges.id_of[bytes([b])] for b in data]
    made = {(a, b): (r, merges.id_of[merges.bytes_of[a] + merges.bytes_of[b]]) for (a, b), r in merges.rank.items()}
    while True:
        best = min(((made[p][0], i) for i, p in enumerate(zip(seq, seq[1:])) if p in made), default=None)
        if best is None:
            return seq
        i = best[1]
        seq[i : i + 2] = [made[seq[i], seq[i + 1]][1]]


@pytest.mark.parametrize("seed", range(12))
def test_random_merge_lists(seed):
    rng = random.Random(seed)
    tokens = {0: b"a", 1: b"b", 2: b"c"}
    merges = []
    while len(merges) < 14:
        a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
        if len(tokens[a]) + len(tokens[b]) <= 12 and tokens[a] + tokens[b] not in tokens.values():
            c = len(tokens)
            tokens[c] = tokens[a] + tokens[b]
            merges.append((a, b, c))
    m = bpe.Merges(tokens, merges)
    for _ in range(300):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        want = _plain(m, word)
        assert m.encode_word(word) == want
        assert ids(bpe.Lanes(m).encode([word])[0]) == want
        t, out = bpe.Transducer(m), []
        t.step = 1
        for k, byte in enumerate(word):
            out += t.feed(bytes([byte]))
            assert len(t.window) <= m.lookahead + m.longest
        assert out + t.finish() == want
        # what follows beyond the lookahead changes nothing before it
        tail = bytes(rng.choice(b"abc") for _ in range(m.lookahead + m.longest))
        more = _plain(m, word + tail)
        other = _plain(m, word + tail + bytes(rng.choice(b"abc") for _ in range(9)))
        cut = lambda seq: [t for t, e in zip(seq, np.cumsum([len(tokens[x]) for x in seq])) if e <= len(word)]
        assert cut(more) == cut(other)


def test_improper_lists_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({0: b"a", 1: b"aa", 2: b"aaa"}, [(0, 1, 2), (0, 0, 1)])


def test_documents(spark, theirs):
    import hashlib

    rows = [(1, "Hello  world\n", 5), (2, None, 5), (3, "", 5), (4, "x" * 200_000 + " <|endoftext|>", 5), (4, "é" * 70_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.digests(df, PATH).collect()))
    want = []
    for i, text, _ in rows:
        e = theirs.encode(text or "", add_special_tokens=False).ids
        back = theirs.decode(e, skip_special_tokens=False)
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_histogram_answers_every_limit(spark):
    n = [0, 0, 3, 3, 7, 300, 301, 1000, 5]
    hist = token_counts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")).cache()
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert r.docs == n.count(x) and r.docs_longer == sum(v > x for v in n) and r.tokens_longer == sum(v for v in n if v > x)
        assert r.truncated_total == sum(min(v, x) for v in n) and r.share_upto == pytest.approx(sum(v <= x for v in n) / len(n))
    for r in token_counts.answers(hist, [0, 1, 4, 300, 5000]).collect():
        assert r.truncated_total == sum(min(v, r.context) for v in n) and r.docs_longer == sum(v > r.context for v in n)
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(n)[4]
    assert token_counts.histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_counts_match_encoding(spark, theirs):
    texts = ["a b c", None, "", "word " * 50, "word " * 50]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, docs int")
    got = {r.n_tokens: r.docs for r in token_counts.count_tokens(df, PATH).collect()}
    want = {}
    for t in texts:
        k = len(theirs.encode(t or "", add_special_tokens=False).ids)
        want[k] = want.get(k, 0) + 1
    assert got == want
