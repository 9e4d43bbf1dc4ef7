import random
import re

import numpy as np
import pytest

from rillwork.llm import ngram_join
from rillwork.llm.textbytes import ASCII_LOWER, shingle_hashes, word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups[find(i)] = min(groups.get(find(i), doc), doc)
    return sorted((str(doc), len(sets[i]), str(groups.get(find(i)) if sets[i] else doc)) for i, (doc, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
            text = "  ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        elif kind < 0.45:
            text = line + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20)))
        elif kind < 0.5:
            text = rng.choice([None, "", " \n\t", "one", "One", "a b c d", "A b c d", "a b c d e"])
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 120)))
        rows.append((k, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 400)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n int").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_classes(df).collect())
    assert got == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (3, text + " end"), (7, "other " * 9), (None, "solo words here only now"), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_classes(df).collect())
    assert got == brute(rows)


def test_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(700):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(200)] = f"n{k}"
        rows.append((k, " ".join(words)))
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(9, 120) + [(1000, "same text again and again"), (1000, "same text again and again")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, __mark string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    classes = {int(c) for _, n, c in brute(rows) if n}
    bare = [i for i, t in rows if not shingles(t)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*classes, *bare])


def test_empty_table(spark):
    assert ngram_join.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.integers(0, 80, n).tolist())
        b = set(a)
        for x in list(a):
            if rng.random() < 0.15:
                b.discard(x)
        b |= set(rng.integers(100, 200, int(rng.integers(0, 6))).tolist())
        if not a or not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        assert len(a & b) >= ngram_join.least_overlap(len(a), len(b))
        pa, pb = sorted(a)[: ngram_join.prefix_length(len(a))], sorted(b)[: ngram_join.prefix_length(len(b))]
        first = min(a & b)
        assert first in pa and first in pb
        i, j = sorted(a).index(first), sorted(b).index(first)
        assert min(len(a) - i, len(b) - j) >= ngram_join.least_overlap(len(a), len(b))


def test_hashes_do_not_depend_on_place():
    texts = ["Alpha beta  gamma\x0bdelta é eta", "", "x", " alpha BETA gamma delta é eta zeta", "a\x1cb c"]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    low = ASCII_LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, first = word_spans(low, off)
    words = [bytes(low[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in WORD.findall(t.translate(UP))]
    h = word_hashes(low, starts, ends)
    assert len(set(h.tolist())) == len(set(words))
    g, at = shingle_hashes(h, first, 5)
    assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
    assert g[at[0]] == g[at[3]]


def test_group_that_shares_much_and_links_little(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(500):
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = f"n{k}"
        rows.append((k, " ".join(words)))
    made, keep = {}, ngram_join.Scratch.keep

    def counted(self, df, tag):
        out = keep(self, df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "keep", counted)
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert made["pairs"] <= 8 * len(rows), made


def test_bits_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (3, 40, 400, 3000):
        for _ in range(50):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.append(a[int(rng.integers(0, n // 7 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64))
            if not ngram_join.linked(np.unique(a), np.unique(b)):
                continue
            x, y = (np.bincount((np.unique(h) % 256).astype(int), minlength=256) & 1 for h in (a, b))
            assert (x ^ y).sum() <= len(np.unique(a)) + len(np.unique(b)) - 2 * ngram_join.least_overlap(len(np.unique(a)), len(np.unique(b)))


def test_rounds_over_crowds_leave_other_postings_alone(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(200):  # shares much and links little: several rounds
        words = list(base)
        for at in rng.sample(range(60), 2):
            words[at] = f"n{k}"
        rows.append((k, " ".join(words)))
    blocks = [" ".join(f"b{k}x{i}" for i in range(40)) for k in range(600)]
    rows += [(1000 + k, f"{blocks[k]} {blocks[(k + 1) % 600]}") for k in range(600)]  # each n-gram in two texts, without links
    read, crowds = [], ngram_join.crowds

    def counted(postings):
        read.append(postings.count())
        return crowds(postings)

    monkeypatch.setattr(ngram_join, "crowds", counted)
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)
    assert len(read) >= 3 and sum(read) <= 2 * read[0], read
