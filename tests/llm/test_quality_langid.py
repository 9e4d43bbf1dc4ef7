import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.llm import langid, quality
from rillwork.llm.queries import op1_quality, op5_language_id


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = op1_quality(spark, d).where("held_out").join(labels, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op5_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([None, "", " ", "x" * 200_000, "ok words here"] + ["good prose, as it goes. "] * 20 + ["$$$ !!! ###"] * 20)] + [(None, "t", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(5, 25)] + [(i, 0) for i in range(25, 45)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == 46 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    by = {r.doc_id: r.score for r in rows}
    assert by[6] > 0.5 > by[26] and by[0] == by[1]
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    one = quality.score_documents(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_density_difference_matches_the_formula():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (200, 3))
    m = quality.fit({0: (300, a.sum(0), a.T @ a), 1: (200, b.sum(0), b.T @ b)}, 0.0, 0.0)
    x = rng.normal(0, 2, (50, 3))

    def logpdf(x, s):
        mu, cov = s.mean(0), np.cov(s.T, bias=True)
        z = x - mu
        return -0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.log(np.linalg.det(cov)))

    want = 1 / (1 + np.exp(logpdf(x, a) + np.log(0.6) - logpdf(x, b) - np.log(0.4)))
    assert np.allclose(m.score(x), want)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Hello world. Hello!", "", "AAA AAA BBB", "é ß 中 12$$", "x"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = quality.statistics(raw, off)
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.statistics(own, np.array([0, len(own)])), together[i : i + 1])


LANGS = {"aa": "kala muno tiri ", "en": "the and with shing ", "de": "der und schein keit ", "xx": "zob wug blip "}


def test_language_edges(spark):
    rows = [(i, LANGS[k] * (1 + i % 5), k) for i, k in enumerate(list(LANGS) * 30)]
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", "en"), (1003, "中文", None), (1004, "the and " * 40_000, None), (1005, "rare one", "qq"), (None, "und der keit schein", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows) + len(extra)
    for i, _, k in rows:
        assert got[i].lang_pred == k and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred in {*LANGS, "qq"} and got[1004].lang_pred == "en" and got[None].lang_pred == "de"
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {1000, 1001, 1002}
    blank = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blank} == {"und"}
    single = langid.identify(docs.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in single} == {"en", "und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_the_answer_ignores_the_label_columns(spark):
    rows = [(i, LANGS[k] * 3, k) for i, k in enumerate(list(LANGS) * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    import pyarrow as pa

    names, _ = langid.predict_column(model, pa.array([LANGS["de"], LANGS["xx"]]))
    assert names == ["de", "xx"]


def test_separating_machine():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1, 0.3, (40, 5)), rng.normal(-1, 0.3, (20, 5))])
    y = np.array([1.0] * 40 + [-1.0] * 20)
    w = langid.train_svm(x, y)
    assert ((x @ w[:-1] + w[-1]) * y > 0).all()
    assert pytest.approx(w, abs=1e-9) == langid.train_svm(x, y)


def test_many_languages_are_all_learned(spark):
    rng = np.random.default_rng(5)
    words = {f"x{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(6)] for k in range(300)}
    rows = [(k, " ".join(rng.permutation(words[c])), c) for k, c in enumerate(list(words) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, rest=300)
    assert sum(map(len, model.of)) == 300 and len(model.families) == 300
    import pyarrow as pa

    names, score = langid.predict_column(model, pa.array([" ".join(w) for w in words.values()]))
    assert np.mean([a == b for a, b in zip(names, words)]) > 0.98 and ((score >= 0) & (score <= 1)).all()


def _vector_by_hand(text):
    """Trigrams of bytes within the text, letters folded, other ASCII blank, none with two blanks side by side."""
    fold = lambda b: b if b >= 0x80 else b | 0x20 if chr(b).isalpha() else 0x20
    c = [fold(b) for b in text.encode()]
    counts = {}
    for a, b, d in zip(c, c[1:], c[2:]):
        if not (a == b == 0x20 or b == d == 0x20):
            slot = (((a << 16 | b << 8 | d) * 2654435761) & 0xFFFFFFFF) >> (32 - langid.BITS)
            counts[slot] = counts.get(slot, 0) + 1
    norm = sum(counts.values()) ** 0.5
    return {k: v**0.5 / norm for k, v in counts.items()}


def _predict_by_hand(model, text):
    if not any(ch.isalpha() for ch in text or ""):
        return "und", 0.0
    x = _vector_by_hand(text)
    margin = lambda w: sum(v * w[k] for k, v in x.items()) + w[-1]
    logistic = lambda z: 1 / (1 + np.exp(-z))
    sure, f = 1.0, 0
    if model.top is not None:
        m = [margin(w) for w in model.top]
        f = m.index(max(m))
        sure = logistic(2 * (m[f] - max(v for i, v in enumerate(m) if i != f)))
    languages = model.of[f]
    wins, lead = [0.0] * len(languages), [np.inf] * len(languages)
    for i, j, w in model.pairs[f]:
        d = margin(w)
        wins[i] += (d >= 0) + logistic(d) * 1e-3
        wins[j] += (d < 0) + logistic(-d) * 1e-3
        lead[i], lead[j] = min(lead[i], d), min(lead[j], -d)
    best = wins.index(max(wins))
    return languages[best], sure * (logistic(4 * lead[best]) if model.pairs[f] else 1.0)


def test_languages_by_hand(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    for r in rows[:120]:
        name, score = _predict_by_hand(model, texts[r.doc_id])
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-4)


def _statistics_by_hand(text):
    """The features of one text by plain loops, in FEATURES' order."""
    import math
    import re

    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n, size = len(words), len(data)
    chars = len(text or "")
    sentence, plain = b".,;:?'\"()-", bytes(range(0x21, 0x7F))
    is_mark = lambda b: b in plain and not chr(b).isalnum() and b not in sentence
    odds = lambda part, whole, typical, weight: (lambda p: math.log((p + 0.005) / (1 - p + 0.005)))((part + weight * typical) / (whole + weight))
    low = [bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in w) for w in words]
    mean = sum(map(len, words)) / max(n, 1)
    variance = max(sum(len(w) ** 2 for w in words) / max(n, 1) - mean**2, 0)
    share = lambda test: odds(sum(map(test, data)), chars, *PRIOR[test])
    tests = [
        (lambda b: 0x61 <= b <= 0x7A, 0.78), (lambda b: 0x41 <= b <= 0x5A, 0.02), (lambda b: 0x30 <= b <= 0x39, 0.005),
        (lambda b: b in b"\r\n", 0.005), (lambda b: b in sentence, 0.03), (is_mark, 0.002), (lambda b: b >= 0xC0, 0.03),
    ]
    PRIOR = {f: (p, 50.0) for f, p in tests}
    most = max((low.count(w) for w in low), default=0)
    return [
        math.log1p(n), math.log((size + 60) / (n + 10)), 0.5 * math.log((variance * n + 100) / (n + 10)), math.log((len(set(low)) + 10) / (n + 10)),
        odds(sum(a == b for a, b in zip(low, low[1:])), n, 0.01, 10), odds(sum(a == b for a, b in zip(low, low[2:])), n, 0.01, 10),
        *(share(f) for f, _ in tests), odds(sum(is_mark(w[-1]) for w in words), n, 0.005, 10),
        odds(sum(len(w) > 1 and all(0x41 <= b <= 0x5A for b in w[:2]) for w in words), n, 0.005, 10), odds(max(most - 1, 0), n, 0.05, 10),
    ]


def test_statistics_by_hand(spark):
    import pyarrow as pa

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:60]
    texts += ["", None, "a", "The the THE  the.", "12 $$ ## ab$", "é ß 中 WORD WORD x\r\n\r\nx", "a b a b a b", "\t\x0b  "]
    assert np.allclose(quality.batch_statistics(pa.array(texts)), [_statistics_by_hand(t) for t in texts], atol=1e-9)
