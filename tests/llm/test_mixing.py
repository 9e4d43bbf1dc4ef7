import re

import pytest

from rillwork.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes: dict, weights=(5, 2, 1), cap=3.0):
    """Water filling by hand: share, stop at the cap, reshare the excess until none is above."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, total = {}, set(order), float(sum(sizes.values()))
    while left:
        share = (total - sum(out.values())) / sum(w[s] for s in left)
        full = {s for s in left if share * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: share * w[s] for s in left}
            break
        out |= {s: cap * sizes[s] for s in full}
        left -= full
    return out


def check(rows, texts):
    sizes = {}
    for _, text, source in texts:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = fill(sizes)
    taken = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    by_id = {}
    for i, text, source in texts:
        by_id[i] = (len(WORD.findall(text or "")), source)
    for r in rows:
        size, source = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        taken[source] = taken.get(source, 0) + r.taken
    return want, taken, sizes


def test_targets_and_budgets(spark):
    texts = []
    for s, n in (("a", 400), ("b", 30), ("é", 900), (None, 250), ("c", 3)):
        texts += [(len(texts) + k, "w " * (1 + (k * 7) % 23), s) for k in range(n)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    want, taken, _ = check(rows, texts)
    for s in want:
        assert abs(taken[s] - want[s]) <= 24, s  # within a document of the budget
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_hot_source_and_repeated_rows(spark):
    texts = [(k, "a b c", "hot") for k in range(500)] + [(k, "a b", "cold") for k in range(500, 520)] + [(9999, "x y", "twin")] * 40
    rows = mixing.mix(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()
    assert len(rows) == len(texts)
    want, taken, _ = check(rows, texts)
    for s in want:  # equal rows too are taken one by one
        assert abs(taken[s] - want[s]) <= 3, s
    again = mixing.mix(spark.createDataFrame(texts[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    kept = mixing.mixed_documents(spark.createDataFrame(texts, "doc_id long, text string, source string")).groupBy("source").count().collect()
    assert {r["source"]: r["count"] * {"hot": 3, "cold": 2, "twin": 2}[r["source"]] for r in kept} == taken


def test_nulls_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, None, 1, 2), (1, "", "s", 1, 2), (2, "one two", "s", 1, 2)], "doc_id long, text string, source string, size int, h int")
    rows = mixing.mix(df).collect()
    assert sorted(r.size for r in rows) == [0, 0, 2]
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns


def test_documents_are_repeated_as_taken(spark):
    texts = [(k, "w " * (k % 5 + 1), "a" if k % 9 else "b") for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.taken // r.size if r.size else 0) for r in mixing.mix(df).collect()}
    counts = {}
    for r in mixing.mixed_documents(df).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {k: v for k, v in taken.items() if v}


def test_thresholds_nest(spark):
    from pyspark.sql import functions as F

    texts = [(k, "w " * (k % 11 + 1), "s") for k in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    sized = df.select("source", mixing.word_count(F.col("text")).alias("size"), mixing.row_hash(F.col("doc_id")).alias("h"))
    marks = [mixing.thresholds(sized, spark.createDataFrame([("s", float(b))], "source string, budget double"), bits=4).first().threshold for b in (100, 1000, 5000)]
    assert marks == sorted(marks)
