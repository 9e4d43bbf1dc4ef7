import numpy as np
import pytest

from rillwork.llm import neardup


def truth(rows, threshold=0.98):
    """vec_id, n_links, component by brute force, in row order."""
    x = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) and all(a is not None and np.isfinite(a) for a in v) and any(v)
        x.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(n)]
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
            for j in seen:
                comp[j] = (least,)
    return [(str(rows[i][0]), len(near[i]), str(comp[i][0]), bool(rows[i][0] is not None and rows[i][0] == comp[i][0])) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in neardup.near_duplicates(df, **kw).collect())


def data(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.4:
            base = rows[rng.integers(len(rows))]
            v = np.array(base[1]) + rng.normal(0, 0.04, dim) * (rng.random() < 0.8)
            rows.append((k, v.astype(np.float32).tolist(), base[2]))
        else:
            rows.append((k, rng.normal(0, 1, dim).astype(np.float32).tolist(), int(rng.integers(0, 3))))
    return rows


def test_small_cells_against_brute_force(spark):
    rows = data(1, 400)
    assert run(spark, rows) == sorted(truth(rows))


def test_split_cells_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_MAX", 150)
    monkeypatch.setattr(neardup, "CELL_AIM", 80)
    rows = data(2, 900)
    packed_deal = neardup.deal
    monkeypatch.setattr(neardup, "deal", lambda p, o: packed_deal(p, o, 150, 80))
    got, want = run(spark, rows), sorted(truth(rows))
    found, total = sum(min(a[1], b[1]) for a, b in zip(got, want)), sum(b[1] for b in want)
    assert found >= 0.9 * total and all(a[1] <= b[1] for a, b in zip(got, want))


def test_bad_vectors_and_copies(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
            (9, [float("inf"), 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1e-30, 0.0], 1), (2, [1.0, 0.0], 1)]
    assert run(spark, rows) == sorted(truth(rows))


def test_large_group_of_equal_vectors(spark):
    rows = [(k, [1.0, 2.0, 3.0], 0) for k in range(3000)] + [(5000, [1.0, 2.0, 3.001], 0), (5001, [3.0, -2.0, 1.0], 0)]
    got = run(spark, rows)
    assert ("5000", 3000, "0", False) in got and ("5001", 0, "5001", True) in got and ("0", 3000, "0", True) in got


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_shortfall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neardup, "audit", lambda *a, **k: 0.5)
    with pytest.raises(RuntimeError):
        run(spark, data(3, 60))


def small_cells(monkeypatch):
    monkeypatch.setattr(neardup, "CELL_MAX", 150)
    deal = neardup.deal
    monkeypatch.setattr(neardup, "deal", lambda p, o: deal(p, o, 150, 80))


@pytest.mark.parametrize("loose", [0, 400])
def test_clump_of_distinct_near_copies_is_whole(spark, monkeypatch, loose):
    small_cells(monkeypatch)
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 1, 32)
    rows = [(k, (centre + rng.normal(0, 0.05, 32)).astype(np.float32).tolist(), 0) for k in range(700)]
    rows += [(1000 + k, rng.normal(0, 1, 32).astype(np.float32).tolist(), 0) for k in range(loose)]
    assert run(spark, rows) == sorted(truth(rows))


def test_audit_is_by_label(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_MAX", 50)
    x = np.array([1.0, 0.0])
    packed = spark.createDataFrame([(k, "a:2" if k < 900 else "b:2", x.astype("<f8").tobytes(), 1) for k in range(1000)], "node long, cell string, x binary, copies long")
    links = spark.createDataFrame([(k, 899 if k < 900 else 9) for k in range(1000)], "node long, links long")
    assert neardup.audit(packed, links) == pytest.approx(9 / 99)


def test_growth_follows_the_united_graph_into_other_cells(spark):
    angles = [0.0, 0.06, 0.12, 0.18, 0.24]  # in range up to 0.2003
    cells = [["1"], ["1", "2"], ["2", "3"], ["3", "4"], ["4"]]
    rows = [(k, c, np.array([np.cos(a), np.sin(a)]).astype("<f8").tobytes(), k + 1) for k, a in enumerate(angles) for c in cells[k]]
    found = neardup._link_cells(spark.createDataFrame(rows, "node long, cell string, x binary, copies long"), 0.98, 16)
    links = {r.node: r.n for r in found.groupBy("node").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    want = {i: sum(j + 1 for j, b in enumerate(angles) if j != i and np.cos(a - b) >= 0.98) for i, a in enumerate(angles)}
    assert links == want
