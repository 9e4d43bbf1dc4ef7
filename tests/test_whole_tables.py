"""Queries over whole tables that SQL has no fast form for, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import kernels, tiles
from rillwork.plans import catalogue

Q = catalogue.queries()


@pytest.fixture(scope="module")
def raster(spark, tmp_path_factory):
    z = np.random.default_rng(3).normal(0, 0.25, (130, 64)).astype(np.float32)
    z[50:80, 10] = 1.0  # a wall across row 60
    d = str(tmp_path_factory.mktemp("raster"))
    spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(z)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, z.astype(float)


def regions(mask):
    left, out = {(int(i), int(j)) for i, j in np.argwhere(mask)}, []
    while left:
        todo = [left.pop()]
        for i, j in todo:
            near = {(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)} & left
            left -= near
            todo += near
        out.append(todo)
    return out


def test_floodplain_mask_across_tiles(spark):
    z = np.random.default_rng(5).normal(10, 1, (50, 40))
    z[10:30, 8:30] = 1.0
    z[14:20, 14:17] = 20.0  # a hole across a tile edge
    z[20:24, 20:30] = 20.0  # a bay
    want = np.zeros(z.shape, bool)
    for own in regions(z <= 10):
        for i, j in own:
            want[i, j] = len(own) >= 30
    for own in regions(~want):
        if len(own) < 30 and not any(i in (0, 49) or j in (0, 39) for i, j in own):
            for i, j in own:
                want[i, j] = True
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(50) for j in range(40)], "row long, col long, height double")
    got = {(r.row, r.col): r.inside for r in tiles.floodplain_mask(cells, 1.0, 10.0, 30.0, 16).collect()}
    assert got == {(i, j): bool(want[i, j]) for i in range(50) for j in range(40)}


def test_mask_components_of_all_rows(spark, raster):
    d, z = raster
    left, want = {(int(i), int(j)) for i, j in np.argwhere(z > 0.25)}, []
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        for i, j in todo:
            near = {(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        want.append((*min(todo), len(todo)))
    assert max(w[0] for w in want) >= 100
    assert sorted((r.first_row, r.first_col, r.n) for r in Q["mask_components"](spark, d).collect()) == sorted(want)


def test_dilate_mask_of_all_rows(spark, raster):
    d, z = raster
    at = np.argwhere(z > 0.3)
    want = {(i, j) for i in range(len(z)) for j in range(64) if (((at - (i, j)) ** 2).sum(1) <= 9).any()}
    got = [(r.row, r.col) for r in Q["dilate_mask"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_window_tiles_of_all_points(spark, raster):
    assert {r.id for r in Q["window_tiles"](spark, raster[0]).select("id").distinct().collect()} == set(range(130))


def test_graph_smooth_of_all_links(spark, sf):
    links = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity").collect()
    ids = sorted({k for r in links for k in r[:2] if r[0] != r[1]})
    at = {k: i for i, k in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for u, v, n in links:
        if u != v:
            w[at[u], at[v]] += float(n)
            w[at[v], at[u]] += float(n)
    x = np.array([k * 37 % 100 / 100 for k in ids])
    for _ in range(20):
        x = 0.5 * x + 0.5 * (w @ x) / w.sum(1)
    got = {r.id: r.value for r in Q["graph_smooth"](spark, sf).collect()}
    assert sorted(got) == ids and max(ids) >= 50
    assert np.allclose([got[k] for k in ids], x, atol=2e-6)


@pytest.mark.parametrize("size", [16, 64, 512])
def test_tile_size_changes_nothing(spark, size):
    z = np.random.default_rng(8).normal(0, 0.25, (70, 45))
    z[20:50, 10:30] -= 2.0  # a pit over several tiles
    z[5, 3:40] = 0.9
    z[60:64, 40:44] = np.nan
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(70) for j in range(45)], "row long, col long, z double").cache()
    grid = lambda rows, name: {(r["row"], r["col"]): r[name] for r in rows}
    filled = grid(tiles.fill(cells, size).collect(), "filled")
    want = kernels.flood_fill(z)
    assert len(filled) == z.size and all(filled[p] == want[p] or np.isnan(want[p]) and filled[p] is None for p in np.ndindex(z.shape))
    got = tiles.depressions(cells, size=size).collect()
    lab, rows = kernels.depressions(z)
    first = [tuple(np.argwhere(lab == r["label"])[0].tolist()) for r in rows]
    assert sorted((r.first_row, r.first_col, round(r.max_depth, 9), r.area_m2, round(r.volume_m3, 9)) for r in got) == sorted(
        (*f, round(r["max_depth"], 9), r["area_m2"], round(r["volume_m3"], 9)) for f, r in zip(first, rows)
    )
    with np.errstate(invalid="ignore"):
        weak, strong = z > 0.1, z > 0.3
    assert grid(tiles.hysteresis(cells.fillna(-9.0), "z > 0.1", "z > 0.3", size).collect(), "kept") == {p: bool(v) for p, v in np.ndenumerate(kernels.hysteresis(weak, strong))}
    assert grid(tiles.drop_small(cells.fillna(-9.0), "z > 0.1", 4, size).collect(), "kept") == {p: bool(v) for p, v in np.ndenumerate(kernels.drop_small(weak, 4))}


@pytest.mark.parametrize("size", [16, 64])
def test_flow_of_whole_rasters(spark, size):
    z = np.round(np.random.default_rng(11).normal(0, 1, (45, 52)) + np.abs(np.arange(52) - 20) * 0.1)  # many flats, some across tiles
    z[5:8, 40:44] = np.nan
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(45) for j in range(52)], "row long, col long, z double")
    pits = [(r.row, r.col) for r in tiles.pit_flats(cells, size).collect()]
    assert sorted(pits) == sorted((int(i), int(j)) for i, j in kernels.pit_flats(z)) and pits
    level = kernels.flood_fill(z)
    direction = kernels.flow_directions(level)
    area = kernels.accumulate(direction, np.ones(z.shape))
    order = kernels.strahler_streams(direction, area, 6.0)
    filled = tiles.fill(cells, size).select("row", "col", F.col("filled").alias("z"))
    areas = tiles.accumulate(tiles.directions(filled, size), 1.0, size)
    rows = areas.join(tiles.stream_order(areas, 6.0, size), ["row", "col"]).collect()
    assert len(rows) == z.size and order.max() >= 3
    for r in rows:
        assert (r.direction, r.area, r.stream_order) == (direction[r.row, r.col], area[r.row, r.col], order[r.row, r.col])


def test_distance_to_mask_of_odd_rasters(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    z = np.random.default_rng(13).normal(0, 0.13, (150, 20))
    rows = [(i, [None if i == 7 and j == 3 else float(x) for j, x in enumerate(row)]) for i, row in enumerate(z)]
    rows += [(i, [0.0] * 20) for i in range(100, 150)]  # rows given twice
    rows += [(i, [float("nan")] + [0.0] * 18 + [float("-inf")]) for i in (20, 130)] + [(None, [1.0] * 3), (None, [1.0] * 3), (151, None), (152, [])]
    rows += [(i - 400, [1.0 if i == 15 else 0.0]) for i in range(40)]
    rows += [(10**18 + i, [1.0 if i % 37 == 0 else 0.0] * 5) for i in range(160)]  # beyond what a double tells apart
    spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(f'select "row", col, dist from ({catalogue.oracle_sql()["distance_to_mask"]})').fetchall()
    got = [tuple(r) for r in Q["distance_to_mask"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[2] == np.inf and r[0] is not None for r in got)
