import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.config import Config, Settings
from rillwork.functions import geometry, grid, scalars
from rillwork.operators import focal, graph, greedy, labels, metrics, near, rules, tiles, windows
from rillwork.sources import catalog, raster, readers


def points(spark, n, seed, size=100.0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.uniform(0, size), rng.uniform(-size, size)) for i in range(n)], "id long, x double, y double")


def test_near_pairs_match_all_pairs(spark):
    a, b = points(spark, 200, 1), points(spark, 150, 2)
    got = {(r.a_id, r.b_id) for r in near.near_pairs(a, b, 7.5).collect()}
    pa, pb = a.collect(), b.collect()
    assert got == {(p.id, q.id) for p in pa for q in pb if np.hypot(p.x - q.x, p.y - q.y) <= 7.5}


def test_points_without_place_join_nothing(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 0.0)], "id long, x double, y double")
    assert [r.a_id for r in near.near_pairs(a, a, 5.0).collect()] == [3]


@pytest.mark.parametrize("seed", range(3))
def test_independent_set_is_the_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, rng.randint(0, 5)) for i in range(80)]
    edges = list({tuple(sorted(rng.sample(range(80), 2))) for _ in range(140)})
    near_of = {i: set() for i in range(80)}
    for a, b in edges:
        near_of[a].add(b)
        near_of[b].add(a)
    live, want = set(range(80)), {}
    for i, rank in sorted(nodes, key=lambda n: (n[1], n[0])):
        if i in live:
            want[i] = True
            live -= near_of[i] | {i}
    got = greedy.independent_set(spark.createDataFrame(nodes, "id long, rank int"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id for r in got if r.chosen} == set(want)
    rank = dict(nodes)
    for r in got:
        assert r.by == (r.id if r.chosen else min((rank[j], j) for j in near_of[r.id] if j in want)[1])


@pytest.mark.parametrize("seed", range(3))
def test_matching_is_the_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(u, v, float(rng.randint(0, 9))) for u, v in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}]
    got = sorted((r.u, r.v, r.cost) for r in greedy.greedy_match(spark.createDataFrame(rows, "u long, v long, cost double")).collect())
    assert got == sorted(greedy.sequential_match([(c, u, v) for u, v, c in rows]))


def test_matching_of_nothing(spark):
    assert greedy.greedy_match(spark.createDataFrame([], "u long, v long, cost double")).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "u long, v long")
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), 1000, 1001, 2000]], "id long")
    got = {r.id: r.label for r in graph.components(nodes, e).collect()}
    assert set(got[i] for i in range(n + 1)) == {0} and got[1001] == 1000 and got[2000] == 2000


def tree(spark, seed, n=120):
    rng = random.Random(seed)
    return [(0, None, 1.0)] + [(i, rng.randrange(max(0, i - 12), i), float(rng.randint(1, 9))) for i in range(1, n)]


@pytest.mark.parametrize("seed", range(2))
def test_tree_operators(spark, seed):
    rows = tree(spark, seed)
    t = spark.createDataFrame(rows, "id long, parent long, area double")
    up = {i: [] for i, _, _ in rows}
    for i, p, _ in rows:
        if p is not None:
            up[p].append(i)

    def walk(i):
        kids = [walk(j) for j in up[i]]
        total[i] = rows[i][2] + sum(total[j] for j in up[i])
        top[i] = max([rows[i][2]] + [top[j] for j in up[i]])
        m = max(kids, default=0)
        order[i] = 1 if not kids else m + (kids.count(m) >= 2)
        return order[i]

    total, top, order = {}, {}, {}
    walk(0)
    assert {r.id: r.total for r in graph.upstream_sum(t, "area").collect()} == total
    assert {r.id: r.top for r in graph.propagate_max(t, "area").collect()} == top
    assert {r.id: r.order for r in graph.strahler(t).collect()} == order


def test_shortest_paths_with_a_detour(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0), (0, 1, 9.0), (7, 8, 1.0)], "u long, v long, cost double")
    got = {r.id: (r.dist, r.pred, r.source) for r in graph.shortest_paths(e, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {0: (0.0, None, 0), 2: (1.0, 0, 0), 1: (2.0, 2, 0), 3: (3.0, 1, 0)}


def test_peeling_stops_at_protected_edges(spark):
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 3, 5), (5, 5, 6), (6, 6, 3)], "id long, u long, v long")
    got = {r.id: r.round for r in graph.peel_leaves(e).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: None, 5: None, 6: None}
    kept = spark.createDataFrame([(1,)], "id long")
    assert {r.id for r in graph.peel_leaves(e, kept).collect() if r.round} == {3}


def test_orientation_follows_area(spark):
    r = spark.createDataFrame([(1, 10, 11, 1.0), (2, 12, 11, 2.0), (3, 12, 13, 3.0)], "id long, a long, b long, area double")
    got = {x.id: (x.from_node, x.to_node) for x in graph.orient(r).collect()}
    assert got == {1: (10, 11), 2: (11, 12), 3: (12, 13)} or got[2] == (11, 12)


def test_windows_leave_gaps_as_gaps(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 5.0), (0, 5, 9.0)], "row long, col long, z double")
    got = {r.col: r.v for r in focal.separable(cells, F.max, 3).collect()}
    assert got == {0: 5.0, 1: 5.0, 5: 9.0}


def test_tiles_with_halo_match_the_whole(spark):
    from rillwork.operators import kernels

    rng = np.random.default_rng(3)
    z = rng.normal(size=(50, 37))
    cells = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(50) for c in range(37)], "row long, col long, z double")
    got = tiles.run(cells, lambda a: {"v": kernels.gaussian(a, 1.0)}, {"v": "double"}, 16, 6).collect()
    assert len(got) == z.size
    want = kernels.gaussian(z, 1.0)
    assert max(abs(r.v - want[r.row, r.col]) for r in got) < 1e-9


def test_label_rules(spark):
    can = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 12.0, 0.0)], "id long, x double, y double")
    lab = spark.createDataFrame([(1, 1.0, 0.0, 5.0, 2, 1), (2, 0.5, 0.0, 5.0, 1, 0), (3, 100.0, 0.0, 5.0, 1, 1), (4, 11.0, 0.0, 5.0, 1, 1)], "id long, x double, y double, radius double, priority int, value int")
    got = {r.id: (r.label_id, r.value, r.n_labels, r.conflict) for r in labels.match(lab, can, 5.0).collect()}
    assert got == {1: (2, 0, 2, True), 2: (4, 1, 1, False)}  # a tie of distance goes to the lower candidate
    assert [r.id for r in labels.misses(lab, can, 5.0).collect()] == [3]
    assert [r.id for r in labels.near_positive(can, labels.match(lab, can, 5.0), 3.0).collect()] == [3]


def test_roles_are_a_partition(spark):
    rows = [(y, n, s) for y in (1, 0, None) for n in (True, False, None) for s in (True, False, None)]
    d = spark.createDataFrame(rows, "y int, n boolean, s boolean")
    for r in d.withColumns(rules.roles(F.col("y"), F.col("n"), F.col("s"))).collect():
        assert r.positive + r.negative + r.unlabelled + r.excluded == 1


def test_tiers(spark):
    rows = [(["gap", "testA"], 0.5, 0.0, 5.0, None, "high"), (["gap"], 0.5, 0.0, 50.0, None, "medium"), (["road_x_drain"], 0.1, 0.0, 2.0, 3.0, "bridge"), (["road_x_drain"], 0.1, 0.0, 2.0, None, "bridge_or_open"), (["gap", "testA"], 0.5, 0.9, 5.0, None, "low")]
    d = spark.createDataFrame(rows, "src array<string>, h double, veg double, road double, deck double, want string")
    for r in d.withColumn("t", rules.tier(F.col("src"), F.col("h"), F.col("veg"), F.col("road"), F.col("deck"), F.lit(False))).collect():
        assert r.t == r.want


def test_grid_ids(spark):
    d = spark.createDataFrame([(1_012_000.0, 6_234_000.0), (1_600_000.0, 5_300_000.0)], "e double, n double")
    got = d.select(grid.sheet_tile(F.col("e"), F.col("n"), 50_000).alias("s"), grid.sheet_tile(F.col("e"), F.col("n"), 500).alias("t"), grid.quadrant(F.col("e"), F.col("n")).alias("q")).collect()
    assert got[0].s == "AS01" and got[0].t == "AS01_500_001001" and got[0].q == "AS01_10000_0101_NW"
    b = d.select(*[c.alias(k) for k, c in grid.tile_bounds(grid.sheet_tile(F.col("e"), F.col("n"), 500)).items()], "e", "n").collect()
    for r in b:
        assert r.xmin <= r.e < r.xmax and r.ymin < r.n <= r.ymax and r.xmax - r.xmin == 240 and r.ymax - r.ymin == 360
    bad = spark.createDataFrame([("AI01",), ("AS01_500_999999",), ("x",)], "t string")
    assert all(r[0] is None for r in bad.select(grid.tile_bounds(F.col("t"))["xmin"]).collect())


def test_canonical_keys():
    assert scalars.canonical({"b": 1.0, "a": [0.1 + 0.2, None]}) == '{"a":[0.3,null],"b":1}'
    assert scalars.content_key({"a": 1, "b": 2.0}) == scalars.content_key({"b": 2, "a": 1.0})
    with pytest.raises(ValueError):
        scalars.canonical(float("nan"))


def test_content_keys_of_rows(spark):
    rows = [(1, "a b", None), (-7, 'q"\\/\u00e9', 3), (None, "", 0)]
    d = spark.createDataFrame(rows, "k long, t string, a int")
    got = [r[0] for r in d.select(scalars.content_key_of({"k": F.col("k"), "t": F.col("t"), "a": F.col("a")})).collect()]
    assert got == [scalars.content_key({"k": k, "t": t, "a": a}) for k, t, a in rows]


def test_merge_and_flatten():
    assert scalars.merge_deep({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert scalars.flatten({"a": {"b": 1}, "c": 2}) == {"a.b": 1, "c": 2}
    assert scalars.read_mapping("{'a': 1}") == {"a": 1} == scalars.read_mapping('{"a": 1}')


def test_settings():
    assert Settings.from_env({"RILLWORK_RESOLUTION": "4", "RILLWORK_SPATIAL_REUSE": "yes"}).resolution == 4
    for env in ({"RILLWORK_RESOLUTION": "3"}, {"RILLWORK_SPATIAL_REUSE": "perhaps"}, {"RILLWORK_LAND_SOURCE": "file"}):
        with pytest.raises(ValueError):
            Settings.from_env(env)
    assert Config().with_options(links={"max_m": 10.0}).links.max_m == 10.0
    with pytest.raises(ValueError):
        Config().with_options(links={"longest": 1})


def test_product_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c) if (r + c) % 3 else None) for r in range(20) for c in range(15)], "row long, col long, z double")
    raster.write_product({"z": cells, "twice": cells.withColumn("z", F.col("z") * 2)}, f"{tmp_path}/p", {"cell": 1.0, "crs": "X"}, 8)
    chunks, meta = raster.read_product(spark, f"{tmp_path}/p", "twice")
    got = {(r.row, r.col): r.z for r in raster.chunks_to_cells(chunks).collect()}
    assert meta == {"cell": 1.0, "crs": "X"} and got == {(r, c): 2.0 * (r * 10 + c) for r in range(20) for c in range(15) if (r + c) % 3}
    frame = grid.Frame(100.0, 200.0, 1.0, 20, 15)
    part = raster.read_window(raster.read_product(spark, f"{tmp_path}/p")[0], frame, 102.0, 190.0, 105.0, 195.0).collect()
    assert {(r.row, r.col) for r in part} == {(r, c) for r in range(5, 10) for c in range(2, 5) if (r + c) % 3}
    with pytest.raises(ValueError):
        raster.read_window(chunks, frame, 900.0, 0.0, 901.0, 1.0)
    with pytest.raises(ValueError):
        raster.check_frames([frame, grid.Frame(100.5, 200.0, 1.0, 5, 5)])
    assert raster.check_crs("a", "EPSG:2193+EPSG:7839", (1e6, 5e6, 1.1e6, 5.1e6), {"EPSG:2193"}) == "EPSG:2193"
    with pytest.raises(ValueError):
        raster.check_crs("a", "EPSG:2193", (170, -45, 171, -44), {"EPSG:2193"})


def test_mapping_and_drift(spark):
    assert catalog.missing_fields(["OBJECTID", "Width"], {"a": "width", "b": ["h", "objectid"], "c": "gone", "d": ["x", "y"]}) == ["gone", "x|y"]
    raw = spark.createDataFrame([("7", "-1", " Ford "), ("8", "250", None)], "OID string, W string, T string")
    spec = {"id_field": "oid", "fields": {"width": "w"}, "scale": {"width": 0.01}, "class_map": {"kind": ("t", {"ford": "ford"}, "other")}}
    got = [tuple(r) for r in catalog.harmonise(raw, spec, [("source_id", "string"), ("width", "double"), ("kind", "string"), ("note", "string"), ("source", "string")], "s").collect()]
    assert got == [("7", None, "ford", None, "s"), ("8", 2.5, "other", None, "s")]


def test_readers(spark, tmp_path):
    import json

    gj = {"features": [{"id": "a", "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}, "properties": {"k": "v"}}, {"id": "b", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 9]]]}, "properties": {}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(gj))
    f = readers.read(spark, "geojson", str(tmp_path / "a.geojson"))
    assert {r.id: (r.xmax, r.n) for r in f.select("id", "xmax", geometry.length(F.col("line")).alias("n")).collect()}["a"] == (3.0, 5.0)
    assert [r.id for r in readers.at_point(f, 5.0, 5.0).where("type = 'Polygon'").collect()] == ["b"]
    assert readers.layer(spark, str(tmp_path), "none") is None
    f.write.parquet(str(tmp_path / "lines"))
    assert [r.id for r in readers.layer(spark, str(tmp_path), "lines", (8.0, 8.0, 10.0, 10.0)).collect()] == ["b"]
    with pytest.raises(ValueError):
        readers.read(spark, "nonsense", "x")
    (tmp_path / "p1.json").write_text(json.dumps({"features": [{"i": 1}, {"i": 2}]}))
    (tmp_path / "p2.json").write_text(json.dumps({"features": [{"i": 3}]}))
    spark.dataSource.register(readers.PagedJson)
    pages = spark.read.format("rillwork_pages").option("pages", f"{tmp_path}/p1.json,{tmp_path}/p2.json").load()
    assert sorted(json.loads(r.row)["i"] for r in pages.collect()) == [1, 2, 3]
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"type": "way", "id": 5, "tags": {"waterway": "drain"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}, {"type": "node", "id": 6}]}))
    assert [(r.id, r.waterway) for r in readers.read(spark, "overpass", str(tmp_path / "o.json")).collect()] == [(5, "drain")]


def test_stream_drops_repeats(spark, tmp_path):
    from rillwork.streaming import log

    spark.sql("select 's' as source, 'h' as sha256, timestamp'2024-01-01 00:00:00' as at union all select 's', 'h', timestamp'2024-01-01 00:01:00' union all select 's', 'g', timestamp'2024-01-01 00:02:00'").write.parquet(f"{tmp_path}/in")
    q = log.first_seen(log.read_log(spark, f"{tmp_path}/in", "source string, sha256 string, at timestamp")).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_window_helpers(spark):
    d = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 0, 5, 0, 0, 7, 7, 0])], "line int, k int, z double")
    runs = [(r.run, r.z, r.n_rows) for r in windows.value_runs(d, ["line"], ["k"], "z").orderBy("run").collect()]
    assert runs == [(1, 0.0, 2), (2, 5.0, 1), (3, 0.0, 2), (4, 7.0, 2), (5, 0.0, 1)]
    bumps = [r.bump for r in windows.bed_bumps(d, ["line"], ["k"], "z", 2).orderBy("k").collect()]
    assert bumps[0] is None and bumps[2] == 5.0 and bumps[-1] is None


def test_rings_are_refused(spark):
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 1, 1.0)], "id long, parent long, v double")
    for run in (lambda: graph.levels(ring), lambda: graph.upstream_sum(ring, "v"), lambda: graph.propagate_max(ring, "v")):
        with pytest.raises(ValueError):
            run().collect()


def test_area_under_curve_with_ties_and_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(str(g), float(rng.integers(0, 12)), int(rng.integers(0, 2))) for g in range(3) for _ in range(80)] + [("one", 1.0, 1), (None, 1.0, 1), (None, 2.0, 0)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in {r[0] for r in rows}:
        pos, neg = ([s for k, s, y in rows if k == g and y == v] for v in (1, 0))
        want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) if pos and neg else None
        assert got[g] == (None if want is None else pytest.approx(want))
