"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors of a label are one node with a count, so exact copies cost nothing further.
2. Nodes are dealt to cluster cells: a cell over CELL_MAX nodes is split by k-means centres of a bounded sample (SAMPLE
   rows of the cell), each node going to its OVERLAP nearest centres, until every cell fits. Centres whose sample rows
   link with each other (CLUMP of the pairs or more) stay one cell; one that centres do not make smaller is a clump of near
   copies. It stays over CELL_MAX nodes and is compared exactly, in pairs of blocks, each a task of its own.
3. In each cell every node gets neighbours by robust pruning of its nearest candidates and some random ones, with edges
   both ways; the adjacency lists that a node got in its cells are united.
4. Each node is searched for in its cells: greedily from the cell's medoids, then, from every node in range, through all
   neighbours that are in range too, until no more are found. Links are verified in double precision. The growth goes on
   in other cells: united neighbours that share no cell with the node are joined to it in rounds, verified, and grown
   from, until a round finds no more. Only edges of up to twice the range are followed, as no other can end in range.
5. A pair that shares several cells is counted in the first of them only, so links are counted without listing pairs; a
   cell hands on one edge a node (to its local root), and components join these. Clumps come before other cells.
6. Recall is audited: AUDIT nodes of every label over CELL_MAX nodes, and AUDIT of all smaller ones, are compared with all
   nodes of their label by brute force in blocks, and the least share counts (labels with fewer than AUDIT true links are
   judged together). Below `recall`, everything is done again with more overlap; after the last try the shortfall is an
   error, never silent.

Defined cases: a null label, a null, empty or zero vector, and one with null or non-finite components links with nothing;
vectors of different length never link; repeated ids: a component is the least id of its rows, null if all are null; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, prepare
from .graph import components

THRESHOLD = 0.98
CELL_MAX = 3000
CELL_AIM = 1500
SAMPLE = 4096
OVERLAP = 2
CANDIDATES = 48
DEGREE = 16
ALPHA = 1.2
BEAM = 16
AUDIT = 256
CLUMP = 0.1
STUCK = 0.75


def unit_rows(packed: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes(rows: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows with their class key, and one node a class: node, label, dim, x (doubles, scaled by the largest), copies."""
    e = F.col(embedding).cast("array<double>")
    good = F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(e) > 0)
    good = good & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(F.coalesce(good, F.lit(False)), e).alias("e"))
    base = materialize(base, "emb-rows")
    own = base.where("e is not null").groupBy("label", "e").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    return base, materialize(own.withColumn("node", F.monotonically_increasing_id()), "emb-classes")


def pack(nodes: DataFrame) -> DataFrame:
    """node, cell (label and length), x binary, copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("e"):
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                out.append((v / np.abs(v).max()).astype("<f8").tobytes())  # no over- or underflow in squares
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("cell"), pa.array(out, pa.binary()), batch.column("copies")], ["node", "cell", "x", "copies"]
            )

    cell = F.concat_ws(":", F.col("label").cast("string"), F.size("e")).alias("cell")
    return nodes.select("node", cell, "e", "copies").mapInArrow(frugal(work), "node long, cell string, x binary, copies long")


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from k rows picked at random (seeded), so that a dense clump gets its share of centres and splits."""
    c = x[np.sort(np.random.default_rng(len(x)).choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            rows = x[own == j]
            if len(rows):
                mean = rows.sum(0)
                size = np.sqrt(mean @ mean)
                c[j] = mean / size if size > 0 else c[j]
    return c


def unite(x: np.ndarray, c: np.ndarray, threshold: float) -> np.ndarray:
    """Group of every centre: centres are one group if CLUMP or more of the pairs between their rows are in range."""
    own = (x @ c.T).argmax(1)
    home = np.eye(len(c))[own]
    linked = np.zeros((len(c), len(c)))
    for start in range(0, len(x), 512):
        hits = (x[start : start + 512] @ x.T >= threshold).astype(np.float64)
        linked += home[start : start + 512].T @ (hits @ home)
    size = home.sum(0)
    return np.unique(spread(linked >= CLUMP * np.maximum(np.outer(size, size), 1)), return_inverse=True)[1]


def nearest_groups(sims: np.ndarray, groups: np.ndarray, overlap: int) -> np.ndarray:
    """The `overlap` groups with the nearest centres, a row of sims each."""
    best = np.stack([sims[:, groups == g].max(1) for g in range(groups.max() + 1)], 1)
    return np.argsort(-best, axis=1, kind="stable")[:, :overlap]


def deal(packed: DataFrame, overlap: int, cell_max: int = CELL_MAX, cell_aim: int = CELL_AIM, threshold: float = THRESHOLD) -> DataFrame:
    """node, cell, x, copies with cells of at most cell_max rows, or clumps; a node is in `overlap` cells of each split."""
    done, open_rows = None, packed
    for _ in range(32):
        counts = materialize(open_rows.groupBy("cell").count(), "emb-cells")
        sized = open_rows.join(counts, "cell")
        fits = sized.where(F.col("count") <= cell_max).drop("count")
        done = fits if done is None else done.unionByName(fits)
        if counts.where(F.col("count") > cell_max).isEmpty():
            return materialize(done.dropDuplicates(["node", "cell"]), "emb-dealt")
        big = sized.where(F.col("count") > cell_max)
        picked = big.where(F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) < F.greatest(F.lit(SAMPLE / 2) / F.col("count"), F.lit(0)) * (1 << 20))

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node").head(SAMPLE)
            dim = len(pdf["x"].iloc[0]) // 8
            # twice as many centres as cells a node goes to at least, so that every split makes cells smaller
            k = int(min(max(2 * overlap, -(-overlap * int(pdf["count"].iloc[0]) // cell_aim)), 64, len(pdf)))
            x = unit_rows(list(pdf["x"]), dim)
            c = centres(x, k)
            groups = unite(x, c, threshold)
            fullest = np.bincount(nearest_groups(x @ c.T, groups, overlap).ravel()).max() / len(x)
            clump = groups.max() < overlap or fullest > STUCK
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "centres": [c.astype("<f8").tobytes()], "groups": [groups.astype(np.int32)], "clump": [bool(clump)]})

        learned = materialize(picked.groupBy("cell").applyInPandas(learn, "cell string, centres binary, groups array<int>, clump boolean"), "emb-centres")
        done = done.unionByName(big.join(learned.where("clump").select("cell"), "cell").drop("count"))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                take, cells = [], []
                known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
                for i, (cell, x, c, g) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("cell", "x", "centres", "groups")))):
                    v = np.frombuffer(x, "<f8")
                    if cell not in known:
                        known[cell] = np.frombuffer(c, "<f8").reshape(-1, len(v)), np.array(g)
                    near = nearest_groups((known[cell][0] @ v)[None, :], known[cell][1], overlap)[0]
                    take += [i] * len(near)
                    cells += [f"{cell}.{j}" for j in near]
                own = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.array(cells, pa.string()), own.column("x"), own.column("copies")], ["node", "cell", "x", "copies"])

        open_rows = materialize(big.join(learned.where("not clump"), "cell").mapInArrow(frugal(assign), "node long, cell string, x binary, copies long"), "emb-open")
    raise RuntimeError("cells did not become small enough")


def robust_prune(p: int, pool: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """From the pool, nearest first, drop every candidate that is alpha times nearer to one already taken than to p."""
    pool = pool[pool != p]
    to_p = 1 - x[pool] @ x[p]
    order = np.argsort(to_p, kind="stable")
    pool, to_p = pool[order], to_p[order]
    between = 1 - x[pool] @ x[pool].T
    left = np.ones(len(pool), bool)
    out = []
    for i in range(len(pool)):
        if left[i]:
            out.append(pool[i])
            if len(out) == degree:
                break
            left &= alpha * alpha * between[i] > to_p
    return np.array(out, np.int64)


def build(x: np.ndarray, seed: int, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of a bounded cell."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near: list[np.ndarray] = []
    for start in range(0, n, 512):
        sims = x[start : start + 512] @ x.T
        k = min(candidates + 1, n)
        near += list(np.argpartition(-sims, k - 1, axis=1)[:, :k])
    out = [robust_prune(p, np.unique(np.append(near[p], rng.integers(0, n, 8))), x, degree, alpha) for p in range(n)]
    back: list[list[int]] = [[] for _ in range(n)]
    for p, own in enumerate(out):
        for q in own:
            back[q].append(p)
    for p in range(n):
        both = np.unique(np.append(out[p], np.array(back[p], np.int64)))
        out[p] = both if len(both) <= 2 * degree else robust_prune(p, both, x, 2 * degree, alpha)
    return out


def medoids(x: np.ndarray, count: int = 4) -> np.ndarray:
    """The row nearest to the mean, and rows far from it and each other."""
    chosen = [int((x @ x.mean(0)).argmax())]
    far = 1 - x @ x[chosen[0]]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    return np.array(chosen, np.int64)


def range_search(q: np.ndarray, x: np.ndarray, links: list[np.ndarray], entry: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Rows with a cosine of `threshold` or more that the graph leads to: greedy beam search, then growth from all in range."""
    seen = np.zeros(len(x), bool)
    seen[entry] = True
    ids, sims = entry, x[entry] @ q
    fresh = np.ones(len(ids), bool)
    inside = [ids[sims >= threshold]]
    while fresh.any():
        i = int(np.where(fresh, sims, -np.inf).argmax())
        fresh[i] = False
        new = links[ids[i]]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            s = x[new] @ q
            inside.append(new[s >= threshold])
            ids, sims, fresh = np.append(ids, new), np.append(sims, s), np.append(fresh, np.ones(len(new), bool))
            if len(ids) > beam:
                best = np.argpartition(-sims, beam - 1)[:beam]
                ids, sims, fresh = ids[best], sims[best], fresh[best]
    found = np.concatenate(inside)
    front = found
    while len(front):
        new = np.unique(np.concatenate([links[i] for i in front]))
        new = new[~seen[new]]
        seen[new] = True
        front = new[x[new] @ q >= threshold]
        found = np.append(found, front)
    return found


def local_roots(n: int, pairs: list[np.ndarray]) -> np.ndarray:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(pairs):
        for j in own:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def spread(hits: np.ndarray) -> np.ndarray:
    """local_roots for a symmetric table of links: a node's row is read once, however many links it has."""
    root = np.full(len(hits), -1)
    for i in range(len(hits)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(hits[front].any(0) & (root < 0))
                root[front] = i
    return root


def in_range(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return np.concatenate([a[start : start + 512] @ b.T >= threshold for start in range(0, len(a), 512)])


def shared_earlier(cell: str, cells: list) -> dict[str, list[int]]:
    """Rows by the cells that come before this one."""
    out: dict[str, list[int]] = {}
    for i, own in enumerate(cells):
        for c in own:
            if c < cell:
                out.setdefault(c, []).append(i)
    return out


def outward(hits: np.ndarray, close, place) -> list[np.ndarray]:
    """A row of hits each: the neighbours, outside `place`, of all that it hits."""
    outside = [[v for v in own.tolist() if v not in place] for own in close]
    has = np.array([i for i, own in enumerate(outside) if own], np.int64)
    found: list[list[np.ndarray]] = [[] for _ in range(len(hits))]
    if len(has):
        ids, flat = np.unique(np.concatenate([outside[i] for i in has]), return_inverse=True)
        source = np.repeat(np.arange(len(has)), [len(outside[i]) for i in has])
        led = hits[:, has].astype(np.float32)
        for low in range(0, len(ids), 1024):
            here = (flat >= low) & (flat < low + 1024)
            edges = np.zeros((len(has), min(1024, len(ids) - low)), np.float32)
            edges[source[here], flat[here] - low] = 1
            for i, row in enumerate(led @ edges > 0):
                if row.any():
                    found[i].append(ids[low + np.flatnonzero(row)])
    return [np.concatenate(own) if own else np.zeros(0, np.int64) for own in found]


def _grow_across(start: DataFrame, info: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for the links between nodes that share no cell. start: p, q to look at; info: node, x, copies,
    cells, close. Each round verifies the new pairs and goes on with the neighbours of both ends of those in range."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for a, b in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                a, b = np.frombuffer(a, "<f8"), np.frombuffer(b, "<f8")
                hit.append(bool(a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), batch.column("ca"), batch.column("cb"), pa.array(hit, pa.bool_())], ["u", "v", "ca", "cb", "hit"])

    cells = info.select("node", "cells")
    vectors = info.select("node", "x", "copies")
    seen, linked = None, None
    while True:
        pairs = start.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).where("u <> v").distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["u", "v"], "left_anti")
        pairs = pairs.join(cells.toDF("u", "cu"), "u").join(cells.toDF("v", "cv"), "v").where(~F.arrays_overlap("cu", "cv")).select("u", "v")
        pairs = pairs.join(vectors.toDF("u", "xa", "ca"), "u").join(vectors.toDF("v", "xb", "cb"), "v")
        tried = materialize(pairs.mapInArrow(frugal(verify), "u long, v long, ca long, cb long, hit boolean"), "emb-tried")
        hits = tried.where("hit")
        linked = hits if linked is None else linked.unionByName(hits)
        if hits.isEmpty():
            break
        seen = tried.select("u", "v") if seen is None else seen.unionByName(tried.select("u", "v"))
        ends = hits.select(F.col("u").alias("p"), F.col("v").alias("node")).unionByName(hits.select(F.col("v").alias("p"), F.col("u").alias("node")))
        start = ends.join(info.select("node", "close"), "node").select("p", F.explode("close").alias("q"))
    one = linked.select(F.col("u").alias("node"), F.col("cb").alias("links"), F.col("v").alias("root"))
    return one.unionByName(linked.select(F.col("v").alias("node"), F.col("ca").alias("links"), F.col("v").alias("root")))


def _link_cells(dealt: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(node, links, root) a node and cell: copies linked in this cell as the pair's first, and the local root."""
    # clumps sort before other cells, so a pair that shares one is counted where nothing is missed
    counts = materialize(dealt.groupBy("cell").count(), "emb-sizes")
    sized = dealt.join(counts, "cell").withColumn("clump", F.col("count") > CELL_MAX)
    blocks = F.when(F.col("clump"), F.ceil(F.col("count") / CELL_MAX)).otherwise(1).cast("int")
    sized = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("cell", F.concat(F.when(F.col("clump"), "0").otherwise("1"), "cell")).drop("count")

    reach = 2 * threshold * threshold - 1 - 1e-9 if threshold > 0 else -2.0  # cosine at twice the angle of `threshold`

    def adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        x = unit_rows(list(pdf["x"]), len(pdf["x"].iloc[0]) // 8)
        near = build(x, len(ids))
        close = [own[x[own] @ x[i] >= reach] for i, own in enumerate(near)]
        return pd.DataFrame({"node": ids, "near": [ids[own] for own in near], "close": [ids[own] for own in close]})

    lists = dealt.groupBy("cell", "block").applyInPandas(adjacency, "node long, near array<long>, close array<long>")
    united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")]  # at most degree x cells
    lists = lists.groupBy("node").agg(*united)
    lists = materialize(lists, "emb-graph")
    cells = dealt.groupBy("node").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    members = materialize(dealt.join(lists, "node").join(cells, "node"), "emb-members")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids, cell = pdf["node"].to_numpy(), pdf["cell"].iloc[0]
        x = unit_rows(list(pdf["x"]), len(pdf["x"].iloc[0]) // 8)
        place = {v: i for i, v in enumerate(ids.tolist())}
        links = [np.array([place[v] for v in own.tolist() if v in place], np.int64) for own in pdf["near"]]
        entry = medoids(x)
        found = [range_search(x[i], x, links, entry, threshold, beam) for i in range(len(ids))]
        hits = np.zeros((len(ids), len(ids)), bool)
        for i, own in enumerate(found):
            hits[i, own] = hits[own, i] = True
        np.fill_diagonal(hits, False)
        roots = local_roots(len(ids), [np.flatnonzero(hits[i, : i + 1]) for i in range(len(ids))])
        # pairs that share an earlier cell are counted there
        out = outward(hits | np.eye(len(ids), dtype=bool), pdf["close"], place)
        for rows in shared_earlier(cell, pdf["cells"]).values():
            hits[np.ix_(rows, rows)] = False
        return pd.DataFrame({"node": ids, "links": hits @ pdf["copies"].to_numpy(), "root": ids[roots], "out": out})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Two blocks of a clump, or one with itself: every pair."""
        pdf = pdf.sort_values(["block", "node"])
        ids, cell, copies = pdf["node"].to_numpy(), pdf["cell"].iloc[0], pdf["copies"].to_numpy()
        x = unit_rows(list(pdf["x"]), len(pdf["x"].iloc[0]) // 8)
        own = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        a = int((pdf["block"] == pdf["low"]).sum())
        b = 0 if own else a  # rows from b on are the second block
        hits = in_range(x[:a], x[b:], threshold)
        if own:
            np.fill_diagonal(hits, False)
        both = np.zeros((len(ids), len(ids)), bool)
        both[:a, b:] = hits
        roots = spread(both | both.T)
        del both
        place = set(ids.tolist())
        out = outward(hits | np.eye(a, dtype=bool) if own else hits, pdf["close"].iloc[b:], place)
        out += [] if own else outward(hits.T, pdf["close"].iloc[:a], place)
        for rows in shared_earlier(cell, pdf["cells"]).values():
            at = np.array(rows)
            hits[np.ix_(at[at < a], at[at >= b] - b)] = False
        links = np.zeros(len(ids), np.int64)
        links[:a] += hits @ copies[b:]
        if not own:
            links[b:] += hits.T @ copies[:a]
        return pd.DataFrame({"node": ids, "links": links, "root": ids[roots], "out": out})

    small = members.where("not clump").groupBy("cell").applyInPandas(search, "node long, links long, root long, out array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.where("clump").select("node", "cell", "x", "copies", "cells", "close", "block", other)
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    large = pairs.groupBy("cell", "low", "high").applyInPandas(compare, "node long, links long, root long, out array<long>")
    found = materialize(small.unionByName(large), "emb-found")
    info = materialize(members.dropDuplicates(["node"]).select("node", "x", "copies", "cells", "close"), "emb-info")
    start = found.select(F.col("node").alias("p"), F.explode("out").alias("q"))
    return found.drop("out").unionByName(_grow_across(start, info, threshold))


def audit(packed: DataFrame, links: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT) -> float:
    """Least share, over the labels, of the true links of `queries` nodes, picked by hash, that were found; the truth by
    brute force over all nodes of the label. Labels of up to CELL_MAX nodes, and those with few true links, count as one."""
    counts = materialize(packed.groupBy("cell").count(), "emb-labels")
    counts = counts.withColumn("large", F.col("count") > CELL_MAX).withColumn("of", F.when(F.col("large"), F.col("cell")))
    counts = counts.withColumn("total", F.sum("count").over(Window.partitionBy("of"))).withColumn("parts", F.ceil(F.col("count") / CELL_MAX).cast("int"))
    counts = materialize(counts, "emb-parts")
    sized = packed.select("node", "cell", "x", "copies").join(counts, "cell")
    rank = F.pmod(F.xxhash64("node"), F.lit(1 << 40))
    picked = sized.withColumn("rank", rank).where(F.col("rank") < F.lit(4.0 * queries * (1 << 40)) / F.col("total"))
    picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy("rank", "node"))).where(F.col("n") <= queries)
    picked = materialize(picked.select("node", "cell", "of", "x", "parts"), "emb-queries")
    asked = picked.select("node", "cell", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = sized.join(picked.select("cell").distinct(), "cell", "left_semi")
    rows = rows.select("node", "cell", "x", "copies", F.pmod(F.xxhash64("node", "cell"), F.col("parts")).cast("int").alias("part"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"node": [], "true": []}, dtype=np.int64)
        dim = len(left["x"].iloc[0]) // 8
        nodes = left["node"].to_numpy()
        hit = unit_rows(list(left["x"]), dim) @ unit_rows(list(right["x"]), dim).T >= threshold
        hit &= nodes[:, None] != right["node"].to_numpy()[None, :]
        return pd.DataFrame({"node": nodes, "true": hit @ right["copies"].to_numpy()})

    truth = asked.groupBy("cell", "part").cogroup(rows.groupBy("cell", "part")).applyInPandas(work, "node long, true long")
    truth = truth.groupBy("node").agg(F.sum("true").alias("true")).join(picked.select("node", "of"), "node").join(links, "node", "left")
    sums = truth.groupBy("of").agg(F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("f"))
    sums = sums.groupBy(F.when(F.col("t") >= queries, F.col("of")).alias("of")).agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    least = sums.where("t > 0").agg(F.min(F.col("f") / F.col("t"))).first()[0]
    return 1.0 if least is None else float(least)


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = 0.95, tries: int = 3
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept, audit_recall."""
    prepare(rows.sparkSession)
    base, nodes = classes(rows, vec_id, embedding, label)
    packed = materialize(pack(nodes), "emb-packed")
    for attempt in range(tries):
        wide = {} if threshold == THRESHOLD else {"threshold": threshold}
        found = _link_cells(deal(packed, OVERLAP + attempt, **wide), threshold, BEAM << attempt)
        links = materialize(found.groupBy("node").agg(F.sum("links").alias("links")), "emb-links")
        reached = audit(packed, links, threshold)
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"the audit found a recall of {reached:.3f}; {recall} is asked for")
    known = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())
    named = nodes.join(links, "node").join(known, "node", "left").withColumn("label_node", F.coalesce(known["label"], F.col("node")))
    named = materialize(named.select(nodes["label"], "e", "copies", "least_id", "links", "label_node"), "emb-named")
    least = named.groupBy("label_node").agg(F.min("least_id").alias("component_id"))
    per_class = materialize(
        named.join(least, "label_node").select("label", "e", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id"), "emb-result"
    )
    out = base.join(per_class, ["label", "e"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"), F.lit(reached).alias("audit_recall"),
    )
