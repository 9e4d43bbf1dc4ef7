"""Array kernels for one tile: the algorithms that are sequential by nature or need a dense neighbourhood.

All take and return plain arrays (row 0 in the north, NaN for no data). Tiles are bounded, so these run inside one task.
"""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np

STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
ROOT2 = 2**0.5


def shift(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """The array whose cell (r, c) is a[r + dr, c + dc], `fill` outside."""
    h, w = a.shape
    out = np.full_like(a, fill)
    r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
    if r0 < r1 and c0 < c1:
        out[r0:r1, c0:c1] = a[r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def median_relief(z: np.ndarray, n: int) -> np.ndarray:
    """Cell minus the median of its n x n window; edges repeat, no data is left out."""
    r = n // 2
    padded = np.pad(z, r, mode="edge")
    out = np.empty_like(z)
    view = np.lib.stride_tricks.sliding_window_view(padded, (n, n))
    for i in range(0, z.shape[0], 32):
        block = view[i : i + 32].reshape(-1, z.shape[1], n * n)
        with np.errstate(all="ignore"):
            out[i : i + 32] = z[i : i + 32] - (np.nanmedian(block, axis=2) if np.isnan(block).any() else np.median(block, axis=2))
    return out


def _gauss(sigma: float, order: int) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-x * x / (2 * sigma * sigma))
    g /= g.sum()
    return g if order == 0 else -x / sigma**2 * g if order == 1 else (x * x / sigma**4 - 1 / sigma**2) * g


def convolve(z: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with the reversed kernel along an axis, edges repeated."""
    r = len(kernel) // 2
    padded = np.pad(z, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
    n = z.shape[axis]
    return sum(k * np.take(padded, range(2 * r - i, 2 * r - i + n), axis=axis) for i, k in enumerate(kernel))


def gaussian(z: np.ndarray, sigma: float) -> np.ndarray:
    g = _gauss(sigma, 0)
    return convolve(convolve(z, g, 0), g, 1)


def hessian(z: np.ndarray, sigma: float, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Larger and smaller eigenvalue of the second Gaussian derivatives."""
    s = sigma / cell
    g0, g1, g2 = (_gauss(s, k) for k in (0, 1, 2))
    zrr, zcc = convolve(convolve(z, g2, 0), g0, 1), convolve(convolve(z, g0, 0), g2, 1)
    zrc = convolve(convolve(z, g1, 0), g1, 1)
    half, disc = (zrr + zcc) / 2, np.sqrt((zrr - zcc) ** 2 / 4 + zrc**2)
    return (half + disc) / cell**2, (half - disc) / cell**2


def openness(z: np.ndarray, radius: float, cell: float = 1.0, directions: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positive and negative openness in degrees: mean over directions of the angle from zenith (nadir) to the horizon."""
    n = max(1, int(radius / cell))
    ways = [(np.cos(a), np.sin(a)) for a in np.arange(directions) * 2 * np.pi / directions]
    up, down = np.zeros_like(z), np.zeros_like(z)
    for wr, wc in ways:
        high, low = np.full_like(z, -np.inf), np.full_like(z, np.inf)
        for k in range(1, n + 1):
            dr, dc = round(k * wr), round(k * wc)
            far = np.hypot(dr, dc) * cell
            if far == 0 or far > radius + 1e-9:
                continue
            s = (shift(z, dr, dc, np.nan) - z) / far
            high, low = np.fmax(high, s), np.fmin(low, s)
        up += 90 - np.degrees(np.arctan(np.where(np.isfinite(high), high, 0)))
        down += 90 + np.degrees(np.arctan(np.where(np.isfinite(low), low, 0)))
    return up / directions, down / directions


def nearest(mask: np.ndarray, cap: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact distance in cells to the nearest mask cell, and that cell's row and column (-1 beyond the cap).

    Two passes: nearest row within each column, then the least over columns, offset by offset until no offset can win.
    """
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -1), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, 2 * h + 2)[::-1], axis=0)[::-1]
    big = float(4 * (h + w + 2) ** 2)
    da, db = np.where(above >= 0, rows - above, np.inf), np.where(below < h, below - rows, np.inf)
    row = np.where(da <= db, above, below)
    g = np.minimum(da, db) ** 2
    best, br, bc = g.copy(), np.where(np.isfinite(g), row, -1), np.broadcast_to(np.arange(w), (h, w)).copy()
    limit = min(cap, w)
    k = 1
    while k <= limit and k * k < min(best.max(), big):
        for d in (-k, k):
            other = shift(g, 0, d, np.inf) + k * k
            win = other < best
            if win.any():
                best = np.where(win, other, best)
                br = np.where(win, shift(np.where(np.isfinite(g), row, -1), 0, d, -1), br)
                bc = np.where(win, np.arange(w)[None, :] + d, bc)
        k += 1
    dist = np.sqrt(best)
    out = dist > cap
    return np.where(out, np.inf, dist), np.where(out | (br < 0), -1, br), np.where(out | (br < 0), -1, bc)


def fill_nodata(z: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(z)
    if ok.all() or not ok.any():
        return z.copy()
    _, r, c = nearest(ok)
    return np.where(ok, z, z[r, c])


def label(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Component numbers from 1 in scan order, 0 outside. Labels spread by row runs joined in a union-find."""
    h, w = mask.shape
    root: list[int] = [0]
    out = np.zeros((h, w), np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    before: list[tuple[int, int, int]] = []
    for r in range(h):
        edge = np.diff(np.concatenate([[0], mask[r].astype(np.int8), [0]]))
        here = []
        j = 0
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            n = len(root)
            root.append(n)
            reach = 1 if eight else 0
            while j < len(before) and before[j][1] + reach <= a:
                j += 1
            k = j
            while k < len(before) and before[k][0] < b + reach:
                x, y = find(before[k][2]), find(n)
                root[max(x, y)] = min(x, y)
                k += 1
            here.append((a, b, n))
            out[r, a:b] = n
        before = here
    roots = np.array([find(i) for i in range(len(root))])
    names = {v: i for i, v in enumerate(np.unique(roots[1:]), 1)} if len(root) > 1 else {}
    return np.array([0] + [names[v] for v in roots[1:].tolist()])[out] if len(root) > 1 else out


def hysteresis(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Weak cells in eight-connected components that hold a strong cell."""
    lab = label(weak | strong)
    good = np.unique(lab[strong])
    return np.isin(lab, good[good > 0])


def drop_small(mask: np.ndarray, least: int, eight: bool = True) -> np.ndarray:
    lab = label(mask, eight)
    return mask & (np.bincount(lab.ravel())[lab] >= least)


def outlets(z: np.ndarray) -> np.ndarray:
    """Valid cells at the edge or beside no data."""
    ok = ~np.isnan(z)
    inner = ok.copy()
    for dr, dc in STEPS:
        inner &= shift(ok, dr, dc, False)
    return ok & ~inner


def flood_fill(z: np.ndarray) -> np.ndarray:
    """Priority flood: every cell raised to the lowest level at which it drains to an outlet (Barnes et al. 2014)."""
    h, w = z.shape
    out = z.copy()
    done = np.isnan(z)
    heap = [(z[r, c], r, c) for r, c in zip(*np.nonzero(outlets(z)))]
    heapq.heapify(heap)
    for _, r, c in heap:
        done[r, c] = True
    pit: deque = deque()
    while heap or pit:
        level, r, c = pit.popleft() if pit else heapq.heappop(heap)
        for dr, dc in STEPS:
            i, j = r + dr, c + dc
            if 0 <= i < h and 0 <= j < w and not done[i, j]:
                done[i, j] = True
                if out[i, j] <= level:
                    out[i, j] = level
                    pit.append((level, i, j))
                else:
                    heapq.heappush(heap, (out[i, j], i, j))
    return out


def flood_from(z: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The least level at which each cell drains to one with a known level (infinite: unknown), known levels only fall."""
    h, w = z.shape
    out = np.where(np.isnan(z), np.nan, level)
    heap = [(out[p], p) for p in map(tuple, np.argwhere(np.isfinite(out)).tolist())]
    heapq.heapify(heap)
    while heap:
        here, (r, c) = heapq.heappop(heap)
        if here > out[r, c]:
            continue
        for dr, dc in STEPS:
            i, j = r + dr, c + dc
            if 0 <= i < h and 0 <= j < w and max(here, z[i, j]) < out[i, j]:
                out[i, j] = max(here, z[i, j])
                heapq.heappush(heap, (out[i, j], (i, j)))
    return out


def depressions(z: np.ndarray, least: float = 0.02, cell: float = 1.0) -> tuple[np.ndarray, list[dict]]:
    """Labels of filled areas deeper than `least`, and greatest depth, area and volume of each."""
    depth = np.nan_to_num(flood_fill(z) - z)
    lab = label(depth > least)
    n = int(lab.max())
    top = np.zeros(n + 1)
    np.maximum.at(top, lab.ravel(), depth.ravel())
    cells, sums = np.bincount(lab.ravel(), minlength=n + 1), np.bincount(lab.ravel(), depth.ravel(), n + 1)
    return lab, [{"label": k, "max_depth": float(top[k]), "area_m2": float(cells[k] * cell**2), "volume_m3": float(sums[k] * cell**2)} for k in range(1, n + 1)]


def pond(z: np.ndarray, seed: tuple[int, int], level: float, most: int, cell: float = 1.0) -> dict:
    """Flood from a seed below a level: area, volume, depth, and whether it was cut off at `most` cells."""
    h, w = z.shape
    if not z[seed] < level:
        return {"area_m2": 0.0, "volume_m3": 0.0, "max_depth": 0.0, "truncated": False}
    seen, todo, got = {seed}, deque([seed]), []
    while todo and len(got) < most:
        r, c = todo.popleft()
        got.append(level - z[r, c])
        for dr, dc in STEPS:
            i, j = r + dr, c + dc
            if 0 <= i < h and 0 <= j < w and (i, j) not in seen and z[i, j] < level:
                seen.add((i, j))
                todo.append((i, j))
    return {"area_m2": len(got) * cell**2, "volume_m3": float(sum(got)) * cell**2, "max_depth": float(max(got)), "truncated": bool(todo)}


def pits(z: np.ndarray) -> list[list[tuple[int, int]]]:
    """The flats (equal heights, eight-connected) with no lower neighbour and no outlet cell; cells in scan order."""
    edge, h, w = outlets(z), *z.shape
    lower = np.zeros(z.shape, bool)
    for dr, dc in STEPS:
        lower |= shift(z, dr, dc, np.nan) < z
    seen = np.isnan(z) | lower
    out = []
    for r, c in zip(*(x.tolist() for x in np.nonzero(~seen))):
        if seen[r, c]:
            continue
        ok, todo, mark = True, [(r, c)], {(r, c)}
        while todo:
            i, j = todo.pop()
            ok &= not (lower[i, j] or edge[i, j])
            for dr, dc in STEPS:
                a, b = i + dr, j + dc
                if 0 <= a < h and 0 <= b < w and (a, b) not in mark and z[a, b] == z[i, j]:
                    mark.add((a, b))
                    todo.append((a, b))
        for i, j in mark:
            seen[i, j] = True
        if ok:
            out.append(sorted(mark))
    return out


def pit_flats(z: np.ndarray) -> list[tuple[int, int]]:
    """The first cell of each pit."""
    return [cells[0] for cells in pits(z)]


def breach(z: np.ndarray, longest: float = 100.0, cell: float = 1.0, flat: float = 1e-3, keep_cut: float = 0.1, budget: float = np.inf) -> tuple[np.ndarray, list[dict]]:
    """Least-cost breaching (Lindsay 2016): from each pit, lowest first, to the first lower cell or outlet by the path with the
    least digging, at most `longest` long and `budget` dear; the path is cut to a gently falling bed. The search starts from
    all cells of the pit at once, and a pit of which any cell drains by then is left. Returns the surface and the paths cut
    by keep_cut or more."""
    out, edge = z.copy(), outlets(z)
    h, w = z.shape
    paths = []

    def around(r: int, c: int):
        for dr, dc in STEPS:
            if 0 <= r + dr < h and 0 <= c + dc < w:
                yield r + dr, c + dc, cell * (ROOT2 if dr and dc else 1.0)

    for flat_cells in sorted(pits(z), key=lambda p: (z[p[0]], p[0])):
        level, own = z[flat_cells[0]], set(flat_cells)
        if any(out[p] < level or any(out[i, j] < level for i, j, _ in around(*p)) for p in flat_cells):
            continue
        reached = {p: (0.0, 0.0, None) for p in flat_cells}  # cost, length, cell before
        heap, target, shut = [(0.0, p) for p in flat_cells], None, set()
        while heap and target is None:
            spent, p = heapq.heappop(heap)
            if p in shut:
                continue
            shut.add(p)
            if p not in own and (out[p] < level or edge[p]):
                target = p
                break
            far = reached[p][1]
            for i, j, step in around(*p):
                q = (i, j)
                if q in shut or np.isnan(out[q]) or far + step > longest:
                    continue
                new = spent + (max(out[q] - level, 0.0) + flat) * step
                if new <= budget and new < reached.get(q, (np.inf,))[0]:
                    reached[q] = new, far + step, p
                    heapq.heappush(heap, (new, q))
        if target is None:
            continue
        line = [target]
        while reached[line[-1]][2] is not None:
            line.append(reached[line[-1]][2])
        line.reverse()
        bed, cuts = level, []
        for p in line[1:]:
            bed -= 1e-4
            cuts.append(max(out[p] - bed, 0.0))
            out[p] = min(out[p], bed)
        if cuts and max(cuts) >= keep_cut:
            cost, length, _ = reached[target]
            paths.append({"seed": flat_cells[0], "outlet": target, "length_m": length, "max_cut_m": float(max(cuts)), "cost": cost, "cells": line})
    return out, paths


def steepest(z: np.ndarray) -> np.ndarray:
    """Index of the steepest falling step in STEPS, -1 for none."""
    best, out = np.zeros(z.shape), np.full(z.shape, -1, np.int8)
    for k, (dr, dc) in enumerate(STEPS):
        fall = (z - shift(z, dr, dc, np.nan)) / (ROOT2 if dr and dc else 1.0)
        win = fall > best
        best, out = np.where(win, fall, best), np.where(win, k, out)
    return out


def flat_distance(z: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The least seed plus steps inside a flat (equal heights, eight-connected); inf where no finite seed is reached."""
    (h, w), dist = z.shape, np.where(np.isnan(z), np.inf, seed)
    front = np.zeros(z.shape, bool)
    for dr, dc in STEPS:
        front |= (shift(z, dr, dc, np.nan) == z) & (shift(dist, dr, dc, -1.0) > dist + 1)
    heap = [(dist[r, c], r, c) for r, c in np.argwhere(front).tolist()]
    heapq.heapify(heap)
    while heap:
        d, r, c = heapq.heappop(heap)
        if d > dist[r, c]:
            continue
        for dr, dc in STEPS:
            i, j = r + dr, c + dc
            if 0 <= i < h and 0 <= j < w and z[i, j] == z[r, c] and dist[i, j] > d + 1:
                dist[i, j] = d + 1
                heapq.heappush(heap, (d + 1, i, j))
    return dist


def along_flats(z: np.ndarray, direction: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Directions with those of flat cells added: the first step in STEPS to a cell of the flat that is one step nearer."""
    out = direction.copy()
    for k, (dr, dc) in enumerate(STEPS):
        hit = (out < 0) & (dist > 0) & np.isfinite(dist) & (shift(z, dr, dc, np.nan) == z) & (shift(dist, dr, dc, np.inf) == dist - 1)
        out[hit] = k
    return out


def flow_directions(filled: np.ndarray) -> np.ndarray:
    """Index of the steepest step in STEPS, -1 for none; flats drain towards their outlets by breadth-first distance."""
    out = steepest(filled)
    return along_flats(filled, out, flat_distance(filled, np.where((out >= 0) | outlets(filled), 0.0, np.inf)))


def downstream(direction: np.ndarray) -> np.ndarray:
    """The flat index of the cell that each cell flows to, -1 if there is none in the array."""
    place = np.arange(direction.size).reshape(direction.shape)
    down = np.full(direction.shape, -1, np.int64)
    for k, (dr, dc) in enumerate(STEPS):
        at = direction == k
        down[at] = shift(place, dr, dc, -1)[at]
    return down.ravel()


def path_ends(direction: np.ndarray) -> np.ndarray:
    """The flat index of the last cell in the array on each cell's way down."""
    down = downstream(direction)
    last = np.where(down >= 0, down, np.arange(down.size))
    while not np.array_equal(last, last[last]):
        last = last[last]
    return last


def accumulate(direction: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Own amount plus that of everything upstream, by peeling cells without open inflow."""
    h, w = direction.shape
    down = downstream(direction)
    degree = np.bincount(down[down >= 0], minlength=h * w)
    total = own.astype(float).ravel().copy()
    front = np.flatnonzero((degree == 0) & (down >= 0))
    while len(front):
        to = down[front]
        np.add.at(total, to, total[front])
        np.subtract.at(degree, to, 1)
        to = np.unique(to)
        front = to[(degree[to] == 0) & (down[to] >= 0)]
    return total.reshape(h, w)


def thin(mask: np.ndarray) -> np.ndarray:
    """Zhang-Suen thinning to one-cell lines."""
    m = np.pad(mask, 1).astype(np.uint8)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for first in (True, False):
            p = [shift(m, r, c, 0) for r, c in ring]
            count = sum(p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(np.uint8) for i in range(8))
            a = p[0] * p[2] * p[4] == 0 if first else p[0] * p[2] * p[6] == 0
            b = p[2] * p[4] * p[6] == 0 if first else p[0] * p[4] * p[6] == 0
            gone = (m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & a & b
            if gone.any():
                m[gone] = 0
                changed = True
        if not changed:
            return m[1:-1, 1:-1].astype(bool)


def degree(skeleton: np.ndarray) -> np.ndarray:
    return np.where(skeleton, sum(shift(skeleton.astype(np.int8), r, c, 0) for r, c in STEPS), 0)


def skeleton_edges(skeleton: np.ndarray) -> list[list[tuple[int, int]]]:
    """Cell sequences between ends and junctions (cells whose degree is not 2), and closed rings."""
    d = degree(skeleton)
    h, w = skeleton.shape
    near = lambda p: [(p[0] + r, p[1] + c) for r, c in STEPS if 0 <= p[0] + r < h and 0 <= p[1] + c < w and skeleton[p[0] + r, p[1] + c]]
    nodes = {(r, c) for r, c in zip(*(x.tolist() for x in np.nonzero(skeleton & (d != 2))))}
    out, used = [], set()
    for n in sorted(nodes):
        for q in near(n):
            if (n, q) in used:
                continue
            line, before = [n, q], n
            while line[-1] not in nodes:
                ahead = [x for x in near(line[-1]) if x != before]
                before = line[-1]
                line.append(ahead[0])
                if line[-1] == n and n not in nodes:
                    break
            used |= {(n, q), (line[-1], line[-2])}
            out.append(line)
    on = {p for line in out for p in line}
    left = {(r, c) for r, c in zip(*(x.tolist() for x in np.nonzero(skeleton & (d == 2))))} - on
    while left:
        start = min(left)
        line, before = [start], None
        while True:
            ahead = [x for x in near(line[-1]) if x != before and (x == start or x in left)]
            before = line[-1]
            nxt = next((x for x in ahead if x not in line[1:]), None)
            if nxt is None or nxt == start and len(line) > 2:
                break
            line.append(nxt)
        left -= set(line)
        out.append(line + [start])
    return out


def prune(skeleton: np.ndarray, least: float, cell: float = 1.0, rounds: int = 2) -> np.ndarray:
    """Remove end branches shorter than `least` that hang on a junction; the junction cell stays."""
    s = skeleton.copy()
    for _ in range(rounds):
        d = degree(s)
        for line in skeleton_edges(s):
            a, b = d[line[0]], d[line[-1]]
            length = sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(line, line[1:])) * cell
            if length < least and (a == 1) != (b == 1) and max(a, b) > 2:
                for p in line[:-1] if a == 1 else line[1:]:
                    s[p] = False
    return s


def least_cost(cost: np.ndarray, start: tuple[int, int], goals: np.ndarray, longest: float = np.inf) -> tuple[list[tuple[int, int]], float]:
    """Dijkstra over eight neighbours (mean cost of the two cells times the step) to the cheapest goal cell."""
    h, w = cost.shape
    best, came, far = {start: 0.0}, {}, {start: 0.0}
    heap, shut = [(0.0, start)], set()
    while heap:
        k, p = heapq.heappop(heap)
        if p in shut:
            continue
        shut.add(p)
        if goals[p]:
            line = [p]
            while line[-1] != start:
                line.append(came[line[-1]])
            return line[::-1], k
        for dr, dc in STEPS:
            q = p[0] + dr, p[1] + dc
            if 0 <= q[0] < h and 0 <= q[1] < w and q not in shut and np.isfinite(cost[q]):
                step = ROOT2 if dr and dc else 1.0
                new, length = k + step * (cost[p] + cost[q]) / 2, far[p] + step
                if length <= longest and new < best.get(q, np.inf):
                    best[q], came[q], far[q] = new, p, length
                    heapq.heappush(heap, (new, q))
    return [], np.inf


def line_cells(r0: int, c0: int, r1: int, c1: int) -> list[tuple[int, int]]:
    """Cells of a straight line in order (Bresenham)."""
    dr, dc = abs(r1 - r0), abs(c1 - c0)
    sr, sc = (1 if r1 >= r0 else -1), (1 if c1 >= c0 else -1)
    out, err = [(r0, c0)], dc - dr
    while (r0, c0) != (r1, c1):
        e = 2 * err
        if e > -dr:
            err -= dr
            c0 += sc
        if e < dc:
            err += dc
            r0 += sr
        out.append((r0, c0))
    return out


def burn(shape: tuple[int, int], lines: list[tuple[list[tuple[int, int]], float]], none: float = np.nan) -> np.ndarray:
    """Rasterise cell polylines; where several meet, the largest value counts."""
    out = np.full(shape, -np.inf)
    for points, value in lines:
        for a, b in zip(points, points[1:] or points):
            for r, c in line_cells(*a, *b):
                if 0 <= r < shape[0] and 0 <= c < shape[1]:
                    out[r, c] = max(out[r, c], value)
    return np.where(np.isinf(out), none, out)


def burn_ring(shape: tuple[int, int], ring: np.ndarray) -> np.ndarray:
    """Cells whose centre lies inside a ring of (row, col) points, by the even-odd rule, row by row."""
    h, w = shape
    out = np.zeros(shape, bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for r in range(h):
        hit = (a[:, 0] > r) != (b[:, 0] > r)
        if hit.any():
            x = np.sort(a[hit, 1] + (r - a[hit, 0]) / (b[hit, 0] - a[hit, 0]) * (b[hit, 1] - a[hit, 1]))
            for lo, hi in zip(x[::2], x[1::2]):
                out[r, max(0, int(np.ceil(lo))) : max(0, int(np.floor(hi)) + 1)] = True
    return out


def strong_channels(z: np.ndarray, cell: float, shapes) -> np.ndarray:
    """Cells in a valley of any of the shapes (config.ValleyShape): by curvature and by depth below closings."""
    from .focal import cells_across

    out = np.zeros(z.shape, bool)
    for s in shapes:
        own = hessian(z, s.sigma_m, cell)[0] >= s.curvature
        for window, least in s.depths:
            own &= closing_depth(z, cells_across(window, cell)) >= least
        out |= own
    return out


def _slide(z: np.ndarray, n: int, f) -> np.ndarray:
    r = n // 2
    a = f(np.lib.stride_tricks.sliding_window_view(np.pad(z, ((0, 0), (r, r)), mode="edge"), n, axis=1), axis=2)
    return f(np.lib.stride_tricks.sliding_window_view(np.pad(a, ((r, r), (0, 0)), mode="edge"), n, axis=0), axis=2)


def closing_depth(z: np.ndarray, n: int) -> np.ndarray:
    return _slide(_slide(z, n, np.max), n, np.min) - z


def opening_height(z: np.ndarray, n: int) -> np.ndarray:
    return z - _slide(_slide(z, n, np.min), n, np.max)


def cut_through(z: np.ndarray, path: list[tuple[int, int]], cut: np.ndarray, cell: float = 1.0, threshold: float = 0.05, window: float = 5.0) -> dict | None:
    """The barrier that a breach path goes through: the span around the deepest cut, beds beside it, crest and height."""
    if not len(cut) or cut.max() <= threshold:
        return None
    k = int(cut.argmax())
    a = b = k
    while a > 0 and cut[a - 1] > threshold:
        a -= 1
    while b + 1 < len(cut) and cut[b + 1] > threshold:
        b += 1
    heights = np.array([z[p] for p in path])
    n = max(1, round(window / cell))
    up, down = heights[max(0, a - n) : a + 1].min(), heights[b : b + n + 1].min()
    crest = a + int(heights[a : b + 1].argmax())
    span = sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(path[a : b + 1], path[a + 1 : b + 1])) * cell
    return {"crest": path[crest], "length_m": float(span), "height_m": float(heights[crest] - max(up, down)), "bed_up": float(up), "bed_down": float(down)}


def strahler_streams(direction: np.ndarray, area: np.ndarray, least: float, given: np.ndarray | None = None) -> np.ndarray:
    """Strahler order of cells with enough upstream area, 0 elsewhere; upstream cells first. Cells where `given` is 0 or more
    have that order."""
    h, w = direction.shape
    order, top, ties = np.zeros((h, w), int), np.zeros((h, w), int), np.zeros((h, w), int)
    stream = area >= least
    cells = np.argwhere(stream)
    for r, c in cells[np.argsort(area[stream], kind="stable")]:
        order[r, c] = max(1, top[r, c] + (ties[r, c] >= 2)) if given is None or given[r, c] < 0 else given[r, c]
        k = direction[r, c]
        if k >= 0:
            i, j = r + STEPS[k][0], c + STEPS[k][1]
            if 0 <= i < h and 0 <= j < w:
                if order[r, c] > top[i, j]:
                    top[i, j], ties[i, j] = order[r, c], 1
                elif order[r, c] == top[i, j]:
                    ties[i, j] += 1
    return order


def shrink_links(lines: list[tuple[float, int, int, bool]]) -> list[int]:
    """Shortest first without loops: links (length, u, v, end_to_end); an end is used once by end-to-end links. Indices kept."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        root.setdefault(i, i)
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    used, out = set(), []
    for k in sorted(range(len(lines)), key=lambda i: (lines[i][0], i)):
        _, u, v, ends = lines[k]
        if find(u) == find(v) or ends and (u in used or v in used):
            continue
        root[find(u)] = find(v)
        if ends:
            used |= {u, v}
        out.append(k)
    return out
