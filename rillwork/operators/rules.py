"""Row-wise rules: link acceptance, tiers, roles, reasons, scores. Expressions only, so they fuse into any scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import add, and_, mul, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Candidates, Links


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """Map lookup with a default, null keys included."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sure(test: Column) -> Column:
    """The test, with unknown as false."""
    return F.coalesce(test, F.lit(False))


def any_of(*tests: Column) -> Column:
    return reduce(or_, map(sure, tests))


def all_of(*tests: Column) -> Column:
    return reduce(and_, map(sure, tests))


def first_case(cases: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first case that holds."""
    return F.coalesce(*[F.when(sure(test), F.lit(name)) for name, test in cases], F.lit(otherwise))


def points(table: list[tuple[int, Column]]) -> Column:
    """Sum of the points of the tests that hold."""
    return reduce(add, [F.when(sure(test), n).otherwise(0) for n, test in table])


def either(*chances: Column) -> Column:
    """1 - product of (1 - p): the chance of at least one of independent events."""
    return F.lit(1.0) - reduce(mul, [F.lit(1.0) - p for p in chances])


def link_probability(length: Column, rise: Column, prob: Column, mask: Column, road: Column, tier: Column, p: Links = Links()) -> dict[str, Column]:
    """p_link, reason and is_crossing of a link.

    At a structure (a candidate of a tier with a probability, where a road or a rise of more than rise_sigma_m blocks the way)
    it is the tier's probability. Elsewhere it is a product of factors: evidence (probability or mask share, whichever is
    more, or a short gap), passage (road_prior on a road) and climb (falls off with the rise). Null measures count as 0.
    """
    climb, blocked_by_road = F.greatest(F.coalesce(rise, F.lit(0.0)), F.lit(0.0)), sure(road)
    seen = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in (prob, mask)])
    factors = [
        either(seen, F.exp(-length / p.gap_scale_m)),
        F.when(blocked_by_road, p.road_prior).otherwise(1.0),
        F.exp(-climb / p.rise_sigma_m),
    ]
    at_structure = F.coalesce(lookup(tier, dict(p.tier_p), 0.0), F.lit(0.0))
    is_crossing = all_of(at_structure > 0, any_of(blocked_by_road, climb > p.rise_sigma_m))
    p_link = F.when(is_crossing, at_structure).otherwise(reduce(mul, factors))
    return {"p_link": p_link, "reason": first_case([("too_long", length > p.max_m), ("improbable", p_link < p.keep_p)], ""), "is_crossing": is_crossing}


def is_minor(kind: Column, river: Column, osm: Column, is_link: Column, width: Column, depth: Column, p: Links = Links()) -> Column:
    """Minor are links, and drains under a least width or depth (missing counts as 0) that nothing names a larger water."""
    least = {p.minor_width_m: width, p.minor_depth_m: depth}
    under = any_of(*[F.coalesce(size, F.lit(0.0)) < limit for limit, size in least.items()])
    return any_of(is_link, all_of(under, kind == "drain", ~any_of(osm.isin(*p.keep_kinds), river)))


def structure_probability(score: Column, tier: Column, p: Links = Links()) -> Column:
    """The scorer's probability if there is one, else by tier, else 0."""
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), lookup(tier, dict(p.tier_p), None), F.lit(0.0))


def noisy_or(evidence: list[Column], area: Column, middle: float = 4.0, scale: float = 0.5) -> Column:
    """The evidence and a logistic prior in log10 of the upstream area, as independent chances."""
    prior = logistic((F.log10(F.greatest(area, F.lit(1.0))) - middle) / scale)
    return either(prior, *[clip(F.coalesce(e, F.lit(0.0)), 0.0, 1.0) for e in evidence])


def linear_score(terms: Mapping[str, float], bias: float, river: Column | None = None, floor: float = 0.95) -> Column:
    """Logistic of a weighted sum of columns, null as 0; rivers have at least `floor`."""
    z = F.lit(float(bias))
    for name, weight in terms.items():
        z = z + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    s = logistic(z)
    return s if river is None else F.when(F.coalesce(river, F.lit(False)), F.greatest(s, F.lit(floor))).otherwise(s)


# The names of candidate sources, by what they show.
NETWORK_SOURCES = ("bump", "gap")
ROAD_SOURCES = ("road_end_pair", "road_x_drain")
TEST_SOURCES = ("testA", "testB")
# The least points of a tier, and the points of each kind of evidence.
TIER_POINTS = (("high", 3), ("medium", 2))
POINTS = {"network": 2, "road": 2, "road source": 1, "several sources": 1}


def tier(sources: Column, height: Column, vegetation: Column, road: Column, deck: Column, in_network: Column, use_roads: bool = True, p: Candidates = Candidates()) -> Column:
    """bridge, bridge_or_open, high, medium or low from an array of source names and measures. Null measures and sources count
    as absent. A deck over a barrier that hardly rises is a bridge; a bare barrier is ranked by the points of its evidence."""

    def among(names: tuple) -> Column:
        return F.size(F.array_intersect(F.coalesce(sources, F.array().cast("array<string>")), F.array(*map(F.lit, names))))

    rise = F.coalesce(height, F.lit(0.0))
    bare = F.coalesce(vegetation, F.lit(0.0)) < p.vegetation_share
    evidence = {
        "network": any_of(among(NETWORK_SOURCES) > 0, in_network),
        "several sources": among(NETWORK_SOURCES + ROAD_SOURCES + TEST_SOURCES) > 1,
    }
    roadside = {"road": road <= p.road_near_m, "road source": among(ROAD_SOURCES) > 0} if use_roads else {}
    strength = points([(POINTS[k], test) for k, test in (evidence | roadside).items()])
    flat = rise < p.min_height_m
    special = [("bridge", all_of(flat, deck >= p.deck_m, any_of(*roadside.values()))), ("bridge_or_open", all_of(rise < p.open_below_m, roadside["road source"]))] if use_roads else []
    ranked = [(name, all_of(~flat, bare, strength >= least)) for name, least in TIER_POINTS]
    return first_case(special + ranked, "low")


def roles(label: Column, near: Column, in_scope: Column) -> dict[str, Column]:
    """Which rows are positive, negative, unlabelled or excluded; exactly one holds. A null label is no label."""
    scope = F.coalesce(in_scope, F.lit(False))
    pos, neg = scope & label.eqNullSafe(F.lit(1)), scope & label.eqNullSafe(F.lit(0))
    unl = scope & label.isNull() & ~F.coalesce(near, F.lit(False))
    return {"positive": pos, "negative": neg, "unlabelled": unl, "excluded": ~(pos | neg | unl)}


def order_score(tier_n: Column, tier2_n: Column, height: Column) -> Column:
    """tier + tier2 / 10 + (height clipped to +-5, plus 5) / 1000."""
    return tier_n + tier2_n / 10 + (clip(F.coalesce(height, F.lit(0.0)), -5.0, 5.0) + 5) / 1000


def least_distance(*distances: Column, cap: float = 500.0) -> Column:
    return F.least(F.lit(cap), *[F.coalesce(d, F.lit(cap)) for d in distances])


def tri_state(text: Column) -> Column:
    """1, 0 or null from text, numbers or truth values."""
    t = F.lower(F.trim(text.cast("string")))
    number = t.try_cast("double")
    return F.when(t.isin("true", "t", "yes", "y"), 1).when(t.isin("false", "f", "no", "n"), 0).when(number == 1, 1).when(number == 0, 0)


def source_flags(text: Column, names: list[str]) -> dict[str, Column]:
    """One 0/1 column a source name in text split at + , or ;."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[+,;]"), lambda v: F.trim(v))
    return {f"src_{n}": F.array_contains(parts, n).cast("int") for n in names}


def robust_scale(rows: DataFrame, columns: list[str], limit: float = 20.0) -> DataFrame:
    """(x - median) / interquartile range, clipped to +-limit; a range of 0 counts as 1. One row of quantiles is broadcast."""
    stats = rows.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{c}") for c in columns])
    wide = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        q = F.col(f"__q_{c}")
        spread = F.when(q[2] > q[0], q[2] - q[0]).otherwise(F.lit(1.0))
        wide = wide.withColumn(f"{c}_scaled", clip((F.col(c) - q[1]) / spread, -limit, limit))
    return wide.drop(*[f"__q_{c}" for c in columns])


def varying_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct (finite values) and varies, for all columns in one pass."""
    one = rows.agg(*[F.countDistinct(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns])
    return one.select(F.explode(pairs).alias("s")).select("s.*", (F.col("s.n_distinct") >= 2).alias("varies"))


def select_columns(rows: DataFrame, include: list[str], exclude: list[str], numeric_only: bool = True) -> list[str]:
    """Column names by shell patterns: excluded ones go first, then those included again stay."""
    from fnmatch import fnmatch

    number = {f.name for f in rows.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "boolean")}
    names = [c for c in rows.columns if not numeric_only or c in number]
    return [c for c in names if any(fnmatch(c, p) for p in include) or not any(fnmatch(c, p) for p in exclude)]


def stack_reasons(default: str, *rules: tuple[Column, str]) -> Column:
    """Reasons assigned in order, the last that holds wins."""
    out = F.lit(default)
    for test, name in rules:
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def axis_difference(a: Column, b: Column) -> Column:
    """Acute angle between two undirected axes in degrees."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)
