"""Scalar functions on strings, dates, numbers, maps and JSON as column expressions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_parts(s: Column) -> Column:
    return F.split(s, "[+,;]")


def joined_set(values: Column, mark: str = ";") -> Column:
    """Aggregate: distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(values)), mark)


def last_part(s: Column, mark: str) -> Column:
    return F.element_at(F.split(s, mark), -1)


def digest(s: Column, n: int = 64, bits: int = 256) -> Column:
    return F.substring(F.sha2(s, bits), 1, n)


def unit_hash(s: Column) -> Column:
    """Hash to [0, 1): the first 32 bits of SHA-1 over 2^32."""
    return F.conv(F.substring(F.sha1(s), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def hash_split(s: Column, fractions: list[tuple[str, float]], forced: dict[str, str] | None = None) -> Column:
    """Split name by hash: fractions are (name, share) in order; the last takes the rest; forced values decide first."""
    u, upto = unit_hash(s), 0.0
    out = F.lit(fractions[-1][0])
    ladder = []
    for name, share in fractions[:-1]:
        upto += share
        ladder.append((upto, name))
    for limit, name in reversed(ladder):
        out = F.when(u < limit, F.lit(name)).otherwise(out)
    for value, name in (forced or {}).items():
        out = F.when(s == value, F.lit(name)).otherwise(out)
    return out


def seconds_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b))


def midpoint_seconds(a: Column, b: Column) -> Column:
    return (F.unix_timestamp(a) + F.unix_timestamp(b)) / 2


def interval_parts(s: Column) -> tuple[Column, Column]:
    """Start and end dates of 'a/b' or of a single date."""
    parts = F.split(s, "/")
    day = r"(\d{4}-\d{2}-\d{2})"
    start, end = F.regexp_extract(parts[0], day, 1), F.regexp_extract(F.element_at(parts, -1), day, 1)
    return F.when(start != "", F.to_date(start)), F.when(end != "", F.to_date(end))


def ladder(x: Column, edges: list[float]) -> Column:
    """Number of edges that are not above x: the bin of a histogram with explicit edges."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x < edges[i], F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def snap_down(x: Column, step: float) -> Column:
    return F.floor(x / step) * step


def snap_up(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


def covariance_axes(cxx: Column, cxy: Column, cyy: Column) -> tuple[Column, Column, Column]:
    """Larger and smaller eigenvalue of a 2 x 2 covariance, and the main axis in degrees from 0 to 180."""
    half, disc = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    return half + disc, half - disc, F.pmod(F.degrees(F.lit(0.5) * F.atan2(2 * cxy, cxx - cyy)), F.lit(180.0))


def contains_all(a: Column, b: Column) -> Column:
    """Whether every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def keeps_order(b: Column, a: Column) -> Column:
    """Whether b's elements stand in a in the same order."""
    places = F.transform(b, lambda v: F.array_position(a, v))
    pairs = F.zip_with(F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0))), lambda x, y: x <= y)
    return F.forall(places, lambda p: p > 0) & F.forall(pairs, lambda ok: ok)


def json_contains(stored: Column, wanted: dict) -> Column:
    """Whether a JSON object has each wanted top-level field with that scalar value."""
    out = F.lit(True)
    for k, v in wanted.items():
        text = json.dumps(v) if not isinstance(v, str) else v
        out = out & F.coalesce(F.get_json_object(stored, f"$.{k}") == F.lit(text), F.lit(False))
    return out


def flatten_json(text: Column) -> Column:
    """One level of a JSON object as a map of strings."""
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))


def coerce_number(s: Column) -> Column:
    """Finite number or null."""
    x = s.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def canonical(value) -> str:
    """JSON with sorted keys and 12 significant digits; whole floats as integers, so that equal requests have equal text."""

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
            return v
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a finite number")
            short = float(f"{v:.12g}")
            return int(short) if short == int(short) and abs(short) < 1e15 else short
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return sorted(plain(x) for x in v)
        raise TypeError(f"no canonical form for {type(v).__name__}")

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_key(value, n: int = 16) -> str:
    import hashlib

    return hashlib.sha256(canonical(value).encode()).hexdigest()[:n]


def content_key_of(columns: dict[str, Column], n: int = 16) -> Column:
    """The content key of each row's {name: value}, for columns of text and whole numbers; nulls count as null."""
    fields = F.struct(*[columns[k].alias(k) for k in sorted(columns)])
    return F.substring(F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256), 1, n)


def merge_deep(left: dict, right: dict) -> dict:
    """Recursive merge of mappings; the right side wins."""
    out = dict(left)
    for k, v in right.items():
        out[k] = merge_deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flatten(value: dict, prefix: str = "") -> dict:
    """Nested mappings to dotted keys."""
    out = {}
    for k, v in value.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def read_mapping(text: str) -> dict:
    """JSON text, or a Python literal where it is none."""
    import ast

    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)
