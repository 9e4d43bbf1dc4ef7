"""Catalogues, plans, coverage and the product registry as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def meets(box: tuple[float, float, float, float]) -> Column:
    """Whether the row's bounding box overlaps the window. Plain comparisons, so they reach the scan as pushed filters."""
    return (F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1])


def contains_box(box: tuple[float, float, float, float]) -> Column:
    return (F.col("xmin") <= box[0]) & (F.col("xmax") >= box[2]) & (F.col("ymin") <= box[1]) & (F.col("ymax") >= box[3])


def source_plan(surveys: DataFrame, priority: list[str], excluded: list[str] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """Order of surveys (slug, end, updated, national): listed ones first in list order, then newest capture, newest update,
    slug; national ones last; excluded ones out. Adds survey_index from 1 (within keys)."""
    place = F.lit(len(priority))
    for i, slug in reversed(list(enumerate(priority))):
        place = F.when(F.col("slug") == slug, F.lit(i)).otherwise(place)
    rows = surveys.where(~F.col("slug").isin(list(excluded))) if excluded else surveys
    order = Window.partitionBy(*keys).orderBy(F.col("national"), place, F.desc_nulls_last("end"), F.desc_nulls_last("updated"), "slug")
    return rows.withColumn("survey_index", F.row_number().over(order))


def paired_plan(dsm: DataFrame, dem_plan: DataFrame) -> DataFrame:
    """Surface surveys restricted to the terrain plan's slugs, in its order."""
    return dsm.join(dem_plan.select("slug", "survey_index"), "slug")


def imagery_plan(surveys: DataFrame, target: str | None, excluded_text: str, coarsest: float) -> DataFrame:
    """Surveys (slug, title, start, end) fit for use: no excluded text in the title, ground sample distance in the title
    not coarser; by closeness of the capture's middle to the target, else newest first."""
    gsd = F.regexp_extract("title", r"(\d+(?:\.\d+)?)\s*m\b", 1).try_cast("double")
    fit = surveys.withColumn("gsd", gsd).where(~F.lower("title").rlike(excluded_text) & (F.col("gsd").isNull() | (F.col("gsd") <= coarsest)))
    middle = (F.unix_timestamp("start") + F.unix_timestamp("end")) / 2
    key = F.abs(middle - F.unix_timestamp(F.lit(target).cast("timestamp"))) if target else -F.unix_timestamp("end")
    return fit.withColumn("distance_s", key).withColumn("place", F.row_number().over(Window.orderBy(F.col("distance_s").asc_nulls_last(), "slug")))


def fill(cells: DataFrame) -> DataFrame:
    """Cells (row, col, survey_index, z) of several surveys: the first valid value and its survey (-1 none)."""
    best = cells.groupBy("row", "col").agg(F.min(F.when(F.col("z").isNotNull(), F.struct("survey_index", "z"))).alias("m"))
    return best.select("row", "col", F.col("m.z").alias("z"), F.coalesce(F.col("m.survey_index"), F.lit(-1)).alias("survey"))


def field_values(rows: DataFrame, fields: list[str], most: int) -> DataFrame:
    """Counts of the values of string fields with at most `most` distinct ones."""
    pairs = rows.unpivot([], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    counts = pairs.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("field").agg(F.count("*").alias("d")).where(F.col("d") <= most).select("field")
    return counts.join(few, "field")


def field_ranges(rows: DataFrame, fields: list[str]) -> DataFrame:
    """count, min, median and max of numeric fields in one pass."""
    pairs = rows.unpivot([], [F.col(f).cast("double").alias(f) for f in fields], "field", "value")
    return pairs.groupBy("field").agg(F.count("value").alias("n"), F.min("value").alias("v_min"), F.percentile("value", 0.5).alias("v_median"), F.max("value").alias("v_max"))


def missing_fields(columns: list[str], mapping: Mapping) -> list[str]:
    """Mapped fields that a source no longer has, in any case; of alternatives, only if none is there."""
    have = {c.lower() for c in columns}
    out = []
    for wanted in mapping.values():
        names = [wanted] if isinstance(wanted, str) else list(wanted)
        if not any(n.lower() in have for n in names):
            out.append("|".join(names))
    return sorted(out)


def coverage(features: DataFrame, source: str, coarse: str, fine: str) -> DataFrame:
    """Feature counts by source and fine tile, only inside coarse sheets that hold any, with the sheet's count."""
    a = features.groupBy(source, coarse, fine).agg(F.count("*").alias("n_tile"))
    return a.withColumn("n_sheet", F.sum("n_tile").over(Window.partitionBy(source, coarse)))


def tile_sources(tiles: DataFrame, by_tile: DataFrame, by_sheet: DataFrame) -> DataFrame:
    """Tiles (tile, sheet) with the sources that cover them: counts by tile, else by sheet. One row a tile: sources, n."""
    t = tiles.join(by_tile.select("tile", "source", F.col("n").alias("n_t")), "tile", "left")
    a = t.where("source is not null").select("tile", "source", F.col("n_t").alias("n"))
    known = by_tile.select("source").distinct()
    b = tiles.join(by_sheet.join(known, "source", "left_anti"), "sheet").select("tile", "source", "n")
    got = a.unionByName(b).groupBy("tile").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("n").alias("n"))
    return tiles.join(got, "tile", "left").fillna({"n": 0, "sources": ""})


def usable_sources(sources: DataFrame, box: tuple[float, float, float, float], layers: list[str]) -> DataFrame:
    """Enabled, unrestricted sources whose box meets the window and that provide one of the layers."""
    wanted = F.array(*[F.lit(x) for x in layers])
    return sources.where(F.col("enabled") & ~F.coalesce(F.col("restricted"), F.lit(False)) & meets(box) & F.arrays_overlap("provides", wanted))


def partition_tiles(collections: DataFrame, surface: DataFrame, national: DataFrame) -> DataFrame:
    """collections: slug, end, items (tile ids). Per tile: latest survey by capture end (ties by slug), all surveys joined,
    has_dsm if the latest also has a surface model (slug, items), in_national by the sheet part of the id. Bad ids go."""
    rows = collections.select("slug", "end", F.explode("items").alias("tile")).where(F.col("tile").rlike(r"^[A-Z]{2}\d{2}_\d+_\d+$"))
    a = rows.groupBy("tile").agg(F.max(F.struct("end", "slug")).alias("m"), F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("surveys"))
    a = a.select("tile", F.col("m.slug").alias("latest_survey"), F.col("m.end").alias("latest_end"), "surveys")
    s = surface.select(F.col("slug").alias("latest_survey"), F.explode("items").alias("tile")).distinct().withColumn("has_dsm", F.lit(True))
    n = national.select("sheet").distinct().withColumn("in_national", F.lit(True))
    out = a.withColumn("sheet", F.substring_index("tile", "_", 1)).join(s, ["tile", "latest_survey"], "left").join(n, "sheet", "left")
    return out.fillna({"has_dsm": False, "in_national": False})


def neighbour_counts(tiles: DataFrame) -> DataFrame:
    """tiles: tile, r, c, survey. Number of the eight neighbours present and with the same survey; edge if under 8 match."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    near = tiles.select("tile", "survey", "r", "c", steps.alias("k")).select("tile", "survey", (F.col("r") + F.col("k.i")).alias("r"), (F.col("c") + F.col("k.j")).alias("c"))
    other = tiles.select("r", "c", F.col("survey").alias("other"))
    n = near.join(other, ["r", "c"]).groupBy("tile").agg(F.count("*").alias("n_near"), F.count(F.when(F.col("other") == F.col("survey"), 1)).alias("n_same"))
    out = tiles.join(n, "tile", "left").fillna({"n_near": 0, "n_same": 0})
    return out.withColumn("survey_edge", F.col("n_same") < 8)


def select_manifest(rows: DataFrame, least: int, cap: int, seed: str) -> DataFrame:
    """rows: council, tile, n. Per council at most `cap` tiles with at least `least` features, most first, ties by a seeded
    digest; a tile of several councils goes to the one with more features there."""
    order = Window.partitionBy("council").orderBy(F.desc("n"), F.sha2(F.concat(F.lit(seed + ":"), F.col("tile").cast("string")), 256))
    top = rows.where(F.col("n") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    once = Window.partitionBy("tile").orderBy(F.desc("n"), "council")
    return top.withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")


def work_status(manifest: DataFrame, log: DataFrame, params_hash: Column, version: Column) -> DataFrame:
    """todo without a finished run, stale if its parameters or version differ from now, else done. log: id, params, version."""
    done = log.select(F.col("id"), F.col("params"), F.col("version"), F.lit(True).alias("__done"))
    m = manifest.withColumns({"__p": params_hash, "__v": version}).join(done, "id", "left")
    same = (F.col("params") == F.col("__p")) & (F.col("version") == F.col("__v"))
    state = F.when(F.col("__done").isNull(), "todo").when(F.coalesce(same, F.lit(False)), "done").otherwise("stale")
    return m.withColumn("status", state).drop("__p", "__v", "__done", "params", "version")


def replace_source(stored: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Rows of the sources in `new` are replaced by it; the others stay."""
    return stored.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def registry_lookup(registry: DataFrame, key: str, box: tuple[float, float, float, float]) -> DataFrame:
    """The product to reuse: exact (same key) over one that contains the box, newest first, then the largest id. One row or none."""
    kind = F.when(F.col("key") == key, F.lit(0)).when(contains_box(box), F.lit(1))
    return registry.withColumn("match", kind).where("match is not null").orderBy("match", F.desc("created_at"), F.desc("id")).limit(1)


def append_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Fetch log with one row for each source and content digest, the first fetched."""
    both = log.unionByName(new)
    return both.groupBy("source", "sha256").agg(F.min(F.struct("at", *[c for c in both.columns if c not in ("source", "sha256", "at")])).alias("m")).select("source", "sha256", "m.*")


def harmonise(raw: DataFrame, spec: Mapping, schema: list[tuple[str, str]], source: str) -> DataFrame:
    """Map a source to a fixed schema.

    spec: const (field to value), fields (field to source column or alternatives), scale (field to factor; 0 and less is
    null), class_map ((from field, mapping, default) by field), id_field. Columns are found in any case; missing ones are null.
    """
    have = {c.lower(): c for c in raw.columns}

    def column(names) -> Column:
        found = [F.col(f"`{have[n.lower()]}`") for n in ([names] if isinstance(names, str) else names) if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None)

    out = []
    for name, kind in schema:
        if name == "source":
            c = F.lit(source)
        elif name == "source_id":
            c = column(spec.get("id_field", []))
        elif name in spec.get("const", {}):
            c = F.lit(spec["const"][name])
        elif name in spec.get("class_map", {}):
            field, mapping, default = spec["class_map"][name]
            key = F.lower(F.trim(column(field).cast("string")))
            c = F.lit(default)
            for k, v in mapping.items():
                c = F.when(key == k.lower(), F.lit(v)).otherwise(c)
        else:
            c = column(spec.get("fields", {}).get(name, []))
            if name in spec.get("scale", {}):
                v = c.cast("string").try_cast("double")
                c = F.when(v > 0, v * F.lit(float(spec["scale"][name])))
        out.append(c.cast("string").try_cast(kind).alias(name) if kind != "string" else c.cast("string").alias(name))
    return raw.select(*out)


def osm_class(tags: Mapping[str, Column]) -> Column:
    """Class of a feature by fixed precedence of its tags."""
    w, water, nat = tags["waterway"], tags["water"], tags["natural"]
    return (
        F.when(nat == "coastline", "coastline").when(w.isin("river", "stream", "canal", "ditch", "drain"), w)
        .when(water.isin("lake", "pond", "reservoir", "lagoon"), "lake").when(water.isin("river", "canal"), "river_area").when(nat == "water", "water")
        .when(nat.isin("mud", "tidalflat", "wetland"), "tidal")
    )


def hstore(text: Column) -> Column:
    """'"k"=>"v","k2"=>"v2"' as a map; the last of repeated keys counts by position."""
    keys = F.regexp_extract_all(text, F.lit(r'"([^"]*)"=>"([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r'"([^"]*)"=>"([^"]*)"'), F.lit(2))
    return F.map_from_arrays(keys, values)


def rank_point_clouds(items: DataFrame, host: str, priority: list[str]) -> DataFrame:
    """Datasets (name, identifier, provider, end) hosted by id pattern, else provider; one row a name; listed first, then
    newest, undated last."""
    hosted = F.col("identifier").rlike(host) | F.lower("provider").contains("open")
    once = Window.partitionBy("name").orderBy(F.desc_nulls_last("end"), "identifier")
    place = F.lit(len(priority))
    for i, p in reversed(list(enumerate(priority))):
        place = F.when(F.col("name") == p, F.lit(i)).otherwise(place)
    rows = items.withColumn("hosted", F.coalesce(hosted, F.lit(False))).withColumn("__k", F.row_number().over(once)).where("__k = 1").drop("__k")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(place, F.desc_nulls_last("end"), "name")))


def river_columns(raw: DataFrame, names: Mapping[str, str], n: float) -> DataFrame:
    """River reaches under standard names (found in any case), constant roughness, km2 to m2, first row of each id."""
    have = {c.lower(): c for c in raw.columns}
    col = lambda k: F.col(f"`{have[names[k].lower()]}`")
    rows = raw.select(col("id").cast("long").alias("id"), col("flow").cast("double").alias("flow"), F.lit(n).alias("roughness"), (col("area").cast("double") * 1e6).alias("area_m2"))
    return rows.groupBy("id").agg(F.min(F.struct("flow", "roughness", "area_m2")).alias("m")).select("id", "m.*")
