"""Readers by kind, vector layers, catalogue documents, paged services saved as files, and a paged data source.

Nothing here fetches from a network: services are read from saved pages, or through `PagedJson`, whose pages are files; a
client that fetches only has to write such pages. Warped reads into another projection need a projection library and are
not offered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .catalog import meets

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    def keep(f):
        READERS[kind] = f
        return f

    return keep


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Dispatch by kind of source."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source {kind!r}; known: {', '.join(sorted(READERS))}")
    return READERS[kind](spark, path, **options)


@reader("parquet")
def _parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(path)


@reader("csv")
def _csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    r = spark.read.option("header", True).options(**options)
    return (r.schema(schema) if schema else r).csv(path)


@reader("geojson")
def read_geojson(spark: SparkSession, path: str, properties: str = "map<string,string>") -> DataFrame:
    """Features of GeoJSON files: id, type, line (array of points; a polygon's outer ring), bounding box, properties."""
    geometry = "struct<type:string,coordinates:string>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features:array<struct<id:string,geometry:{geometry},properties:{properties}>>>").alias("d"))
    f = text.select(F.posexplode("d.features").alias("pos", "f"))
    kind, c = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    flat = F.when(kind == "Point", F.array(F.from_json(c, "array<double>"))).when(kind == "LineString", F.from_json(c, "array<array<double>>")).when(kind == "Polygon", F.from_json(c, "array<array<array<double>>>")[0])
    line = F.transform(flat, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    from ..functions.geometry import bounds

    b = bounds(F.col("line"))
    base = f.select(F.coalesce(F.col("f.id"), F.col("pos").cast("string")).alias("id"), kind.alias("type"), line.alias("line"), F.col("f.properties").alias("properties"))
    return base.withColumns({k: b[k] for k in ("xmin", "ymin", "xmax", "ymax")})


@reader("arcgis_pages")
def read_feature_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved query pages of a feature service: attributes as a map and the first path as a line."""
    schema = "struct<features:array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double,paths:array<array<array<double>>>,rings:array<array<array<double>>>>>>>"
    f = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    raw = F.coalesce(F.col("f.geometry.paths")[0], F.col("f.geometry.rings")[0], F.array(F.array("f.geometry.x", "f.geometry.y")))
    return f.select(F.col("f.attributes").alias("attributes"), F.transform(raw, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("line"))


@reader("overpass")
def read_overpass(spark: SparkSession, path: str, tags: tuple[str, ...] = ("waterway", "natural", "water", "name")) -> DataFrame:
    """Ways of saved Overpass answers with at least two points, and the kept tags."""
    schema = "struct<elements:array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["elements"]).alias("e")).where("e.type = 'way' and size(e.geometry) >= 2")
    line = F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return e.select(F.col("e.id").alias("id"), line.alias("line"), *[F.col("e.tags")[t].alias(t) for t in tags])


@reader("stac")
def read_collections(spark: SparkSession, path: str, product: str = "dem", crs: str = "2193") -> DataFrame:
    """Collection documents: slug, title, end and start of capture, updated, bounding box, items; other products, other
    projections and documents without extent are left out, and the national mosaic is flagged."""
    schema = (
        "struct<id:string,title:string,updated:string,extent:struct<spatial:struct<bbox:array<array<double>>>,temporal:struct<interval:array<array<string>>>>,"
        "links:array<struct<rel:string,href:string>>>"
    )
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"), F.input_file_name().alias("file")).select("d.*", "file")
    box, span = F.col("extent.spatial.bbox")[0], F.col("extent.temporal.interval")[0]
    rows = d.where(F.col("file").contains(f"/{product}") & (F.col("file").contains(crs) | F.lit(not crs)) & box.isNotNull())
    items = F.transform(F.filter("links", lambda v: v["rel"] == "item"), lambda v: F.regexp_replace(F.element_at(F.split(v["href"], "/"), -1), r"\.json$", ""))
    return rows.select(
        F.col("id").alias("slug"), "title", F.substring(span[0], 1, 10).alias("start"), F.substring(span[1], 1, 10).alias("end"), F.substring("updated", 1, 10).alias("updated"),
        box[0].alias("xmin"), box[1].alias("ymin"), box[2].alias("xmax"), box[3].alias("ymax"), items.alias("items"), F.lower("title").contains("national").alias("national"),
    )


@reader("pointcloud")
def read_point_clouds(spark: SparkSession, path: str) -> DataFrame:
    """schema.org dataset lists: name, identifier, provider, end."""
    schema = "struct<dataset:array<struct<name:string,identifier:struct<value:string>,provider:array<struct<name:string>>,temporalCoverage:string>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["dataset"]).alias("e"))
    end = F.regexp_extract(F.element_at(F.split("e.temporalCoverage", "/"), -1), r"(\d{4}-\d{2}-\d{2})", 1)
    return e.select(F.col("e.name").alias("name"), F.col("e.identifier.value").alias("identifier"), F.col("e.provider")[0]["name"].alias("provider"), F.when(end != "", end).alias("end"))


def layer(spark: SparkSession, root: str, name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame | None:
    """A vector layer stored as Parquet with bounding-box columns; the window reaches the scan as filters. None if absent."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.where(meets(box)) if box else rows


def first_layer(spark: SparkSession, places: list[tuple[str, str]], schema: T.StructType) -> DataFrame:
    """The first of several places that has the layer, else an empty table of the schema."""
    for root, name in places:
        found = layer(spark, root, name)
        if found is not None:
            return found
    return spark.createDataFrame([], schema)


def by_id(polygons: DataFrame, value: str, wanted: tuple[str, ...] = ("id", "catch_id", "nzsegment")) -> DataFrame:
    """Rows whose id column, found by name in any case, has the value."""
    names = {c.lower(): c for c in polygons.columns}
    column = next((names[w] for w in wanted if w in names), None)
    if column is None:
        raise ValueError(f"no id column; looked for {', '.join(wanted)}")
    return polygons.where(F.col(column).cast("string") == value)


def at_point(polygons: DataFrame, x: float, y: float) -> DataFrame:
    """Rows whose ring (column line) holds a point: bounding box first, then the even-odd test."""
    from ..functions.geometry import in_ring

    return polygons.where(meets((x, y, x, y)) & in_ring(F.col("line"), F.lit(x), F.lit(y)))


def aoi(value) -> Column:
    """A polygon literal from WKT, GeoJSON text or a list of points; the third dimension is dropped."""
    import re

    if isinstance(value, str) and value.lstrip().startswith("{"):
        g = json.loads(value)
        g = g.get("geometry", g)
        ring = g["coordinates"][0]
    elif isinstance(value, str):
        m = re.match(r"\s*POLYGON\s*Z?\s*\(\(([^)]*)\)", value, re.I)
        if not m:
            raise ValueError("not a POLYGON")
        ring = [[float(v) for v in p.split()] for p in m[1].split(",")]
    else:
        ring = value
    return F.array(*[F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y")) for p in ring])


class _Page(InputPartition):
    def __init__(self, place: str):
        super().__init__(place)
        self.place = place


class PagedJson(DataSource):
    """Saved pages of a paged service as a data source: one partition a page. Options: pages (comma-separated file paths that
    every executor can open), field (the array of rows)."""

    @classmethod
    def name(cls) -> str:
        return "rillwork_pages"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader([p for p in self.options.get("pages", "").split(",") if p], self.options.get("field", "features"))


class _PagedReader(DataSourceReader):
    def __init__(self, pages: list[str], field: str):
        self.pages, self.field = pages, field

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.pages]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8") as f:
            for row in json.load(f)[self.field]:
                yield (json.dumps(row, sort_keys=True),)
