"""Queries on text, dates, numbers, JSON, maps, schemas and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rules
from ..sources import catalog
from .views import Catalogue, over, prof, table, tree

C = Catalogue()


@C.add("split_flags", """WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'gap+testA' WHEN 'O' THEN 'bump; testB' ELSE 'road' END AS s FROM orders)
  SELECT id, list_contains(string_split_regex(s, '[+,;]\\s*'), 'gap')::INT AS src_gap, list_contains(string_split_regex(s, '[+,;]\\s*'), 'testB')::INT AS "src_testB" FROM t""")
def split_flags(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "gap+testA").when(F.col("o_orderstatus") == "O", "bump; testB").otherwise("road")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in rules.source_flags(s, ["gap", "testB"]).items()])


@C.add("tri_state_bool", """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN ' True' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN 'maybe' WHEN 5 THEN NULL ELSE 'YES' END AS s FROM orders)
  SELECT id, CASE WHEN lower(trim(s)) IN ('true', 'yes', '1') THEN 1 WHEN lower(trim(s)) IN ('no', '0.0') THEN 0 END AS v FROM t""")
def tri_state_bool(spark, d):
    k = F.col("o_orderkey") % 7
    s = F.when(k == 0, " True").when(k == 1, "no").when(k == 2, "1").when(k == 3, "0.0").when(k == 4, "maybe").when(k == 5, F.lit(None)).otherwise("YES")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.tri_state(s).alias("v"))


@C.add("schema_map", """SELECT p_partkey::VARCHAR AS source_id, 'bridge' AS kind, CASE WHEN p_retailprice > 0 THEN p_retailprice * 0.001 END AS width_m,
  CASE WHEN lower(p_brand) = 'brand#1' THEN 'stream' WHEN lower(p_brand) = 'brand#2' THEN 'drain' ELSE 'other' END AS class, NULL::VARCHAR AS name, 'parts' AS source FROM part""")
def schema_map(spark, d):
    spec = {
        "const": {"kind": "bridge"}, "fields": {"width_m": ["WIDTH", "P_RetailPrice"], "name": "absent"}, "scale": {"width_m": 0.001}, "id_field": ["OBJECTID", "p_PartKey"],
        "class_map": {"class": ("P_BRAND", {"Brand#1": "stream", "Brand#2": "drain"}, "other")},
    }
    schema = [("source_id", "string"), ("kind", "string"), ("width_m", "double"), ("class", "string"), ("name", "string"), ("source", "string")]
    return catalog.harmonise(table(spark, d, "part"), spec, schema, "parts")


@C.add("missing_fields", """WITH want(field, name) AS (VALUES ('P_BRAND', 'p_brand'), ('width', 'width'), ('height|depth', 'height'), ('height|depth', 'depth'), ('x|p_type', 'x'), ('x|p_type', 'p_type'))
  SELECT field FROM want LEFT JOIN (SELECT lower(column_name) AS name, 1 AS there FROM (DESCRIBE part)) USING (name) GROUP BY field HAVING count(there) = 0""")
def missing_fields(spark, d):
    gone = catalog.missing_fields(table(spark, d, "part").columns, {"a": "P_BRAND", "b": "width", "c": ["height", "depth"], "d": ["x", "p_type"]})
    return spark.createDataFrame([(g,) for g in gone], "field string")


@C.add("json_path", over("prof", "SELECT id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k') = '3' AS three FROM prof"))
def json_path(spark, d):
    return prof(spark, d).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"), scalars.json_contains(F.col("props"), {"k": 3}).alias("three"))


@C.add("json_flatten", over("prof", "SELECT id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM prof"))
def json_flatten(spark, d):
    return prof(spark, d).select("id", F.explode(scalars.flatten_json(F.col("props"))).alias("key", "value"))


@C.add("json_containment", over("prof", "SELECT count(*) AS n FROM prof WHERE json_extract_string(props, '$.k') = '1'"))
def json_containment(spark, d):
    return prof(spark, d).where(scalars.json_contains(F.col("props"), {"k": 1})).agg(F.count("*").alias("n"))


@C.add("id_parse", "SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_extract(url, '/(\\d+)', 1) AS number, regexp_matches(url, 'example\\.(org|net)') AS hit, split_part(url, '/', -1) AS last FROM pages")
def id_parse(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(u, r"^(\w+)://", 1).alias("scheme"), F.regexp_extract(u, r"/(\d+)", 1).alias("number"), u.rlike(r"example\.(org|net)").alias("hit"), scalars.last_part(u, "/").alias("last")
    )


@C.add("joined_set", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1")
def joined_set(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(scalars.joined_set(F.col("o_orderstatus")).alias("s"))


@C.add("digests", "SELECT p_partkey, substr(sha256(p_brand || p_type), 1, 12) AS a, substr(sha1(p_brand), 1, 8) AS b, ('0x' || substr(sha1(p_type), 1, 8))::BIGINT / 4294967296.0 AS u FROM part")
def digests(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", scalars.digest(F.concat("p_brand", "p_type"), 12).alias("a"), F.substring(F.sha1("p_brand"), 1, 8).alias("b"), scalars.unit_hash(F.col("p_type")).alias("u")
    )


@C.add("padded_ids", over("tree", "SELECT id, 'R' || lpad(id::VARCHAR, 6, '0') AS name, starts_with(brand, 'Brand#1') AS first FROM tree"))
def padded_ids(spark, d):
    return tree(spark, d).select("id", F.concat(F.lit("R"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"), F.startswith("brand", F.lit("Brand#1")).alias("first"))


@C.add("date_distance", "SELECT o_orderkey, abs(epoch(o_orderdate)::BIGINT - 852076800) AS s, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_distance(spark, d):
    at = F.lit("1997-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", scalars.seconds_between(F.col("o_orderdate"), at).alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@C.add("interval_parse", """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') || '/2001-01-01' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS s FROM orders)
  SELECT id, TRY_CAST(nullif(regexp_extract(split_part(s, '/', 1), '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE) AS a, TRY_CAST(nullif(regexp_extract(split_part(s, '/', -1), '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE) AS b FROM t""")
def interval_parse(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T00:00:00Z/2001-01-01"))).when(F.col("o_orderkey") % 3 == 1, day).otherwise("none")
    a, b = scalars.interval_parts(s)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("a"), b.alias("b"))


@C.add("latest_by_end", "SELECT o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS latest, max(strftime(o_orderdate, '%Y-%m-%d')) AS day FROM orders GROUP BY 1")
def latest_by_end(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("latest"), F.date_format("m.o_orderdate", "yyyy-MM-dd").alias("day"))


@C.add("trig_and_logs", over("pts", "SELECT id, round_even(degrees(atan2(dy, dx)), 6) AS bearing, round_even(log10(1 + abs(x)), 6) AS l, round_even(exp(-abs(y) / 100), 6) AS e, round_even(sqrt(x * x + y * y), 6) AS h FROM pts"))
def trig_and_logs(spark, d):
    from .views import pts

    b = lambda c: F.bround(c, 6) + F.lit(0.0)
    return pts(spark, d).select(
        "id", b(F.degrees(F.atan2("dy", "dx"))).alias("bearing"), b(F.log10(1 + F.abs("x"))).alias("l"), b(F.exp(-F.abs("y") / 100)).alias("e"), b(F.hypot("x", "y")).alias("h")
    )


@C.add("axis_difference", over("pts", """, a AS (SELECT id, degrees(atan2(dy, dx)) - degrees(atan2(y, x)) AS t FROM pts), m AS (SELECT id, t - 180 * floor(t / 180) AS m FROM a) SELECT id, round_even(least(m, 180 - m), 5) AS d FROM m"""))
def axis_difference(spark, d):
    from .views import pts

    a = rules.axis_difference(F.degrees(F.atan2("dy", "dx")), F.degrees(F.atan2("y", "x")))
    return pts(spark, d).select("id", F.bround(a, 5).alias("d"))


@C.add("snapping", over("pts", "SELECT id, floor(x / 8) * 8 + 0.0 AS lo, ceil(x / 8) * 8 + 0.0 AS hi, least(greatest(y, -50), 50) AS c FROM pts"))
def snapping(spark, d):
    from .views import pts

    return pts(spark, d).select(
        "id", scalars.snap_down(F.col("x"), 8).cast("double").alias("lo"), scalars.snap_up(F.col("x"), 8).cast("double").alias("hi"), rules.clip(F.col("y"), -50.0, 50.0).alias("c")
    )


@C.add("histogram_ladder", over("pts", "SELECT CASE WHEN abs(x) < 10 THEN 0 WHEN abs(x) < 50 THEN 1 WHEN abs(x) < 100 THEN 2 WHEN abs(x) < 200 THEN 3 ELSE 4 END AS bin, count(*) AS n FROM pts GROUP BY 1"))
def histogram_ladder(spark, d):
    from .views import pts

    return pts(spark, d).groupBy(scalars.ladder(F.abs("x"), [10, 50, 100, 200]).alias("bin")).agg(F.count("*").alias("n"))


@C.add("covariance_axes", over("pts", """, m AS (SELECT kind, covar_samp(x, y) AS c, var_samp(x) AS a, var_samp(y) AS b FROM pts GROUP BY kind)
  SELECT kind, round_even((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 4) AS l1, round_even((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 4) AS l2 FROM m"""))
def covariance_axes(spark, d):
    from .views import pts

    m = pts(spark, d).groupBy("kind").agg(F.covar_samp("x", "y").alias("c"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"))
    l1, l2, _ = scalars.covariance_axes(F.col("a"), F.col("c"), F.col("b"))
    return m.select("kind", F.bround(l1, 4).alias("l1"), F.bround(l2, 4).alias("l2"))


@C.add("coerce_numbers", "WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'n/a' WHEN 2 THEN 'NaN' ELSE '' END AS s FROM orders) SELECT id, CASE WHEN s = '12.5' THEN 12.5::DOUBLE END AS v FROM t")
def coerce_numbers(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, "12.5").when(k == 1, "n/a").when(k == 2, "NaN").otherwise("")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.coerce_number(s).alias("v"))


@C.add("map_lookup", "SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 0 END AS p FROM orders")
def map_lookup(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.lookup(F.col("o_orderpriority"), {"1-URGENT": 3, "2-HIGH": 2}, 0).alias("p"))


@C.add("reason_ladder", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'found' WHEN o_orderstatus = 'F' THEN 'no_channel' WHEN o_orderstatus = 'O' THEN 'position' ELSE 'no_crossing_test' END AS reason FROM orders")
def reason_ladder(spark, d):
    s = F.col("o_orderstatus")
    r = rules.stack_reasons("no_crossing_test", (s == "O", "position"), (s == "F", "no_channel"), (F.col("o_totalprice") > 300000, "found"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r.alias("reason"))


@C.add("osm_class", """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'river' WHEN 1 THEN 'fish' END AS w, CASE p_partkey % 3 WHEN 0 THEN 'pond' END AS wa, CASE p_partkey % 4 WHEN 0 THEN 'coastline' WHEN 1 THEN 'water' WHEN 2 THEN 'mud' END AS n FROM part)
  SELECT id, CASE WHEN n = 'coastline' THEN 'coastline' WHEN w = 'river' THEN w WHEN wa = 'pond' THEN 'lake' WHEN n = 'water' THEN 'water' WHEN n = 'mud' THEN 'tidal' END AS class FROM t""")
def osm_class(spark, d):
    k = F.col("p_partkey")
    tags = {
        "waterway": F.when(k % 5 == 0, "river").when(k % 5 == 1, "fish"), "water": F.when(k % 3 == 0, "pond"),
        "natural": F.when(k % 4 == 0, "coastline").when(k % 4 == 1, "water").when(k % 4 == 2, "mud"),
    }
    return table(spark, d, "part").select(k.alias("id"), catalog.osm_class(tags).alias("class"))


@C.add("hstore_tags", "SELECT p_partkey AS id, p_brand AS brand, p_type AS type FROM part")
def hstore_tags(spark, d):
    text = F.concat(F.lit('"brand"=>"'), F.col("p_brand"), F.lit('","type"=>"'), F.col("p_type"), F.lit('"'))
    m = catalog.hstore(text)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), m["brand"].alias("brand"), m["type"].alias("type"))


@C.add("river_columns", "SELECT p_partkey AS id, p_size::DOUBLE AS flow, 0.04::DOUBLE AS roughness, p_retailprice * 1e6 AS area_m2 FROM part")
def river_columns(spark, d):
    p = table(spark, d, "part")
    return catalog.river_columns(p.unionByName(p), {"id": "P_PARTKEY", "flow": "p_size", "area": "P_RetailPrice"}, 0.04)


@C.add("point_cloud_ranking", """WITH t AS (SELECT p_brand AS name, 'OT.' || p_partkey AS identifier, p_type AS provider, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS e, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END DESC NULLS LAST, 'OT.' || p_partkey) AS k FROM part)
  SELECT name, identifier, row_number() OVER (ORDER BY CASE name WHEN 'Brand#13' THEN 0 ELSE 1 END, e DESC NULLS LAST, name) AS place FROM t WHERE k = 1""")
def point_cloud_ranking(spark, d):
    p = table(spark, d, "part")
    end = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    items = p.select(F.col("p_brand").alias("name"), F.concat(F.lit("OT."), F.col("p_partkey").cast("string")).alias("identifier"), F.col("p_type").alias("provider"), end.alias("end"))
    return catalog.rank_point_clouds(items, "^OT", ["Brand#13"]).select("name", "identifier", F.col("place").cast("long").alias("place"))


@C.add("usable_sources", """WITH s AS (SELECT p_partkey AS id, p_partkey % 100 AS xmin, p_partkey % 100 + 10 AS xmax, p_partkey % 50 AS ymin, p_partkey % 50 + 10 AS ymax, p_partkey % 3 > 0 AS enabled, p_partkey % 11 = 0 AS restricted, CASE p_partkey % 2 WHEN 0 THEN ['channels'] ELSE ['bridges', 'roads'] END AS provides FROM part)
  SELECT id FROM s WHERE enabled AND NOT restricted AND xmin <= 40 AND xmax >= 20 AND ymin <= 30 AND ymax >= 10 AND list_has_any(provides, ['roads', 'x'])""")
def usable_sources(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(
        k.alias("id"), (k % 100).alias("xmin"), (k % 100 + 10).alias("xmax"), (k % 50).alias("ymin"), (k % 50 + 10).alias("ymax"), (k % 3 > 0).alias("enabled"), (k % 11 == 0).alias("restricted"),
        F.when(k % 2 == 0, F.array(F.lit("channels"))).otherwise(F.array(F.lit("bridges"), F.lit("roads"))).alias("provides"),
    )
    return catalog.usable_sources(s, (20, 10, 40, 30), ["roads", "x"]).select("id")


@C.add("append_log", """WITH l AS (SELECT event_type AS source, sha256(props) AS sha256, ts AS "at", event_id AS id FROM events)
  SELECT source, sha256, min("at") AS "at", arg_min(id, {'a': "at", 'i': id}) AS id FROM l GROUP BY 1, 2""")
def append_log(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.sha2("props", 256).alias("sha256"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return catalog.append_log(e.where("id % 2 = 0"), e.where("id % 2 = 1"))


@C.add("varying_columns", "SELECT 'a' AS \"column\", count(DISTINCT o_custkey % 3) AS n_distinct, TRUE AS varies FROM orders UNION ALL SELECT 'b', 1, FALSE")
def varying_columns(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 3).alias("a"), F.lit(1).alias("b"))
    return rules.varying_columns(o, ["a", "b"])


@C.add("column_patterns", """SELECT column_name AS name FROM (DESCRIBE lineitem) WHERE column_type IN ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT', 'SMALLINT', 'TINYINT', 'BOOLEAN')
  AND (column_name = 'l_tax' OR NOT (column_name GLOB 'l_*key' OR column_name GLOB 'l_t*'))""")
def column_patterns(spark, d):
    names = rules.select_columns(table(spark, d, "lineitem"), ["l_tax"], ["l_*key", "l_t*"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@C.add("status_counts", "SELECT o_orderstatus AS status, count(*) AS n, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS n_big FROM orders GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_big"))


@C.add("indices_contrast", over("pts", """SELECT id, CASE WHEN x + y <> 0 THEN round_even((x - y) / (x + y), 6) END AS ndvi, round_even((x + y + w) / 3, 6) AS bright,
  CASE WHEN sign(x - w) = sign(y - w) THEN sign(x - w) * least(abs(x - w), abs(y - w)) ELSE 0 END AS contrast FROM pts"""))
def indices_contrast(spark, d):
    from .views import pts

    a, b = F.col("x") - F.col("w"), F.col("y") - F.col("w")
    two = F.when(F.signum(a) == F.signum(b), F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(F.lit(0.0))
    ndvi = F.bround(F.try_divide(F.col("x") - F.col("y"), F.col("x") + F.col("y")), 6) + F.lit(0.0)
    return pts(spark, d).select("id", ndvi.alias("ndvi"), (F.bround((F.col("x") + F.col("y") + F.col("w")) / 3, 6) + F.lit(0.0)).alias("bright"), two.alias("contrast"))
