"""Queries of readers: files of each form are written from the tables and read back strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import geometry, stats
from millrace.plans.records import words
from millrace.session import new_path, table
from millrace.sources import images, readers, writers

PIXELS = images.WIDTH * images.HEIGHT


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file a year with the nations' orders in it; one optional value is empty in some."""
    year, nation = F.year("o_orderdate"), F.col("c_nationkey")
    sums = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(year.alias("period"), nation.alias("id"))
    sums = sums.agg(F.count("*").cast("double").alias("orders"), F.sum(F.floor("o_totalprice").cast("long")).cast("double").alias("price"))
    extra = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("price").cast("string"))
    element = F.struct(F.col("id").cast("long").alias("id"), F.struct("orders", extra.alias("extra")).alias("stats"))
    texts = sums.groupBy("period").agg(F.sort_array(F.collect_list(element)).alias("elements"))  # a nation an element
    texts = texts.select("period", F.to_json(F.struct(F.lit("v1").alias("format"), F.lit("2024-25").alias("season"), "period", "elements")).alias("text"))
    path = new_path(spark, "snapshots")
    writers.named_texts(texts, path, "period", "year-{}.json")
    return readers.snapshots(spark, path, ["orders"], ["extra"]).select("season", "period", "entity", "orders", "extra")


def tagged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as lines of word and tag with a blank line after each, read as sentences: their sizes, and how often."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words("text")).alias("position", "w")).where(F.length(F.trim("w")) > 0)
    tag = F.when(F.length("w") > 5, "B-LONG").otherwise("O")
    blocks = rows.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("position", F.concat("w", F.lit(" "), tag).alias("line")))).alias("lines"))  # a turn's words
    path = new_path(spark, "tagged")
    blocks.select(F.concat(F.array_join(F.col("lines.line"), "\n"), F.lit("\n"))).write.text(path)
    read = readers.bio(spark, path)
    sizes = read.groupBy("file", "sentence").agg(F.count("*").alias("tokens"), F.count(F.when(F.col("tag") != "O", 1)).alias("tagged"), (F.max("position") + 1 == F.count("*")).alias("dense"))
    return sizes.groupBy("tokens", "tagged", "dense").agg(F.count("*").alias("sentences"))


def layer(spark: SparkSession, d: str) -> DataFrame:
    """Nations as squares in degrees, some of two parts, written as one layer and read with all checks; those that touch."""
    key = F.col("n_nationkey")
    x, y = key % 5, F.floor(key / 5)
    box = lambda a, b, w: F.array(*[F.array(a + i * w, b + j * w) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    own = F.array(box((x / 10).cast("double"), (y / 10).cast("double"), 0.1))
    island = F.array(box((x / 10).cast("double") + 3, (y / 10).cast("double"), 0.05))
    shape = F.when(key % 4 == 0, F.to_json(F.array(own, island))).otherwise(F.to_json(own))
    kind = F.when(key % 4 == 0, "MultiPolygon").otherwise("Polygon")
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit('},"properties":{"code":"N'), F.lpad(key.cast("string"), 2, "0"), F.lit('"}}'))
    path = new_path(spark, "layer")
    writers.write_feature_collection(table(spark, d, "nation").select(key.alias("key"), text.alias("feature")), path, ["key"])
    return geometry.touching(readers.geojson_areas(spark, path, "code", "N[0-9]{2}"))


def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey pictures of 9 by 8, written as PNG and decoded again."""
    grey = F.transform(F.sequence(F.lit(0), F.lit(PIXELS - 1)), lambda i: F.floor((F.get("embedding", i % 64).cast("double") + 1) * 127).cast("int"))
    values = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), grey.alias("values"))
    found = images.inspected(images.drawn(values))
    return found.select(F.col("path").cast("long").alias("vec_id"), "width", "height", "mode", "hash", "fault")


def medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians of order lines by status: a few groups of nearly all rows."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"))
    return stats.medians(lines, ["l_returnflag", "l_linestatus"], "price").withColumn("median", F.round("median", 6)).drop("n")


def season_of(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions.scalar import matches_season

    year = F.year("o_orderdate")
    said = F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1 + (F.col("o_orderkey") % 5 == 0).cast("int")) % 100).cast("string"), 2, "0"))
    rows = table(spark, d, "orders").select(said.alias("season"))
    return rows.groupBy("season", matches_season(F.col("season")).alias("valid")).agg(F.count("*").alias("n"))


QUERIES = {"json_snapshots": snapshots, "tagged_lines": tagged_lines, "area_layer": layer, "image_hashes": image_hashes, "exact_medians": medians, "season_names": season_of}

_BITS = " + ".join(f"CASE WHEN p[{9 * r + c + 1}] > p[{9 * r + c + 2}] THEN {1 << (63 - 8 * r - c)}::UBIGINT ELSE 0::UBIGINT END" for r in range(8) for c in range(8))

ORACLE_SQL = {
    "json_snapshots": """
        SELECT '2024-25' AS season, CAST(year(o_orderdate) AS INTEGER) AS period, CAST(c_nationkey AS BIGINT) AS entity, CAST(count(*) AS DOUBLE) AS orders,
               CASE WHEN c_nationkey % 3 = 0 THEN 0::DOUBLE ELSE CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) END AS extra
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY year(o_orderdate), c_nationkey""",
    "tagged_lines": r"""
        WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM conversations),
        s AS (SELECT conv_id, turn, count(*) AS tokens, count(*) FILTER (length(w) > 5) AS tagged FROM w WHERE trim(w) <> '' GROUP BY 1, 2)
        SELECT tokens, tagged, true AS dense, count(*) AS sentences FROM s GROUP BY 1, 2""",
    "area_layer": """
        WITH n AS (SELECT n_nationkey AS k, n_nationkey % 5 AS x, n_nationkey // 5 AS y, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation)
        SELECT a.code AS a, b.code AS b FROM n a JOIN n b ON a.code < b.code AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1""",
    "image_hashes": f"""
        WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: CAST(floor((CAST(embedding[i % 64 + 1] AS DOUBLE) + 1) * 127) AS INTEGER)) AS p FROM embeddings)
        SELECT vec_id, CAST(9 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, 'L' AS mode, lpad(lower(to_hex({_BITS})), 16, '0') AS hash, CAST(NULL AS VARCHAR) AS fault FROM g""",
    "exact_medians": "SELECT l_returnflag, l_linestatus, round(median(CAST(l_extendedprice AS DOUBLE)), 6) AS median FROM lineitem GROUP BY 1, 2",
    "season_names": """
        WITH s AS (SELECT year(o_orderdate) AS y, (year(o_orderdate) + 1 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) % 100 AS e FROM orders)
        SELECT CAST(y AS VARCHAR) || '-' || lpad(CAST(e AS VARCHAR), 2, '0') AS season, (y + 1) % 100 = e AS valid, count(*) AS n FROM s GROUP BY 1, 2""",
}
