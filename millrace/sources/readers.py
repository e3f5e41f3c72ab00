"""Readers that refuse what they do not expect.

Schemas are declared, never inferred. A reader that finds a wrong header, a ragged
row, a repeated key or a value that is no finite number raises ContractError; row
faults are counted by one aggregation first, so the error says how many there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.scalar import flag, whole_match
from millrace.operators import geometry
from millrace.session import ship, staged


class ContractError(ValueError):
    """Input that breaks its contract."""


def refuse(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows as they are, if no row breaks a rule; else an error with the counts."""
    found = df.agg(*[F.coalesce(F.sum(flag(rule)), F.lit(0)).alias(name) for name, rule in rules.items()]).first().asDict()
    if broken := {k: v for k, v in found.items() if v}:
        raise ContractError(f"rows break rules: {broken}")
    return df


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first line only, without a byte order mark."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in first[0][0].lstrip("﻿").split(",")] if first else []


def strict_csv(spark: SparkSession, path: str, columns: list[str], exact: bool = True) -> DataFrame:
    """A CSV table of strings. The header must be `columns` in order (or, if not exact, hold them).

    Values are trimmed and wholly blank rows skipped; rows with more or fewer fields are refused.
    """
    names = header(spark, path)
    if len(set(names)) != len(names):
        raise ContractError("the header repeats a name")
    if names != columns if exact else not set(columns) <= set(names):
        raise ContractError(f"the header is {names}, not {columns}")
    bad = "_corrupt"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, bad]])
    rows = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=bad, quote='"', escape='"')
    rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in names], bad)
    blank = F.lit(True)
    for c in names:
        blank = blank & (F.coalesce(F.col(c), F.lit("")) == "")
    kept = rows.where(~blank)
    refuse(kept, {"ragged": F.col(bad).isNotNull()})
    return kept.select(*columns)


def _no_duplicates(pairs: Iterable[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise ContractError(f"the key {key!r} occurs twice")
        out[key] = value
    return out


def _no_constant(name: str) -> float:
    raise ContractError(f"{name} is no number")


def strict_object(text: str, most: int = 1 << 20) -> dict:
    """A small control file as an object: no repeated keys, no NaN or infinity, no more than `most` characters."""
    if len(text) > most:
        raise ContractError("the file is too large")
    try:
        found = json.loads(text, object_pairs_hook=_no_duplicates, parse_constant=_no_constant)
    except json.JSONDecodeError as e:
        raise ContractError(str(e)) from e
    if not isinstance(found, dict):
        raise ContractError("not an object")
    return found


SNAPSHOT = "format string, season string, period int, elements array<struct<id: long, stats: struct<{stats}>>>"


def snapshots(spark: SparkSession, path: str, required: list[str], optional: list[str]) -> DataFrame:
    """(season, period, entity, stats...) from a folder of JSON files, one a period, named ...<period>.json.

    A file's name must agree with its period, each period has one file, ids are unique in
    it, no object repeats a key, required stats are finite numbers; optional ones count as 0
    where they are not given or empty.
    """
    stats = [*required, *optional]
    schema = SNAPSHOT.format(stats=", ".join([*(f"{s}: double" for s in required), *(f"{s}: string" for s in optional)]))
    files = spark.read.text(f"{path}/*.json", wholetext=True).select("value", F.input_file_name().alias("file"))
    options = {"allowNonNumericNumbers": "false", "mode": "FAILFAST"}
    parsed = files.select(F.from_json("value", schema, options).alias("s"), F.regexp_extract("file", r"(\d+)\.json$", 1).alias("named"))
    repeats = F.udf(repeated_json_keys, "boolean")  # a file a call
    if files.where(repeats("value")).limit(1).count():
        raise ContractError("an object repeats a key")
    heads = parsed.select("s.season", "s.period", "named", F.size("s.elements").alias("n"))
    refuse(heads, {"name_differs": ~F.coalesce(F.col("named").cast("int") == F.col("period"), F.lit(False)), "empty": F.coalesce(F.col("n"), F.lit(0)) <= 0})
    if heads.groupBy("season", "period").count().where("count > 1").limit(1).count():
        raise ContractError("a period has two files")
    rows = parsed.select("s.season", "s.period", F.explode("s.elements").alias("e"))
    rows = rows.select("season", "period", F.col("e.id").alias("entity"), *[F.col(f"e.stats.{s}").alias(s) for s in required], *[F.coalesce(F.nullif(F.col(f"e.stats.{s}"), F.lit("")).cast("double"), F.lit(0.0)).alias(s) for s in optional])
    missing = F.col("entity").isNull()
    for s in required:
        missing = missing | F.col(s).isNull()
    refuse(rows, {"missing": missing})
    if rows.groupBy("season", "period", "entity").count().where("count > 1").limit(1).count():
        raise ContractError("an entity occurs twice in a period")
    return rows


def repeated_json_keys(text: str) -> bool:
    """Whether any object in a JSON text repeats a key (from_json would silently keep the last one)."""
    try:
        json.loads(text, object_pairs_hook=_no_duplicates)
    except ContractError:
        return True
    return False


_POINT = "type string, geometry struct<type: string, coordinates: array<double>>, properties map<string,string>"
_POLYGON = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties map<string,string>"


def geojson_points(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, x, y) of the points of a feature collection; codes are unique and coordinates finite."""
    rows = _features(spark, path, _POINT).select(F.col(f"f.properties.{code}").alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rows = rows.select("code", "kind", F.get("c", F.lit(0)).alias("x"), F.get("c", F.lit(1)).alias("y"))
    return _unique(refuse(rows, {"no_code": F.col("code").isNull(), "no_point": F.col("kind") != "Point", "no_place": F.col("x").isNull() | F.col("y").isNull()})).select("code", "x", "y")


def geojson_polygons(spark: SparkSession, path: str, code: str) -> DataFrame:
    """(code, ring, position, x, y): the vertices of polygons, each ring closed."""
    rows = _features(spark, path, _POLYGON).select(F.col(f"f.properties.{code}").alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("rings"))
    opened = F.exists("rings", lambda r: (F.size(r) < 4) | (F.element_at(r, 1) != F.element_at(r, -1)))
    _unique(refuse(rows, {"no_code": F.col("code").isNull(), "no_polygon": F.col("kind") != "Polygon", "open_ring": F.coalesce(opened, F.lit(True))}))
    vertices = rows.select("code", F.posexplode("rings").alias("ring", "v")).select("code", "ring", F.posexplode("v").alias("position", "p"))
    return vertices.select("code", "ring", "position", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


#: Names of coordinate systems in degrees of longitude and latitude; a layer that names none is in these too.
DEGREES = ("EPSG:4326", "urn:ogc:def:crs:OGC:1.3:CRS84", "urn:ogc:def:crs:EPSG::4326")
_LAYER = "type string, crs struct<type: string, properties: struct<name: string>>"
_AREA = "type string, geometry struct<type: string, coordinates: string>, properties map<string,string>"


def geojson_areas(spark: SparkSession, path: str, code: str, pattern: str = ".+", decimals: int = 6) -> DataFrame:
    """(code, part, ring, position, x, y) of the valid polygons of a layer of areas, as fixed-point numbers.

    Polygons and multipolygons are taken; a polygon is a part of its own. Refused are a layer
    in another coordinate system, one without areas, codes that do not match the pattern as a
    whole or come twice, other or empty geometries, and polygons that are not valid
    (operators.geometry.invalid()), with their reasons.
    """
    layer = spark.read.text(path, wholetext=True).select(F.from_json("value", _LAYER).alias("l"))
    refuse(layer, {"no_layer": ~F.coalesce(F.col("l.type") == "FeatureCollection", F.lit(False)), "other_coordinates": ~F.coalesce("l.crs.properties.name", F.lit(DEGREES[0])).isin(*DEGREES)})
    rows = _features(spark, path, _AREA).select(F.col(f"f.properties.{code}").alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    rings = "array<array<array<double>>>"
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", rings))).when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{rings}>"))
    rows = rows.select("code", parts.alias("parts"))
    if rows.limit(1).isEmpty():
        raise ContractError("the layer is empty")
    bare = F.exists("parts", lambda p: F.coalesce(F.size(p) < 1, F.lit(True)) | F.exists(p, lambda r: F.coalesce(F.size(r) < 1, F.lit(True)) | F.exists(r, lambda v: F.size(v) < 2)))
    _unique(refuse(rows, {
        "no_code": ~F.coalesce(whole_match(F.col("code"), pattern), F.lit(False)), "no_polygon": F.col("parts").isNull(), "empty": F.coalesce(F.size("parts") < 1, F.lit(True)) | F.coalesce(bare, F.lit(True)),
    }))
    vertices = rows.select("code", F.posexplode("parts").alias("part", "p")).select("code", "part", F.posexplode("p").alias("ring", "r")).select("code", "part", "ring", F.posexplode("r").alias("position", "v"))
    fixed = geometry.fixed_point(vertices.select("code", "part", "ring", "position", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")), decimals)
    bad = geometry.invalid(fixed).groupBy("reason").agg(F.count("*").alias("n")).collect()
    if bad:
        raise ContractError(f"areas are not valid: { {r['reason']: r['n'] for r in bad} }")
    return fixed


def same_codes(areas: DataFrame, points: DataFrame) -> None:
    """Refuses layers of areas and points whose codes differ."""
    a, b = areas.select("code").distinct(), points.select("code").distinct()
    only = a.exceptAll(b).count(), b.exceptAll(a).count()
    if any(only):
        raise ContractError(f"{only[0]} codes have no point, {only[1]} no area")


def _features(spark: SparkSession, path: str, feature: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"features array<struct<{_colons(feature)}>>")["features"]).alias("f"))


def _colons(ddl: str) -> str:
    """The fields of a schema as those of a struct."""
    return ", ".join(f"{x.fieldNames()[0]}: {x.fields[0].dataType.simpleString()}" for x in (T.StructType([f]) for f in T._parse_datatype_string(ddl).fields))


def _unique(df: DataFrame) -> DataFrame:
    if df.groupBy("code").count().where("count > 1").limit(1).count():
        raise ContractError("a code occurs twice")
    return df


def bio(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, position, token, tag) from lines `token tag`, with blank lines between sentences.

    The last white space of a line parts token and tag. Lines are counted as each split of a file
    is read, and what the splits of a file add up to says where each begins; no task holds or
    sorts a file.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("text"))
    read = staged(lines.withColumn("blank", F.trim("text") == "").mapInArrow(_counted_lines, "file string, split long, text string, blank boolean, line long, starts long, filled long, begin long"), "lines")
    splits = read.groupBy("file", "split").agg(
        F.max("starts").alias("_starts"), F.max("filled").alias("_filled"), F.max("begin").alias("_begin"), F.max(F.when(F.col("line") == 0, ~F.col("blank"))).alias("_first"), F.max_by("blank", "line").alias("_ended")
    )
    order = Window.partitionBy("file").orderBy("split")  # a row a split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"_opens": F.col("_first") & F.lag("_ended", 1, True).over(order), "_filled_before": F.coalesce(F.sum("_filled").over(before), F.lit(0))})
    own = F.when(F.col("_begin") >= 0, F.col("_filled_before") + F.col("_begin")).when(F.col("_opens"), F.col("_filled_before"))
    splits = splits.withColumn("_own", own).select(
        "file", "split", "_opens", "_filled_before", F.coalesce(F.sum(F.col("_starts") + flag(F.col("_opens"))).over(before), F.lit(0)).alias("_starts_before"), F.last("_own", True).over(before).alias("_carried")
    )
    placed = read.where(~F.col("blank")).join(F.broadcast(splits), ["file", "split"])
    begin = F.when(F.col("begin") >= 0, F.col("_filled_before") + F.col("begin")).when(F.col("_opens"), F.col("_filled_before")).otherwise(F.col("_carried"))
    part = lambda i: F.regexp_extract("text", r"^\s*(.+?)\s+(\S+)\s*$", i)
    sentence = F.col("_starts_before") + flag(F.col("_opens")) + F.col("starts") - 1
    parts = placed.select("file", sentence.alias("sentence"), (F.col("_filled_before") + F.col("filled") - 1 - begin).cast("int").alias("position"), part(1).alias("token"), part(2).alias("tag"))
    return refuse(parts, {"no_tag": F.col("tag") == ""})


def _counted_lines(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Adds to lines, which come in order, counts within their split of a file: lines before (line), sentences begun
    after a blank line (starts), lines that are not blank (filled), and how many were before the sentence (begin, -1 if it may go on from another split)."""
    at, line, starts, filled, begin, ended = None, 0, 0, 0, -1, False
    for batch in batches:
        pieces, low = [], 0
        files, offsets = batch.column("file").dictionary_encode(), batch.column("split").to_numpy(zero_copy_only=False)
        code = files.indices.to_numpy(zero_copy_only=False)
        edges = [*(np.flatnonzero((np.diff(code) != 0) | (np.diff(offsets) != 0)) + 1).tolist(), batch.num_rows]
        blanks = batch.column("blank").to_numpy(zero_copy_only=False).astype(bool)
        for high in edges:
            if high == low:
                continue
            here = (files.dictionary[code[low]].as_py(), int(offsets[low]))
            if here != at:
                at, line, starts, filled, begin, ended = here, 0, 0, 0, -1, False
            blank = blanks[low:high]
            start = ~blank & np.append(ended, blank[:-1])
            s, f = starts + np.cumsum(start), filled + np.cumsum(~blank)
            b = np.maximum.accumulate(np.append(begin, np.where(start, f - 1, -1)))[1:]
            pieces.append((line + np.arange(high - low), s, f, b))
            line, starts, filled, begin, ended, low = line + high - low, int(s[-1]), int(f[-1]), int(b[-1]), bool(blank[-1]), high
        counts = [pa.array(np.concatenate([p[i] for p in pieces]) if pieces else [], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "split", "text", "blank")), *counts], names=["file", "split", "text", "blank", "line", "starts", "filled", "begin"])


def files(spark: SparkSession, root: str, classes: dict[str, str], most: int = 64 << 20) -> DataFrame:
    """(relative_path, label, byte_size, sha256, width, height) of the files under folders named like classes.

    Files over `most` bytes are refused before they are read. Sizes are read from PNG
    headers; other formats have none, since no image library is at hand.
    """
    base = root.rstrip("/")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    refuse(every.select("length"), {"too_large": F.col("length") > most})
    relative = F.regexp_extract("path", r"^(?:file:)?/*" + base.split("://")[-1].lstrip("/") + "/(.+)$", 1)
    named = spark.createDataFrame(sorted(classes.items()), "folder string, label string")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    rows = every.select(relative.alias("relative_path"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), F.when(png, number(17)).alias("width"), F.when(png, number(21)).alias("height"))
    rows = rows.withColumn("folder", F.element_at(F.split("relative_path", "/"), -2))
    return rows.join(F.broadcast(named), "folder").drop("folder")


def agrees_with_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose digest is not that of the manifest, or which only one of the two has."""
    m = manifest.select("relative_path", F.col("sha256").alias("_said"))
    return found.select("relative_path", "sha256").join(m, "relative_path", "full").where(~F.col("sha256").eqNullSafe(F.col("_said"))).select("relative_path", "sha256", F.col("_said").alias("said"))


def synthetic_panel(spark: SparkSession, entities: int, periods: int, seed: int = 7) -> DataFrame:
    """(entity, period, points, minutes, starts, extra) drawn by a hash, the same whatever the partitioning."""
    rows = spark.range(entities * periods).select((F.floor(F.col("id") / periods) + 1).alias("entity"), (F.col("id") % periods + 1).cast("int").alias("period"))
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "entity", "period"), F.lit(n))
    return rows.select("entity", "period", draw("points", 15).alias("points"), draw("minutes", 91).alias("minutes"), draw("starts", 2).alias("starts"), draw("extra", 50).alias("extra"))


def synthetic_flows(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(origin, destination, indicator, people) between the cells of an n by n grid, with one destination outside."""
    if not 2 <= n <= 200:
        raise ContractError("a grid has 2 to 200 cells a side")
    cells = n * n
    rows = spark.range(cells * (cells + 3)).select(F.floor(F.col("id") / (cells + 3)).alias("o"), (F.col("id") % (cells + 3)).alias("k"))
    code = lambda x: F.concat(F.lit("E020"), F.lpad(x.cast("string"), 5, "0"))
    people = F.pmod(F.xxhash64(F.lit(seed), "o", "k"), F.lit(200)) + 1
    k = F.col("k")
    return rows.select(
        code(F.col("o")).alias("origin"), F.concat(F.lit("Cell "), F.col("o").cast("string")).alias("origin_label"),
        F.when(k < cells, code(k)).when(k == cells, F.lit("OUTSIDE")).otherwise(code(F.col("o"))).alias("destination"),
        F.when(k <= cells, 3).when(k == cells + 1, 1).otherwise(2).alias("indicator"), people.alias("people"),
    )


def finite_or_refuse(values: dict[str, float]) -> dict[str, float]:
    """Numbers of a control file, none of them a boolean or not finite."""
    for k, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
            raise ContractError(f"{k} is no finite number")
    return values
