"""Writers with a fixed form: what is equal is equal byte for byte."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind in ("double", "float"):
        value = c.cast("double")
        # Zeros at the end of the mantissa go, and a point that then ends it.
        text = F.regexp_replace(F.format_string("%.12g", value), r"(\.[0-9]*?)0*(e.*)?$", "$1$2")
        text = F.regexp_replace(text, r"\.(e.*)?$", "$1")
        infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
        return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(F.abs(value) == float("inf"), infinite).otherwise(text)
    return c.cast("string")


def fixed_csv(df: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """CSV in the order of a key, doubles to 12 significant digits, lines ended by a line feed; null and NaN are empty.

    With `single`, which is for small tables, one file; else a file a range of the key.
    """
    ordered = df.orderBy(*order)
    rows = ordered.select(*[_text(c, t).alias(c) for c, t in df.dtypes])
    (rows.coalesce(1) if single else rows).write.mode("errorifexists").csv(path, header=True, lineSep="\n", emptyValue="")


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, ASCII, a line feed at the end; NaN and infinity are refused. For small results on the driver."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) + "\n").encode()


def pretty_json(value: object) -> bytes:
    return (json.dumps(value, sort_keys=True, indent=2, ensure_ascii=True, allow_nan=False) + "\n").encode()


def geojson_features(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """A row a feature, in column `feature`: points as GeoJSON."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_geojson(df: DataFrame, path: str) -> None:
    """Line-delimited features, one file a partition."""
    df.select("feature").write.mode("errorifexists").text(path)


def write_feature_collection(df: DataFrame, path: str, order: list[str]) -> None:
    """The features as one GeoJSON document, in the order of a key: one file, whose lines a task writes as they come."""
    head = df.orderBy(*order).limit(1).select(*order, F.lit(True).alias("_first"))  # one row; keys are unique
    marked = df.join(F.broadcast(head), order, "left")
    lines = marked.select(F.lit(1).alias("_part"), *order, F.concat(F.when(F.col("_first"), F.lit("")).otherwise(F.lit(",")), F.col("feature")).alias("line"))
    nothing = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in order]
    ends = df.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "_part int, line string").select("_part", *nothing, "line")
    lines.unionByName(ends).orderBy("_part", *order).coalesce(1).select("line").write.mode("errorifexists").text(path)


def named_texts(df: DataFrame, path: str, key: str, name: str) -> None:
    """One text file for each row of (key, text), under a name with the key in it; for few rows, since each is a rename."""
    df.repartition(key).write.mode("errorifexists").partitionBy(key).text(f"{path}/.writing")
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.globStatus(hadoop.Path(f"{path}/.writing/{key}=*")):
        value = folder.getPath().getName().partition("=")[2]
        parts = [s.getPath() for s in files.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{len(parts)} files for {key} {value}")
        files.rename(parts[0], hadoop.Path(f"{path}/{name.format(value)}"))
    files.delete(hadoop.Path(f"{path}/.writing"), True)
