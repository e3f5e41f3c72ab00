"""Readers, writers and streams."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import flows as streams
from tests.conftest import rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv(spark, tmp_path):
    good = write(tmp_path / "a.csv", '﻿a,b\n 1 ,"x, y"\n,\n2,z\n')
    assert rows(readers.strict_csv(spark, good, ["a", "b"]), "a") == [("1", "x, y"), ("2", "z")]
    assert rows(readers.strict_csv(spark, good, ["b"], exact=False), "b") == [("x, y",), ("z",)]
    for text in ("a,c\n1,2\n", "b,a\n1,2\n", "a,a\n1,2\n", "a,b\n1,2,3\n", "a,b\n1\n"):
        with pytest.raises(readers.ContractError):
            readers.strict_csv(spark, write(tmp_path / f"{zlib.crc32(text.encode())}.csv", text), ["a", "b"])


def snapshot(period, elements, name=None):
    return f"week-{name or period}.json", json.dumps({"format": "1", "season": "2024-25", "period": period, "elements": elements})


@pytest.mark.parametrize(
    "files",
    [
        [snapshot(1, [{"id": 1, "stats": {"points": 2}}], 2)],
        [snapshot(1, [])],
        [snapshot(1, [{"id": 1, "stats": {}}])],
        [snapshot(1, [{"id": 1, "stats": {"points": 2}}, {"id": 1, "stats": {"points": 3}}])],
        [("a-1.json", snapshot(1, [{"id": 1, "stats": {"points": 2}}])[1]), ("b-1.json", snapshot(1, [{"id": 1, "stats": {"points": 2}}])[1])],
        [("a-1.json", '{"season": "x", "period": 1, "elements": [{"id": 1, "stats": {"points": NaN}}]}')],
    ],
)
def test_snapshots_are_refused(spark, tmp_path, files):
    for name, text in files:
        write(tmp_path / name, text)
    with pytest.raises(Exception):
        readers.snapshots(spark, str(tmp_path), ["points"], ["minutes"]).collect()


def test_snapshots(spark, tmp_path):
    for p in (1, 2):
        write(tmp_path / snapshot(p, [])[0], snapshot(p, [{"id": 7, "stats": {"points": p, "minutes": None}}, {"id": 8, "stats": {"points": 0, "minutes": 9}}])[1])
    got = rows(readers.snapshots(spark, str(tmp_path), ["points"], ["minutes"]), "period", "entity")
    assert got == [("2024-25", 1, 7, 1.0, 0.0), ("2024-25", 1, 8, 0.0, 9.0), ("2024-25", 2, 7, 2.0, 0.0), ("2024-25", 2, 8, 0.0, 9.0)]


def test_strict_objects():
    assert readers.strict_object('{"a": [1, {"b": 2}]}') == {"a": [1, {"b": 2}]}
    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "{", '{"a": {"b": 1, "b": 1}}'):
        with pytest.raises(readers.ContractError):
            readers.strict_object(text)
    with pytest.raises(readers.ContractError):
        readers.strict_object('{"a": 1}', most=3)
    assert readers.repeated_json_keys('{"a": {"b": 1, "b": 1}}') and not readers.repeated_json_keys('{"a": {"b": 1}, "b": 2}')
    with pytest.raises(readers.ContractError):
        readers.finite_or_refuse({"a": True})


def test_geojson(spark, tmp_path):
    def point(code, xy):
        return {"type": "Feature", "properties": {"code": code}, "geometry": {"type": "Point", "coordinates": xy}}

    path = write(tmp_path / "p.json", json.dumps({"type": "FeatureCollection", "features": [point("a", [1.5, 2]), point("b", [0, -1])]}, indent=1))
    assert rows(readers.geojson_points(spark, path, "code"), "code") == [("a", 1.5, 2.0), ("b", 0.0, -1.0)]
    twice = write(tmp_path / "q.json", json.dumps({"features": [point("a", [1, 2]), point("a", [0, 1])]}))
    with pytest.raises(readers.ContractError):
        readers.geojson_points(spark, twice, "code")
    square = {"type": "Feature", "properties": {"code": "s"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    path = write(tmp_path / "r.json", json.dumps({"features": [square]}))
    assert rows(readers.geojson_polygons(spark, path, "code"), "position")[2] == ("s", 0, 2, 1.0, 1.0)
    square["geometry"]["coordinates"][0].pop()
    with pytest.raises(readers.ContractError):
        readers.geojson_polygons(spark, write(tmp_path / "t.json", json.dumps({"features": [square]})), "code")


def test_bio(spark, tmp_path):
    path = write(tmp_path / "x.txt", "\n\nThe B-NP\ncat I-NP\n\n\nNew York B-LOC\n")
    got = [r[1:] for r in rows(readers.bio(spark, path), "sentence", "position")]
    assert got == [(0, 0, "The", "B-NP"), (0, 1, "cat", "I-NP"), (1, 0, "New York", "B-LOC")]
    with pytest.raises(readers.ContractError):
        readers.bio(spark, write(tmp_path / "y.txt", "alone\n"))


def test_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    for name, data in (("cats/a.png", png), ("dogs/b.png", b"no image"), ("others/c.png", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = rows(readers.files(spark, str(tmp_path), {"cats": "cat", "dogs": "dog"}), "relative_path")
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in got] == [("cats/a.png", len(png), 640, 480, "cat"), ("dogs/b.png", 8, None, None, "dog")]
    found = readers.files(spark, str(tmp_path), {"cats": "cat", "dogs": "dog"})
    manifest = found.where("relative_path like 'cats%'").select("relative_path", "sha256").union(spark.createDataFrame([("gone.png", "0")], "a string, b string"))
    assert [r[0] for r in rows(readers.agrees_with_manifest(found, manifest), "relative_path")] == ["dogs/b.png", "gone.png"]
    with pytest.raises(readers.ContractError):
        readers.files(spark, str(tmp_path), {"cats": "cat"}, most=4)


def test_generators_do_not_depend_on_partitions(spark):
    one = rows(readers.synthetic_panel(spark, 5, 4))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        assert rows(readers.synthetic_panel(spark, 5, 4)) == one and len(one) == 20
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    flows = readers.synthetic_flows(spark, 3)
    assert flows.count() == 9 * 12 and flows.groupBy("origin", "destination", "indicator").count().where("count > 1").count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.1 + 0.2, "b"), (1, 3.0, None)], "k int, x double, s string")
    writers.fixed_csv(df, str(tmp_path / "out"), ["k"], single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes() == b"k,x,s\n1,3,\n2,0.3,b\n"
    values = [1e-5, 1e12, 123456789012.0, 100000000000.0, 0.1, -0.0, 1.5e-7, 1234567890123.0, float("nan"), float("inf"), 2.50, 1e300]
    writers.fixed_csv(spark.createDataFrame(list(enumerate(values)), "k int, x double"), str(tmp_path / "exponents"), ["k"], single=True)
    (part,) = (tmp_path / "exponents").glob("part-*")
    said = [line.split(",")[1] for line in part.read_text().splitlines()[1:]]
    assert said == ["" if v != v else f"{v:.12g}" for v in values]
    assert writers.canonical_json({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}\n'
    with pytest.raises(ValueError):
        writers.canonical_json(float("nan"))
    points = spark.createDataFrame([("a", 1.0, 2.0)], "code string, x double, y double")
    features = writers.geojson_features(points, "x", "y", ["code"])
    assert json.loads(features.first()["feature"]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"code": "a"}}


def test_streamed_panel_equals_the_batch(spark, tmp_path):
    rows_ = [(f"2024-01-0{d} 12:00:00", e, d * 10 + e) for d in range(1, 8) for e in (1, 2)]
    batch = spark.createDataFrame(rows_, "ts string, entity int, points int").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = streams.windowed_panel(stream).writeStream.format("memory").queryName("windowed").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["entity"], str(r["start"])): r["points"] for r in spark.table("windowed").collect()}
    want = {(r["entity"], str(r["w"]["start"])): r["points"] for r in batch.groupBy(F.window("ts", "2 days").alias("w"), "entity").agg(F.sum("points").alias("points")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_feature_collection_is_one_document(spark, tmp_path):
    points = spark.createDataFrame([(k, float(k), -1.0) for k in (3, 1, 2)], "code int, x double, y double")
    features = writers.geojson_features(points, "x", "y", ["code"]).withColumn("code", F.get_json_object("feature", "$.properties.code").cast("int"))
    for name, made in (("three", features), ("none", features.limit(0))):
        writers.write_feature_collection(made, str(tmp_path / name), ["code"])
        (part,) = (tmp_path / name).glob("part-*")
        found = json.loads(part.read_text())
        assert found["type"] == "FeatureCollection"
        assert [f["properties"]["code"] for f in found["features"]] == ([1, 2, 3] if name == "three" else [])


def test_snapshots_refuse_repeated_keys_and_take_empty_stats(spark, tmp_path):
    text = '{"season": "x", "period": 1, "elements": [{"id": 1, "stats": {"points": 2, "minutes": ""}}]}'
    (tmp_path / "a").mkdir()
    write(tmp_path / "a" / "a-1.json", text)
    assert rows(readers.snapshots(spark, str(tmp_path / "a"), ["points"], ["minutes"])) == [("x", 1, 1, 2.0, 0.0)]
    (tmp_path / "b").mkdir()
    write(tmp_path / "b" / "a-1.json", text.replace('"points": 2', '"points": 2, "points": 3'))
    with pytest.raises(readers.ContractError):
        readers.snapshots(spark, str(tmp_path / "b"), ["points"], ["minutes"])


@pytest.mark.parametrize("size", ["2k", "1m"])
def test_tagged_text_is_read_in_any_splits(spark, tmp_path, size):
    texts = ["\n\na O\nb B-X\n\n \nc O\r\n\r\nd e I-X\nf O\ng O\nh O\ni O\nj O", "k O\n\nl O\n\n\n", "\n", "m O\nn O\n" * 900, "p O\n\nq O\nr O\n" * 400]
    want = []
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(text.encode())
        sentence, position, open_ = -1, 0, False
        for line in text.replace("\r", "").split("\n"):
            if not line.strip():
                open_ = False
                continue
            sentence, position = (sentence, position + 1) if open_ else (sentence + 1, 0)
            open_ = True
            want.append((f"{i}.txt", sentence, position, *line.rsplit(" ", 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = readers.bio(spark, str(tmp_path))
        got = [(r[0].rsplit("/", 1)[1], *r[1:]) for r in read.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
