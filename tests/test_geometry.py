"""Grid coordinates against published points; touching and valid polygons against exact plain versions."""

import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import geodesy
from millrace.operators import geometry


def degrees(d, m, s):
    return d + m / 60 + s / 3600


#: Published worked example of the projection: a water tower, on the grid's own datum, at 24.7 m.
TOWER = (degrees(1, 43, 4.5177), degrees(52, 39, 27.2531))


def test_projection_of_a_published_point(spark):
    row = spark.createDataFrame([TOWER], "lon double, lat double")
    east, north = row.select(*geodesy.transverse_mercator(F.radians("lon"), F.radians("lat"))).first()
    assert abs(east - 651409.903) < 1e-3 and abs(north - 313177.270) < 1e-3


def test_cartesian_of_the_published_point(spark):
    row = spark.createDataFrame([TOWER], "lon double, lat double")
    x, y, z = row.select(*geodesy.cartesian(F.col("lon"), F.col("lat"), geodesy.AIRY)).first()
    up = (math.cos(math.radians(TOWER[1])) * math.cos(math.radians(TOWER[0])), math.cos(math.radians(TOWER[1])) * math.sin(math.radians(TOWER[0])), math.sin(math.radians(TOWER[1])))
    for got, u, want in zip((x, y, z), up, (3874938.849, 116218.624, 5047168.208), strict=True):
        assert abs(got + 24.7 * u - want) < 2e-3


def shifted(x, y, z, by=geodesy.SHIFT):
    """The shift itself, of which shifted_back() is the inverse to first order of the angles."""
    rx, ry, rz = (math.radians(a / 3600) for a in (by.rx, by.ry, by.rz))
    m = 1 + by.scale * 1e-6
    return by.x + m * (x - rz * y + ry * z), by.y + m * (rz * x + y - rx * z), by.z + m * (-ry * x + rx * y + z)


def test_shift_and_geodetic_are_undone(spark):
    points = [(lon, lat) for lon in (-8.0, -2.0, 0.0, 1.9) for lat in (49.5, 55.0, 61.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    there = df.select("lon", "lat", *[c.alias(n) for n, c in zip("xyz", geodesy.cartesian(F.col("lon"), F.col("lat"), geodesy.AIRY), strict=True)])
    back = there.select("*", *[F.degrees(c).alias(n) for n, c in zip(("lon2", "lat2"), geodesy.geodetic(F.col("x"), F.col("y"), F.col("z")), strict=True)])
    for r in back.collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-12 and abs(r["lat"] - r["lat2"]) < 1e-10  # a hundredth of a millimetre
        moved = spark.createDataFrame([shifted(r["x"], r["y"], r["z"])], "x double, y double, z double")
        got = moved.select(*geodesy.shifted_back(F.col("x"), F.col("y"), F.col("z"))).first()
        assert max(abs(a - b) for a, b in zip(got, (r["x"], r["y"], r["z"]), strict=True)) < 2e-4


def arc(lat, on=geodesy.AIRY, steps=20000):
    """Metres from the equator along the meridian, by Simpson's rule."""
    f = lambda p: on.a * (1 - on.e2) / (1 - on.e2 * math.sin(p) ** 2) ** 1.5
    h = lat / steps
    return h / 3 * (f(0) + f(lat) + sum(f(i * h) * (4 if i % 2 else 2) for i in range(1, steps)))


def test_northings_on_the_central_meridian_are_arcs(spark):
    for lat in (49.0, 53.4, 60.8):
        east, north = spark.range(1).select(*geodesy.transverse_mercator(F.lit(math.radians(-2.0)), F.lit(math.radians(lat)))).first()
        want = geodesy.GRID.north + geodesy.GRID.scale * (arc(math.radians(lat)) - arc(math.radians(49.0)))
        assert abs(east - 400000) < 1e-6 and abs(north - want) < 1e-4


def test_places_off_the_globe_are_null(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (0.0, 95.0), (0.0, 51.5)], "lon double, lat double")
    got = geodesy.national_grid(df).collect()
    assert [r["east"] is None for r in got] == [True, True, True, False]
    # A datum shift of this kind is good to some metres: the observatory's transit circle, 5.31 seconds west on WGS84, is near 538885, 177320.
    greenwich = geodesy.national_grid(spark.createDataFrame([(-0.001475, 51.4779)], "lon double, lat double")).first()
    assert abs(greenwich["east"] - 538885) < 10 and abs(greenwich["north"] - 177320) < 20


def rings(spark, polygons):
    """{code: [part, ...]}, a part being [shell, hole, ...], as closed fixed-point rings."""
    rows = [
        (code, p, r, i, x, y) for code, parts in polygons.items() for p, part in enumerate(parts)
        for r, ring in enumerate(part) for i, (x, y) in enumerate([*ring, ring[0]])
    ]
    return spark.createDataFrame(rows, "code string, part int, ring int, position int, x long, y long")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


SHAPES = {
    "a": [[box(0, 0, 10, 10)]],
    "b": [[box(10, 4, 20, 14)]],  # a T-junction on both edges
    "c": [[[(20, 14), (30, 14), (25, 30)]]],  # touches b at a corner
    "d": [[box(5, 5, 8, 8)]],  # inside a, no contact
    "e": [[box(0, 0, 4, 4)]],  # inside a, along two edges
    "f": [[box(40, 0, 60, 20), box(45, 5, 55, 15)]],  # with a hole
    "g": [[box(45, 5, 55, 15)]],  # fills the hole
    "h": [[box(48, 8, 50, 10)]],  # in the hole, inside g
    "i": [[[(45, 10), (50, 5), (55, 10), (50, 15)]]],  # in the hole, corners on its edges
    "j": [[box(60, 0, 70, 5)], [box(46, 6, 47, 7)]],  # two parts: one beside f, one inside g
    "k": [[[(0, 10), (5, 20), (10, 10), (5, 12)]]],  # two corners on a's corners
    "l": [[[(3, 10), (7, 10), (5, -5)]]],  # crosses a
    "m": [[box(40, 0, 60, 20)]],  # f without its hole
    "n": [[box(80, 0, 90, 10)], [box(62, 1, 64, 2)]], "o": [[box(90, 0, 95, 5)], [box(60, 5, 61, 6)]],
}


def test_touching_shapes(spark):
    got = {(r["a"], r["b"]): r["overlap"] for r in geometry.contacts(rings(spark, SHAPES)).collect()}
    touch = {p for p, overlap in got.items() if not overlap}
    assert touch == {("a", "b"), ("b", "c"), ("f", "g"), ("f", "i"), ("f", "j"), ("a", "k"), ("b", "k"), ("n", "o"), ("j", "o"), ("m", "o"), ("f", "o")}
    assert {("a", "e"), ("a", "l"), ("g", "i"), ("f", "m"), ("e", "l"), ("j", "m")} <= {p for p, overlap in got.items() if overlap}
    assert geometry.touching(rings(spark, SHAPES)).where("a = 'g' OR b = 'g'").count() == 1  # f alone


def test_a_part_inside_the_other_polygon_is_an_overlap(spark):
    shapes = {"p": [[box(0, 0, 10, 10)]], "q": [[box(10, 0, 20, 10)], [box(3, 3, 4, 4)]], "r": [[box(20, 0, 30, 10)], [box(50, 50, 51, 51)]]}
    got = {(r["a"], r["b"]): r["overlap"] for r in geometry.contacts(rings(spark, shapes)).collect()}
    assert got == {("p", "q"): True, ("q", "r"): False}


def clipped_area(p, q):
    """Doubled area that two convex anticlockwise polygons share, exactly."""
    out = [(Fraction(x), Fraction(y)) for x, y in p]
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1], strict=True):
        side = lambda s: (bx - ax) * (s[1] - ay) - (by - ay) * (s[0] - ax)  # noqa: B023, E731
        made = []
        for s, t in zip(out, out[1:] + out[:1], strict=True):
            if side(s) >= 0:
                made.append(s)
            if side(s) * side(t) < 0:
                u = side(s) / (side(s) - side(t))
                made.append((s[0] + u * (t[0] - s[0]), s[1] + u * (t[1] - s[1])))
        out = made
        if not out:
            return None
    return abs(sum(s[0] * t[1] - t[0] * s[1] for s, t in zip(out, out[1:] + out[:1], strict=True)))


def test_random_triangles_equal_exact_clipping(spark):
    draw = random.Random(11)
    shapes = {}
    while len(shapes) < 90:
        x, y = draw.randrange(12), draw.randrange(12)
        p = [(x + draw.randrange(5), y + draw.randrange(5)) for _ in range(3)]
        area = (p[1][0] - p[0][0]) * (p[2][1] - p[0][1]) - (p[1][1] - p[0][1]) * (p[2][0] - p[0][0])
        if area:
            shapes[f"{len(shapes):02}"] = p if area > 0 else p[::-1]
    want = set()
    for a, b in itertools.combinations(shapes, 2):
        if clipped_area(shapes[a], shapes[b]) == 0:
            want.add((a, b))
    given = {code: [[p if int(code) % 2 else p[::-1]]] for code, p in shapes.items()}
    got = {(r["a"], r["b"]) for r in geometry.touching(rings(spark, given)).collect()}
    assert got == want and len(want) > 50


def test_valid_and_invalid_rings(spark):
    shapes = SHAPES | {
        "bow": [[[(0, 0), (10, 10), (10, 0), (0, 10)]]],
        "spike": [[[(0, 0), (10, 0), (10, 5), (10, 20), (10, 5), (0, 5)]]],
        "flat": [[[(0, 0), (5, 0), (9, 0)]]],
        "dot": [[[(3, 3)]]],
        "eight": [[[(0, 0), (4, 0), (4, 4), (2, 2), (0, 4), (2, 2)]]],  # a vertex on another one
        "tee": [[[(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)]]],  # a vertex on an edge
        "outside": [[box(0, 0, 5, 5), box(7, 7, 8, 8)]],
        "through": [[box(0, 0, 5, 5), box(4, 4, 8, 8)]],
        "parts": [[box(0, 0, 5, 5)], [box(5, 0, 8, 8)]],  # two parts along an edge
        "kiss": [[box(0, 0, 9, 9), [(0, 4), (3, 3), (3, 6)]]],  # a hole touches its shell at a point, as it may
        "repeated": [[[(0, 0), (0, 0), (4, 0), (4, 4), (4, 4)]]],
    }
    got = {}
    table = rings(spark, shapes).union(spark.createDataFrame([("open", 0, 0, i, x, y) for i, (x, y) in enumerate(box(0, 0, 4, 4))], "code string, part int, ring int, position int, x long, y long"))
    for r in geometry.invalid(table).collect():
        got.setdefault(r["code"], set()).add(r["reason"])
    assert got["open"] == {"open_ring"} and got["bow"] == {"self_crossing", "collapsed"} and got["outside"] == {"hole_outside"}
    assert got["spike"] == {"self_crossing"} and "collapsed" in got["flat"] and got["dot"] == {"collapsed"}
    assert got["eight"] == {"self_crossing"} and got["tee"] == {"self_crossing"} and "rings_cross" in got["through"] and got["parts"] == {"rings_cross"}
    assert set(got) == {"open", "bow", "outside", "spike", "flat", "dot", "eight", "tee", "through", "parts"}


def test_long_and_steep_edges_find_each_other(spark):
    draw = random.Random(4)
    shapes = {f"s{i:02}": [[[(x := draw.randrange(10**6), y := draw.randrange(10**6)), (x + 5, y), (x, y + 7)]]] for i in range(40)}
    shapes["long"] = [[[(0, 0), (10**8, 3 * 10**7), (0, 1)]]]
    shapes["tip"] = [[[(10**8, 3 * 10**7), (10**8 + 5, 3 * 10**7), (10**8, 3 * 10**7 + 5)]]]
    assert ("long", "tip") in {(r["a"], r["b"]) for r in geometry.touching(rings(spark, shapes)).collect()}


def test_no_nested_loop_and_no_cross_join(spark):
    for df in (geometry.contacts(rings(spark, SHAPES)), geometry.invalid(rings(spark, SHAPES))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_coordinates_out_of_reach_are_refused(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.5, -2.25), ("a", 0, 1, 1e12, 0.0)], "code string, ring int, position int, x double, y double")
    assert [tuple(r) for r in geometry.fixed_point(df.where("position = 0")).collect()] == [("a", 0, 0, 0, 1500000, -2250000)]
    with pytest.raises(Exception, match="out of reach"):
        geometry.fixed_point(df).collect()


def layer(path, features, **more):
    import json

    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {"code": code}} for code, kind, c in features], **more}))
    return str(path)


def ring(*points):
    return [list(p) for p in (*points, points[0])]


def test_layers_of_areas(spark, tmp_path):
    from millrace.sources import readers

    square, other = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((1, 0.5), (2, 0.5), (2, 2), (1, 2))
    far = ring((5, 5), (6, 5), (6, 6))
    good = [("E1", "Polygon", [square]), ("E2", "MultiPolygon", [[other], [far]])]
    crs = {"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}}
    got = readers.geojson_areas(spark, layer(tmp_path / "a.json", good, **crs), "code", "E[0-9]")
    assert got.count() == 5 + 5 + 4 and {tuple(r) for r in got.select("code", "part").distinct().collect()} == {("E1", 0), ("E2", 0), ("E2", 1)}
    assert [tuple(r) for r in geometry.touching(got).collect()] == [("E1", "E2")]
    points = spark.createDataFrame([("E1", 0.5, 0.5), ("E2", 1.5, 1.0)], "code string, x double, y double")
    readers.same_codes(got, points)
    with pytest.raises(readers.ContractError, match="1 codes have no point"):
        readers.same_codes(got, points.where("code = 'E1'"))
    bow = ring((0, 0), (1, 1), (1, 0), (0, 1))
    cases = [
        (good, {"crs": {"type": "name", "properties": {"name": "EPSG:27700"}}}, "other_coordinates"), ([], {}, "empty"), ([*good, good[0]], {}, "twice"), ([("X1", "Polygon", [square])], {}, "no_code"),
        ([("E1", "Point", [0, 0])], {}, "no_polygon"), ([("E1", "Polygon", [])], {}, "empty"), ([("E1", "Polygon", [bow])], {}, "self_crossing"), ([("E1", "Polygon", [square[:-1]])], {}, "open_ring"),
    ]
    for i, (features, more, said) in enumerate(cases):
        with pytest.raises(readers.ContractError, match=said):
            readers.geojson_areas(spark, layer(tmp_path / f"c{i}.json", features, **more), "code", "E[0-9]")
