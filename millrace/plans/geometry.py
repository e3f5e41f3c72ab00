"""Queries of places and polygons: customers are points over the country, bricks of a wall, and four-sided rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geodesy
from millrace.operators import geometry
from millrace.session import table

#: Bricks in a row of the wall, and their size.
ROW, WIDE, HIGH = 32, 10, 6


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers between 8 degrees west and 2 east, 50 and 60 north."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (key * 7919 % 100003 / 10000.3 - 8).alias("lon"), (key * 104729 % 99991 / 9999.1 + 50).alias("lat"))


def grid_coordinates(spark: SparkSession, d: str) -> DataFrame:
    made = geodesy.national_grid(places(spark, d))
    return made.select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


def bricks(spark: SparkSession, d: str) -> DataFrame:
    """Every other row is shifted by half a brick, so corners lie on edges; some bricks reach into the next one, some leave a gap above."""
    key, at = F.col("c_custkey"), F.col("c_nationkey")
    row = F.floor(key / ROW)
    x = key % ROW * WIDE + row % 2 * (WIDE // 2)
    return table(spark, d, "customer").select(
        key.alias("code"), x.alias("x0"), (row * HIGH).alias("y0"), (x + WIDE + F.when(at == 7, 3).otherwise(0)).alias("x1"), (row * HIGH + HIGH - F.when(at == 3, 1).otherwise(0)).alias("y1")
    )


def closed(df: DataFrame, corners: list[tuple[str, str]]) -> DataFrame:
    """One ring a row through the corners (pairs of columns), back to the first; coordinates as fixed-point numbers."""
    around = [*corners, corners[0]]
    points = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in around])
    return geometry.fixed_point(df.select("code", F.lit(0).alias("ring"), F.posexplode(points).alias("position", "p")).select("code", "ring", "position", "p.x", "p.y"), 2)


def touching_bricks(spark: SparkSession, d: str) -> DataFrame:
    return geometry.touching(closed(bricks(spark, d), [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]))


def overlapping_bricks(spark: SparkSession, d: str) -> DataFrame:
    found = geometry.contacts(closed(bricks(spark, d), [("x0", "y1"), ("x1", "y1"), ("x1", "y0"), ("x0", "y0")]))
    return found.where("overlap").select("a", "b")


def invalid_rings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rings through four places drawn from the key: some cross themselves, some have no area."""
    key = F.col("p_partkey")
    drawn = [(key * a % m).alias(name) for name, a, m in (("ax", 13, 101), ("ay", 29, 103), ("bx", 37, 107), ("by", 41, 109), ("cx", 53, 113), ("cy", 59, 127), ("dx", 61, 131), ("dy", 67, 137))]
    quads = table(spark, d, "part").select(key.alias("code"), *drawn)
    return geometry.invalid(closed(quads, [("ax", "ay"), ("bx", "by"), ("cx", "cy"), ("dx", "dy")]))


QUERIES = {f.__name__: f for f in (grid_coordinates, touching_bricks, overlapping_bricks, invalid_rings)}

_WALL = f"""
    SELECT c_custkey AS code, c_custkey % {ROW} * {WIDE} + c_custkey // {ROW} % 2 * {WIDE // 2} AS x0, c_custkey // {ROW} * {HIGH} AS y0,
           c_custkey % {ROW} * {WIDE} + c_custkey // {ROW} % 2 * {WIDE // 2} + {WIDE} + CASE WHEN c_nationkey = 7 THEN 3 ELSE 0 END AS x1,
           c_custkey // {ROW} * {HIGH} + {HIGH} - CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS y1
    FROM customer
"""
_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
_SHARE = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def _turn(a: str, b: str, c: str) -> str:
    return f"sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _on(a: str, b: str, c: str) -> str:
    """Whether c is on the edge from a to b."""
    return f"({_turn(a, b, c)} = 0 AND {c}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {c}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y))"


def _meet(a: str, b: str, c: str, d: str) -> str:
    through = f"({_turn(a, b, c)} * {_turn(a, b, d)} < 0 AND {_turn(c, d, a)} * {_turn(c, d, b)} < 0)"
    return f"({through} OR {_on(a, b, c)} OR {_on(a, b, d)} OR {_on(c, d, a)} OR {_on(c, d, b)})"


def _spike(a: str, b: str, c: str) -> str:
    """Whether the way from b on to c lies on the way from a."""
    return f"({_turn(a, b, c)} = 0 AND ({b}x - {a}x) * ({c}x - {b}x) + ({b}y - {a}y) * ({c}y - {b}y) < 0)"


def _same(a: str, b: str) -> str:
    return f"({a}x = {b}x AND {a}y = {b}y)"


_DRAWN = ", ".join(f"p_partkey * {a} % {m} AS p{name}" for name, a, m in (("ax", 13, 101), ("ay", 29, 103), ("bx", 37, 107), ("by", 41, 109), ("cx", 53, 113), ("cy", 59, 127), ("dx", 61, 131), ("dy", 67, 137)))

ORACLE_SQL = {
    "grid_coordinates": geodesy.national_grid_sql(
        "SELECT c_custkey, c_custkey * 7919 % 100003 / 10000.3 - 8 AS lon, c_custkey * 104729 % 99991 / 9999.1 + 50 AS lat FROM customer", "c_custkey"
    ),
    "touching_bricks": f"""
        WITH wall AS ({_WALL})
        SELECT a.code AS a, b.code AS b FROM wall a JOIN wall b ON a.code < b.code AND {_MEET} WHERE NOT ({_SHARE})
    """,
    "overlapping_bricks": f"""
        WITH wall AS ({_WALL})
        SELECT a.code AS a, b.code AS b FROM wall a JOIN wall b ON a.code < b.code AND {_SHARE}
    """,
    "invalid_rings": f"""
        WITH quads AS (SELECT p_partkey AS code, {_DRAWN} FROM part),
        seen AS (
            SELECT *, {_same("pa", "pb")} OR {_same("pb", "pc")} OR {_same("pc", "pd")} OR {_same("pd", "pa")} AS repeated,
                   {_same("pa", "pb")} AND {_same("pb", "pc")} AND {_same("pc", "pd")} AS one_place,
                   pax * pby - pbx * pay + pbx * pcy - pcx * pby + pcx * pdy - pdx * pcy + pdx * pay - pax * pdy AS area
            FROM quads)
        SELECT code, 'self_crossing' AS reason FROM seen
        WHERE CASE WHEN repeated THEN area = 0 AND NOT one_place ELSE
              {_meet("pa", "pb", "pc", "pd")} OR {_meet("pb", "pc", "pd", "pa")}
              OR {_spike("pa", "pb", "pc")} OR {_spike("pb", "pc", "pd")} OR {_spike("pc", "pd", "pa")} OR {_spike("pd", "pa", "pb")} END
        UNION ALL
        SELECT code, 'collapsed' FROM seen WHERE area = 0
    """,
}
