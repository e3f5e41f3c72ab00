"""Areas in space: accessibility by gravity, contiguity, spatial autocorrelation.

Areas are a dimension table (code, x, y in metres); the all-pairs distance table
that gravity needs by definition grows with its square, so the number of areas is
checked. Contiguity comes from an equi-join on shared vertices, never from a loop
over pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalar import hash_order, ratio

DECAY_KM = (3, 5, 10)
MAX_AREAS = 20_000


def distances(areas: DataFrame) -> DataFrame:
    """Metres between every two areas, each with itself included (origin, destination, metres)."""
    if areas.count() > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} areas")
    to = areas.select(F.col("code").alias("destination"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    metres = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    return areas.withColumnRenamed("code", "origin").crossJoin(F.broadcast(to)).select("origin", "destination", metres.alias("metres"))


def gravity_access(areas: DataFrame, mass: DataFrame, decay_km: tuple[int, ...] = DECAY_KM) -> DataFrame:
    """Sum over all areas of mass * exp(-km / decay), for each decay."""
    pairs = distances(areas).join(mass, F.col("destination") == F.col("code")).drop("code")
    each = [F.round(F.sum(F.col("mass") * F.exp(-F.col("metres") / (1000.0 * k))), 6).alias(f"access_{k}km") for k in decay_km]
    return pairs.groupBy("origin").agg(*each)


def mean_local_distance(areas: DataFrame, flows: DataFrame) -> DataFrame:
    """Mean metres travelled from each area, weighted by people; 0 without flows."""
    here = areas.select(F.col("code").alias("origin"), F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    there = areas.select(F.col("code").alias("destination"), F.col("x").alias("_dx"), F.col("y").alias("_dy"))
    metres = F.sqrt(F.pow(F.col("_ox") - F.col("_dx"), 2) + F.pow(F.col("_oy") - F.col("_dy"), 2))
    sums = (
        flows.join(here, "origin").join(there, "destination")
        .groupBy("origin").agg(F.sum(metres * F.col("people")).alias("_m"), F.sum("people").alias("_p"))
    )
    return areas.select(F.col("code").alias("origin")).join(sums, "origin", "left").select(
        "origin", ratio(F.col("_m"), F.col("_p"), 6).alias("mean_metres")
    )


def touching(vertices: DataFrame) -> DataFrame:
    """Pairs a < b of areas that share a vertex, from (code, vx, vy) with exact coordinates."""
    left = vertices.select(F.col("code").alias("a"), "vx", "vy")
    right = vertices.select(F.col("code").alias("b"), "vx", "vy")
    return left.join(right, ["vx", "vy"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def cell_vertices(cells: DataFrame) -> DataFrame:
    """The four corners of unit cells (code, cx, cy)."""
    corners = F.array(*[F.struct((F.col("cx") + i).alias("vx"), (F.col("cy") + j).alias("vy")) for i in (0, 1) for j in (0, 1)])
    return cells.select("code", F.explode(corners).alias("v")).select("code", "v.*")


def islands(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """Areas without any edge."""
    ends = edges.select(F.col("a").alias("code")).union(edges.select(F.col("b").alias("code"))).distinct()
    return areas.select("code").join(ends, "code", "left_anti")


def weights(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with weight 1 / degree of the first end (i, j, w)."""
    both = edges.select(F.col("a").alias("i"), F.col("b").alias("j")).union(edges.select(F.col("b").alias("i"), F.col("a").alias("j")))
    return both.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("i")))


def _moran(cross: Column, square: Column, n: Column, total: Column) -> Column:
    return F.try_divide(cross, square) * F.try_divide(n.cast("double"), total)


def morans_i(values: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Moran's I of (code, value) under row-standardised contiguity, for each combination of `by`."""
    by = by or []
    mean = values.groupBy(*by).agg(F.avg("value").alias("_mean"))
    centred = values.join(mean, by) if by else values.crossJoin(F.broadcast(mean))
    z = centred.select(*by, "code", (F.col("value") - F.col("_mean")).alias("z"))
    w = weights(edges)
    other = z.select(*by, F.col("code").alias("j"), F.col("z").alias("zj"))
    crossed = w.join(z.withColumnRenamed("code", "i"), "i").join(other, [*by, "j"])
    over = crossed.groupBy(*by).agg(F.sum(F.col("w") * F.col("z") * F.col("zj")).alias("_cross"), F.sum("w").alias("_w"))
    squares = z.groupBy(*by).agg(F.sum(F.col("z") * F.col("z")).alias("_square"), F.count("*").alias("n"))
    joined = over.join(squares, by) if by else over.crossJoin(squares)
    return joined.select(*by, "n", _moran(F.col("_cross"), F.col("_square"), F.col("n"), F.col("_w")).alias("moran_i"))


def moran_permutation(values: DataFrame, edges: DataFrame, permutations: int = 199, seed: int = 7) -> DataFrame:
    """Two-sided p-value: values are dealt to areas anew in the order of a seeded hash, permutation by permutation."""
    spark = values.sparkSession
    if values.count() > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} areas")
    rounds = spark.range(permutations).select(F.col("id").cast("int").alias("round"))
    ordered = Window.partitionBy("round")
    # A value table is a dimension table: it meets each round once.
    places = values.select("code", F.row_number().over(Window.orderBy("code")).alias("place"))
    dealt = (
        rounds.crossJoin(F.broadcast(values))
        .withColumn("place", F.row_number().over(ordered.orderBy(hash_order(F.lit(seed), F.col("round"), F.col("code")))))
        .select("round", "place", "value")
        .join(places, "place")
        .select("round", "code", "value")
    )
    real = morans_i(values, edges).select(F.col("moran_i").alias("observed"), "n")
    drawn = morans_i(dealt, edges, ["round"]).select("round", F.col("moran_i").alias("drawn"))
    expected = -1.0 / (F.col("n") - 1)
    beyond = F.abs(F.col("drawn") - expected) >= F.abs(F.col("observed") - expected) - 1e-12
    return drawn.crossJoin(F.broadcast(real)).groupBy("observed", "n").agg(
        ((F.sum(beyond.cast("int")) + 1) / (F.count("*") + 1)).alias("p_value"), F.count("*").alias("permutations")
    )
