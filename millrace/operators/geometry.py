"""Polygons: which are valid, and which touch, by exact predicates over a grid join of their edges.

Vertices are whole numbers (fixed-point coordinates, see fixed_point()), so the sign of
every cross product is exact in 64 bits. Edges are dealt to the cells of a grid that they
pass, and only edges that share a cell meet: an equi-join, never a loop over pairs.

Rings are (code, part, ring, position, x, y), closed (the last vertex repeats the first);
ring 0 of a part is its shell, the others are holes. Their direction does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import staged

#: Coordinates reach this far at most, so that cross products fit in 64 bits.
REACH = 1 << 29
_RING = ["code", "part", "ring"]


def fixed_point(vertices: DataFrame, decimals: int = 6) -> DataFrame:
    """Coordinates as whole multiples of 10 ** -decimals; an error where one is null, not finite, or out of reach."""
    whole = lambda c: F.round(F.col(c).cast("double") * float(10**decimals)).cast("long")
    fine = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) * float(10**decimals) <= REACH, F.lit(False))
    checked = lambda c: F.when(fine(c), whole(c)).otherwise(F.raise_error(F.lit(f"a coordinate is out of reach: {c}")).cast("long"))
    part = F.col("part") if "part" in vertices.columns else F.lit(0)
    return vertices.select("code", part.alias("part"), "ring", "position", checked("x").alias("x"), checked("y").alias("y"))


def turn(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column]) -> Column:
    """The sign of the turn from a over b to c: 1 left, -1 right, 0 on one line."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("int")


def edges(rings: DataFrame) -> DataFrame:
    """(code, part, ring, n, i, ax, ay, bx, by): the i-th of a ring's n edges, without those of no length, all with the ring's area to one side.

    Shells run anticlockwise and holes clockwise, so the polygon is on the left of each edge.
    A ring is one window; its size is that of one polygon.
    """
    order = Window.partitionBy(*_RING).orderBy("position")
    steps = rings.select(*_RING, "position", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"))
    steps = steps.where("bx IS NOT NULL AND (ax <> bx OR ay <> by)")
    ring = Window.partitionBy(*_RING)
    turned = F.sum((F.col("ax").cast("decimal(38,0)") * F.col("by") - F.col("bx").cast("decimal(38,0)") * F.col("ay")).cast("decimal(38,0)")).over(ring)
    counted = steps.withColumns({"_area": turned, "n": F.count("*").over(ring), "i": F.row_number().over(Window.partitionBy(*_RING).orderBy("position")) - 1})
    keep = (F.col("_area") > 0) == (F.col("ring") == 0)
    return counted.select(
        *_RING, "n", F.when(keep, F.col("i")).otherwise(F.col("n") - 1 - F.col("i")).alias("i"),
        *[F.when(keep, F.col(c)).otherwise(F.col(d)).alias(c) for c, d in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))],
        F.col("_area").alias("doubled_area"),
    )


def celled(lines: DataFrame, size: int) -> DataFrame:
    """Adds the cells (gx, gy) of a grid that each edge passes: column by column, the rows between its ends there."""
    cell = lambda c: F.floor(c / F.lit(float(size))).cast("long")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    columns = lines.withColumn("gx", F.explode(F.sequence(cell(F.least(ax, bx)), cell(F.greatest(ax, bx)))))
    # The edge's height where it enters and leaves the column, a unit further to be safe from rounding.
    at = lambda x: ay + (by - ay) * F.try_divide((x - ax).cast("double"), (bx - ax).cast("double"))
    left, right = F.greatest(F.col("gx") * size, F.least(ax, bx)), F.least((F.col("gx") + 1) * size, F.greatest(ax, bx))
    ends = [F.coalesce(at(left), F.least(ay, by).cast("double")), F.coalesce(at(right), F.greatest(ay, by).cast("double"))]
    low = F.greatest(F.least(*ends) - 1, F.least(ay, by).cast("double"))
    high = F.least(F.greatest(*ends) + 1, F.greatest(ay, by).cast("double"))
    return columns.withColumn("gy", F.explode(F.sequence(cell(low), cell(high))))


def cell_size(lines: DataFrame) -> int:
    """The mean extent of an edge: an edge then passes a few cells, and a cell holds a few edges."""
    extent = F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")))
    return max(1, int(lines.agg(F.avg(extent)).first()[0] or 1))


def _point(prefix: str, end: str) -> tuple[Column, Column]:
    return F.col(f"{prefix}{end}x"), F.col(f"{prefix}{end}y")


def meetings(lines: DataFrame, same: bool) -> DataFrame:
    """Pairs of edges that share a point, of one polygon (same) or of two with p_code < q_code; columns p_* and q_*, crosses, overlaps.

    crosses: each has its ends on different sides of the other. overlaps: they share more than a point.
    """
    size = cell_size(lines)
    columns = [c for c in lines.columns if c != "doubled_area"]
    placed = celled(lines, size)
    side = lambda k: placed.select("gx", "gy", *[F.col(c).alias(f"{k}_{c}") for c in columns])
    p, q = side("p"), side("q")
    on = ["gx", "gy"]
    if same:
        p = p.withColumn("_code", F.col("p_code"))
        q = q.withColumn("_code", F.col("q_code"))
        order = lambda k: F.struct(f"{k}_part", f"{k}_ring", f"{k}_i")
        met = p.join(q, [*on, "_code"]).where(order("p") < order("q"))
    else:
        met = p.join(q, on).where(F.col("p_code") < F.col("q_code"))
    a, b, c, d = _point("p_", "a"), _point("p_", "b"), _point("q_", "a"), _point("q_", "b")
    apart = F.lit(False)
    for i in (0, 1):
        apart = apart | (F.greatest(a[i], b[i]) < F.least(c[i], d[i])) | (F.greatest(c[i], d[i]) < F.least(a[i], b[i]))
    turned = met.where(~apart).withColumns({"_c": turn(a, b, c), "_d": turn(a, b, d), "_a": turn(c, d, a), "_b": turn(c, d, b)})
    met = turned.where("_c * _d <= 0 AND _a * _b <= 0")
    line = (F.col("_c") == 0) & (F.col("_d") == 0)
    shared = [F.least(F.greatest(a[i], b[i]), F.greatest(c[i], d[i])) - F.greatest(F.least(a[i], b[i]), F.least(c[i], d[i])) for i in (0, 1)]
    made = met.withColumns({
        "crosses": (F.col("_c") * F.col("_d") < 0) & (F.col("_a") * F.col("_b") < 0),
        "overlaps": line & (F.greatest(*shared) > 0),
    })
    names = [f"{k}_{c}" for k in "pq" for c in columns]
    return made.select(*names, "crosses", "overlaps").distinct()  # an edge pair may share several cells


def _within(points: DataFrame, shells: DataFrame, key: list[str]) -> DataFrame:
    """Adds `inside` to points (key, id, px, py): whether an odd number of edges of the same key is passed on the way to the right.

    Points and edges are doubled coordinates, so that middles of edges are whole numbers too.
    """
    ax, ay, bx, by = (F.col(c) * 2 for c in ("ax", "ay", "bx", "by"))
    px, py = F.col("px"), F.col("py")
    up = (ay <= py) & (py < by)
    down = (by <= py) & (py < ay)
    side = (bx - ax).cast("decimal(20,0)") * (py - ay) - (by - ay).cast("decimal(20,0)") * (px - ax)
    passed = (up & (side > 0)) | (down & (side < 0))
    odd = points.join(shells, key).where(passed).groupBy("id").agg((F.count("*") % 2 == 1).alias("_odd"))
    return points.join(odd, "id", "left").withColumn("inside", F.coalesce("_odd", F.lit(False))).drop("_odd")


def invalid(rings: DataFrame) -> DataFrame:
    """(code, reason) of polygons that are not valid; a code may have several reasons.

    open_ring: the last vertex is not the first. collapsed: a ring of no area, or of fewer than
    three edges. self_crossing: two edges of a ring share more than what neighbours share.
    rings_cross: edges of two rings cross or lie on each other. hole_outside: a hole is not in
    its shell. Not looked for: interiors that holes cut in two at single points.
    """
    order = F.struct("position", "x", "y")
    ends = rings.groupBy(*_RING).agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.count("*").alias("_n"))
    opened = ends.where("_n < 2 OR _a.x <> _b.x OR _a.y <> _b.y").select("code", F.lit("open_ring").alias("reason"))
    lines = staged(edges(rings), "edges")
    flat = lines.where("n < 3 OR doubled_area = 0").select("code", F.lit("collapsed").alias("reason"))
    none = ends.join(lines.select(*_RING).distinct(), _RING, "left_anti").select("code", F.lit("collapsed").alias("reason"))
    met = staged(meetings(lines, same=True), "meetings")
    one = (F.col("p_part") == F.col("q_part")) & (F.col("p_ring") == F.col("q_ring"))
    gap = F.col("q_i") - F.col("p_i")
    beside = (gap == 1) | (gap == F.col("p_n") - 1)
    # Neighbours share one vertex; a triangle's edges are all neighbours.
    crossing = met.where(one & (F.col("crosses") | F.col("overlaps") | ~beside)).select(F.col("p_code").alias("code"), F.lit("self_crossing").alias("reason"))
    between = met.where(~one & (F.col("crosses") | F.col("overlaps"))).select(F.col("p_code").alias("code"), F.lit("rings_cross").alias("reason"))
    # A hole that crosses nothing is inside its shell if the middle of one of its edges is.
    middle = lines.where("ring > 0 AND i = 0").select(
        "code", "part", F.concat_ws("|", *_RING).alias("id"), (F.col("ax") + F.col("bx")).alias("px"), (F.col("ay") + F.col("by")).alias("py")
    )
    shells = lines.where("ring = 0").select("code", "part", "ax", "ay", "bx", "by")
    outside = _within(middle, shells, ["code", "part"]).where(~F.col("inside")).select("code", F.lit("hole_outside").alias("reason"))
    found = opened
    for more in (flat, none, crossing, between, outside):
        found = found.unionByName(more)
    return found.distinct()


def _strictly_inside(d: tuple[Column, Column], n: tuple[Column, Column], p: tuple[Column, Column]) -> Column:
    """Whether direction d is between n and p, going anticlockwise from n, and along neither."""
    cross = lambda u, v: u[0] * v[1] - u[1] * v[0]
    whole = cross(n, p)
    within = (cross(n, d) > 0) & (cross(d, p) > 0)
    beyond = (cross(p, d) >= 0) & (cross(d, n) >= 0)
    return F.when(whole > 0, within).when(whole < 0, ~beyond).otherwise(cross(n, d) > 0)


def contacts(rings: DataFrame) -> DataFrame:
    """(a, b, overlap) of polygons a < b whose boundaries share a point; overlap: their interiors do so too.

    Where boundaries meet and do not cross, one of the two has a vertex. There, each polygon's
    interior is the angle from its way on to its way back; the interiors overlap if the
    angles do. A part that meets no edge of the other polygon may still lie inside it; that
    is decided by one of its vertices, for polygons of several parts.
    """
    lines = staged(edges(rings), "edges")
    met = staged(meetings(lines, same=False), "meetings")
    pairs = met.groupBy(F.col("p_code").alias("a"), F.col("q_code").alias("b")).agg(F.max("crosses").alias("_cross"))

    # At each end of an edge that lies on the other polygon: the ways on and back of both.
    ways = []
    for own, other in (("p", "q"), ("q", "p")):
        vertex = _point(f"{own}_", "a")
        on = (turn(_point(f"{other}_", "a"), _point(f"{other}_", "b"), vertex) == 0)
        for i in (0, 1):
            s, t = _point(f"{other}_", "a")[i], _point(f"{other}_", "b")[i]
            on = on & (vertex[i] >= F.least(s, t)) & (vertex[i] <= F.greatest(s, t))
        ways.append(met.where(on).select("p_code", "q_code", vertex[0].alias("vx"), vertex[1].alias("vy")))
    spots = ways[0].union(ways[1]).distinct()

    def at(code: str) -> DataFrame:
        """For each spot, the directions in which a polygon's boundary leaves it: on (n) and back (p)."""
        k = code[0]
        touched = met.select("p_code", "q_code", *[F.col(f"{k}_{c}").alias(c) for c in ("part", "ring", "n", "i", "ax", "ay", "bx", "by")]).distinct()
        near = spots.join(touched, ["p_code", "q_code"])
        v, a, b = (F.col("vx"), F.col("vy")), (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
        on = turn(a, b, v) == 0
        for i in (0, 1):
            on = on & (v[i] >= F.least(a[i], b[i])) & (v[i] <= F.greatest(a[i], b[i]))
        starts, ends = (a[0] == v[0]) & (a[1] == v[1]), (b[0] == v[0]) & (b[1] == v[1])
        on_way = F.when(~ends, F.struct((b[0] - v[0]).alias("x"), (b[1] - v[1]).alias("y")))
        back = F.when(~starts, F.struct((a[0] - v[0]).alias("x"), (a[1] - v[1]).alias("y")))
        corner = F.when(starts, F.col("i")).when(ends, (F.col("i") + 1) % F.col("n")).otherwise(-1 - F.col("i"))  # the place in the ring
        return near.where(on).groupBy("p_code", "q_code", "vx", "vy", "part", "ring", corner.alias("_corner")).agg(
            F.max(on_way).alias("on"), F.max(back).alias("back")
        ).where("on IS NOT NULL AND back IS NOT NULL").select("p_code", "q_code", "vx", "vy", F.col("on").alias(f"{k}_on"), F.col("back").alias(f"{k}_back"))

    both = at("p_code").join(at("q_code"), ["p_code", "q_code", "vx", "vy"])
    way = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"))
    pn, pb, qn, qb = way("p_on"), way("p_back"), way("q_on"), way("q_back")
    along = (pn[0] * qn[1] - pn[1] * qn[0] == 0) & (pn[0] * qn[0] + pn[1] * qn[1] > 0)
    angles = both.groupBy(F.col("p_code").alias("a"), F.col("q_code").alias("b")).agg(
        F.max(_strictly_inside(pn, qn, qb) | _strictly_inside(qn, pn, pb) | along).alias("_angle")
    )
    joined = pairs.join(angles, ["a", "b"], "left")

    # Parts of a polygon of several parts that may lie in the other without meeting its boundary.
    several = lines.groupBy("code").agg(F.countDistinct("part").alias("_parts")).where("_parts > 1")
    first = lines.where("ring = 0 AND i = 0").join(several, "code", "left_semi")
    either = pairs.select("a", "b", F.col("a").alias("code"), F.col("b").alias("other")).union(pairs.select("a", "b", F.col("b").alias("code"), F.col("a").alias("other")))
    probes = either.join(first, "code").select("a", "b", F.col("other").alias("_within"), F.concat_ws("|", "a", "b", "code", "part").alias("id"), (F.col("ax") * 2).alias("px"), (F.col("ay") * 2).alias("py"), F.col("ax").alias("vx"), F.col("ay").alias("vy"))
    free = probes.join(spots.select(F.col("p_code").alias("a"), F.col("q_code").alias("b"), "vx", "vy"), ["a", "b", "vx", "vy"], "left_anti")
    lone = _within(free, lines.select(F.col("code").alias("_within"), "ax", "ay", "bx", "by"), ["_within"]).groupBy("a", "b").agg(F.max("inside").alias("_lone"))
    return joined.join(lone, ["a", "b"], "left").select(
        "a", "b", (F.coalesce("_cross", F.lit(False)) | F.coalesce("_angle", F.lit(False)) | F.coalesce("_lone", F.lit(False))).alias("overlap")
    )


def touching(rings: DataFrame) -> DataFrame:
    """Pairs a < b of valid polygons whose boundaries meet and whose interiors do not."""
    return contacts(rings).where(~F.col("overlap")).select("a", "b")
