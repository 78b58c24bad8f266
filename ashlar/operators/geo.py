"""Planar hexagon cells and polygons, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut, spread


def hex_cells(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """df with the axial coordinates q and r of the pointy-top hexagon of that size around each point."""
    near = lambda c: F.floor(F.col(c) + 0.5)
    out = df.withColumns({"_q": (x * 0.5773502691896258 - y / 3.0) / size, "_r": y * 2.0 / 3.0 / size}).withColumn("_s", -F.col("_q") - F.col("_r"))
    out = out.withColumns({"_a": near("_q"), "_b": near("_r"), "_c": near("_s")})
    off = {n: F.abs(F.col(a) - F.col(b)) for n, a, b in (("q", "_a", "_q"), ("r", "_b", "_r"), ("s", "_c", "_s"))}
    # the coordinate that rounding moved most follows from the others
    q = F.when((off["q"] > off["r"]) & (off["q"] > off["s"]), -F.col("_b") - F.col("_c")).otherwise(F.col("_a"))
    r = F.when(~((off["q"] > off["r"]) & (off["q"] > off["s"])) & (off["r"] > off["s"]), -F.col("_a") - F.col("_c")).otherwise(F.col("_b"))
    return out.withColumns({"q": q.cast("long"), "r": r.cast("long")}).drop("_q", "_r", "_s", "_a", "_b", "_c")


def smooth(cells: DataFrame, k: int, value: str) -> DataFrame:
    """q, r and each cell's value spread evenly over the cells at most k steps away."""
    disk = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i + j) <= k]
    to = F.array(*(F.struct((F.col("q") + i).alias("q"), (F.col("r") + j).alias("r")) for i, j in disk))
    spread = cells.select(F.col(value), F.explode(to).alias("c"))
    return spread.groupBy("c.q", "c.r").agg((F.sum(value) / len(disk)).alias(value))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside the ring: an odd number of its edges cross the ray to the right."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossed = crossed + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
    return crossed % 2 == 1


#: The width of a hexagon of size 1, between opposite sides.
WIDTH = 1.7320508075688772


def centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    """x and y of a hexagon's centre."""
    return size * WIDTH * (q + r / 2.0), size * 1.5 * r


def edges(polygons: DataFrame, id_col: str, rings: str) -> DataFrame:
    """id_col, x1, y1, x2, y2: the sides of every ring (array of x, y), the last point joined to the first. Rings with a null point or coordinate have none."""
    whole = polygons.select(id_col, F.explode(rings).alias("_g")).where(F.forall("_g", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    sides = F.arrays_zip(F.col("_g").alias("a"), F.concat(F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(0))), F.slice("_g", 1, 1)).alias("b"))
    each = whole.where(F.size("_g") > 1).select(id_col, F.explode(sides).alias("_s"))
    return each.select(id_col, F.col("_s.a.x").alias("x1"), F.col("_s.a.y").alias("y1"), F.col("_s.b.x").alias("x2"), F.col("_s.b.y").alias("y2"))


def _crossing(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Whether a side crosses the height y, and where."""
    return (y1 > y) != (y2 > y), x1 + (y - y1) * ((x2 - x1) / (y2 - y1))


def _rows_of(sides: DataFrame, size: float, margin: float) -> DataFrame:
    """Each side once for every row of hexagons whose centres are within margin of its heights, and perhaps for the next ones."""
    row = lambda y, up: (F.ceil if up else F.floor)((y + (margin if up else -margin)) / (size * 1.5))
    return sides.withColumn("r", F.explode(F.sequence(row(F.least("y1", "y2"), False), row(F.greatest("y1", "y2"), True))))


def polyfill(polygons: DataFrame, id_col: str, rings: str, size: float) -> DataFrame:
    """id_col, q, r: the hexagons whose centres lie in the polygon, by the even-odd rule over all its rings, so that rings inside others are holes.

    Sides are dealt to the rows of hexagons that they cross; in each row the
    crossings, sorted, bound the runs of centres inside. Work goes with the
    polygons' outlines and the cells that come out.
    """
    sides = _rows_of(edges(polygons, id_col, rings), size, 0.0)
    crosses, at = _crossing(size * 1.5 * F.col("r"), *map(F.col, ("x1", "y1", "x2", "y2")))
    found = sides.where(crosses).select(id_col, "r", at.alias("_at"))
    order = Window.partitionBy(id_col, "r").orderBy("_at")
    runs = found.withColumns({"_i": F.row_number().over(order), "_to": F.lead("_at").over(order)}).where("_i % 2 = 1 and _at < _to")
    q_of = lambda x: x / (size * WIDTH) - F.col("r") / 2.0
    cells = runs.withColumn("q", F.explode(F.sequence(F.floor(q_of(F.col("_at"))), F.ceil(q_of(F.col("_to"))))))
    x = centre(F.col("q"), F.col("r"), size)[0]
    return cells.where((x >= F.col("_at")) & (x < F.col("_to"))).select(id_col, "q", "r")


def cover(polygons: DataFrame, id_col: str, rings: str, size: float) -> DataFrame:
    """id_col, q, r, whole: the hexagons that may hold points of the polygon; whole: no side comes near the cell, and it lies inside."""
    sides = _rows_of(edges(polygons, id_col, rings), size, size)
    middle = size * 1.5 * F.col("r")
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    clipped = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + (F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")) * slope)
    low, high = clipped(middle - size), clipped(middle + size)
    first, last = (F.coalesce(f(low, high), f("x1", "x2")) for f in (F.least, F.greatest))  # of the part of the side in this row
    q_of = lambda x: x / (size * WIDTH) - F.col("r") / 2.0
    border = sides.withColumn("q", F.explode(F.sequence(F.floor(q_of(first)) - 1, F.ceil(q_of(last)) + 1))).select(id_col, "q", "r").distinct()
    inner = polyfill(polygons, id_col, rings, size).join(border.hint("merge"), [id_col, "q", "r"], "left_anti")
    return border.withColumn("whole", F.lit(False)).unionByName(inner.withColumn("whole", F.lit(True)))


#: Ids of polygons in one list, and points that meet the lists of their place in one task, at least.
LIST, TURN = 1_000, 50_000

#: So many places at most are sent to all tasks.
FEW_PLACES = 50_000


def in_polygons(points: DataFrame, x: str, y: str, polygons: DataFrame, id_col: str, rings: str, size: float) -> DataFrame:
    """points with the id_col of each polygon that contains them, holes left out; points on a side belong to one of its two sides by the even-odd rule.

    Points meet polygons by cell; only in cells near a side the ray test is
    made, against the sides of that polygon which reach the point's row of
    cells. Points of one place are tested once, and so are polygons of one shape; at
    the end points take the polygons of their place, which lie in lists of about LIST
    ids. A place of many points is dealt to several tasks. Points or polygons with nulls
    have no pairs. Choose size so that a polygon has tens to thousands of cells.
    Columns of points are kept as they are; they must not be named like id_col.

    Rows of points, polygons and cells are joined by sorting: Spark's estimates of
    their sizes miss what explode and compression hide, so it might broadcast them.
    """
    rows = points.select(F.struct(*points.columns).alias("_p"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    places = cut(rows.groupBy("_x", "_y").agg(F.count("*").alias("_n")), "places")
    n_places, n_points = places.agg(F.count("*"), F.sum("_n")).first()
    shapes, members = _shapes(polygons, id_col, rings)

    placed = hex_cells(places, F.col("_x"), F.col("_y"), size)
    met = cover(shapes, "_shape", "_g", size).join(F.broadcast(placed) if n_places <= FEW_PLACES else placed.hint("merge"), ["q", "r"])
    near = _rows_of(edges(shapes, "_shape", "_g"), size, size).groupBy("_shape", "r").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_sides"))  # sides of one shape in one row

    def odd(sides: Column) -> Column:
        def step(n: Column, s: Column) -> Column:
            crosses, at = _crossing(F.col("_y"), s["x1"], s["y1"], s["x2"], s["y2"])
            return n + F.when(crosses & (F.col("_x") < at), 1).otherwise(0)

        return F.aggregate(sides, F.lit(0), step) % 2 == 1

    near = near.select(F.col("_shape").alias("_of"), F.col("r").alias("_row"), "_sides")
    tested = met.join(near.hint("merge"), (F.col("_shape") == F.col("_of")) & (F.col("r") == F.col("_row")) & ~F.col("whole"), "left")
    inside = cut(tested.where(F.col("whole") | odd(F.col("_sides"))).select("_x", "_y", "_n", "_shape"), "inside")

    pairs = inside.join(members.hint("merge"), "_shape")
    lists = pairs.groupBy("_x", "_y").agg(F.ceil(F.count("*") / LIST).alias("_lists"))
    pairs = pairs.join(lists.hint("merge"), ["_x", "_y"]).withColumn("_list", F.expr("pmod(xxhash64(_id), _lists)"))
    listed = pairs.groupBy("_x", "_y", "_n", "_list").agg(F.collect_list("_id").alias("_ids"))
    turn = max(TURN, -(-(n_points or 0) // 1000))  # at most 1,000 places have more points
    turns = F.ceil(F.col("_n") / turn)
    hot = places.where(F.col("_n") > turn).select("_x", "_y", turns.alias("_turns"))
    known = F.xxhash64(*(F.col("_p").getField(f.name) for f in points.schema if "map<" not in f.dataType.simpleString()))
    dealt = rows.join(F.broadcast(hot), ["_x", "_y"], "left").withColumn("_turn", F.coalesce(F.pmod(known, F.col("_turns")), F.lit(0)))
    listed = listed.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)))
    return dealt.join(listed.hint("merge"), ["_x", "_y", "_turn"]).select("_p.*", F.explode("_ids").alias(id_col))


def _shapes(polygons: DataFrame, id_col: str, rings: str) -> tuple[DataFrame, DataFrame]:
    """(_shape, _g: each shape once, by the smallest id of its polygons, and its rings; _shape, _id: every polygon's shape). Rings of one id are one polygon's."""
    plain = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    whole = polygons.select(F.col(id_col).alias("_id"), plain.alias("_g")).where("_id is not null").groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_g"))).alias("_g"))
    whole = cut(whole, "polygons")
    first = whole.groupBy("_g").agg(F.min("_id").alias("_shape"))
    whole = cut(whole.join(first.hint("merge"), "_g"), "shapes")
    return spread(whole.where("_id = _shape").select("_shape", "_g"), "_shape"), whole.select("_shape", "_id")
