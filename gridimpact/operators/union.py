"""The union of polygons that may overlap, nest or touch, as an overlay spread over cells.

Edges go to the cells they pass. Two edges of a group meet only in a cell, and are split where they cross, touch or run along each other,
so that afterwards pieces meet only at their ends or are the same. For each piece it is counted, for each shape whose box holds its middle, how many pieces
of that shape lie to one side: an odd number is inside (the even-odd rule), and pieces of the shape that are the same turn that round for
the other side. A piece stays if the union is on one of its sides only. What stays is turned so that the inside is on its left, and stitched into rings.

A cell that lies inside one shape holds nothing of the boundary: edges are not compared there, and pieces whose middle is there are left out. A piece that
reaches into such a cell is inside up to where it is cut outside, so where it is cut in there does not matter. So the work is that of the places where
the boundary may be, however many shapes lie over each other elsewhere.

Ends are rounded to `DIGITS` decimals, so that pieces that meet have equal ends. Nothing pairs all edges of a group: the work is that of edges
that share a cell, and of pieces with those shapes that reach over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.operators.grid import edges_of
from gridimpact.sources.tables import settled

DIGITS = 9
#: How far from a line a point may be and still count as on it, as a share of its length.
NEAR = 1e-11
RINGS = "array<array<struct<x:double,y:double>>>"
#: Cells that a `step` is divided into, and those across a shape when it is asked which of them lie inside it.
FINER, ACROSS = 4, 8


def _passed_rows(edges: DataFrame, step: float | Column, y: str, beside: Column | None = None) -> tuple[DataFrame, Column]:
    """edges with each row of cells that they pass, and the columns that they pass in it; `beside`: how near they count as in a cell."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    more = F.lit(0.0) if beside is None else beside
    rows = edges.withColumn(y, F.explode(F.sequence(F.floor((low - more) / step).cast("long"), F.floor((high + more) / step).cast("long"))))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = lambda v: F.coalesce(F.col("x1") + (F.greatest(low, F.least(high, v)) - F.col("y1")) * slope, F.col("x1"))
    enters, leaves = at(F.col(y) * step - more), at((F.col(y) + 1) * step + more)
    level = F.col("y1") == F.col("y2")
    left, right = F.when(level, F.least("x1", "x2")).otherwise(F.least(enters, leaves)), F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(enters, leaves))
    slack = 1e-9 * step if beside is None else beside
    return rows, F.sequence(F.floor((left - slack) / step).cast("long"), F.floor((right + slack) / step).cast("long"))


def passed_cells(edges: DataFrame, step: float, x: str = "_cx", y: str = "_cy") -> DataFrame:
    """edges (x1, y1, x2, y2) with each cell of a grid that they pass: row by row, the columns between where an edge enters and leaves the row."""
    rows, columns = _passed_rows(edges, step, y)
    return rows.withColumn(x, F.explode(columns))


def covered_cells(edges: DataFrame, keys: list[str], step: float) -> DataFrame:
    """keys, _k, _cx, _cy: cells of the size step * 2^_k that lie wholly inside a shape of the group, of edges (keys, shape, x1, y1, x2, y2).

    A shape is asked at the size at which it is `ACROSS` to twice as many cells wide, so it has some hundred of them at most. A cell is inside if no
    edge of the shape comes near it, and its middle is between an odd and an even crossing of its row.
    """
    wide = F.greatest(*(F.max(F.greatest(f"{c}1", f"{c}2")) - F.min(F.least(f"{c}1", f"{c}2")) for c in "xy"))
    sizes = edges.groupBy(*keys, "shape").agg(F.greatest(F.lit(0), F.floor(F.log2(wide / (ACROSS * step)))).cast("int").alias("_k")).select("shape", "_k")
    sized = edges.join(sizes, "shape").withColumn("_s", step * F.pow(F.lit(2.0), F.col("_k")))
    size = F.col("_s")
    rows, touched = _passed_rows(sized, size, "_cy", 1e-6 * size + 1e-8)
    middle = (F.col("_cy") + 0.5) * size
    crossing = F.when((F.col("y1") > middle) != (F.col("y2") > middle), F.col("x1") + (middle - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    each = rows.select(*keys, "shape", "_k", "_s", "_cy", touched.alias("_t"), crossing.alias("_x"))
    whole = each.groupBy(*keys, "shape", "_k", "_s", "_cy").agg(F.array_sort(F.collect_list("_x")).alias("_xs"), F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_t"))
    between = F.transform(F.sequence(F.lit(0), F.size("_xs") - 2, F.lit(2)), lambda i: F.sequence(F.ceil(F.get("_xs", i) / size - 0.5).cast("long"), F.greatest(F.ceil(F.get("_xs", i) / size - 0.5), F.floor(F.get("_xs", i + 1) / size - 0.5)).cast("long")))
    inside = whole.where("size(_xs) >= 2").select(*keys, "_k", "_s", "_cy", "_xs", F.explode(F.array_except(F.flatten(between), "_t")).alias("_cx"))
    centre = (F.col("_cx") + 0.5) * size
    return inside.where(F.size(F.filter("_xs", lambda v: v < centre)) % 2 == 1).select(*keys, "_k", "_cx", "_cy").distinct()


def uncovered(rows: DataFrame, covered: DataFrame, levels: Sequence[int], keys: list[str]) -> DataFrame:
    """rows (keys, _cx, _cy) without those whose cell is covered at one of the sizes."""
    for k in levels:
        own = covered.where(F.col("_k") == k).select(*keys, F.col("_cx").alias("_kx"), F.col("_cy").alias("_ky"))
        rows = rows.withColumns({f"_k{c}": F.floor(F.col(f"_c{c}") / 2**k).cast("long") for c in "xy"}).join(own, [*keys, "_kx", "_ky"], "left_anti").drop("_kx", "_ky")
    return rows


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def cuts(dealt: DataFrame, keys: list[str]) -> DataFrame:
    """id and px, py: the places inside edges (keys, id, x1, y1, x2, y2, a row for each cell _cx, _cy) where another edge of the group crosses or touches them."""
    ends = ("x1", "y1", "x2", "y2")
    a = dealt.select(*keys, "_cx", "_cy", F.col("id").alias("a"), *(F.col(c).alias(f"a{c}") for c in ends))
    b = dealt.select(*keys, "_cx", "_cy", F.col("id").alias("b"), *(F.col(c).alias(f"b{c}") for c in ends))
    c = F.col
    touch = lambda v: (F.least(f"a{v}1", f"a{v}2") <= F.greatest(f"b{v}1", f"b{v}2") + 1e-9) & (F.least(f"b{v}1", f"b{v}2") <= F.greatest(f"a{v}1", f"a{v}2") + 1e-9)
    pairs = a.join(b, [*keys, "_cx", "_cy"]).where((c("a") < c("b")) & touch("x") & touch("y")).dropDuplicates(["a", "b"])
    adx, ady, bdx, bdy = c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("bx2") - c("bx1"), c("by2") - c("by1")
    ox, oy = c("bx1") - c("ax1"), c("by1") - c("ay1")
    a2, b2 = adx * adx + ady * ady, bdx * bdx + bdy * bdy
    turn = _cross(adx, ady, bdx, bdy)
    parallel = F.abs(turn) <= NEAR * F.sqrt(a2 * b2)
    t, u = _cross(ox, oy, bdx, bdy) / turn, _cross(ox, oy, adx, ady) / turn
    within = lambda v, n: (v >= -1e-9 / F.sqrt(n)) & (v <= 1 + 1e-9 / F.sqrt(n))
    point = lambda x, y: F.struct(F.round(x, DIGITS).alias("px"), F.round(y, DIGITS).alias("py"))
    meets = ~parallel & within(t, a2) & within(u, b2)
    where = point(c("ax1") + t * adx, c("ay1") + t * ady)
    along = parallel & (F.abs(_cross(ox, oy, adx, ady)) <= 1e-9 * F.sqrt(a2))
    # Where edges meet at an end of one, that end is the place, so that its ring stays closed.
    for name in ("ax1", "ax2", "bx1", "bx2"):
        x, y = c(name), c(name.replace("x", "y"))
        near = F.greatest(F.abs(where["px"] - x), F.abs(where["py"] - y)) <= 2e-9
        where = F.when(near, point(x, y)).otherwise(where)
    on = lambda line, x, y: (lambda v, n: within(v, n))((((x - c(f"{line}x1")) * (c(f"{line}x2") - c(f"{line}x1")) + (y - c(f"{line}y1")) * (c(f"{line}y2") - c(f"{line}y1")))) / (a2 if line == "a" else b2), a2 if line == "a" else b2)
    both = [F.when(meets, F.struct(c(k).alias("id"), where.alias("p"))) for k in "ab"]
    for line, other in (("a", "b"), ("b", "a")):
        for k in "12":
            x, y = c(f"{other}x{k}"), c(f"{other}y{k}")
            both.append(F.when(along & on(line, x, y), F.struct(c(line).alias("id"), point(x, y).alias("p"))))
    found = pairs.select(F.explode(F.filter(F.array(*both), lambda s: s.isNotNull())).alias("s"))
    return found.select("s.id", "s.p.*").distinct()


def pieces(edges: DataFrame, dealt: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape and the ends (ax, ay) < (bx, by) of the parts that edges fall into where they share a cell in `dealt`."""
    own = edges.join(cuts(dealt, keys).groupBy("id").agg(F.collect_set(F.struct("px", "py")).alias("_cut")), "id", "left")
    end = lambda k: F.struct(F.col(f"x{k}").alias("px"), F.col(f"y{k}").alias("py"))
    share = lambda p: (p["px"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["py"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    places = F.array_distinct(F.concat(F.array(end(1), end(2)), F.coalesce("_cut", F.array().cast("array<struct<px:double,py:double>>"))))
    placed = F.array_sort(F.transform(places, lambda p: F.struct(share(p).alias("t"), p["px"].alias("px"), p["py"].alias("py"))))
    rows = own.withColumn("_p", placed).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_p") - 2)))
    p, q = F.get("_p", F.col("_i")), F.get("_p", F.col("_i") + 1)
    first, last = F.struct(p["px"].alias("x"), p["py"].alias("y")), F.struct(q["px"].alias("x"), q["py"].alias("y"))
    rows = rows.select(*keys, "shape", F.least(first, last).alias("a"), F.greatest(first, last).alias("b"))
    return rows.select(*keys, "shape", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def union_edges(polygons: DataFrame, by: Sequence[str], step: float = 1.0, rings: str = "rings") -> DataFrame:
    """by and x1, y1, x2, y2 of the boundary of each group's union, the inside on the left; rows with a missing key belong to no group.

    step: the size of the cells, best some times the length of an edge. It has no influence on the result.
    """
    keys = [f"_g{i}" for i in range(len(by) + 1)]
    shapes = polygons.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=False)), F.lit(0).alias(keys[-1]), F.col(rings).alias("_rings"))
    shapes = shapes.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "_rings"])).withColumn("shape", F.xxhash64(*keys, "_rings")).dropDuplicates(["shape"])
    rounded = lambda c: F.round(F.col(c), DIGITS).alias(c)
    edges = edges_of(shapes, [*keys, "shape"], "_rings").select(*keys, "shape", *(rounded(c) for c in ("x1", "y1", "x2", "y2"))).where("x1 <> x2 OR y1 <> y2")
    edges = settled(edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    fine = step / FINER
    covered = settled(covered_cells(edges, keys, fine), "covered")
    levels = sorted(r["_k"] for r in covered.select("_k").distinct().collect())  # the sizes of shapes as powers of two
    dealt = settled(uncovered(passed_cells(edges.select(*keys, "id", "x1", "y1", "x2", "y2"), fine), covered, levels, keys), "dealt")
    parts = settled(pieces(edges, dealt, keys), "pieces")

    ends = ["ax", "ay", "bx", "by"]
    place = {f"_c{c}": F.floor((F.col(f"a{c}") + F.col(f"b{c}")) / 2 / fine).cast("long") for c in "xy"}
    same = uncovered(parts.withColumns(place), covered, levels, keys).groupBy(*keys, *ends, "shape").count().where("count % 2 = 1").groupBy(*keys, *ends).agg(F.collect_set("shape").alias("_same"))  # shapes that share a piece
    middle = same.withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2, "_flat": F.abs(F.col("bx") - F.col("ax")) > F.abs(F.col("by") - F.col("ay"))})
    middle = settled(middle, "middles")

    # Shapes whose box holds a middle, by the cells of their boxes.
    reach = edges.groupBy(*keys, "shape").agg(*(f(g(f"{c}1", f"{c}2")).alias(f"_{c}{k}") for c in "xy" for k, f, g in ((1, F.min, F.least), (2, F.max, F.greatest))))
    span = lambda c, size: F.sequence(F.floor(F.col(f"_{c}1") / size).cast("long"), F.floor(F.col(f"_{c}2") / size).cast("long"))
    boxes = reach.withColumn("_cx", F.explode(span("x", step))).withColumn("_cy", F.explode(span("y", step)))
    cell = {"_cx": F.floor(F.col("mx") / step).cast("long"), "_cy": F.floor(F.col("my") / step).cast("long")}
    held = middle.withColumns(cell).join(boxes, [*keys, "_cx", "_cy"]).where("mx BETWEEN _x1 AND _x2 AND my BETWEEN _y1 AND _y2")
    held = held.select(*keys, *ends, "mx", "my", "_flat", "shape", F.array_contains("_same", F.col("shape")).cast("int").alias("_own"))
    held = held.withColumn("_row", F.floor(F.when(F.col("_flat"), F.col("mx")).otherwise(F.col("my")) / step).cast("long"))

    # Pieces of the shape on a line from the middle to the left, or from that of a flat piece downwards.
    lines = parts.select("shape", *(F.col(c).alias(f"_{c}") for c in ends))
    rows = lambda c, flat: lines.withColumns({"_flat": F.lit(flat), "_row": F.explode(F.sequence(F.floor(F.least(f"_a{c}", f"_b{c}") / step).cast("long"), F.floor(F.greatest(f"_a{c}", f"_b{c}") / step).cast("long")))})
    pairs = held.join(rows("y", False).unionByName(rows("x", True)), ["shape", "_flat", "_row"], "left")

    def beyond(c: str, d: str) -> Column:
        m, n, a1, b1, a2, b2 = (F.col(x) for x in (f"m{c}", f"m{d}", f"_a{c}", f"_b{c}", f"_a{d}", f"_b{d}"))
        return ((a1 > m) != (b1 > m)) & (a2 + (m - a1) * (b2 - a2) / (b1 - a1) < n)

    other = ~((F.col("_ax") == F.col("ax")) & (F.col("_ay") == F.col("ay")) & (F.col("_bx") == F.col("bx")) & (F.col("_by") == F.col("by")))
    crossed = F.coalesce(other & F.when(F.col("_flat"), beyond("x", "y")).otherwise(beyond("y", "x")), F.lit(False))
    inside = pairs.groupBy(*keys, *ends, "_flat", "shape").agg((F.count_if(crossed) % 2).alias("_near"), F.first("_own").alias("_own"))
    sides = inside.groupBy(*keys, *ends, "_flat").agg(F.max("_near").alias("_near"), F.max((F.col("_near") + F.col("_own")) % 2).alias("_far"))  # left or below; right or above
    kept = sides.where("_near <> _far")
    # (ax, ay) is left of (bx, by), or below it. The inside is on the left of: a flat piece to the right if it is above, a steep piece upwards if it is to its left.
    upwards = F.col("by") > F.col("ay")
    forward = F.when(F.col("_flat"), F.col("_far") == 1).otherwise(upwards == (F.col("_near") == 1))
    turned = lambda k: [F.when(forward == (k == 1), F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"{c}{k}") for c in "xy"]
    return kept.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), *turned(1), *turned(2))


def stitched(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and ring: closed rings of directed edges. Where several meet at a place, an edge goes on with the one most to its left."""
    keys = list(by)
    edges = settled(edges.withColumn("id", F.monotonically_increasing_id()), "boundary")
    ahead = edges.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"), (F.col("x2") - F.col("x1")).alias("_nx"), (F.col("y2") - F.col("y1")).alias("_ny"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.atan2(dx * F.col("_ny") - dy * F.col("_nx"), dx * F.col("_nx") + dy * F.col("_ny"))
    best = Window.partitionBy("id").orderBy(F.desc(angle))
    linked = edges.join(ahead, [*keys, "x2", "y2"]).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "next")
    # The smallest number along twice as many edges in each round, until no edge finds a smaller one.
    state, size = settled(linked.withColumn("low", F.least("id", "next")), "rings"), 1
    while True:
        jump = state.select(F.col("id").alias("next"), F.col("next").alias("_to"), F.col("low").alias("_low"))
        found = settled(state.join(jump, "next").select("id", F.col("_to").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("new")), "rings")
        state, size = found.drop("new"), 2 * size
        if not found.where("new").limit(1).count():
            break
    kinds = edges.select(*keys).schema

    def walk(group: pa.Table) -> pa.Table:
        """The edges of one ring in order; a ring is one value of the result."""
        after = dict(zip(group.column("id").to_pylist(), group.column("next").to_pylist(), strict=True))
        at = dict(zip(group.column("id").to_pylist(), zip(group.column("x1").to_pylist(), group.column("y1").to_pylist(), strict=True), strict=True))
        start = k = min(after)
        ring = []
        while True:
            ring.append(dict(zip("xy", at[k], strict=True)))
            k = after[k]
            if k == start or len(ring) > len(after):
                break
        ring.append(ring[0])
        return group.select(keys).slice(0, 1).append_column("ring", pa.array([ring], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    whole = edges.join(state.select("id", "low"), "id").join(linked, "id").select(*keys, "low", "id", "next", "x1", "y1")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "ring array<struct<x:double,y:double>>"])
    return whole.groupBy("low").applyInArrow(walk, schema)


def dissolved(polygons: DataFrame, by: Sequence[str], step: float = 1.0) -> DataFrame:
    """One polygon (rings, by the even-odd rule) for each group: the union of all its parts."""
    rings = stitched(union_edges(polygons, by, step), by)
    return rings.groupBy(*by).agg(F.collect_list("ring").alias("rings"))


def areas(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """area and length of what directed boundary edges enclose."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return edges.groupBy(*by).agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("length"))
