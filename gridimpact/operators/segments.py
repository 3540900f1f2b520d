"""The nearest line segment of each point, by a packed tree of boxes whose distance bounds are refined level by level.

Segments are put in order along a space-filling curve, and every `LEAF` of them in order are a leaf, every `FAN` leaves a node, and so on to one root
for each group. So all nodes hold as many segments, wherever these lie. A node knows the box of its segments and one of them: nothing in it is
nearer to a point than the box, and that one segment is no nearer than the nearest of all. Points go down from the root; at each level they keep
the nodes whose box is not beyond the nearest segment seen. Few nodes are left for each point, so no product of points and
segments is ever formed. Levels are broadcast while they have few nodes, and joined by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.sources.tables import settled

#: Segments of a leaf, and nodes below a node.
LEAF, FAN = 8, 16
#: Nodes of a level up to which it is broadcast.
BROADCAST_NODES = 50_000
ENDS = ("x1", "y1", "x2", "y2")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def curve_place(x: Column, y: Column, box: Sequence[float], bits: int = 31) -> Column:
    """The place along the curve that takes one bit of each coordinate in turn."""
    low_x, low_y, high_x, high_y = box
    top = (1 << bits) - 1

    def spread(v: Column, low: float, high: float) -> Column:
        n = F.floor((v - low) / max(high - low, 1e-300) * top).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return n

    return spread(x, low_x, high_x).bitwiseOR(F.shiftleft(spread(y, low_y, high_y), 1))


def in_order(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """segments with their rank in their group along the curve: ranges are sorted side by side and counted, so no group is in one task."""
    box = segments.agg(*(f((F.col(f"{c}1") + F.col(f"{c}2")) / 2) for f in (F.min, F.max) for c in "xy")).first()
    middle = curve_place((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, box)
    keyed = segments.withColumns({"_z": middle, "_u": F.xxhash64(*ENDS)})
    order = [*by, "_z", "_u"]
    ranges = settled(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "segments")
    before, counts = 0, {}
    for part, n in sorted((r["_part"], r["count"]) for r in ranges.groupBy("_part").count().collect()):  # a row for each range
        counts[part], before = before, before + n
    offset = F.create_map(*chain.from_iterable((F.lit(p), F.lit(n)) for p, n in counts.items()))[F.col("_part")]
    ranked = ranges.withColumn("_rank", offset + F.row_number().over(Window.partitionBy("_part").orderBy(*order, *ENDS)) - 1)
    first = ranked.groupBy(*by).agg(F.min("_rank").alias("_first"))
    return ranked.join(F.broadcast(first) if first.count() <= BROADCAST_NODES else first, list(by)).withColumn("_rank", F.col("_rank") - F.col("_first")).drop("_first", "_z", "_u", "_part")


def nearest_segment(points: DataFrame, segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """points (x, y and `by`, each once) with dist to the nearest of the segments (x1, y1, x2, y2) of the same `by`, and how many were compared.

    Points of a group without segments, and points and segments with missing numbers, drop out.
    """
    keys = [f"_g{i}" for i in range(len(by) + 1)]
    group = lambda df: df.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=False)), F.lit(0).alias(keys[-1]), *(c for c in df.columns if c not in by))
    known = lambda names: " AND ".join(f"{c} IS NOT NULL" for c in names)
    places = group(points.select("x", "y", *by)).where(known(("x", "y"))).distinct()
    lines = group(segments.select(*ENDS, *by)).where(known(ENDS))
    if lines.isEmpty():
        return points.select("x", "y", *by).where(F.lit(False)).withColumns({"dist": F.lit(0.0), "compared": F.lit(0).cast("long")})
    lines = settled(in_order(lines, keys), "segments")
    most = lines.groupBy(*keys).count().agg(F.max("count")).first()[0]

    box = lambda low, high: [F.min(low("x")).alias("bx1"), F.min(low("y")).alias("by1"), F.max(high("x")).alias("bx2"), F.max(high("y")).alias("by2")]
    lines = lines.withColumn("_node", F.floor(F.col("_rank") / LEAF))
    one = F.min_by(F.struct(*ENDS), "_rank").alias("one")
    level = lines.groupBy(*keys, "_node").agg(*box(lambda c: F.least(f"{c}1", f"{c}2"), lambda c: F.greatest(f"{c}1", f"{c}2")), one)
    levels = [settled(level, "nodes")]
    while most > LEAF * FAN ** (len(levels) - 1):
        below = levels[-1].withColumn("_up", F.floor(F.col("_node") / FAN))
        level = below.groupBy(*keys, F.col("_up").alias("_node")).agg(*box(lambda c: F.col(f"b{c}1"), lambda c: F.col(f"b{c}2")), F.min_by("one", below["_node"]).alias("one"))
        levels.append(settled(level, "nodes"))

    away = lambda c: F.greatest(F.col(f"b{c}1") - F.col(c), F.col(c) - F.col(f"b{c}2"), F.lit(0.0))
    open_ = settled(places.withColumn("_at", F.lit(0).cast("long")), "points").repartition(*keys, "x", "y")  # all at the root of their group
    each = Window.partitionBy(*keys, "x", "y")
    for nodes in reversed(levels[:-1]):
        small = nodes.count() <= BROADCAST_NODES
        below = nodes.withColumn("_at", F.floor(F.col("_node") / FAN))
        pairs = open_.join(F.broadcast(below) if small else below, [*keys, "_at"])
        bound = segment_distance(F.col("x"), F.col("y"), *(F.col(f"one.{c}") for c in ENDS))
        pairs = pairs.withColumns({"_least": F.sqrt(F.pow(away("x"), 2) + F.pow(away("y"), 2)), "_most": F.min(bound).over(each)})
        open_ = pairs.where(F.col("_least") <= F.col("_most") * (1 + 1e-12)).select(*keys, "x", "y", F.col("_node").alias("_at"))
    small = most <= BROADCAST_NODES and lines.count() <= BROADCAST_NODES
    pairs = open_.join((F.broadcast(lines) if small else lines).withColumnRenamed("_node", "_at"), [*keys, "_at"])
    d = segment_distance(*(F.col(c) for c in ("x", "y", *ENDS)))
    found = pairs.groupBy(*keys, "x", "y").agg(F.min(d).alias("dist"), F.count(F.lit(1)).alias("compared"))
    return found.select("x", "y", *(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), "dist", "compared")
