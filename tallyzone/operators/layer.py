"""Map layer table: padded keys, scope semi-filter, left join, centroids, labels.

The original draws an interactive map; here the result is the table the
map is drawn from, one row per polygon feature (zip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyzone.constants import CITYWIDE
from tallyzone.functions.values import colour_bin, marker_label, pad_zip

LAYER_JOIN_COLUMNS = ["zip_text", "borough", "total_crashes", "rank", "crash_likelihood", "decile"]


def layer_keys(layer: DataFrame) -> DataFrame:
    """Vertex rows keyed by the trimmed text of ``modzcta``."""
    return layer.withColumn("zip_text", F.trim(F.col("modzcta").cast("string")))


def padded_report(report: DataFrame) -> DataFrame:
    """Ranked table with the zip as 5-character zero-padded text."""
    return report.withColumn("zip_text", pad_zip("zip_code"))


def layer_features(layer: DataFrame) -> DataFrame:
    """One row per polygon feature (zip)."""
    return layer_keys(layer).select("zip_text").distinct()


def scope_zips(report: DataFrame, scope: str | None) -> DataFrame:
    """Distinct padded zips of the scope's rows."""
    r = padded_report(report)
    if scope is not None and scope != CITYWIDE:
        r = r.where(F.col("borough") == F.lit(scope))
    return r.select("zip_text").distinct()


def layer_semi(layer: DataFrame, report: DataFrame, scope: str | None) -> DataFrame:
    """Polygons whose zip is among the scope's ranked zips (F16, J5); Citywide keeps all."""
    feats = layer_features(layer)
    if scope is None or scope == CITYWIDE:
        return feats
    return feats.join(scope_zips(report, scope), "zip_text", "left_semi")


def layer_join(layer: DataFrame, report: DataFrame, scope: str | None = None) -> DataFrame:
    """Polygons left-joined with the (scope-filtered) ranked table on the padded zip.

    Polygons without crashes stay with NULLs; zips without a polygon vanish.
    """
    r = padded_report(report)
    if scope is not None and scope != CITYWIDE:
        r = r.where(F.col("borough") == F.lit(scope))
    feats = layer_semi(layer, report, scope)
    return feats.join(r.drop("zip_code"), "zip_text", "left").select(*LAYER_JOIN_COLUMNS)


# Vertices of one ring that a task sorts together.
RING_RANGE = 1 << 16
_RING = ["zip_text", "part", "ring"]


def _range_sums(layer: DataFrame, size: int) -> DataFrame:
    """Shoelace sums of each range of ``size`` seq numbers of a ring, taken from the range's first vertex."""
    chunk = [*_RING, "range"]
    along = Window.partitionBy(*chunk).orderBy("seq")
    v = layer_keys(layer).select(*_RING, F.floor(F.col("seq") / size).alias("range"), "seq", "x", "y").withColumns({
        "bx": F.first("x").over(along), "by": F.first("y").over(along),
        "nx": F.lead("x").over(along), "ny": F.lead("y").over(along)})
    u, w, u2, w2 = (F.col(c) - F.col(b) for c, b in (("x", "bx"), ("y", "by"), ("nx", "bx"), ("ny", "by")))
    cross = u * w2 - u2 * w
    return v.groupBy(*chunk).agg(
        F.min("bx").alias("fx"), F.min("by").alias("fy"), F.max_by("x", "seq").alias("lx"), F.max_by("y", "seq").alias("ly"),
        *(F.coalesce(F.sum(e), F.lit(0.0)).alias(n) for n, e in (
            ("s", cross), ("sx", (u + u2) * cross), ("sy", (w + w2) * cross), ("xx", (u + u2) * (u2 - u)),
            ("xy", (u + u2) * (w2 - w)), ("yx", (w + w2) * (u2 - u)), ("yy", (w + w2) * (w2 - w)))))


def layer_centroid(layer: DataFrame, size: int = RING_RANGE) -> DataFrame:
    """Area-weighted centroid per zip (A12): exterior rings count +, holes -, parts add up.

    A ring, whatever its first ``seq``, is cut into ranges of ``size`` seq
    numbers, each summed in one task from its own first vertex. The vertices
    are shuffled once. One row per range then goes on: its sums are moved to
    the ring's first vertex, and the edge to the next range is added. Sums
    taken near the ring keep their digits when it is small and far from the
    origin.
    """
    along = Window.partitionBy(*_RING).orderBy("range")
    r = _range_sums(layer, size).withColumns({
        "ox": F.first("fx").over(along), "oy": F.first("fy").over(along),
        "nx": F.lead("fx").over(along), "ny": F.lead("fy").over(along)})
    dx, dy = F.col("fx") - F.col("ox"), F.col("fy") - F.col("oy")
    # what an edge's cross product gains when its origin moves by (-dx, -dy), summed over the range
    gain = dx * (F.col("ly") - F.col("fy")) - dy * (F.col("lx") - F.col("fx"))
    moved = {"s": F.col("s") + gain,
             "sx": F.col("sx") + 2 * dx * F.col("s") + dx * F.col("xy") - dy * F.col("xx") + 2 * dx * gain,
             "sy": F.col("sy") + 2 * dy * F.col("s") + dx * F.col("yy") - dy * F.col("yx") + 2 * dy * gain}
    ax, ay, bx, by = (F.col(c) - F.col(o) for c, o in (("lx", "ox"), ("ly", "oy"), ("nx", "ox"), ("ny", "oy")))
    edge = ax * by - bx * ay  # to the next range; null after the last
    bridge = {"s": edge, "sx": (ax + bx) * edge, "sy": (ay + by) * edge}
    rings = (
        r.groupBy(*_RING)
        .agg(F.first("ox").alias("bx"), F.first("oy").alias("by"),
             *(F.sum(moved[c] + F.coalesce(bridge[c], F.lit(0.0))).alias(c) for c in ("s", "sx", "sy")))
        .where(F.col("s") != 0)
    )
    sign = F.when(F.col("ring") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    area = sign * F.abs(F.col("s")) / 2.0
    weighted = rings.select(
        "zip_text",
        area.alias("a"),
        (area * (F.col("bx") + F.col("sx") / (F.col("s") * 3.0))).alias("ax"),
        (area * (F.col("by") + F.col("sy") / (F.col("s") * 3.0))).alias("ay"),
    )
    return weighted.groupBy("zip_text").agg((F.sum("ax") / F.sum("a")).alias("centroid_x"),
                                            (F.sum("ay") / F.sum("a")).alias("centroid_y"))


def layer_table(layer: DataFrame, report: DataFrame, scope: str | None = None) -> DataFrame:
    """E5: per polygon the ranked values, centroid (marker position), label and colour bin."""
    joined = layer_join(layer, report, scope)
    if scope is not None and scope != CITYWIDE:  # only the scope's polygons
        layer = layer_keys(layer).join(scope_zips(report, scope), "zip_text", "left_semi").drop("zip_text")
    cent = layer_centroid(layer)
    return (
        joined.join(cent, "zip_text", "left")
        .select(
            "zip_text", "borough", "total_crashes", "rank", "decile",
            "centroid_x", "centroid_y",
            marker_label("zip_text", "total_crashes", "decile", "rank").alias("label"),
            colour_bin("decile").alias("colour_bin"),
        )
    )
