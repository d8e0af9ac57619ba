"""Polygon layer source (S9) as a vertex table.

A layer is ``modzcta string, part int, ring int, seq int, x double, y double``:
one row per vertex, rings closed (last vertex = first), ring 0 the exterior
and rings > 0 holes, ``part`` numbering the pieces of a multi-part shape,
x = longitude and y = latitude in degrees. A vertex table is read with
:func:`read_layer`, a geometry file (GeoJSON, one feature a line) with
:func:`read_geojson`. Shapefile parsing is not part of this library.

:func:`layer_from_customers` derives the test layer from the given
``customer`` table: one square per customer, the first 180 on the zip cells
of the test lattice (the zips used by the test records), the others with
zips that have no records; a hole in every cell of column 7, a second piece
for every cell of row 5, and blank-padded key text in column 3 (the key is
trimmed on read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAYER_SCHEMA = T.StructType([
    T.StructField("modzcta", T.StringType(), True),
    T.StructField("part", T.IntegerType(), True),
    T.StructField("ring", T.IntegerType(), True),
    T.StructField("seq", T.IntegerType(), True),
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
])
LAYER_COLUMNS = [f.name for f in LAYER_SCHEMA.fields]


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYER_SCHEMA).parquet(path).select(*LAYER_COLUMNS)


_LINE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
_POLYGON = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, key: str = "modzcta") -> DataFrame:
    """Polygons and multi-polygons of GeoJSON lines as the vertex table; ``key`` names the property.

    Lines may begin with the record separator of GeoJSON text sequences.
    Other geometries, features without one and lines that are no feature give
    no rows. All parsing is on the JVM; a feature is one line, its vertices
    leave as rows at once.
    """
    line = F.from_json(F.ltrim(F.col("value"), F.lit("\x1e \t")), _LINE)
    features = (spark.read.text(path).select(line.alias("f")).where("f.type = 'Feature'")
                .select(F.col("f.properties")[key].alias("modzcta"), F.col("f.geometry.type").alias("kind"),
                        F.col("f.geometry.coordinates").alias("c")))
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", _POLYGON))) \
        .when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{_POLYGON}>"))
    return (features.select("modzcta", F.posexplode(parts).alias("part", "rings"))
            .select("modzcta", "part", F.posexplode("rings").alias("ring", "points"))
            .select("modzcta", "part", "ring", F.posexplode("points").alias("seq", "p"))
            .select("modzcta", "part", "ring", "seq", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))


def write_geojson(layer: DataFrame, path: str, key: str = "modzcta") -> None:
    """A vertex table as GeoJSON lines, one multi-polygon a line; parts, rings and vertices in their order."""
    def nested(df, by, order, what):
        listed = F.array_sort(F.collect_list(F.struct(order, what)))
        return df.groupBy(*by).agg(F.transform(listed, lambda s: s[what]).alias("c"))

    rings = nested(layer.withColumn("p", F.array("x", "y")), ["modzcta", "part", "ring"], "seq", "p")
    parts = nested(rings, ["modzcta", "part"], "ring", "c")
    features = nested(parts, ["modzcta"], "part", "c")
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("c").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("modzcta").alias(key)).alias("properties"),
                       geometry.alias("geometry"))
    features.select(F.to_json(feature).alias("value")).write.text(path)


def _ring(cells: DataFrame, zip_col: Column, part: int, ring: int,
          x0: Column, y0: Column, x1: Column, y1: Column, clockwise: bool) -> DataFrame:
    # corner order of a closed square ring; counter-clockwise for exteriors
    corners = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)] if clockwise else \
        [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    pts = F.array(*[
        F.struct(F.lit(i).alias("seq"),
                 (x0 if cx == 0 else x1).alias("x"),
                 (y0 if cy == 0 else y1).alias("y"))
        for i, (cx, cy) in enumerate(corners)
    ])
    return cells.select(zip_col.alias("modzcta"), F.lit(part).alias("part"),
                        F.lit(ring).alias("ring"), F.explode(pts).alias("p")) \
        .select("modzcta", "part", "ring", F.col("p.seq").cast("int").alias("seq"),
                F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def layer_from_customers(customer: DataFrame) -> DataFrame:
    """The test polygon layer derived from ``customer`` (see module doc)."""
    cells = customer.select((F.col("c_custkey") - 1).alias("c")).distinct()
    cells = cells.select(
        "c",
        (F.col("c") % 15).alias("col"),
        (F.floor(F.col("c") / 15) % 1000).alias("row"),
    )
    key = F.when(F.col("col") == 3, F.concat(F.lit(" "), (F.lit(10001) + F.col("c")).cast("string"), F.lit(" "))) \
        .otherwise((F.lit(10001) + F.col("c")).cast("string"))
    x0 = F.lit(-74.25) + F.lit(0.035) * F.col("col")
    y0 = F.lit(40.5) + F.lit(0.03) * F.col("row")
    squares = _ring(cells, key, 0, 0, x0, y0, x0 + F.lit(0.035), y0 + F.lit(0.03), False)
    holed = cells.where(F.col("col") == 7)
    holes = _ring(holed, key, 0, 1, x0 + F.lit(0.00875), y0 + F.lit(0.0075),
                  x0 + F.lit(0.02625), y0 + F.lit(0.0225), True)
    two = cells.where(F.col("row") == 5)
    pieces = _ring(two, key, 1, 0, x0, y0 - F.lit(0.015), x0 + F.lit(0.0175), y0, False)
    return squares.unionByName(holes).unionByName(pieces)
