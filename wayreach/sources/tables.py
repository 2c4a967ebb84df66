"""Feature layers, configuration tables, result tables and run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"

# Default speed in km/h and cleaning priority by road class.
ROAD_CLASSES = [
    ("tertiary", 50, 2),
    ("residential", 50, 2),
    ("track", 40, 2),
    ("cycleway", 20, 1),
    ("service", 40, 2),
    ("primary", 90, 2),
    ("unclassified", 30, 1),
    ("track_grade5", 20, 2),
    ("trunk", 90, 2),
    ("path", 5, 0),
    ("secondary", 50, 2),
    ("steps", 5, 0),
    ("pedestrian", 5, 0),
    ("footway", 3, 0),
    ("track_grade2", 30, 2),
    ("living_street", 50, 2),
    ("track_grade4", 20, 2),
    ("track_grade1", 40, 2),
    ("trunk_link", 60, 2),
    ("tertiary_link", 50, 2),
    ("unknown", 30, 1),
    ("secondary_link", 50, 2),
    ("primary_link", 50, 2),
    ("track_grade3", 20, 2),
    ("motorway", 120, 2),
    ("motorway_link", 90, 2),
    ("busway", 50, 2),
    ("bridleway", 5, 0),
]

# Congestion factor by start hour 0..23.
CONGESTION = [
    1, 1, 1, 1, 1, 0.9, 0.75, 0.6, 0.6, 0.65, 0.7, 0.7,
    0.7, 0.7, 0.65, 0.65, 0.6, 0.6, 0.625, 0.625, 0.75, 0.75, 0.75, 0.9,
]

# Direction codes of road links.
DIRECTIONS = ["T", "F", "B", "N"]


def read_config(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """``road_classes``, ``congestion`` or ``directions``: from a CSV file, or the defaults."""
    schemas = {
        "road_classes": "link_type string, speed_km_h int, priority int",
        "congestion": "hour int, cdi double",
        "directions": "direction_type string",
    }
    if path is not None:
        wanted = [f.name for f in T._parse_datatype_string(schemas[name]).fields]
        text = spark.read.csv(path, header=True)
        text = text.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in text.columns})
        types = {f.name: f.dataType for f in T._parse_datatype_string(schemas[name]).fields}
        return text.select(*[F.col(c).cast(types[c]) for c in wanted if c in text.columns])
    rows = {
        "road_classes": ROAD_CLASSES,
        "congestion": [(h, float(f)) for h, f in enumerate(CONGESTION)],
        "directions": [(d,) for d in DIRECTIONS],
    }[name]
    return spark.createDataFrame(rows, schemas[name])


def parse_wkt_points(c: Column | str) -> Column:
    """The vertices of one WKT ring, line or point as array<struct<x,y>>."""
    number = r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s+(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    pairs = F.arrays_zip(
        F.regexp_extract_all(X.col(c), F.lit(number), F.lit(1)).alias("x"),
        F.regexp_extract_all(X.col(c), F.lit(number), F.lit(2)).alias("y"),
    )
    return F.transform(
        pairs,
        lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")),
    )


def read_features(
    spark: SparkSession, path: str, fmt: str, id_column: str, geometry: str = "geometry"
) -> DataFrame:
    """A layer as (id, x, y, attributes): points as they are, polygons by their centroid.

    ``fmt``: ``parquet`` (geometry = outer ring array or x/y columns), ``csv``
    (geometry = WKT text) or ``geojson`` (one feature per line).
    """
    if fmt == "geojson":
        ring = f"geometry struct<type:string,coordinates:string>, properties map<string,string>"
        raw = spark.read.schema(ring).json(path)
        return features_from_geojson(raw, id_column)
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.csv(path, header=True)
    if {"x", "y"} <= set(df.columns):
        return df
    if fmt == "csv":
        outer = F.regexp_extract(geometry, r"\(+([^()]*)\)", 1)
        df = df.withColumn(geometry, parse_wkt_points(outer))
    return with_centroid(df, geometry)


def features_from_geojson(raw: DataFrame, id_column: str) -> DataFrame:
    number = r"\[\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    coordinates = F.col("geometry.coordinates")
    # the outer ring is the first bracketed list of pairs
    ring_text = F.when(
        F.col("geometry.type") == "Point", coordinates
    ).otherwise(F.regexp_extract(coordinates, r"(\[\s*\[\s*-?[0-9.][^\]]*\](\s*,\s*\[[^\]]*\])*)", 1))
    ring = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(ring_text, F.lit(number), F.lit(1)).alias("x"),
            F.regexp_extract_all(ring_text, F.lit(number), F.lit(2)).alias("y"),
        ),
        lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")),
    )
    df = raw.select(
        F.col("properties")[id_column].alias(id_column), "properties", ring.alias("geometry")
    )
    return with_centroid(df, "geometry")


def with_centroid(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace a vertex array by the centroid columns ``x, y``."""
    centre = X.ring_centroid(geometry)
    return df.withColumn("__c", centre).select(
        *[c for c in df.columns if c != geometry], F.col("__c.x").alias("x"), F.col("__c.y").alias("y")
    )


def numeric_last(df: DataFrame) -> DataFrame:
    """Cast the last column to a number (bad text becomes null), unless it is ``Value``."""
    last = df.columns[-1]
    if last == "Value" or not isinstance(df.schema[last].dataType, T.StringType):
        return df
    return df.withColumn(last, F.col(last).try_cast("double"))


def write_table(df: DataFrame, folder: str, table: str, fmt: str = "parquet") -> None:
    """Write one result table below ``folder``, replacing an earlier one."""
    numeric_last(df).write.mode("overwrite").format(fmt).options(header=True).save(f"{folder}/{table}")


def run_log(texts: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """Run log text to (Parameter, Value) rows: split at the first colon, blanks dropped."""
    # strip() of the whole text removes only blanks, and blank lines drop out below
    line = F.explode(F.split(F.col(text), "\n"))
    lines = texts.select(*keys, line.alias("line")).withColumn("line", strip_blanks("line"))
    lines = lines.filter(F.col("line") != "")
    cut = F.instr("line", ":")
    return lines.select(
        *keys,
        F.when(cut > 0, strip_blanks(F.substring_index("line", ":", 1))).otherwise(F.col("line")).alias("Parameter"),
        F.when(cut > 0, strip_blanks(F.expr("substring(line, instr(line, ':') + 1)"))).otherwise("").alias("Value"),
    )


def run_log_csv(texts: DataFrame, text: str = "text", keys: Sequence[str] = ()) -> DataFrame:
    """The same log as quoted CSV lines, doubling inner quotes."""

    def quoted(c):
        return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))

    return run_log(texts, text, keys).select(
        *keys, F.concat(quoted("Parameter"), F.lit(","), quoted("Value")).alias("csv_line")
    )


def strip_blanks(c: Column | str) -> Column:
    """Strip blanks, tabs and line ends on both sides."""
    return F.regexp_replace(X.col(c), r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def check_features(df: DataFrame | None, name: str, id_column: str = "", spark=None) -> DataFrame:
    """Layer given, not empty, and holding its id field; one row (ok, message)."""
    if df is None:
        ok, message = False, "Layer is not selected"
    elif not df.limit(1).count():
        ok, message = False, f"Layer '{name}' is empty"
    elif id_column and id_column not in df.columns:
        ok, message = False, f"Layer '{name}' does not contain required field '{id_column}'"
    else:
        ok, message = True, ""
    spark = spark or df.sparkSession
    return spark.createDataFrame([(ok, message)], "ok boolean, message string")
