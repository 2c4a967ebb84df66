"""Reading, checking and writing GTFS folders (CSV text files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X

# Files a feed must have, with the column each must hold.
REQUIRED_COLUMNS = {
    "routes.txt": "route_id",
    "stops.txt": "stop_id",
    "stop_times.txt": "trip_id",
    "trips.txt": "trip_id",
}

# Columns written for the cleaned feed.
WRITTEN_COLUMNS = {
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "trips": ["route_id", "service_id", "trip_id", "trip_headsign", "direction_id", "shape_id"],
    "routes": [
        "route_id",
        "agency_id",
        "route_short_name",
        "route_long_name",
        "route_desc",
        "route_type",
        "route_color",
    ],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
}

# Columns that are not text when a feed is read with types.
TYPED_COLUMNS = {
    "stop_lat": T.DoubleType(),
    "stop_lon": T.DoubleType(),
    "shape_pt_lat": T.DoubleType(),
    "shape_pt_lon": T.DoubleType(),
    "stop_sequence": T.IntegerType(),
    "shape_pt_sequence": T.IntegerType(),
    "route_type": T.IntegerType(),
    "start_date": T.IntegerType(),
    "end_date": T.IntegerType(),
    "date": T.IntegerType(),
    "exception_type": T.IntegerType(),
    "headway_secs": T.IntegerType(),
    **{
        day: T.IntegerType()
        for day in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    },
}

# Id columns that are trimmed on reading, and cleaned of '.0'.
TRIMMED_COLUMNS = ("route_id", "trip_id", "stop_id", "service_id", "stop_code", "stop_name")
POINT_ZERO_COLUMNS = (
    "agency_id",
    "stop_code",
    "zone_id",
    "direction_id",
    "shape_id",
    "wheelchair_accessible",
)

FEED_FILES = (
    "routes",
    "trips",
    "stop_times",
    "stops",
    "calendar",
    "calendar_dates",
    "frequencies",
    "shapes",
    "agency",
)

BOM = "﻿"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    names = first[0][0].lstrip(BOM).split(",") if first else []
    return [n.strip().strip('"') for n in names]


def read_gtfs_raw(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """One file with every column as text, ids trimmed; ``None`` if the file is absent."""
    path = f"{folder}/{name}.txt"
    if not _exists(spark, path):
        return None
    names = _header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, emptyValue="", nullValue=None)
    return trim_ids(df.fillna("", subset=names))


def trim_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in TRIMMED_COLUMNS if c in df.columns})


def fix_ids(df: DataFrame) -> DataFrame:
    """Drop '.0' left in ids by number-typed exports."""
    return df.withColumns({c: X.strip_point_zero(c) for c in POINT_ZERO_COLUMNS if c in df.columns})


ORDER = "__order"


def in_file_order(df: DataFrame) -> DataFrame:
    """``df``, just read from files, with ``ORDER``: file, place of the part of it, and row.

    Taken at the scan, so that it still tells the first row after joins and shuffles, and
    however files are packed into tasks.
    """
    return df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(ORDER))


def read_gtfs(spark: SparkSession, folder: str, ordered: bool = False) -> dict[str, DataFrame]:
    """All files of a feed with pinned types; stops never used are dropped.

    Optional files that are absent are simply not in the result. With ``ordered`` the tables
    carry the place of their rows, which decides where the first row of an id is to stay.
    """
    feed = {}
    for name in FEED_FILES:
        path = f"{folder}/{name}.txt"
        if not _exists(spark, path):
            continue
        names = _header(spark, path)
        schema = T.StructType(
            [T.StructField(n, TYPED_COLUMNS.get(n, T.StringType())) for n in names]
        )
        feed[name] = spark.read.schema(schema).csv(path, header=True, enforceSchema=True)
        if ordered:
            feed[name] = in_file_order(feed[name])
    feed["stops"] = used_stops(feed["stops"], feed["stop_times"])
    return feed


def used_stops(stops: DataFrame, stop_times: DataFrame) -> DataFrame:
    return stops.join(stop_times, "stop_id", "left_semi")


def validate_gtfs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per check: file present, header present, key column present."""
    rows = []
    for file, column in REQUIRED_COLUMNS.items():
        present = _exists(spark, f"{folder}/{file}")
        names = _header(spark, f"{folder}/{file}") if present else []
        rows += [
            (file, "exists", present),
            (file, "has header", names not in ([], [""])),
            (file, f"has {column}", column in names),
        ]
    return spark.createDataFrame(rows, "file string, check string, ok boolean")


def gtfs_date_range(calendar: DataFrame | None, calendar_dates: DataFrame | None) -> DataFrame:
    """First and last valid date named by the feed, as yyyymmdd text; none valid gives nulls."""
    columns = []
    if calendar is not None:
        columns += [calendar.select(F.col(c).cast("string").alias("d")) for c in ("start_date", "end_date")]
    if calendar_dates is not None:
        columns.append(calendar_dates.select(F.col("date").cast("string").alias("d")))
    days = columns[0]
    for more in columns[1:]:
        days = days.unionAll(more)
    day = F.when(F.col("d").rlike("^[0-9]{8}$"), F.try_to_timestamp("d", F.lit("yyyyMMdd")).cast("date"))
    return days.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(
        F.date_format("first", "yyyyMMdd").alias("first_date"),
        F.date_format("last", "yyyyMMdd").alias("last_date"),
        F.col("first").isNotNull().alias("found"),
    )


def _pick(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def cascade(feed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables to write: trips with stop times, routes with trips, shapes with trips."""
    out = {"stops": feed["stops"], "stop_times": _pick(feed["stop_times"], WRITTEN_COLUMNS["stop_times"])}
    trips = feed["trips"].join(feed["stop_times"], "trip_id", "left_semi")
    out["trips"] = _pick(trips, WRITTEN_COLUMNS["trips"])
    out["routes"] = _pick(feed["routes"].join(trips, "route_id", "left_semi"), WRITTEN_COLUMNS["routes"])
    if "shapes" in feed:
        out["shapes"] = _pick(feed["shapes"].join(trips, "shape_id", "left_semi"), WRITTEN_COLUMNS["shapes"])
    for name in ("calendar", "calendar_dates", "agency"):
        if name in feed:
            out[name] = feed[name]
    return out


def write_gtfs(feed: dict[str, DataFrame], folder: str) -> None:
    """Write each table as ``<folder>/<name>.txt`` (a folder of CSV parts with headers)."""
    for name, df in cascade(feed).items():
        df.drop(ORDER).write.mode("overwrite").csv(f"{folder}/{name}.txt", header=True)
