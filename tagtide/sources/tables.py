"""Reading the input tables and mapping them to the points model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.functions.columns import DAY_S, epoch_seconds, series_id, series_id_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def to_points(df: DataFrame, metric: str, tags: dict[str, Column], ts: Column, value: Column, seq: Column) -> DataFrame:
    """Points of one metric. ``seq`` must be unique among rows of equal time; it makes first and last definite."""
    made = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))])
    return df.select(
        F.lit(metric).alias("metric"), series_id_of(metric, tags).alias("series_id"), made.alias("tags"), ts.alias("ts"),
        value.cast("double").alias("value"), seq.cast("bigint").alias("seq"),
    )


def event_points(spark: SparkSession, folder: str, with_user: bool = False) -> DataFrame:
    df = table(spark, folder, "events")
    tags = {"event_type": F.col("event_type")} | ({"user_id": F.col("user_id")} if with_user else {})
    return to_points(df, "events.value", tags, epoch_seconds(F.col("ts")), F.col("value"), F.col("event_id"))


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "orders")
    tags = {"o_orderstatus": F.col("o_orderstatus"), "o_orderpriority": F.col("o_orderpriority")}
    when = epoch_seconds(F.col("o_orderdate"))
    return to_points(df, "orders.totalprice", tags, when, F.col("o_totalprice"), F.col("o_orderkey"))


def line_points(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem")
    tags = {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return to_points(df, "lineitem.quantity", tags, epoch_seconds(F.col("l_shipdate")), F.col("l_quantity"), order)


def stored_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points table as written."""
    return table(spark, folder, "points")


def wide_to_points(df: DataFrame, ts: Column, seq: Column, tags: dict[str, Column], metrics: dict[str, str]) -> DataFrame:
    """Several metrics in columns of one row (name -> column) to one point per metric that is not null."""
    made = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v.cast("string"))])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()])
    flat = df.select(made.alias("tags"), ts.alias("ts"), seq.cast("bigint").alias("seq"), F.explode(pairs).alias("p"))
    return flat.where(F.col("p.value").isNotNull()).select(
        F.col("p.metric").alias("metric"), series_id(F.col("p.metric"), F.col("tags")).alias("series_id"), "tags", "ts",
        F.col("p.value").alias("value"), "seq",
    )


def read_points(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """Points from Parquet, ORC, JSON or CSV. CSV needs a header, in any order, and carries tags as a JSON object
    in a string column; cells that do not fit their type become null."""
    if form in ("parquet", "orc"):
        return spark.read.format(form).options(**options).load(path)
    plain = "metric string, series_id string, tags string, ts bigint, value double, seq bigint"
    if form == "json":
        return spark.read.schema(plain.replace("tags string", "tags map<string,string>")).options(**options).json(path)
    if form == "csv":
        df = spark.read.options(header=True, **options).csv(path)
        fields = [x.split(" ") for x in plain.split(", ")]
        named = df.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in fields])
        return named.withColumn("tags", F.from_json("tags", "map<string,string>"))
    raise ValueError(f"unknown form {form!r}")


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    """Store partitioned by (metric, day), sorted by series and time within files, so that range scans prune
    partitions and row groups. Rows are rebalanced by metric and day: a day too large for one task is split by its
    size in bytes, small days share tasks (adaptive execution, spark.sql.adaptive.advisoryPartitionSizeInBytes)."""
    day = F.floor(F.col("ts") / F.lit(DAY_S)).cast("bigint")
    (
        points.withColumn("day", day)
        .hint("rebalance", F.col("metric"), F.col("day"))
        .sortWithinPartitions("metric", "day", "series_id", "ts")
        .write.mode(mode)
        .partitionBy("metric", "day")
        .parquet(path)
    )


def write_text_points(points: DataFrame, path: str, form: str, mode: str = "append") -> None:
    if form == "json":
        points.write.mode(mode).json(path)
    elif form == "csv":
        points.withColumn("tags", F.to_json("tags")).write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")
