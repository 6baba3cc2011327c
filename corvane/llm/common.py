"""What the training-data operators share: written tables, ranks and sums without a single task.

Every operator projects its inputs to private names first, so extra columns and
clashing names of the caller's tables never reach the plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a window partition in ranked() and running_sum(); only the number of partitions grows with the input.
ROWS_PER_BUCKET = 20_000
#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 100_000
#: Characters of text up to which a side with texts is broadcast.
BROADCAST_CHARS = 16_000_000

#: ASCII white space as the contracts define it.
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset: the context's checkpoint folder, else a folder in
    the session's warehouse.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        at = context._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, is computed once and outlives executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    # Spark 4.1 may take a union of parts that are partitioned alike for partitioned; adaptive plans then break groups over it
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; as it is, for a shuffled join, if not."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def sized_by_bytes(df: DataFrame, texts: list[str]) -> DataFrame:
    """sized() for rows with texts of any length: broadcast only if all of them together are small."""
    lengths = F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0)).cast("long"))
    n, chars = df.agg(F.count(F.lit(1)), F.coalesce(lengths, F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // per_bucket))


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Exclusive running sums within keys, in order of (bucket, order), in two levels.

    bucket must not decrease along the wanted order and be even enough to bound
    a window's rows, so a key with any share of the rows is spread over many
    tasks. The sums of whole buckets are small (one row per key and bucket).
    """
    b = df.withColumn("__bucket", bucket)
    per = b.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__of_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = written(per.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__to_{k}") for k in sums]), f"{name}-offsets")
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = b.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__in_{k}") for k, c in sums.items()])
    held = per.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__k_bucket"), *[f"__to_{k}" for k in sums])
    on = F.col("__bucket") == F.col("__k_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = inside.join(sized(held), on, "left")
    return out.select(*df.columns, *[(F.col(f"__in_{k}") + F.col(f"__to_{k}")).alias(k) for k in sums])
