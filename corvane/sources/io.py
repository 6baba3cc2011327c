"""Sources and sinks: parquet relations, the answer file, fingerprints, JSON and the content-addressed cache."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ITEM_FIELDS, QUERY_FIELDS, conformed


@dataclass(frozen=True)
class Frames:
    train: DataFrame
    queries: DataFrame
    items: DataFrame


def load_frames(spark: SparkSession, data_dir: str) -> Frames:
    """train, queries and items of a folder, with their contracts checked. Nothing is read before an action."""
    read = lambda name: spark.read.parquet(f"{data_dir}/{name}.parquet")
    return Frames(
        conformed(read("train"), QUERY_FIELDS + ITEM_FIELDS, "train"),
        conformed(read("queries"), QUERY_FIELDS, "queries"),
        conformed(read("items"), ITEM_FIELDS, "items"),
    )


def item_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """A scan of one column."""
    return spark.read.parquet(f"{data_dir}/items.parquet").select(F.col("item_id").cast("string"))


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(path: str, value: object) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(canonical_json(value, indent=2) + "\n", encoding="utf-8")


def canonical_json(value: object, indent: int | None = None) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent, sort_keys=True, default=str)


def answer_rows(ranked: DataFrame, qid: str = "qid", item: str = "item_id", rank: str = "rank") -> DataFrame:
    """qid, answer: the items of each query in order of rank, joined by single spaces."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda s: s[item])
    return ranked.groupBy(qid).agg(F.concat_ws(" ", ordered).alias("answer"))


def write_answer(answers: DataFrame, path: str) -> None:
    """One CSV file with a header in a folder, ordered by query; answers are bounded by queries times fifty."""
    answers.orderBy(answers.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an empty field is an empty string."""
    frame = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return frame.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in frame.columns])


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of each file at a path, read in the cluster."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def table_fingerprint(frame: DataFrame) -> dict:
    """Rows, schema and an order-free digest of a table's rows, by aggregation in the cluster."""
    digest = F.xxhash64(*frame.columns).cast("decimal(38,0)")
    row = frame.agg(F.count(F.lit(1)).alias("rows"), F.sum(digest).alias("digest")).first()
    return {"rows": row["rows"], "schema": frame.schema.simpleString(), "digest": str(row["digest"])}


def fingerprint(parts: object) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(canonical_json(parts).encode("utf-8")).hexdigest()


def source_fingerprint(package: str) -> str:
    """Of a package's Python files: sorted names and bytes, with zero bytes between."""
    h = hashlib.sha256()
    root = Path(package)
    for p in sorted(root.rglob("*.py")):
        h.update(p.relative_to(root).as_posix().encode() + b"\0" + p.read_bytes() + b"\0")
    return h.hexdigest()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; its files go when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        root = context.getCheckpointDir().get()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Tasks per core of a scan that makes a table: with one or two, the last ones keep the other cores waiting.
WAVES = 4
_SPLITS = "spark.sql.files.minPartitionNum"
_splitting, _open = threading.Lock(), {}


@contextmanager
def fine_scans(spark: SparkSession) -> Iterator[None]:
    """Scans that run meanwhile have at least WAVES tasks per core where their files allow it. Tables may be made in several threads."""
    with _splitting:
        many, before = _open.get(spark, (0, spark.conf.get(_SPLITS, None)))
        _open[spark] = (many + 1, before)
        spark.conf.set(_SPLITS, str(WAVES * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        with _splitting:
            many, before = _open.pop(spark)
            if many > 1:
                _open[spark] = (many - 1, before)
            elif before is None:
                spark.conf.unset(_SPLITS)
            else:
                spark.conf.set(_SPLITS, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """frame as a written table, which is computed once and keeps later plans short."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """frame over at least as many partitions as there are cores: a few small files would leave most of them idle. Larger inputs stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def cached(spark: SparkSession, root: str, key: object, name: str, build: Callable[[], DataFrame], columns: list[str] | None = None) -> DataFrame:
    """The table `name` under root for a key, built once.

    The commit protocol's marker makes the write atomic: a folder without it is
    built again. A table with other columns than asked for is refused.
    """
    path = f"{root}/{fingerprint(key)}/{name}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        build().write.mode("overwrite").parquet(path)
    frame = spark.read.parquet(path)
    if columns is not None and frame.columns != columns:
        raise ValueError(f"the cache at {path} holds other columns: {frame.columns}")
    return frame
