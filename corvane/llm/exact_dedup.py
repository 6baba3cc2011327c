"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes: the leading characters,
then the digest of the whole normalised text, then the identifier. The leading
characters and the digest bound what the splitters' sample sends to the driver;
with the identifier in the key, a group of copies of any size spreads over as
many ranges as its rows need. An external sort within each range places equals
next to each other, and a stream over each range compares whole neighbouring
texts. Runs that reach a border of their range are compared with the run on the
other side: at most two rows per range, which meet by digest; whole texts travel
only where the digests on both sides of a border are the same, to a task for each
border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, sized, written

#: Leading characters in the sort key.
LEAD = 48
_SPACE = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with each run of ASCII white space as one space; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return b" " * (raw[0] in _SPACE) + b" ".join(words) + b" " * (raw[-1] in _SPACE)


def content_sorted(docs: DataFrame, id_col: str, text_col: str, carried: list[str] = ()) -> DataFrame:
    """__id, __text, __digest and __p_i for each carried column, in ranges of the content order."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WS, " ")
    keyed = docs.select(
        F.col(id_col).cast("long").alias("__id"),
        F.col(text_col).alias("__text"),
        norm.substr(1, LEAD).alias("__lead"),
        F.unhex(F.sha2(norm, 256)).alias("__digest"),
        *[F.col(c).alias(f"__p_{i}") for i, c in enumerate(carried)],
    )
    key = [F.col("__lead"), F.col("__digest"), F.col("__id").asc_nulls_last()]
    return keyed.repartitionByRange(*key).sortWithinPartitions(*key)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: id, digest, the run's smallest id and rows in this range, and whether the run touches a border."""
    at = TaskContext.get().partitionId()
    fields = ["doc_id", "text_sha256", "keep_id", "group_size", "first", "range", "border", "border_text"]
    out: dict[str, list] = {f: [] for f in fields}
    ids: list = []
    last: bytes | None = None
    opened = 0

    def close(border: int) -> None:
        digest = hashlib.sha256(last).hexdigest()
        n = len(ids)
        out["doc_id"] += ids
        out["text_sha256"] += [digest] * n
        out["keep_id"] += [ids[0]] * n
        out["group_size"] += [n] * n
        out["first"] += [True] + [False] * (n - 1)
        out["range"] += [at] * n
        out["border"] += [border] * n
        out["border_text"] += [last if border else None] + [None] * (n - 1)

    def drained() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out[f], t) for f, t in zip(fields, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()], strict=True)],
            names=fields,
        )
        for f in fields:
            out[f] = []
        return batch

    for batch in batches:
        for i, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
            now = normalised(text)
            if last is not None and now == last:
                ids.append(i)
                continue
            if last is not None:
                close(1 if opened == 0 else 0)
                opened += 1
            last, ids = now, [i]
        if len(out["doc_id"]) >= 10_000:
            yield drained()
    if last is not None:
        close(3 if opened == 0 else 2)
    yield drained()


_RUN_SCHEMA = "doc_id long, text_sha256 string, keep_id long, group_size long, first boolean, range int, border int, border_text binary"


def _same_as_before(ends: DataFrame) -> DataFrame:
    """range, border of the runs whose text is that of the run before them, in another range.

    ends: range, border (1 the first run of a range, 2 the last, 3 the only one),
    border_text. Two rows per range at most, so the one ordered window holds a
    digest for each; the texts are compared in joins on range and border.
    """
    order = Window.orderBy("range", "border")
    light = ends.select("range", "border", F.sha2("border_text", 256).alias("digest"))
    near = light.select("range", "border", (F.lag("digest").over(order) == F.col("digest")).alias("same"), F.lag("range").over(order).alias("of_range"), F.lag("border").over(order).alias("of_border"))
    near = near.where("same and of_range < range").select("range", "border", "of_range", "of_border")
    own = near.join(ends.select("range", "border", "border_text"), ["range", "border"])
    before = ends.select(F.col("range").alias("of_range"), F.col("border").alias("of_border"), F.col("border_text").alias("before"))
    return own.join(before, ["of_range", "of_border"]).where("border_text = before").select("range", "border")


def _joined_borders(runs: DataFrame) -> DataFrame:
    """For runs at borders: smallest id and rows of the whole group, and the range where it begins."""
    ends = runs.where(F.col("border_text").isNotNull()).select("range", "border", "border_text", "keep_id", "group_size")
    same = written(_same_as_before(ends), "same").select(F.col("range").alias("__range"), F.col("border").alias("__border"))
    ends = ends.drop("border_text").join(sized(same), (F.col("range") == F.col("__range")) & (F.col("border") == F.col("__border")), "left")
    order = Window.orderBy("range", "border")  # two rows per range at most
    ends = ends.select("range", "border", "keep_id", "group_size", F.sum(F.col("__range").isNull().cast("int")).over(order).alias("__group"))
    whole = Window.partitionBy("__group")
    return ends.select(
        F.col("range").alias("__range"), F.col("border").alias("__border"),
        F.min("keep_id").over(whole).alias("__keep"),
        F.sum("group_size").over(whole).alias("__size"),
        (F.row_number().over(whole.orderBy("range", "border")) == 1).alias("__begins"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is one
    space; null counts as empty. The row with the smallest id of a group stays;
    of repeated rows with that id, exactly one. A null id sorts last and stays
    only in a group without other ids. Only the two named columns are read, so
    others may have any name. An empty table gives an empty result.
    """
    runs = written(content_sorted(docs, id_col, text_col).select("__id", "__text").mapInArrow(_runs, _RUN_SCHEMA), "runs")
    ends = sized(written(_joined_borders(runs), "borders"))
    out = runs.join(ends, (F.col("range") == F.col("__range")) & (F.col("border") == F.col("__border")), "left")
    return out.select(
        "doc_id",
        F.when(F.col("__size").isNull(), F.col("keep_id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("__begins", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run, as it came; the first and the last run of the range also carry their text."""
    at = TaskContext.get().partitionId()
    last: bytes | None = None
    opened = 0
    schema = None
    for batch in batches:
        schema = batch.schema
        take, borders, texts = [], [], []
        for k, text in enumerate(batch.column("__text").to_pylist()):
            now = normalised(text)
            if last is not None and now == last:
                continue
            opened += 1
            take.append(k)
            borders.append(1 if opened == 1 else 0)
            texts.append(now if opened == 1 else None)
            last = now
        if take:
            kept = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([at] * len(take), pa.int32()), pa.array(borders, pa.int32()), pa.array(texts, pa.binary())],
                names=[*batch.schema.names, "range", "border", "border_text"],
            )
    if opened > 1:  # where the last run ends; no document
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(1, f.type) for f in schema], pa.array([at], pa.int32()), pa.array([2], pa.int32()), pa.array([last], pa.binary())],
            names=[*schema.names, "range", "border", "border_text"],
        )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Same rules as exact_duplicates().

    Whole rows travel through the sort once; no join by id brings them back.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = content_sorted(docs, id_col, text_col, rest).drop("__lead", "__digest")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("range", T.IntegerType()), T.StructField("border", T.IntegerType()), T.StructField("border_text", T.BinaryType())])
    firsts = written(rows.mapInArrow(_firsts, schema), "firsts")
    # a range's first run goes if the nearest run before it, in another range, is the same
    dropped = _same_as_before(firsts.where(F.col("border_text").isNotNull()))
    dropped = sized(written(dropped.where("border = 1").select(F.col("range").alias("__range")), "dropped"))
    kept = firsts.where(F.col("border") < 2).join(dropped, (F.col("border") == 1) & (F.col("range") == F.col("__range")), "left_anti")
    by = {id_col: F.col("__id").cast(docs.schema[id_col].dataType), text_col: F.col("__text")} | {c: F.col(f"__p_{i}") for i, c in enumerate(rest)}
    return kept.select(*[by[c].alias(c) for c in docs.columns])
