"""Dense search: exact nearest neighbours, candidates, features and hard negatives.

A query set of one block goes to the items, which stay where they lie. Larger
sets and searches within locations meet the items in tiles: a block of queries
and a group of items of one location, both of bounded size, so neither a large
location nor a large query set is one task. A tile gives each query's own top (or
counts of items ahead), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dot, unit
from .lexical import DIGITS, sized, together, top
from .packed import Best

#: Queries and items of a tile, and items that are scored at once.
BLOCK, GROUP, CHUNK = 256, 65_536, 1_024
#: Query vectors up to which they are broadcast.
BROADCAST_VECTORS = 10_000
#: Rank of an item that no local vector precedes, where the query's location has no items.
NO_LOCAL = 1e5

_TOPS = "qid string, item_id string, score double"


def _units(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


class _Tops(Best):
    """The best `depth` items of each query of a block by the product of their vectors."""

    def __init__(self, ids: list[str], vectors: np.ndarray, depth: int) -> None:
        super().__init__(ids, depth)
        self.vectors = vectors

    def add(self, names: list[str], vectors: np.ndarray) -> None:
        for at in range(0, len(names), CHUNK):
            self.put(names[at : at + CHUNK], np.round(self.vectors @ vectors[at : at + CHUNK].T, DIGITS))


class _Ahead:
    """Of each query of a block: the best score, and for each of its marks the items with a larger one."""

    def __init__(self, ids: list[str], vectors: np.ndarray, marks: list[list[float]]) -> None:
        self.ids, self.vectors, self.marks = ids, vectors, [np.array(m) for m in marks]
        self.best = np.full(len(ids), -np.inf)
        self.counts = [np.zeros(len(m), np.int64) for m in marks]

    def add(self, names: list[str], vectors: np.ndarray) -> None:
        for at in range(0, len(names), CHUNK):
            part = np.sort(np.round(self.vectors @ vectors[at : at + CHUNK].T, DIGITS), axis=1)
            self.best = np.maximum(self.best, part[:, -1])
            for k, scores in enumerate(part):
                self.counts[k] += len(scores) - np.searchsorted(scores, self.marks[k], side="right")

    def batch(self) -> pa.RecordBatch:
        n = [len(m) for m in self.marks]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n).tolist(), pa.string()), pa.array(np.concatenate(self.marks)), pa.array(np.concatenate(self.counts)), pa.array(np.repeat(self.best, n))],
            names=["qid", "cosine", "ahead", "local_best"],
        )


def _scan(queries: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """Tops of each task's items for one block of queries, which travels with the plan."""
    rows = queries.select("qid", "vector").collect()
    ids = [r["qid"] for r in rows]
    block = _units(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = _Tops(ids, block, depth)
        for batch in batches:
            if batch.num_rows:
                tops.add(batch.column(0).to_pylist(), _units(batch.column(1)))
        yield tops.batch()

    return items.select("item_id", "vector").mapInArrow(best, _TOPS)


def _tiles(queries: DataFrame, items: DataFrame, block: int, group: int) -> DataFrame:
    """location, block, group, kind, id, vector, marks: the rows of a tile together, its queries (kind 0) before its items.

    queries: qid, location, vector, marks; items: item_id, location, vector.
    The blocks and groups of a location follow its counts; rows without a
    location meet nothing.
    """
    sizes = queries.groupBy("location").agg(F.count(F.lit(1)).alias("queries")).join(items.groupBy("location").agg(F.count(F.lit(1)).alias("items")), "location")
    sizes = sized(sizes.select("location", F.ceil(F.col("queries") / block).cast("int").alias("blocks"), F.ceil(F.col("items") / group).cast("int").alias("groups")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q = queries.join(sizes, "location").select("location", dealt("qid", "blocks").alias("block"), each("groups").alias("group"), F.lit(0).alias("kind"), F.col("qid").alias("id"), "vector", "marks")
    i = items.join(sizes, "location").select("location", each("blocks").alias("block"), dealt("item_id", "groups").alias("group"), F.lit(1).alias("kind"), F.col("item_id").alias("id"), "vector", F.lit(None).cast("array<double>").alias("marks"))
    tile = ["location", "block", "group"]
    return together(q, i).repartition(*tile).sortWithinPartitions(*tile, "kind")


def _matched(made: Callable[[list, np.ndarray, list], _Tops | _Ahead]):
    """The batch of each tile; one tile's queries and one batch of items are held."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            begin = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[begin]:
                    yield keys[begin][:3], keys[begin][3], batch.slice(begin, k - begin)
                    begin = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, now = None, [], None
        for key, kind, part in slices(batches):
            if key != tile:
                if now is not None:
                    yield now.batch()
                tile, asked, now = key, [], None
            if kind == 0:
                asked.append(part)
                continue
            if now is None and asked:
                ids, marks = ([x for p in asked for x in p.column(k).to_pylist()] for k in (4, 6))
                now = made(ids, np.concatenate([_units(p.column(5)) for p in asked]), marks)
            if now is not None:
                now.add(part.column(4).to_pylist(), _units(part.column(5)))
        if now is not None:
            yield now.batch()

    return run


def _tiled_top(queries: DataFrame, items: DataFrame, depth: int, block: int, group: int) -> DataFrame:
    asked = queries.withColumn("marks", F.lit(None).cast("array<double>"))
    found = _tiles(asked, items, block, group).mapInArrow(_matched(lambda ids, vectors, _: _Tops(ids, vectors, depth)), _TOPS)
    return top(found, depth)


def global_top(queries: DataFrame, items: DataFrame, depth: int = 1000, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """qid, item_id, score, rank over all items, by cosine, then id. Vectors need not be of length one; null ones are left out."""
    q, i = queries.select("qid", "vector").where("vector is not null"), items.select("item_id", "vector").where("vector is not null")
    n = q.limit(block + 1).count()
    if not n:
        return queries.select("qid", F.lit("").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    if n <= block:
        return top(_scan(q, i, depth), depth)
    one = F.lit(0).alias("location")
    return _tiled_top(q.select("*", one), i.select("*", one), depth, block, group)


def scores(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with cosine."""
    q = sized(queries.select("qid", unit(F.col("vector")).alias("qv")), BROADCAST_VECTORS)
    i = items.select("item_id", unit(F.col("vector")).alias("iv"))
    return pairs.join(i, "item_id").join(q, "qid").withColumn("cosine", F.round(dot(F.col("qv"), F.col("iv")), DIGITS)).drop("qv", "iv")


def local_top(queries: DataFrame, items: DataFrame, limit: int = 200, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """qid, item_id, score, rank over the items of each query's location."""
    q, i = queries.select("qid", "location", "vector").where("vector is not null"), items.select("item_id", "location", "vector").where("vector is not null")
    return _tiled_top(q, i, limit, block, group)


def candidates(near: DataFrame, local: DataFrame, from_global: int = 50) -> DataFrame:
    """qid, item_id: the local items and the first of the global ones, each once."""
    return together(local.select("qid", "item_id"), near.where(F.col("rank") <= from_global).select("qid", "item_id")).distinct()


def features(pairs: DataFrame, queries: DataFrame, items: DataFrame, near: DataFrame, depth: int = 1000, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """qid, item_id and five features: cosine, less the best, log global rank, less the local best, log of local items ahead."""
    c = scores(pairs.select("qid", "item_id"), queries, items)
    best = near.where("rank = 1").select("qid", F.col("score").alias("best"))
    ranks = near.select("qid", "item_id", (F.col("rank") - 1).alias("place"))
    # a query takes its candidates' scores to the tiles of its location, which count the items strictly ahead of each
    marks = c.groupBy("qid").agg(F.array_sort(F.collect_set("cosine")).alias("marks"))
    asked = queries.where("vector is not null").select("qid", "location", "vector").join(marks, "qid")
    held = items.where("vector is not null").select("item_id", "location", "vector")
    ahead = _tiles(asked, held, block, group).mapInArrow(_matched(_Ahead), "qid string, cosine double, ahead long, local_best double")
    ahead = ahead.groupBy("qid", "cosine").agg(F.sum("ahead").alias("ahead"), F.max("local_best").alias("local_best"))
    c = c.join(sized(best), "qid", "left").join(ranks, ["qid", "item_id"], "left").join(ahead, ["qid", "cosine"], "left")
    return c.select(
        "qid", "item_id", F.col("cosine").alias("dense_cos"),
        (F.col("cosine") - F.col("best")).alias("dense_cos_minus_global_top1"),
        F.log1p(F.coalesce(F.col("place"), F.lit(depth)).cast("double")).alias("dense_log_global_rank"),
        (F.col("cosine") - F.coalesce("local_best", F.lit(-1.0))).alias("dense_cos_minus_local_top1"),
        F.log1p(F.when(F.col("local_best").isNull(), F.lit(NO_LOCAL)).otherwise(F.col("ahead").cast("double"))).alias("dense_log_local_rank"),
    )


def hard_negatives(pairs: DataFrame, clicked: DataFrame, queries: DataFrame, items: DataFrame, low: int = 3, high: int = 30, margin: int = 20, seed: int = 0) -> DataFrame:
    """qid, positive, negative: one item near the anchor that nobody clicked for it, drawn by seeded hash.

    Of the location's items by score, those behind the first `low` and within
    high + margin that were not clicked for the anchor; the first high - low of
    them are the pool. Locations of fewer than `high` items give none.
    """
    n = items.where("vector is not null").groupBy("location").agg(F.count(F.lit(1)).alias("n"))
    near = local_top(queries, items, high + margin).withColumnRenamed("rank", "place").join(queries.select("qid", "location").join(sized(n), "location"), "qid")
    near = near.where((F.col("n") >= high) & (F.col("place") > low) & (F.col("place") <= F.col("n") - 1))
    free = near.join(clicked.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    free = free.withColumn("seat", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("seat") <= high - low)
    drawn = pairs.select("qid", "positive").distinct().join(free.select("qid", "item_id"), "qid")
    pick = F.row_number().over(Window.partitionBy("qid", "positive").orderBy(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "qid", "positive", "item_id"), 256)))
    return drawn.withColumn("pick", pick).where("pick = 1").select("qid", "positive", F.col("item_id").alias("negative"))


def encoded(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], id_col: str, text_col: str) -> DataFrame:
    """id, vector at length one, through a pluggable encoder that each worker loads once; texts of a batch go by length."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for batch in batches:
            order = batch[text_col].str.len().to_numpy().argsort(kind="stable")
            v = np.asarray(encode(batch[text_col].iloc[order].tolist()), dtype=np.float32).reshape(len(batch), -1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            yield pd.DataFrame({id_col: batch[id_col], "vector": list(v[back])})

    return texts.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInPandas(made, f"{id_col} string, vector array<float>")
