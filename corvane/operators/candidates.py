"""The candidate union: channels with values and ranks, eligibility, linear scores and answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import DIGITS, sized, together, top

#: Values of a candidate, in the order of a packed row.
VALUES = ["word", "char", "filter", "history", "category", "location", "popularity", "exact_word", "exact_char", "exact_filter", "title", "microcat"]
ALWAYS = ["history_source", "fallback_source", "dense_source"]


@dataclass(frozen=True)
class Settings:
    """Weights and masks of the linear score."""

    weights: dict[str, float] = field(default_factory=lambda: {"word": 1.0, "char": 0.75, "filter": 0.18, "history": 0.55, "category": 0.12, "location": 0.06, "popularity": 0.03, "title": 0.0, "microcat": 0.0})
    exact_rescore: bool = False
    geo_neighbors: int = 3
    pool: int = 120


def channel(found: DataFrame, name: str, rank: str | list[str] | None = None) -> DataFrame:
    """qid, item_id, channel, value, source, place of one search's result; of a search in several places, rank names the source of each part."""
    place = F.col("rank").cast("int") if rank and "rank" in found.columns else F.lit(1)
    source = F.array(*[F.lit(r) for r in rank])[F.col("part")] if isinstance(rank, list) else F.lit(rank).cast("string")
    return found.select("qid", "item_id", F.lit(name).alias("channel"), F.col("score").cast("double").alias("value"), source.alias("source"), (place if rank else F.lit(None).cast("int")).alias("place"))


def marker(found: DataFrame, source: str) -> DataFrame:
    """A source without a value: its candidates are eligible wherever they rank."""
    return found.select("qid", "item_id", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("double").alias("value"), F.lit(source).alias("source"), F.lit(1).alias("place"))


def merged(parts: list[DataFrame], values: list[str], sources: list[str]) -> DataFrame:
    """One row per qid and item_id: the largest positive value of each channel (else 0) and the least rank of each source (else null)."""
    rows = together(*parts)
    value = [F.coalesce(F.max(F.when((F.col("channel") == v) & (F.col("value") > 0), F.col("value"))), F.lit(0.0)).alias(v) for v in values]
    rank = [F.min(F.when(F.col("source") == s, F.col("place"))).alias(s) for s in sources]
    live = (F.col("value") > 0) | F.col("channel").isNull()
    return rows.where(live).groupBy("qid", "item_id").agg(*value, *rank)


def with_priors(rows: DataFrame, queries: DataFrame, items: DataFrame, category: DataFrame, location: DataFrame) -> DataFrame:
    """Category and location priors of each pair, 0 where the log has none. The priors are small tables."""
    q = queries.select("qid", "search_category", "search_location_id")
    i = items.select("item_id", "item_category_id", "item_location_id")
    x = rows.drop("category", "location").join(sized(q), "qid").join(i, "item_id")
    x = x.join(category.withColumnRenamed("prior", "category"), ["search_category", "item_category_id"], "left")
    x = x.join(location.withColumnRenamed("prior", "location"), ["search_location_id", "item_location_id"], "left")
    return x.select(*[c for c in rows.columns if c not in ("category", "location")], F.coalesce("category", F.lit(0.0)).alias("category"), F.coalesce("location", F.lit(0.0)).alias("location"))


def masks(columns: list[str], pool: int, geo: int) -> dict[str, Column]:
    """word, char, filter and eligible; sources that a table lacks count as unranked."""

    def within(*sources: str) -> Column:
        out = F.lit(False)
        for s in sources:
            if s in columns:
                out = out | F.coalesce(F.col(s) <= pool, F.lit(False))
        return out

    m = {"word": within("global_word_rank", f"geo{geo}_word_rank"), "char": within("global_char_rank", f"geo{geo}_char_rank"), "filter": within("global_filter_rank")}
    always = F.lit(False)
    for s in ALWAYS:
        if s in columns:
            always = always | F.col(s).isNotNull()
    return m | {"eligible": m["word"] | m["char"] | m["filter"] | always}


def linear_score(columns: list[str], settings: Settings, digits: int = DIGITS) -> Column:
    m = masks(columns, settings.pool, settings.geo_neighbors)
    total = F.lit(0.0)
    for name, weight in settings.weights.items():
        if name in ("word", "char", "filter"):
            value = F.col(f"exact_{name}") if settings.exact_rescore else F.when(m[name], F.col(name)).otherwise(0.0)
        elif name in columns:
            value = F.col(name)
        else:
            continue
        total = total + F.lit(float(weight)) * value
    return F.round(total, digits)


def scored(rows: DataFrame, settings: Settings, digits: int = DIGITS) -> DataFrame:
    """The eligible rows with base_score."""
    keep = masks(rows.columns, settings.pool, settings.geo_neighbors)["eligible"]
    return rows.where(keep).withColumn("base_score", linear_score(rows.columns, settings, digits))


def answers(ranked: DataFrame, queries: DataFrame, catalog: DataFrame, top_k: int = 50, score: str = "base_score") -> DataFrame:
    """qid, item_id, rank: the best top_k, filled with the smallest unused ids, so every query has as many as the catalog allows."""
    best = top(ranked.select("qid", "item_id", score), top_k, score=score).select("qid", "item_id", F.col(score).alias("s"), F.lit(0).alias("fill"))
    # top_k smallest ids are enough to fill any answer
    spare = F.broadcast(catalog.select("item_id").distinct().orderBy("item_id").limit(top_k))
    more = queries.select("qid").join(spare).join(best.select("qid", "item_id"), ["qid", "item_id"], "left_anti").select("qid", "item_id", F.lit(None).cast("double").alias("s"), F.lit(1).alias("fill"))
    every = together(best, more).withColumn("key", F.coalesce(F.col("s"), F.lit(float("-inf"))))
    out = top(every, top_k, score="key")
    return out.select("qid", "item_id", F.col("rank").cast("int").alias("rank"), F.col("fill").alias("filled"))
