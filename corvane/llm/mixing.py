"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets: each source's weighted share of the mix, filled up to a cap; the excess
goes to the others by weight (the first rank in order of cap over weight at
which the common level fits). Quotas: equal blocks of tokens go one by one to
the source with the highest quotient weight / (2 * blocks + 1), where the
weights are the targets; a source's blocks then go to its districts and a
district's to its shards the same way, by their sizes. Only quotients near the
cut are made: of n parties and N blocks, the divisor lies within n / N of its
mean, so about five quotients per party are ranked whatever N is.

Selection: a shard's documents stand in seeded order, and the shard is cut into
blocks. All blocks are taken as often as the quota holds the whole shard; for
the rest of the quota, blocks are taken in the order of a seeded hash, the last
one perhaps in part. A shard keeps only the hash of its last block taken, so a
document finds its blocks by itself: no block meets a document in a join.

A block has block_words() tokens: so many that the mix has MIX_BLOCKS blocks,
BLOCK at most. A source misses its target by about a block. Sources have one row
each in the windows over sources; a source has as many shards as its documents
need, and a district about the root of that, so no window holds more parties
than that root, and none more documents than a shard. A source with any share of
the rows is spread over its shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, WS, sized, written

#: Weights of the sources in code-point order, repeating; mix and cap as shares of sizes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Tokens of a block at most; blocks of a mix with smaller ones; documents of a shard.
BLOCK = 1_024
MIX_BLOCKS = 20_000
SHARD_ROWS = 4_000
SEED = 17


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(trimmed, f"{NOT_WS}(?:{WS})?", "x")).cast("long")


def apportioned(parties: DataFrame, keys: list[str], weight: str, cap: str, seats: str) -> DataFrame:
    """parties with column `quota`: the seats of each group of keys, by highest quotients weight / (2 * k + 1) below the caps.

    parties needs a column `party` that is unique within keys and orders ties,
    and no cap may be more than one below the party's even share of the seats
    (targets() fills up to the caps before), else the band of quotients is too
    narrow. Seats that no cap leaves room for stay unused.
    """
    of = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x = parties.withColumn("__w", F.sum(weight).over(of)).withColumn("__n", F.count(F.lit(1)).over(of))
    even = F.when((F.col("__w") > 0) & (F.col(seats) > 0), F.col(weight) * F.col(seats) / F.col("__w")).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, 1.5 * F.col("__n") / F.col(seats)).otherwise(0.0)
    x = x.withColumn("__low", F.least(F.col(cap), F.greatest(F.lit(0), F.floor(even * (1 - slack) - 1))).cast("long"))
    x = x.withColumn("__high", F.when(even > 0, F.least(F.col(cap), F.ceil(even * (1 + slack) + 1))).otherwise(0).cast("long"))
    x = x.withColumn("__left", F.col(seats) - F.sum("__low").over(of))
    steps = F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))
    q = x.where("__high > __low").select(*keys, "party", "__left", F.col(weight).alias("__weight"), F.explode(steps).alias("__k"))
    q = q.withColumn("__rank", F.row_number().over(of.orderBy(F.desc(F.col("__weight") / (2 * F.col("__k") + 1)), "party", "__k")))
    won = q.where("__rank <= __left").groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("party").alias("__party")).agg(F.count(F.lit(1)).alias("__won"))
    on = F.col("party") == F.col("__party")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = x.join(won, on, "left")
    return out.select(*parties.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("quota"))


@dataclass(frozen=True)
class Plan:
    """sources: source, party, source_size, shards, target, quota. cells: source_party, cell, cell_size, times, rest, last (of the blocks taken once more), cut (tokens of the last)."""

    sources: DataFrame
    cells: DataFrame
    block: int


def block_words(tokens: float) -> int:
    """Tokens of a block for a mix of so many."""
    return max(1, min(BLOCK, int(tokens) // MIX_BLOCKS))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with party (1 in code-point order, null last), weight and target."""
    every = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("party", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("party") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("__cap", cap * F.col("source_size").cast("double"))
    order = every.orderBy(F.col("__cap") / F.col("weight"), "party")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("__level", level).withColumn("__rank", F.row_number().over(order))
    fits = F.when(F.col("__level") <= F.col("__cap") / F.col("weight"), F.struct("__rank", "__level"))
    ranked = ranked.withColumn("__at", F.min(fits).over(every)["__level"])
    return ranked.select("source", "source_size", "docs", "party", "weight", F.least(F.col("__cap"), F.coalesce(F.col("__at") * F.col("weight"), F.lit(0.0))).alias("target"))


def _cell(id_: Column, shards: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id_), shards)


def _block_rank(party: Column, cell: Column, block: Column, seed: int) -> Column:
    """The seeded order of a shard's blocks."""
    return F.struct(F.xxhash64(F.lit(seed + 2), party, cell, block).alias("h"), block.cast("long").alias("k"))


def selected(cells: DataFrame, block: int, cap: float, seed: int) -> DataFrame:
    """cells (source_party, cell, cell_size, quota) with times, rest, last and cut."""
    x = cells.withColumn("__tokens", F.least(F.col("quota") * block, F.floor(cap * F.col("cell_size"))))
    whole = F.greatest(F.lit(1), F.col("cell_size"))
    x = x.withColumn("times", F.floor(F.col("__tokens") / whole)).withColumn("rest", F.pmod(F.col("__tokens"), whole))
    blocks = x.where("rest > 0").select("source_party", "cell", "cell_size", "rest", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cell_size") - 1) / block))).alias("k"))
    size = F.least(F.lit(block), F.col("cell_size") - F.col("k") * block)
    blocks = blocks.select("source_party", "cell", "rest", _block_rank(F.col("source_party"), F.col("cell"), F.col("k"), seed).alias("rank"), size.alias("size"))
    order = Window.partitionBy("source_party", "cell").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).where("before < rest")
    last = blocks.groupBy(F.col("source_party").alias("__p"), F.col("cell").alias("__c")).agg(F.max("rank").alias("last"), F.max_by(F.least("size", F.col("rest") - F.col("before")), "rank").alias("cut"))
    out = x.join(last, (F.col("source_party") == F.col("__p")) & (F.col("cell") == F.col("__c")), "left")
    return out.select("source_party", "cell", "cell_size", "times", "rest", "last", "cut")


def planned(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int | None = None, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> Plan:
    """sizes: id, source, size, one row per document."""
    sources = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "source-sizes")
    block = block or block_words(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    sources = targets(sources, weights, share, cap).withColumn("shards", F.ceil(F.col("docs") / shard_rows).cast("long"))
    sources = sources.withColumn("__cap", F.ceil(cap * F.col("source_size") / block)).withColumn("__seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    sources = written(apportioned(sources, [], "target", "__cap", "__seats").drop("__cap", "__seats"), "sources")
    of = sized(sources.select(F.col("source").alias("__source"), F.col("party").alias("source_party"), "shards", F.col("quota").alias("__seats")))
    districts = F.ceil(F.sqrt(F.col("shards").cast("double"))).cast("long")
    cells = sizes.join(of, F.col("source").eqNullSafe(F.col("__source"))).groupBy("source_party", "__seats", districts.alias("__districts"), _cell(F.col("id"), F.col("shards"), seed).alias("cell")).agg(F.sum("size").cast("double").alias("cell_size"))
    cells = written(cells.withColumn("district", F.pmod("cell", "__districts")), "cell-sizes")
    parts = cells.groupBy("source_party", "__seats", F.col("district").alias("party")).agg(F.sum("cell_size").alias("size"))
    parts = apportioned(parts.withColumn("__cap", F.ceil(cap * F.col("size") / block)), ["source_party"], "size", "__cap", "__seats")
    parts = sized(written(parts.select(F.col("source_party").alias("__p"), F.col("party").alias("__d"), F.col("quota").alias("__given")), "districts"))
    cells = cells.join(parts, (F.col("source_party") == F.col("__p")) & (F.col("district") == F.col("__d"))).select("source_party", "district", F.col("cell").alias("party"), "cell_size", "__given")
    cells = apportioned(cells.withColumn("__cap", F.ceil(cap * F.col("cell_size") / block)), ["source_party", "district"], "cell_size", "__cap", "__given")
    cells = cells.select("source_party", F.col("party").alias("cell"), F.col("cell_size").cast("long").alias("cell_size"), "quota")
    return Plan(sources, written(selected(cells, block, cap, seed), "cells"), block)


def taken(docs: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """docs (id, source, size and more) with source_size, target, taken, times (as a whole) and parts: begin and length of the runs of its words that are taken once more."""
    of = sized(plan.sources.select(F.col("source").alias("__source"), "source_size", "target", F.col("party").alias("__party"), "shards"))
    x = docs.join(of, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__cell", _cell(F.col("id"), F.col("shards"), seed))
    cells = sized(plan.cells.select(F.col("source_party").alias("__of"), F.col("cell").alias("__at"), "times", "last", "cut"))
    x = x.join(cells, (F.col("__party") == F.col("__of")) & (F.col("__cell") == F.col("__at")))
    order = Window.partitionBy("__party", "__cell").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__a", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("__b", F.col("__a") + F.col("size"))
    block = F.lit(plan.block).cast("long")

    def of_block(k: Column) -> Column:
        """The document's words that the block brings."""
        rank = _block_rank(F.col("__party"), F.col("__cell"), k, seed)
        words = F.when(rank < F.col("last"), block).when(rank == F.col("last"), F.col("cut")).otherwise(0)
        begin = F.greatest(k * block, F.col("__a"))
        return F.struct((begin - F.col("__a")).alias("begin"), (F.least(k * block + words, F.col("__b")) - begin).cast("long").alias("length"))

    blocks = F.when((F.col("size") > 0) & F.col("last").isNotNull(), F.sequence(F.floor(F.col("__a") / block), F.floor((F.col("__b") - 1) / block)))
    found = F.filter(F.transform(blocks, of_block), lambda p: p["length"] > 0)

    def joined(done: Column, p: Column) -> Column:
        """Neighbouring blocks are one run."""
        end = F.get(done, F.size(done) - 1)
        longer = F.struct(end["begin"].alias("begin"), (end["length"] + p["length"]).alias("length"))
        follows = F.coalesce(end["begin"] + end["length"] == p["begin"], F.lit(False))
        return F.when(follows, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(p)))

    none = F.array().cast("array<struct<begin:bigint,length:bigint>>")
    x = x.withColumn("parts", F.coalesce(F.aggregate(found, none, joined), none))
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"])
    x = x.withColumn("taken", (F.col("size") * F.col("times") + more).cast("long"))
    return x.select(*docs.columns, "source_size", "target", "taken", "times", "parts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null texts count no words; null is a source of its own, last in order. Of
    repeated rows each is taken for itself; rows with one id, or none, share a
    shard. No words at all: every target is 0. Only the three named columns are
    read, so others may have any name. Empty tables give no rows. Reruns agree;
    a source's words miss its target by about a block.
    """
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    out = taken(sizes, planned(sizes, weights, share, cap, block, shard_rows))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself, with the columns of docs: a document as often as it is taken whole, and each run of its words that is taken once more as a text of its own.

    Rows follow mix(): texts without words come once, as they are; repeated rows
    each for themselves; other columns are carried whatever their names. Empty
    tables give no rows.
    """
    columns = docs.columns
    x = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.struct(*columns).alias("row"))
    plan = planned(written(x.select("id", "source", "size"), "sizes"), weights, share, cap)
    x = taken(x, plan)
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(F.lit(1)).cast("int")
    every = F.lit(None).cast("struct<begin:bigint,length:bigint>")
    x = x.select("row", F.explode(F.concat(F.array_repeat(every, times), F.col("parts"))).alias("part"))
    words = F.regexp_extract_all(F.col("row")[text_col], F.lit(f"({NOT_WS})(?:{WS})?"), F.lit(0))
    text = F.when(F.col("part").isNotNull(), F.array_join(F.slice(words, (F.col("part.begin") + 1).cast("int"), F.col("part.length").cast("int")), "")).otherwise(F.col("row")[text_col])
    out = x.select("row", text.alias("text"))
    by = {text_col: F.col("text")} | ({chars_col: F.length("text").cast(docs.schema[chars_col].dataType)} if chars_col in columns else {})
    return out.select(*[by.get(c, F.col("row")[c]).alias(c) for c in columns])
