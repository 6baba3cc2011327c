"""Shards by balanced label propagation: linked documents meet, and every shard gets as many rows.

Links join documents with equal texts; a group's clique is kept as the group's
vote, so no pair is made. Groups larger than a shard are dealt to parts, each
propagated as a group of its own (a group larger than a shard must be cut
somewhere). Each document starts in a shard by hash. In a round every unsettled
group votes: the shard with room that holds most of its documents attracts the
rest, groups are admitted to a shard in seeded order while its quota lasts, and
what was not admitted votes again, until all are settled or none fits any shard.
A shard that was asked always admits the first in its order, so every round
settles a group and the rounds end. Groups of more than LARGE of a shard choose
before the others, while there is room for them. The rest of the rows, which no
link ties, then fills every shard to its quota, so counts are at most one apart.

Votes are (group, shard) counts, aggregated before they are shuffled. Places in a
shard come from two-level running sums, so no task holds a shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, running_sum, sized, written

SHARDS = 24
SEED = 29
#: Share of a shard beyond which a group chooses first.
LARGE = 1 / 16


def _ordered(h: Column, buckets: int) -> Column:
    """The bucket of an unsigned 63-bit hash; it does not decrease with the hash."""
    return F.least(F.lit(buckets - 1), F.floor(h / F.lit(float(1 << 63)) * buckets)).cast("long")


def _hash(seed: int, *cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 1)


def _buckets(df: DataFrame, most: int) -> int:
    """Buckets of a key with at most `most` rows: they bound a task's rows, and let the largest key use every task."""
    return max(buckets_for(most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _settled(units: DataFrame, votes: DataFrame, room: dict[int, int], shards: int, seed: int) -> DataFrame:
    """unit, shard for each group that finds a shard with room, of which it takes its part. units: unit, rows; votes: unit, at, n."""
    done: DataFrame | None = None
    left, n = units, units.count()
    while n and any(v > 0 for v in room.values()):
        # every shard with room may attract; without neighbours there it has no votes
        free = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(v).cast("long").alias("room")) for k, v in room.items() if v > 0])
        near = left.join(votes, "unit").select("unit", "rows", "at", "n")
        anywhere = left.select("unit", "rows", F.explode(free).alias("f")).select("unit", "rows", F.col("f.at").alias("at"), F.lit(0).cast("long").alias("n"), "f.room")
        table = sized(anywhere.select(F.col("at").alias("__at"), "room").distinct().limit(shards), shards)
        near = near.join(table, F.col("at") == F.col("__at")).select("unit", "rows", "at", "n", "room")
        fits = near.union(anywhere).where("rows <= room")
        # more votes first, then more room, then the seeded order
        best = F.max_by("at", F.struct(F.col("n"), F.col("room"), F.xxhash64(F.lit(seed), "unit", "at")))
        wish = written(fits.groupBy("unit", "rows").agg(best.alias("at"), F.max("room").alias("__r")).select("unit", "rows", "at", _hash(seed + 1, "unit").alias("h")), "wishes")
        placed = running_sum(wish, ["at"], _ordered(F.col("h"), _buckets(left, n)), [F.col("h"), F.col("unit")], {"before": F.col("rows")}, "admission")
        limit = F.element_at(F.array(*[F.lit(room[k]).cast("long") for k in range(shards)]), F.col("at") + 1)
        got = written(placed.where(F.col("before") + F.col("rows") <= limit).select("unit", F.col("at").alias("shard"), "rows"), "settled")
        for r in got.groupBy("shard").agg(F.sum("rows").alias("n")).collect():  # at most one row per shard
            room[r["shard"]] -= r["n"]
        settled = got.select("unit", "shard")
        done = settled if done is None else done.union(settled)
        left = written(left.join(settled, "unit", "left_anti"), "unsettled")
        before, n = n, left.count()
        if n == before:
            break
    return done if done is not None else units.select("unit", F.lit(0).alias("shard")).limit(0)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; the law is `rows`.

    size: UTF-8 bytes of the text and 8; a null text has no bytes and no links.
    Repeated rows are rows of one group, and those with one id share a bucket of
    the running sums. Null ids are placed by their text. Of groups that fit, none
    is cut while a shard has room for it. Only the two named columns are read,
    so others may have any name. Empty tables give no rows. Reruns agree.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.unhex(F.sha2(raw, 256))).alias("group"),
    )
    rows = written(rows.withColumn("h", _hash(seed, "doc_id", "text_crc32", "size")), "rows")
    total = rows.count()
    capacity = total // shards
    part = max(1, capacity - 4 * math.isqrt(capacity))  # parts are dealt by hash, and so vary by a root
    groups = rows.where("group is not null").groupBy("group").count().where("count > 1")
    groups = written(groups.select(F.col("group").alias("__group"), F.when(F.col("count") <= capacity, 1).otherwise(F.ceil(F.col("count") / part)).cast("long").alias("__parts")), "groups")
    linked = rows.join(sized(groups), F.col("group") == F.col("__group"), "left")
    unit = F.when(F.col("__parts").isNotNull(), F.xxhash64("__group", F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id"), F.col("__parts"))))
    linked = written(linked.select("doc_id", "size", "text_crc32", "h", unit.alias("unit")), "linked")
    votes = written(linked.where("unit is not null").groupBy("unit", F.pmod(F.xxhash64(F.lit(seed + 3), "doc_id"), F.lit(shards)).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n")), "votes")
    units = written(votes.groupBy("unit").agg(F.sum("n").alias("rows")), "units")
    # groups that take much of a shard choose before shards fill up
    room = dict.fromkeys(range(shards), capacity)
    large = F.col("rows") > LARGE * capacity
    settled = _settled(units.where(large), votes, room, shards, seed).union(_settled(units.where(~large), votes, room, shards, seed))
    settled = sized(written(settled.select(F.col("unit").alias("__unit"), F.col("shard").cast("int").alias("home")), "homes"))
    x = linked.join(settled, F.col("unit") == F.col("__unit"), "left").select("doc_id", "size", "text_crc32", "h", "home")
    x = written(x, "homed")
    own = {r["home"]: r["n"] for r in x.where("home is not null").groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per shard
    x = running_sum(x, ["home"], _ordered(F.col("h"), _buckets(x, max([total - sum(own.values()), *own.values()]))), [F.col("h"), F.col("doc_id"), F.col("size")], {"place": F.lit(1)}, "places")
    # what has no home fills the shards one after the other
    to, slot = F.col("home"), F.col("place")
    begin = 0
    for k in range(shards):
        free = capacity + (k < total % shards) - own.get(k, 0)
        here = F.col("home").isNull() & (F.col("place") >= begin) & (F.col("place") < begin + free)
        to = F.when(here, F.lit(k)).otherwise(to)
        slot = F.when(here, F.col("place") - begin + own.get(k, 0)).otherwise(slot)
        begin += free
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), to.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
