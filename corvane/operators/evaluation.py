"""Evaluation without leaks: query units, folds, recall, slices, tuning, bootstraps and the release gate."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, stable_fold, stable_rank, tokens
from ..sources.schema import QUERY_COLUMNS
from .behavior import keyed
from .candidates import Settings, linear_score, masks
from .lexical import together, top


def with_fold(frame: DataFrame, modulus: int = 5, unicode: bool = True) -> DataFrame:
    """With key and fold; a frame that has fold_<modulus>, the fold of its texts, is taken at its word."""
    if (known := f"fold_{modulus}") in frame.columns:
        return frame.withColumn("fold", F.col(known))
    return keyed(frame, lambda c: normalize_text(c, unicode)).withColumn("fold", stable_fold(F.col("key"), modulus))


def query_units(train: DataFrame, fold: int, modulus: int = 5, unicode: bool = True) -> DataFrame:
    """The search columns and relevant_items (sorted, distinct) of one fold; null search columns make groups of their own."""
    t = with_fold(train, modulus, unicode).where(F.col("fold") == fold)
    return t.groupBy(*QUERY_COLUMNS).agg(F.sort_array(F.collect_set("item_id")).alias("relevant_items"))


def history_without(train: DataFrame, folds: list[int], modulus: int = 5, unicode: bool = True) -> DataFrame:
    return with_fold(train, modulus, unicode).where(~F.col("fold").isin(folds)).drop("fold")


def leaked_texts(units: DataFrame, history: DataFrame, unicode: bool = True) -> int:
    """Held-out query texts that the history holds too."""
    keys = lambda x: keyed(x.select("key" if "key" in x.columns else "search_query").distinct(), lambda c: normalize_text(c, unicode)).select("key").distinct()
    return keys(units).join(keys(history), "key", "left_semi").count()


def assert_cold(units: DataFrame, history: DataFrame, unicode: bool = True) -> None:
    if n := leaked_texts(units, history, unicode):
        raise AssertionError(f"{n} held-out query texts are in the history")


def assert_folds(history: DataFrame, excluded: list[int], modulus: int = 5, unicode: bool = True) -> None:
    held = next(c for c in (f"fold_{modulus}", "key", "search_query") if c in history.columns)
    present = {r["fold"] for r in with_fold(history.select(held).distinct(), modulus, unicode).select("fold").distinct().collect()}  # at most modulus rows
    if present != {*range(modulus)} - {*excluded}:
        raise AssertionError(f"the history holds folds {sorted(present)}")


def sample_units(units: DataFrame, limit: int | None, seed: str, without: DataFrame | None = None, unicode: bool = True, strict: bool = False) -> DataFrame:
    """The first `limit` units by a seeded hash of their search columns; texts of `without` (key) are left out before."""
    u = units
    if without is not None:
        u = u.withColumn("key", normalize_text(F.col("search_query"), unicode)).join(without.select("key").distinct(), "key", "left_anti").drop("key")
    if not limit:
        return u
    if strict and (n := u.count()) < limit:
        raise ValueError(f"{n} fresh units are too few for {limit}")
    order = stable_rank(seed, *[F.col(c) for c in QUERY_COLUMNS])
    return u.withColumn("__rank", order).orderBy("__rank").limit(limit).drop("__rank")


def recalls(predicted: DataFrame, units: DataFrame) -> DataFrame:
    """qid, hits, relevant, recall; a query without truth or answers has 0. predicted: qid, item_id."""
    found = predicted.groupBy("qid").agg(F.collect_set("item_id").alias("found"))
    x = units.select("qid", F.array_distinct("relevant_items").alias("truth")).join(found, "qid", "left")
    hits = F.when(F.col("found").isNull(), 0).otherwise(F.size(F.array_intersect("found", "truth")))
    n = F.size("truth")
    return x.select("qid", hits.alias("hits"), n.alias("relevant"), F.when(n > 0, hits / n).otherwise(0.0).alias("recall"))


def macro_recall(each: DataFrame) -> DataFrame:
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"))


def unit_slices(units: DataFrame, history: DataFrame, items: DataFrame, unicode: bool = True, by_count: bool = False) -> DataFrame:
    """qid and the slices as booleans; by_count: also by the number of relevant items, as a reranker is judged."""
    n = history.where("search_location_id is not null").groupBy("search_location_id").agg(F.count(F.lit(1)).alias("n"))
    half = F.broadcast(n.agg(F.coalesce(F.median("n"), F.lit(0.0)).alias("half")))  # one row
    seen = history.select("item_id").distinct().withColumn("seen", F.lit(True))
    parts = units.select("qid", "search_location_id", F.explode_outer("relevant_items").alias("item_id")).join(seen, "item_id", "left").join(items.select("item_id", "item_location_id"), "item_id", "left")
    every = parts.groupBy("qid").agg(
        F.every(F.col("seen").isNotNull()).alias("all_seen"),
        F.every(F.coalesce(F.col("item_location_id") == F.col("search_location_id"), F.lit(False))).alias("all_local"),
    )
    x = units.join(n, "search_location_id", "left").join(half).join(every, "qid")
    empty = normalize_text(F.col("search_infm_params_text"), unicode) == ""
    one = F.size(tokens(normalize_text(F.col("search_query"), unicode))) <= 1
    rare = F.coalesce("n", F.lit(0)) < F.col("half")
    broad = F.coalesce(F.col("search_category") == 0, F.lit(False))
    pairs = {
        "filter_empty": empty, "filter_present": ~empty, "category_global": broad, "category_scoped": ~broad, "query_one_token": one, "query_multi_token": ~one,
        "location_rare": rare, "location_common": ~rare, "relevant_all_history_seen": F.col("all_seen"), "relevant_has_unseen": ~F.col("all_seen"),
        "relevant_all_exact_location": F.col("all_local"), "relevant_has_cross_location": ~F.col("all_local"),
    }
    if by_count:
        single = F.size(F.array_distinct("relevant_items")) == 1
        pairs |= {"relevant_one": single, "relevant_multiple": ~single}
    return x.select("qid", *[c.alias(k) for k, c in pairs.items()])


def slice_means(values: DataFrame, slices: DataFrame, value: str = "recall") -> DataFrame:
    """slice, queries, mean: all slices in one pass; a slice without queries has mean 0."""
    names = [c for c in slices.columns if c != "qid"]
    long = values.join(slices, "qid").select(value, F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(n).alias("in")) for n in names])).alias("s"))
    inside = F.col("s.in")
    return long.groupBy(F.col("s.slice").alias("slice")).agg(F.count_if(inside).alias("queries"), F.coalesce(F.avg(F.when(inside, F.col(value))), F.lit(0.0)).alias("mean"))


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """qid, before, after, delta of two recall tables."""
    b = before.select("qid", F.col("recall").alias("before"))
    return b.join(after.select("qid", F.col("recall").alias("after")), "qid").withColumn("delta", F.col("after") - F.col("before"))


def wins_losses(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"), F.avg("delta").alias("mean_delta"))


def grid(base: dict[str, float], options: dict[str, list[float]]) -> list[dict[str, float]]:
    """Every combination over sorted names, on top of the base weights."""
    names = sorted(options)
    return [base | dict(zip(names, values, strict=True)) for values in itertools.product(*(options[n] for n in names))]


def grid_recalls(rows: DataFrame, units: DataFrame, trials: list[dict[str, float]], values: list[str], top_k: int = 50) -> DataFrame:
    """trial, recall of each weighting in one pass: the candidates are read once and scored under every weighting."""
    total = lambda w: F.round(sum((F.lit(float(w.get(v, 0.0))) * F.col(v) for v in values), F.lit(0.0)), 9)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), total(w).alias("s")) for k, w in enumerate(trials)]))
    long = rows.select("qid", "item_id", each.alias("t")).select("qid", "item_id", "t.trial", "t.s")
    best = top(long, top_k, ["trial", "qid"], "s")
    # the sizes are a table of their own: beside the exploded items, the whole array would be counted again for each of them
    truth = units.select("qid", F.explode(F.array_distinct("relevant_items")).alias("item_id"))
    sizes = units.groupBy("qid").agg(F.max(F.size(F.array_distinct("relevant_items"))).alias("n"))
    hits = best.join(truth, ["qid", "item_id"]).groupBy("trial", "qid").agg(F.count(F.lit(1)).alias("h")).join(sizes, "qid").select("trial", (F.col("h") / F.col("n")).alias("r"))
    n = F.broadcast(units.agg(F.count(F.lit(1)).alias("units")))  # one row
    names = rows.sparkSession.range(len(trials)).select(F.col("id").cast("int").alias("trial"))
    return names.join(hits.groupBy("trial").agg(F.sum("r").alias("r")), "trial", "left").join(n).select("trial", (F.coalesce("r", F.lit(0.0)) / F.col("units")).alias("recall"))


def settings_recalls(rows: DataFrame, units: DataFrame, settings: Settings, top_k: int = 50) -> DataFrame:
    m = masks(rows.columns, settings.pool, settings.geo_neighbors)
    best = top(rows.where(m["eligible"]).select("qid", "item_id", linear_score(rows.columns, settings).alias("s")), top_k, score="s")
    return recalls(best, units)


@dataclass(frozen=True)
class Tuned:
    settings: Settings
    recall: float
    trials: list[dict]
    floor: float


def coordinate_tune(rows: DataFrame, units: DataFrame, slices: DataFrame, start: Settings, options: dict[str, list], passes: int = 3, least: int = 50, floor: float = -0.02, top_k: int = 50) -> Tuned:
    """One setting at a time: the option with the largest recall that no guarded slice pays for by more than the floor.

    rows should be cached or written: every trial is one job over them. Only
    recalls of the units come to the driver, and equal settings are tried once.
    """
    memory: dict[str, dict[str, float]] = {}
    names = [c for c in slices.columns if c != "qid"]

    def means(s: Settings) -> dict[str, float]:
        key = repr((sorted(s.weights.items()), s.exact_rescore, s.geo_neighbors, s.pool))
        if key not in memory:
            r = settings_recalls(rows, units, s, top_k).join(slices, "qid")
            row = r.agg(F.avg("recall").alias("all"), *[F.avg(F.when(F.col(n), F.col("recall"))).alias(n) for n in names]).first()
            memory[key] = {k: v or 0.0 for k, v in row.asDict().items()}
        return memory[key]

    sizes = slices.agg(*[F.count_if(F.col(n)).alias(n) for n in names]).first().asDict()
    guarded = [n for n in names if sizes[n] >= least]
    first = means(start)
    lowest = lambda s: min((means(s)[n] - first[n] for n in guarded), default=0.0)
    now, trials = start, []
    for number in range(passes):
        for name, values in options.items():
            best, recall = now, means(now)["all"] if lowest(now) >= floor - 1e-12 else -1.0
            for value in values:
                trial = replace(now, weights=now.weights | {name.removeprefix("weight:"): float(value)}) if name.startswith("weight:") else replace(now, **{name: value})
                r, low = means(trial)["all"], lowest(trial)
                trials.append({"pass": number + 1, "parameter": name, "value": value, "recall": r, "eligible": low >= floor - 1e-12, "floor": low})
                if low >= floor - 1e-12 and r > recall + 1e-12:
                    best, recall = trial, r
            now = best
    return Tuned(now, means(now)["all"], trials, lowest(now))


def paired_bootstrap(deltas: np.ndarray, draws: int = 2_000, seed: int = 0) -> tuple[float, float]:
    """The 2.5 and 97.5 per cent quantiles of the mean of resampled deltas."""
    rng = np.random.default_rng(seed)
    means = deltas[rng.integers(0, len(deltas), (draws, len(deltas)))].mean(axis=1)
    return tuple(np.quantile(means, [0.025, 0.975]).tolist())


def cluster_sums(compared: DataFrame, key: Column) -> np.ndarray:
    """Sum and size of the deltas of each cluster, in order of the cluster; bounded by the evaluated units."""
    rows = compared.groupBy(key.alias("key")).agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("key").collect()
    return np.array([[r["s"], r["n"]] for r in rows], dtype=float).reshape(-1, 2)


def cluster_bootstrap(strata: list[np.ndarray], draws: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """Clusters resampled within each stratum; each draw is the ratio of summed deltas to summed sizes."""
    rng = np.random.default_rng(seed)
    estimates = np.empty(draws)
    for k in range(draws):
        total = sum((s[rng.integers(0, len(s), len(s))].sum(axis=0) for s in strata), np.zeros(2))
        estimates[k] = total[0] / total[1]
    return tuple(np.quantile(estimates, [0.025, 0.975]).tolist())


def gate(fold_deltas: list[float], pooled: float, low: float, slice_deltas: dict[str, float], contract: bool, hashes: bool, least: float = 0.003, floor: float = -0.02) -> dict[str, bool]:
    """Every check of a release, and whether all hold."""
    checks = {"folds": all(d > 0 for d in fold_deltas), "pooled": pooled >= least, "interval": low > 0, "slices": all(d >= floor for d in slice_deltas.values()), "contract": contract, "hashes": hashes}
    return checks | {"pass": all(checks.values())}


def ordered_hash(frame: DataFrame, columns: list[str]) -> DataFrame:
    """sha256 of the sorted rows' own hashes: the same for the same rows in any order. One 64-character hash per row is gathered; frame is a set of evaluated units or ids."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]), 256)
    return frame.select(row.alias("h")).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("sha256"), F.count(F.lit(1)).alias("rows"))


def missing_candidates(baseline: DataFrame, candidate: DataFrame) -> int:
    """Baseline candidates that the other set lacks; a comparison needs none."""
    return baseline.select("qid", "item_id").join(candidate.select("qid", "item_id"), ["qid", "item_id"], "left_anti").count()


def fresh_samples(units: DataFrame, rounds: int, limit: int, seed: str, unicode: bool = True) -> list[DataFrame]:
    """Samples whose texts no earlier sample holds."""
    out: list[DataFrame] = []
    used: DataFrame | None = None
    for k in range(rounds):
        s = sample_units(units, limit, f"{seed}-{k}", used, unicode)
        out.append(s)
        keys = s.select(normalize_text(F.col("search_query"), unicode).alias("key"))
        used = keys if used is None else together(used, keys)
    return out


def union_catalog(items: DataFrame, train: DataFrame) -> DataFrame:
    """The catalog and the log's other items; of an id, the catalog's row first, then the smallest of the log's."""
    columns = items.columns
    both = together(items.withColumn("__from", F.lit(0)), train.select(*columns).distinct().withColumn("__from", F.lit(1)))
    return both.groupBy("item_id").agg(F.min(F.struct("__from", *[c for c in columns if c != "item_id"])).alias("r")).select(*[F.col("item_id") if c == "item_id" else F.col(f"r.{c}").alias(c) for c in columns])


def keep_first(items: DataFrame) -> DataFrame:
    """One row of each item_id: the smallest in order of all other columns, so reruns agree."""
    columns = items.columns
    kept = items.groupBy("item_id").agg(F.min(F.struct(*[c for c in columns if c != "item_id"])).alias("r"))
    return kept.select(*[F.col("item_id") if c == "item_id" else F.col(f"r.{c}").alias(c) for c in columns])


def universe_hash(pairs: DataFrame, buckets: int = 1_024) -> str:
    """sha256 of a candidate universe: the sorted hashes of each bucket are hashed where they lie, then the buckets' own."""
    row = F.sha2(F.concat_ws("\x1f", "qid", "item_id"), 256)
    own = pairs.select(row.alias("h"), F.pmod(F.xxhash64("qid", "item_id"), F.lit(buckets)).alias("b")).groupBy("b").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    return own.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])), 256)).first()[0]
