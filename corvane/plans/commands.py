"""The commands: audit, evaluate, improve, evaluate-reranker, predict and validate over a folder of relations.

A folder holds train.parquet, queries.parquet (with query_id) and items.parquet.
Only configuration, scalar results and per-query deltas come to the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import behavior, candidates, evaluation, features, lexical, model, packed, validation
from ..operators.candidates import Settings
from ..sources import io as sources
from ..sources.schema import QUERY_COLUMNS
from .retrieval import Behavior, Index, Keep, Limits, improved_features

# The grid of the first search.
GRID = {"char": [0.55, 0.8, 1.05], "filter": [0.0, 0.18], "history": [0.0, 0.25, 0.6, 0.95], "category": [0.05, 0.14], "location": [0.02, 0.1, 0.3, 0.7]}
#: Our own options, a small grid around the selected settings.
OPTIONS = {"exact_rescore": [False, True], "pool": [120, 240, 300], "geo_neighbors": [3, 5]} | {f"weight:{n}": v for n, v in {"char": [0.35, 0.75, 1.05], "location": [0.06, 0.3, 0.7], "title": [0.0, 0.4], "microcat": [0.0, 0.4]}.items()}


@dataclass(frozen=True)
class RerankerConfig:
    """Checked when made: folds that train or are compared must be outside their own history."""

    schema: str = "metadata"
    modulus: int = 5
    training_fold: int = 2
    training_excluded: tuple[int, ...] = (2, 3, 4)
    evaluation_folds: tuple[int, ...] = (3, 4)
    evaluation_excluded: dict[int, tuple[int, ...]] = field(default_factory=lambda: {3: (3, 4), 4: (4,)})
    training_units: int = 6_000
    evaluation_units: int = 600
    hard: int = 200
    random: int = 50
    weight_numerator: float = 100.0
    blend: float = 0.2
    query_smoothing: float = 3.0
    microcat_smoothing: float = 20.0
    boosting: model.Boosting = model.Boosting()
    seed: str = "units"
    #: The pool that the candidates are compared with: every one of its candidates must be among them.
    baseline: Settings = Settings(exact_rescore=True, geo_neighbors=3, pool=120)
    #: Hashes of the units to be evaluated, by fold. A fold without one is only recorded.
    unit_hashes: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.schema not in ("locality", "metadata"):
            raise ValueError(f"schema {self.schema!r} needs features that these commands do not make")
        if self.training_fold not in self.training_excluded:
            raise ValueError("the training fold is in its own history")
        if {*self.evaluation_folds} - {*self.training_excluded}:
            raise ValueError("a fold that is evaluated is in the training history")
        for fold in self.evaluation_folds:
            if fold == self.training_fold or fold not in self.evaluation_excluded.get(fold, ()):
                raise ValueError(f"fold {fold} is in its own history or trains the model")
        if min(self.training_units, self.evaluation_units, self.hard) < 1 or self.random < 0 or not 0 <= self.blend <= 1:
            raise ValueError("counts must be positive and the blend within 0 and 1")


@dataclass
class Problem:
    """One fold: its units with qid, the history without them, and the candidate rows."""

    units: DataFrame
    past: DataFrame
    index: Index
    log: Behavior
    rows: DataFrame


def _keeper(spark: SparkSession) -> Keep:
    return lambda frame, name: sources.written(frame, name)


def _with_qid(units: DataFrame) -> DataFrame:
    return units.withColumn("qid", text.stable_rank("unit", *[F.col(c) for c in QUERY_COLUMNS]))


def fold_problem(frames: sources.Frames, fold: int, excluded: tuple[int, ...], limit: int | None, limits: Limits, modulus: int = 5, seed: str = "units", index: Index | None = None) -> Problem:
    """Raises AssertionError if a held-out text is in the history or the history lacks a fold it should hold."""
    keep = _keeper(frames.train.sparkSession)
    units = keep(_with_qid(evaluation.sample_units(evaluation.query_units(frames.train, fold, modulus), limit, seed)), "units")
    past = keep(evaluation.history_without(frames.train, list(excluded), modulus), "past")
    evaluation.assert_cold(units, past)
    evaluation.assert_folds(past, list(excluded), modulus)
    index = index or Index(keep(evaluation.union_catalog(frames.items, frames.train), "catalog"), limits, keep)
    log = Behavior(index, past)
    return Problem(units, past, index, log, keep(improved_features(units, index, log), "rows"))


def prepared(problem: Problem, settings: Settings, config: RerankerConfig) -> DataFrame:
    """The reranker's features of the eligible rows."""
    keep, log, index, units = problem.index.keep, problem.log, problem.index, problem.units
    mean = behavior.mean_locality(problem.past)
    near = log.near_keys(units, log.microcats, index.limits.microcat_neighbors)
    local = behavior.query_locality(units, near, behavior.locality(log.train, "key", config.query_smoothing), mean)
    rows = features.with_locality(candidates.scored(problem.rows, settings), index.items, local, behavior.locality(problem.past, "item_microcat_id", config.microcat_smoothing), mean)
    rows = keep(features.row_matrix(rows), "matrix")
    if config.schema == "locality":
        return rows
    meta = features.metadata(rows, units, index.items, features.location_centers(index.items))
    terms = index.query_words(units).select(F.col("doc").alias("qid"), "term").join(index.vocabulary.select("term", "idf"), "term")
    cover = packed.coverage(rows, terms, index.word_vectors, index.title_vectors)
    size = lexical.vocabulary_sizes(index.word_vectors.sizes(), index.items).select("item_id", lexical.length_norm(F.col("nnz"), F.col("median")).alias("word_vocab_bm25_length_norm"))
    return keep(rows.join(meta, ["qid", "item_id"]).join(cover, ["qid", "item_id"]).join(size, "item_id"), "prepared")


def audit(spark: SparkSession, data_dir: str) -> dict:
    f = sources.load_frames(spark, data_dir)
    stats = lambda frame: {"fingerprint": sources.table_fingerprint(frame), "nulls": {r["column"]: r["nulls"] for r in validation.null_counts(frame).collect()}}
    return {"frames": {n: stats(getattr(f, n)) for n in ("train", "queries", "items")}, "ids": validation.id_audit(f.train, f.queries, f.items).first().asDict()}


def evaluate(spark: SparkSession, data_dir: str, limit: int | None = 600, limits: Limits = Limits(), options: dict[str, list[float]] | None = None, tune: int = 0, confirm: int = 1) -> dict:
    """The best weighting of a grid on one fold, and its recall on another that saw neither."""
    f = sources.load_frames(spark, data_dir)
    first = fold_problem(f, tune, (tune, confirm), limit, limits)
    base = Settings().weights
    trials = evaluation.grid(base, options or GRID)
    found = evaluation.grid_recalls(first.rows, first.units, trials, list(base), limits.top_k).collect()  # one row per weighting
    best = min(found, key=lambda r: (-r["recall"], sorted(trials[r["trial"]].items())))
    chosen = trials[best["trial"]]
    second = fold_problem(f, confirm, (tune, confirm), limit, limits, index=first.index)
    ablations = [chosen] + [chosen | {n: 0.0} for n in ("char", "filter", "history", "category", "location", "popularity")]
    confirmed = {r["trial"]: r["recall"] for r in evaluation.grid_recalls(second.rows, second.units, ablations, list(base), limits.top_k).collect()}
    names = ["all", "char", "filter", "history", "category", "location", "popularity"]
    return {"selected_weights": chosen, "tune_recall": best["recall"], "confirm_recall": confirmed[0], "without": {n: confirmed[k] for k, n in enumerate(names) if k}}


def improve(spark: SparkSession, data_dir: str, limit: int | None = 600, limits: Limits = Limits(pool=300, geo=(3, 5)), options: dict[str, list] | None = None, folds: tuple[int, int] = (2, 3), passes: int = 3, least: int = 50) -> dict:
    """Settings by coordinates on one fold under the slice guard, compared with the first settings on another."""
    f = sources.load_frames(spark, data_dir)
    tune = fold_problem(f, folds[0], folds, limit, limits)
    tuned = evaluation.coordinate_tune(tune.rows, tune.units, evaluation.unit_slices(tune.units, tune.past, tune.index.items), Settings(), options or OPTIONS, passes, least, top_k=limits.top_k)
    other = fold_problem(f, folds[1], folds, limit, limits, index=tune.index)
    compared = sources.written(evaluation.comparison(evaluation.settings_recalls(other.rows, other.units, Settings(), limits.top_k), evaluation.settings_recalls(other.rows, other.units, tuned.settings, limits.top_k)), "compared")
    row = evaluation.wins_losses(compared).first().asDict()
    deltas = np.array([r["delta"] for r in compared.select("delta").orderBy("qid").collect()])  # at most `limit` rows
    return {"selected_settings": asdict(tuned.settings), "tune_recall": tuned.recall, "trials": tuned.trials, "comparison": row, "interval": evaluation.paired_bootstrap(deltas) if len(deltas) else None}


def train_reranker(frames: sources.Frames, settings: Settings, config: RerankerConfig, limits: Limits) -> tuple[PipelineModel, Index]:
    problem = fold_problem(frames, config.training_fold, config.training_excluded, config.training_units, limits, config.modulus, config.seed)
    rows = features.labelled(prepared(problem, settings, config), problem.units, config.weight_numerator)
    return model.train(sources.written(features.sampled(rows, config.hard, config.random), "sample"), config.schema, config.boosting), problem.index


def evaluate_reranker(spark: SparkSession, data_dir: str, settings: Settings = Settings(exact_rescore=True), config: RerankerConfig = RerankerConfig(), limits: Limits = Limits()) -> dict:
    """Trains on one fold, compares blended and linear answers on others, and passes or fails the gate."""
    frames = sources.load_frames(spark, data_dir)
    fitted, index = train_reranker(frames, settings, config, limits)
    strata, means, floors, hashes, universes = [], [], {}, {}, {}
    sums = np.zeros(2)
    contract = True
    for fold in config.evaluation_folds:
        p = fold_problem(frames, fold, config.evaluation_excluded[fold], config.evaluation_units, limits, config.modulus, config.seed, index)
        rows = prepared(p, settings, config)
        linear = sources.written(candidates.answers(rows, p.units, index.items, limits.top_k), "linear")
        blended = sources.written(model.ranked(rows, p.units, index.items, fitted, config.schema, config.blend, limits.top_k), "blended")
        compared = sources.written(evaluation.comparison(evaluation.recalls(linear, p.units), evaluation.recalls(blended, p.units)).join(p.units.select("qid", "search_query"), "qid"), "compared")
        strata.append(evaluation.cluster_sums(compared, text.normalize_text(F.col("search_query"))))
        sums += strata[-1].sum(axis=0) if len(strata[-1]) else 0
        means.append(evaluation.wins_losses(compared).first()["mean_delta"] or 0.0)
        slices = evaluation.unit_slices(p.units, p.past, index.items, by_count=True)
        for r in evaluation.slice_means(compared, slices, "delta").where("queries >= 50").collect():  # a dozen slices
            floors[f"{fold}:{r['slice']}"] = r["mean"]
        base = sources.written(candidates.scored(p.rows, config.baseline).select("qid", "item_id"), "baseline")
        contract &= evaluation.missing_candidates(base, rows) == 0
        universes[fold] = {"baseline": evaluation.universe_hash(base), "candidate": evaluation.universe_hash(rows)}
        hashes[fold] = evaluation.ordered_hash(p.units, QUERY_COLUMNS).first()["sha256"]
    interval = evaluation.cluster_bootstrap([s for s in strata if len(s)], 2_000) if any(map(len, strata)) else (0.0, 0.0)
    pooled = float(sums[0] / sums[1]) if sums[1] else 0.0
    known = all(hashes.get(fold) == expected for fold, expected in config.unit_hashes.items())
    gate = evaluation.gate(means, pooled, interval[0], floors, contract, known)
    return {
        "fold_deltas": means, "pooled_delta": pooled, "interval": interval, "slices": floors, "unit_hashes": hashes, "candidate_universes": universes, "gate": gate,
        "selected_settings": asdict(settings), "reranker": asdict(config),
    }


def reranker_of(report: dict | None) -> RerankerConfig:
    """The reranker that a report was made with, so that what is used is what passed."""
    if not report or "reranker" not in report:
        return RerankerConfig()
    return reranker_config(report["reranker"])


def reranker_config(given: dict) -> RerankerConfig:
    """From JSON, where the keys of maps are text. Unknown names raise."""
    made = dict(given)
    for name in ("evaluation_excluded", "unit_hashes"):
        if name in made:
            made[name] = {int(k): tuple(v) if isinstance(v, list) else v for k, v in made[name].items()}
    for name in ("training_excluded", "evaluation_folds"):
        if name in made:
            made[name] = tuple(made[name])
    if "baseline" in made:
        made["baseline"] = Settings(**made["baseline"])
    if "boosting" in made:
        made["boosting"] = model.Boosting(**made["boosting"])
    return RerankerConfig(**made)


def settings_of(report: dict | None) -> Settings:
    """The settings that a report selected, or its weights, or the first ones."""
    if not report:
        return Settings()
    if "selected_settings" in report:
        return Settings(**report["selected_settings"])
    return replace(Settings(), weights=Settings().weights | report.get("selected_weights", {}))


def reranker_enabled(report: dict | None) -> bool:
    """Only a report whose gate passed turns the reranker on."""
    return bool(report and report.get("gate", {}).get("pass"))


def predict(spark: SparkSession, data_dir: str, output: str, report: dict | None = None, config: RerankerConfig | None = None, limits: Limits = Limits()) -> dict:
    """Answers of the queries as CSV, validated after they were written; behavior is that of the whole log."""
    frames = sources.load_frames(spark, data_dir)
    settings = settings_of(report)
    keep = _keeper(spark)
    queries = frames.queries.withColumnRenamed("query_id", "qid")
    index = Index(keep(evaluation.keep_first(frames.items), "catalog"), limits, keep)
    log = Behavior(index, frames.train)
    problem = Problem(queries, frames.train, index, log, keep(improved_features(queries, index, log), "rows"))
    if config and reranker_enabled(report):
        fitted, _ = train_reranker(frames, settings, config, limits)
        ranked = model.ranked(prepared(problem, settings, config), queries, index.items, fitted, config.schema, config.blend, limits.top_k)
    else:
        ranked = candidates.answers(candidates.scored(problem.rows, settings), queries, index.items, limits.top_k)
    sources.write_answer(sources.answer_rows(ranked).withColumnRenamed("qid", "query_id"), output)
    checked = validate(spark, data_dir, output)
    if not checked["valid"]:
        raise ValueError(f"the written answer is not valid: {checked['errors']}")
    return checked


def validate(spark: SparkSession, data_dir: str, answer: str) -> dict:
    frames = sources.load_frames(spark, data_dir)
    return validation.validate_answer(sources.read_answer(spark, answer), frames.queries, frames.items)
