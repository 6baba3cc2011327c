"""Small catalogs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import behavior, candidates, dense, evaluation, features, lexical, model, packed, validation
from corvane.plans.retrieval import Behavior, Index, Limits, improved_features, legacy_features
from corvane.sources import io, schema

ITEMS = [
    ("aaaaaaaaaaaaaaa1", "red bicycle", "sport", "a red bicycle for the city", 1, 10, 100.0), ("aaaaaaaaaaaaaaa2", "blue bicycle", "sport", "a blue bicycle", 1, 20, None),
    ("aaaaaaaaaaaaaaa3", "red car", "auto", "a fast red car", 2, 10, -5.0), ("aaaaaaaaaaaaaaa4", "green chair", "home", "chair", 3, 30, 7.0), ("aaaaaaaaaaaaaaa5", "", None, None, 3, 30, 7.0),
]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(t, 3.0, 4.0, price, micro, 10.0 * loc, loc, 5.0 * loc, True, None, params, i, d, micro) for i, t, params, d, micro, loc, price in ITEMS]
    return spark.createDataFrame(rows, schema.struct_of(schema.ITEM_FIELDS))


@pytest.fixture(scope="module")
def queries(spark):
    rows = [("q1", "Red bicycle!", 10, True, "sport", 1), ("q2", "chair", 99, False, "", 0), ("q3", "zzz", 30, False, None, 3)]
    return spark.createDataFrame(rows, "qid string, search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long")


@pytest.fixture(scope="module")
def train(spark, items):
    clicks = [("red bicycle", 10, 1, 1), ("red bicycle", 10, 1, 1), ("red bicycle", 10, 1, 2), ("chair", 30, 3, 4), ("bicycle", 20, 1, 2), (None, 20, 0, 3)]
    log = spark.createDataFrame([(q, l, True, "", c, f"aaaaaaaaaaaaaaa{n}") for q, l, c, n in clicks], "search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long, item_id string")
    return log.join(items, "item_id")


@pytest.fixture(scope="module")
def limits():
    return Limits(pool=5, min_df=1, fallback=2, top_k=3)


def table(frame, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in frame.collect()}


def test_idf_and_unit_weights(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, ["c"])], "id long, t array<string>")
    counts = lexical.term_counts(docs, "id", F.col("t"))
    v = lexical.vocabulary(counts, 3, min_df=1)
    assert table(v, "term", value="idf")[("a",)] == pytest.approx(math.log(4 / 3) + 1)
    assert {r["term"] for r in lexical.vocabulary(counts, 3, min_df=2).collect()} == {"a"}
    assert [r["term"] for r in lexical.vocabulary(counts, 3, 1, most=1).collect()] == ["a"]
    w = table(lexical.postings(counts, v), "doc", "term", value="w")
    assert w[(1, "a")] ** 2 + w[(1, "b")] ** 2 == pytest.approx(1) and w[(2, "a")] == w[(3, "c")] == 1
    raw = ((1 + math.log(2)) * (math.log(4 / 3) + 1), math.log(4 / 2) + 1)
    assert w[(1, "a")] == pytest.approx(raw[0] / math.hypot(*raw))


def test_word_search_and_its_ties(spark, items, queries, limits):
    index = Index(items, limits)
    got = lexical.nearest(index.query_words(queries), index.word_postings, 5).orderBy("qid", "rank").collect()
    first = [r["item_id"][-1] for r in got if r["qid"] == "q1"]
    assert first[0] == "1" and {*first} == {"1", "2", "3"} and [r["item_id"][-1] for r in got if r["qid"] == "q2"] == ["4"]
    assert not [r for r in got if r["qid"] == "q3"]
    tied = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "qid string, item_id string, score double")
    assert [(r["item_id"], r["rank"]) for r in lexical.top(tied, 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_behavior_tables(items, queries, train, limits):
    log = Behavior(Index(items, limits), train)
    prior = table(log.category_prior, "search_category", "item_category_id", value="prior")
    assert prior[(1, 1)] == 1 and prior[(3, 3)] == 1
    assert table(log.popularity, "item_id", value="popularity")[("aaaaaaaaaaaaaaa1",)] == pytest.approx(1) and table(log.popularity, "item_id", value="popularity")[("aaaaaaaaaaaaaaa5",)] == 0
    assert [r["item_id"][-1] for r in log.fallback.orderBy(F.desc("popularity"), "item_id").collect()] == ["1", "2", "3"]
    past = table(log.history, "key", "item_id", value="click")
    assert past[("red bicycle", "aaaaaaaaaaaaaaa1")] == 1 and past[("red bicycle", "aaaaaaaaaaaaaaa2")] == pytest.approx(math.log(2) / math.log(3)) and not [k for k, _ in past if k == ""]
    assert table(log.microcats, "key", "item_microcat_id", value="p") == {("red bicycle", 1): 1, ("chair", 3): 1, ("bicycle", 1): 1}
    places = {(r["qid"], r["location"]) for r in log.locations(queries, 1).collect()}
    assert places == {("q1", 10), ("q2", 99), ("q3", 30)}  # q2's place is not in the log and stands for itself


def test_locality_is_smoothed(train):
    mean = behavior.mean_locality(train).first()["mean"]
    assert mean == pytest.approx(4 / 6)
    by = table(behavior.locality(train, "item_microcat_id", 20.0), "item_microcat_id", value="propensity")
    assert by[(1,)] == pytest.approx((3 + 20 * mean) / 24)


def test_small_pools_are_masks_of_large_ones(items, queries, train):
    big = Index(items, Limits(pool=5, min_df=1, fallback=2, top_k=3))
    small = Index(items, Limits(pool=1, min_df=1, fallback=2, top_k=3))
    settings = candidates.Settings(pool=1)
    masked = candidates.scored(improved_features(queries, big, Behavior(big, train)), settings)
    direct = candidates.scored(improved_features(queries, small, Behavior(small, train)), settings)
    assert table(masked, "qid", "item_id", value="base_score") == table(direct, "qid", "item_id", value="base_score")


def test_answers_are_filled_and_queries_do_not_matter_to_each_other(items, queries, train, limits):
    index = Index(items, limits)
    log = Behavior(index, train)
    rows = improved_features(queries, index, log)
    scored = candidates.scored(rows, candidates.Settings(exact_rescore=True, pool=5))
    every = candidates.answers(scored, queries, items, 4)
    got = {}
    for r in every.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["item_id"])
    assert all(len(v) == len({*v}) == 4 for v in got.values()) and {*got} == {"q1", "q2", "q3"} and got["q1"][0][-1] == "1"
    one = queries.where("qid = 'q1'")
    alone = candidates.answers(candidates.scored(improved_features(one, index, log), candidates.Settings(exact_rescore=True, pool=5)), one, items, 4)
    assert [r["item_id"] for r in alone.orderBy("rank").collect()] == got["q1"]
    assert legacy_features(queries, index, log).where("qid = 'q1' and word > 0").count() == 3


def test_dense_markers_widen_the_candidates(spark, items, queries, train, limits):
    index = Index(items, limits)
    extra = spark.createDataFrame([("q2", "aaaaaaaaaaaaaaa5")], "qid string, item_id string")
    rows = candidates.scored(improved_features(queries, index, Behavior(index, train), extra), candidates.Settings())
    assert rows.where("qid = 'q2' and item_id = 'aaaaaaaaaaaaaaa5' and dense_source = 1").count() == 1


def test_row_matrix_uses_eligible_rows_only(spark):
    row = {n: 0.0 for n in features.RAW}
    frame = spark.createDataFrame([("q", "a", *(row | {"exact_word": 0.5, "location": 0.2}).values(), 1.0), ("q", "b", *(row | {"exact_word": 0.25}).values(), 0.5)], ", ".join(["qid string", "item_id string", *[f"{n} double" for n in features.RAW], "base_score double"]))
    m = features.row_matrix(frame)
    assert table(m, "item_id", value="relative_exact_word") == {("a",): 1, ("b",): 0.5}
    assert table(m.where("item_id = 'a'"), "item_id", value="exact_word_x_location")[("a",)] == pytest.approx(0.1)
    assert table(features.row_matrix(frame.where("item_id = 'b'")), "item_id", value="query_max_exact_word") == {("b",): 0.25}
    assert [len(s) for s in features.SCHEMAS.values()] == [30, 47, 52]


def test_metadata_keeps_the_unknown_unknown(items, queries):
    pairs = queries.select("qid").crossJoin(items.select("item_id"))
    m = features.metadata(pairs, queries, items, features.location_centers(items))
    prices = table(m.where("qid = 'q1'"), "item_id", value="log_price")
    assert prices[("aaaaaaaaaaaaaaa2",)] is None and prices[("aaaaaaaaaaaaaaa3",)] == 0 and prices[("aaaaaaaaaaaaaaa1",)] == pytest.approx(math.log(101))
    assert {r["log_distance_km"] for r in m.where("qid = 'q2'").collect()} == {None}
    assert table(m.where("qid = 'q1'"), "item_id", value="log_distance_km")[("aaaaaaaaaaaaaaa1",)] == pytest.approx(0)


def test_labels_and_samples(spark):
    rows = spark.createDataFrame([("q", f"i{k:02}", float(-k)) for k in range(20)], "qid string, item_id string, base_score double")
    units = spark.createDataFrame([("q", ["i19", "gone"])], "qid string, relevant_items array<string>")
    x = features.labelled(rows, units)
    assert table(x.where("label = 1"), "item_id", value="weight") == {("i19",): 50}
    got = {r["item_id"] for r in features.sampled(x, 3, 2).collect()}
    assert {"i00", "i01", "i02", "i19"} <= got and len(got) <= 6
    with pytest.raises(ValueError):
        model.ranked(rows.withColumn("__sampled", F.lit(1)), units.select("qid"), rows, None, "locality", 0.0)


def unit_rows(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_dense_search_is_exact(spark):
    q, i = unit_rows(5, 8, 1), unit_rows(60, 8, 2)
    places = [k % 3 for k in range(60)]
    queries = spark.createDataFrame([(f"q{k}", 7 if k == 4 else k % 3, v.tolist()) for k, v in enumerate(q)], "qid string, location long, vector array<double>")
    items = spark.createDataFrame([(f"i{k:02}", places[k], (3 * v).tolist()) for k, v in enumerate(i)], "item_id string, location long, vector array<double>").repartition(3)
    s = np.round(q @ i.T, 9)
    near = dense.global_top(queries, items, 10)
    expected = {(f"q{a}", f"i{b:02}"): r + 1 for a in range(5) for r, b in enumerate(np.lexsort((np.arange(60), -s[a]))[:10])}
    assert table(near, "qid", "item_id", value="rank") == expected
    assert table(dense.global_top(queries, items, 10, block=2, group=7), "qid", "item_id", value="rank") == expected
    local = dense.local_top(queries, items, 4)
    pairs = dense.candidates(near, local, 5)
    assert table(dense.local_top(queries, items, 4, block=1, group=3), "qid", "item_id", value="rank") == table(local, "qid", "item_id", value="rank")
    f = {(r["qid"], r["item_id"]): r for r in dense.features(pairs, queries, items, near, 10).collect()}
    assert {(r["qid"], r["item_id"]): r for r in dense.features(pairs, queries, items, near, 10, block=1, group=3).collect()} == f
    assert len(f) == pairs.count()
    for (a, b), r in f.items():
        x, y = int(a[1:]), int(b[1:])
        own = [s[x, k] for k in range(60) if places[k] == (7 if x == 4 else x % 3)]
        assert r["dense_cos"] == pytest.approx(s[x, y]) and r["dense_cos_minus_global_top1"] == pytest.approx(s[x, y] - s[x].max())
        assert r["dense_cos_minus_local_top1"] == pytest.approx(s[x, y] - (max(own) if own else -1))
        assert r["dense_log_local_rank"] == pytest.approx(np.log1p(sum(o > s[x, y] for o in own) if own else 1e5))
        assert r["dense_log_global_rank"] == pytest.approx(np.log1p(expected.get((a, b), 11) - 1))
    assert dense.global_top(queries.limit(0), items, 3).count() == 0


@pytest.mark.parametrize("block, group", [(1_024, 65_536), (3, 11)])
def test_dense_ties_go_by_id_in_a_hot_location_with_odd_rows(spark, monkeypatch, block, group):
    """Many equal vectors, one location with most rows, null locations and vectors, a zero vector, chunks smaller than a tile."""
    monkeypatch.setattr(dense, "CHUNK", 4)
    kinds = unit_rows(4, 3, 9)
    vectors = [None if k == 5 else [0.0] * 3 if k == 6 else kinds[k % 4].tolist() for k in range(90)]
    places = [None if k == 7 else 1 if k % 9 else k for k in range(90)]
    items = spark.createDataFrame([(f"i{k:02}", places[k], vectors[k]) for k in range(90)], "item_id string, location long, vector array<double>").repartition(5)
    asked = [(f"q{k}", None if k == 3 else 1, None if k == 4 else kinds[k % 4].tolist()) for k in range(8)]
    queries = spark.createDataFrame(asked, "qid string, location long, vector array<double>")

    def best(local, depth):
        out = {}
        for q, place, v in asked:
            if v is None or (local and place is None):
                continue
            scored = sorted((-round(float(np.dot(v, vectors[k])), 9), f"i{k:02}") for k in range(90) if vectors[k] is not None and (not local or places[k] == place))
            out |= {(q, i): r + 1 for r, (_, i) in enumerate(scored[:depth])}
        return out

    assert table(dense.global_top(queries, items, 30, block, group), "qid", "item_id", value="rank") == best(False, 30)
    assert table(dense.local_top(queries, items, 30, block, group), "qid", "item_id", value="rank") == best(True, 30)
    assert dense.local_top(queries, items.limit(0), 3, block, group).count() == 0


def test_hard_negatives_avoid_clicks(spark):
    q, i = unit_rows(3, 6, 3), unit_rows(40, 6, 4)
    queries = spark.createDataFrame([(f"q{k}", 0, v.tolist()) for k, v in enumerate(q)], "qid string, location long, vector array<double>")
    items = spark.createDataFrame([(f"i{k:02}", 0, v.tolist()) for k, v in enumerate(i)], "item_id string, location long, vector array<double>")
    near = dense.local_top(queries, items, 8)
    pairs = near.where("rank = 1").select("qid", F.col("item_id").alias("positive"))
    got = dense.hard_negatives(pairs, near, queries, items, 3, 10, 20).collect()
    clicked = {(r["qid"], r["item_id"]) for r in near.collect()}
    assert len(got) == 3 and not {(r["qid"], r["negative"]) for r in got} & clicked
    assert dense.hard_negatives(pairs, near, queries, items.limit(5), 3, 10).count() == 0


def test_recall_and_slices(spark):
    units = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("c", [])], "qid string, relevant_items array<string>")
    got = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "w"), ("c", "x")], "qid string, item_id string")
    each = evaluation.recalls(got, units)
    assert table(each, "qid", value="recall") == {("a",): 0.5, ("b",): 0, ("c",): 0}
    slices = spark.createDataFrame([("a", True, False), ("b", True, False), ("c", False, False)], "qid string, one boolean, none boolean")
    assert table(evaluation.slice_means(each, slices), "slice", value="mean") == {("one",): 0.25, ("none",): 0}
    assert table(evaluation.slice_means(each, slices), "slice", value="queries") == {("one",): 2, ("none",): 0}


def test_units_keep_null_columns_apart_and_folds_leak_nothing(train):
    key = train.where("search_query is null")
    fold = evaluation.with_fold(key).first()["fold"]
    units = evaluation.query_units(train, fold)
    assert units.where("search_query is null").count() == 1
    past = evaluation.history_without(train, [fold])
    evaluation.assert_cold(units, past)
    with pytest.raises(AssertionError):
        evaluation.assert_cold(units, train)


def test_fresh_samples_are_disjoint(spark):
    units = spark.createDataFrame([(f"text {k}", k % 3, True, "", 0) for k in range(30)], "search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long")
    a, b, c = ({r["search_query"] for r in s.collect()} for s in evaluation.fresh_samples(units, 3, 10, "s"))
    assert len(a) == len(b) == len(c) == 10 and not a & b and not (a | b) & c
    with pytest.raises(ValueError):
        evaluation.sample_units(units, 31, "s", strict=True)


def test_tuning_respects_the_guard(spark):
    rows = []
    for q in ("a", "b"):
        for item, word, history in (("good", 0.1, 1.0), ("bad", 0.9, 0.0)) if q == "a" else (("good", 0.9, 0.0), ("bad", 0.1, 1.0)):
            rows.append((q, item, word, history, 1))
    frame = spark.createDataFrame(rows, "qid string, item_id string, word double, history double, global_word_rank int").withColumns({n: F.lit(0.0) for n in candidates.VALUES if n not in ("word", "history")}).cache()
    units = spark.createDataFrame([("a", ["good"]), ("b", ["good"])], "qid string, relevant_items array<string>")
    slices = spark.createDataFrame([("a", True, False), ("b", False, True)], "qid string, first boolean, second boolean")
    start = candidates.Settings(weights={"word": 1.0, "history": 0.0})
    tuned = evaluation.coordinate_tune(frame, units, slices, start, {"weight:history": [0.0, 5.0]}, 1, least=1, top_k=1)
    assert tuned.settings == start and tuned.recall == 0.5  # the swap would cost the second slice everything
    assert not [t for t in tuned.trials if t["value"] == 5.0][0]["eligible"]


def test_bootstraps_and_gate():
    deltas = np.array([0.1] * 50 + [0.0] * 50)
    low, high = evaluation.paired_bootstrap(deltas, 500, 1)
    assert 0.03 < low < 0.05 < high < 0.07 and (low, high) == evaluation.paired_bootstrap(deltas, 500, 1)
    sums = np.column_stack([deltas * 2, np.full(100, 2.0)])
    low, high = evaluation.cluster_bootstrap([sums[::2], sums[1::2]], 300, 1)
    assert 0.03 < low < 0.05 < high < 0.07
    good = dict(fold_deltas=[0.1], pooled=0.01, low=0.001, slice_deltas={"s": -0.01}, contract=True, hashes=True)
    assert evaluation.gate(**good)["pass"] and not evaluation.gate(**(good | {"slice_deltas": {"s": -0.03}}))["pass"] and not evaluation.gate(**(good | {"pooled": 0.001}))["pass"]


def test_grid_order():
    assert evaluation.grid({"w": 1.0}, {"b": [1, 2], "a": [3]}) == [{"w": 1.0, "a": 3, "b": 1}, {"w": 1.0, "a": 3, "b": 2}]


def test_union_catalog_prefers_the_catalog(items, train):
    some = items.where("item_location_id = 10").withColumn("item_price", F.lit(1.5))
    got = table(evaluation.union_catalog(some, train), "item_id", value="item_price")
    assert got == {("aaaaaaaaaaaaaaa1",): 1.5, ("aaaaaaaaaaaaaaa3",): 1.5, ("aaaaaaaaaaaaaaa2",): None, ("aaaaaaaaaaaaaaa4",): 7.0}


def test_answer_faults(spark, items):
    queries = spark.createDataFrame([("A" * 16,), ("B" * 16,), ("C" * 16,)], "query_id string")
    good = spark.createDataFrame([("A" * 16, "aaaaaaaaaaaaaaa1 aaaaaaaaaaaaaaa2"), ("B" * 16, ""), ("C" * 16, "aaaaaaaaaaaaaaa3")], "query_id string, answer string")
    report = validation.validate_answer(good, queries, items)
    assert report == {"valid": True, "errors": [], "rows": 3, "empty_answers": 1, "max_items": 2}
    bad = spark.createDataFrame([("A" * 16, "aaaaaaaaaaaaaaa1  aaaaaaaaaaaaaaa1"), ("A" * 16, "AAAAAAAAAAAAAAA1"), ("short", " ".join(["aaaaaaaaaaaaaaa9"] * 51))], "query_id string, answer string")
    row = validation.answer_counts(bad, queries, items).first().asDict()
    assert (row["duplicate_queries"], row["missing_queries"], row["unexpected_queries"], row["invalid_query_ids"]) == (1, 2, 1, 1)
    assert (row["invalid_separator"], row["over_limit"], row["duplicate_items"], row["invalid_items"], row["unknown_items"]) == (1, 1, 2, 2, 53)
    assert not validation.validate_answer(bad.select("answer", "query_id"), queries, items)["valid"]


def test_files_round_trip(spark, tmp_path, items):
    ranked = spark.createDataFrame([("q", "b", 2), ("q", "a", 1), ("p", "c", 1)], "qid string, item_id string, rank int")
    io.write_answer(io.answer_rows(ranked), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in io.read_answer(spark, f"{tmp_path}/out").collect()) == [("p", "c"), ("q", "a b")]
    io.write_json(f"{tmp_path}/deep/report.json", {"b": 1, "a": "ё"})
    assert (tmp_path / "deep/report.json").read_text() == '{\n  "a": "ё",\n  "b": 1\n}\n'
    built = []
    build = lambda: built.append(1) or items.select("item_id")
    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/cache", {"k": 1}, "ids", build, ["item_id"]).count() == 5
    assert built == [1]
    with pytest.raises(ValueError):
        io.cached(spark, f"{tmp_path}/cache", {"k": 1}, "ids", build, ["other"])
    assert io.table_fingerprint(items) == io.table_fingerprint(items.repartition(3))
    for name in ("train", "queries", "items"):
        items.withColumns({c: F.lit(None).cast("string") for c in schema.QUERY_COLUMNS}).write.parquet(f"{tmp_path}/data/{name}.parquet")
    assert io.load_frames(spark, f"{tmp_path}/data").items.count() == 5
    with pytest.raises(ValueError, match="item_price"):
        schema.require_columns(items.drop("item_price"), schema.ITEM_COLUMNS, "items")


def test_the_bootstrap_draws_as_often_as_the_reference(spark, monkeypatch):
    from types import SimpleNamespace

    from corvane.plans import registry

    rows = spark.createDataFrame([(f"q{k}", f"text {k}", float(k % 3 - 1)) for k in range(12)], "qid string, search_query string, delta double")
    drawn = []
    monkeypatch.setattr(registry, "_compared", lambda w: rows.select("qid", "delta"))
    monkeypatch.setattr(registry, "world", lambda spark, sf_dir: SimpleNamespace(spark=spark, queries=rows.select("qid", "search_query"), keep=lambda frame, name: frame))
    monkeypatch.setattr(registry.evaluation, "cluster_bootstrap", lambda strata, draws=10_000, seed=0: drawn.append(draws) or (0.0, 0.0))
    assert registry.QUERIES["evaluation_bootstrap"](spark, "").count() == 3
    assert drawn == [10_000, 10_000]


def test_the_five_dense_features_beside_the_47(spark):
    """The dense part of the 52 features against a plain computation over all pairs; the 47 have SQL of their own."""
    import numpy as np

    from corvane.operators import features
    from corvane.plans import registry
    from corvane.sources import fixtures

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES["feature_prepared_52"](spark, sf).toPandas()
    assert {*got.columns} == {"qid", "item_id", *features.SCHEMAS["dense"]} and not got[features.DENSE].isna().any().any()
    q, i = fixtures.search_vectors(spark, sf).collect(), fixtures.item_vectors(spark, sf).collect()
    unit = lambda rows: np.array([np.array(r["vector"], dtype=float) / np.linalg.norm(r["vector"]) for r in rows])
    cos = np.round(unit(q) @ unit(i).T, 9)
    at = {r["item_id"]: k for k, r in enumerate(i)}
    for k, r in enumerate(q):
        own = got[got["qid"] == r["qid"]]
        order = {i[j]["item_id"]: n for n, j in enumerate(sorted(range(len(i)), key=lambda j: (-cos[k, j], i[j]["item_id"])))}
        local = np.array([cos[k, j] for j, x in enumerate(i) if x["location"] == r["location"]])
        c = np.array([cos[k, at[x]] for x in own["item_id"]])
        expected = [c, c - cos[k].max(), np.log1p([min(order[x], 1000) for x in own["item_id"]]), c - (local.max() if len(local) else -1.0), np.log1p([(local > s).sum() if len(local) else 1e5 for s in c])]
        assert np.allclose(own[features.DENSE].to_numpy(), np.array(expected).T, atol=2e-6)


def test_scans_of_vectors_equal_joins_of_postings(spark, items, queries, limits, monkeypatch):
    """A search and given pairs from tables of whole documents, in small chunks, against joins of terms; odd texts among them."""
    from corvane.operators import packed

    monkeypatch.setattr(packed, "CHUNK", 2)
    monkeypatch.setattr(packed, "ROWS", 2)
    texts = ["a b a b c", "", None, "b", "квартиры  новые", "c  a b", "zz"]
    docs = spark.createDataFrame([(f"d{k}", k % 2, t) for k, t in enumerate(texts)], "doc string, location long, text string").repartition(3)
    for kind, index in (("words", Index(items, limits).words), ("chars", Index(items, limits).chars)):
        plain = index(docs, "doc", F.coalesce("text", F.lit("")))
        counts = packed.counts(docs, kind)
        assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in plain.select("doc", "term", "tf").collect()}
        known = lexical.vocabulary(plain, 7, 1)
        assert {tuple(r) for r in lexical.known(packed.totals(docs, kind), 7, 1).select("term", "df", "cf").collect()} == {tuple(r) for r in known.select("term", "df", "cf").collect()}
        held, vectors = lexical.postings(plain, known), packed.Vectors.of(docs, kind, packed.Terms.of(known))
        assert table(vectors.postings(), "doc", "term", value="w") == pytest.approx(table(held, "doc", "term", value="w"))
        asked = held.where("doc <> 'd3'")
        for limit in (1, 2, 9):
            assert table(vectors.nearest(asked, limit), "qid", "item_id", "rank", value="score") == table(lexical.nearest(asked, held, limit), "qid", "item_id", "rank", value="score")
        places = spark.createDataFrame([("d0", 0), ("d0", 1), ("d5", 1), ("d4", None)], "qid string, location long")
        at = docs.select(F.col("doc").alias("item_id"), "location")
        assert table(vectors.nearest(asked, 2, places), "qid", "item_id", "rank", value="score") == table(lexical.nearest_in_locations(asked, held, 2, places, at), "qid", "item_id", "rank", value="score")
        pairs = docs.select(F.col("doc").alias("qid")).crossJoin(docs.select(F.col("doc").alias("item_id"))).where("qid <> item_id or qid = 'd0'")
        assert table(vectors.for_candidates(pairs, asked), "qid", "item_id", value="score") == table(lexical.for_candidates(pairs, asked, held), "qid", "item_id", value="score")
        terms = asked.select(F.col("doc").alias("qid"), "term").join(known.select("term", "idf"), "term")
        for name in ("word_unigram_coverage", "word_unigram_idf_coverage", "title_unigram_coverage"):
            assert table(packed.coverage(pairs, terms, vectors, vectors), "qid", "item_id", value=name) == pytest.approx(table(lexical.coverage(pairs, terms, held, held), "qid", "item_id", value=name))
        monkeypatch.setattr(packed, "QUERY_ROWS", 1)
        assert table(vectors.nearest(asked, 2), "qid", "item_id", "rank", value="score") == table(lexical.nearest(asked, held, 2), "qid", "item_id", "rank", value="score")
        monkeypatch.setattr(packed, "QUERY_ROWS", 1_000_000)
        assert vectors.nearest(asked.limit(0), 2).count() == vectors.for_candidates(pairs, asked.limit(0)).count() == 0


def test_searches_shuffle_tops_and_not_pairs(spark, items, queries, limits):
    index = Index(items, limits)
    plan = index.word_vectors.nearest(index.query_words(queries), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


def test_labels_do_not_gather_relevant_items(spark):
    """Labels are joined pair by pair: a query's relevant items may be a large part of the catalog."""
    rows = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5), ("r", "a", 0.1), ("s", "a", 0.0)], "qid string, item_id string, base_score double")
    units = spark.createDataFrame([("q", ["a", "a", "c", "d"]), ("r", [])], "qid string, relevant_items array<string>")
    x = features.labelled(rows, units)
    assert table(x, "qid", "item_id", value="label") == {("q", "a"): 1, ("q", "b"): 0, ("r", "a"): 0, ("s", "a"): 0}
    assert table(x, "qid", "item_id", value="weight")[("q", "a")] == 25
    assert "array_contains" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_of_a_log_is_normalised_once(spark, monkeypatch):
    rows = spark.createDataFrame([("Red Car",), ("red  car",), (None,), ("Red Car",)], "search_query string")
    log = rows.withColumn("n", F.monotonically_increasing_id())
    for most in (50_000, 1):
        monkeypatch.setattr(behavior, "TEXTS", most)
        got = evaluation.with_fold(log)
        assert sorted(r["key"] for r in got.collect()) == ["", "red car", "red car", "red car"]
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (most > 1)


def test_the_registered_gate_measures_its_checks(spark, monkeypatch):
    """Interval, slices and hashes come from the compared units, none is given."""
    from corvane.plans import registry

    seen = {}
    real = evaluation.gate
    monkeypatch.setattr(registry.evaluation, "gate", lambda *a: seen.update(dict(zip(["folds", "pooled", "low", "slices", "contract", "hashes"], a, strict=True))) or real(*a))
    monkeypatch.setattr(registry.evaluation, "cluster_bootstrap", lambda strata, draws=0: seen.update(strata=strata) or (0.25, 0.5))
    got = registry.QUERIES["evaluation_gate"](spark, "/root/testdata/sf0.001")
    assert got.count() == 7 and seen["low"] == 0.25 and len(seen["folds"]) == len(seen["strata"]) > 1
    assert seen["pooled"] == pytest.approx(sum(s[:, 0].sum() for s in seen["strata"]) / sum(s[:, 1].sum() for s in seen["strata"]))
    assert isinstance(seen["contract"], bool) and seen["hashes"] is True


def test_a_log_is_counted_by_numbers_and_folded_by_text(spark, items):
    """Texts of a log are many times as long as what is asked of them: they are not shuffled, and not hashed for each click."""
    log = spark.createDataFrame([("a b", 7, 2, 1), ("a b", 7, 2, 1), ("a b", 7, 2, 3), ("c", 8, 3, 1), ("", 9, 1, 1)], "key string, key_id long, fold_5 int, n int").select("key", "key_id", "fold_5", F.concat(F.lit("aaaaaaaaaaaaaaa"), "n").alias("item_id"))
    got = behavior.history(log, items)
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert any("key_id#" in line or "item_id#" in line for line in dealt) and not any("hashpartitioning(key#" in line for line in dealt if "item_id#" in line)
    plain = behavior.history(log.drop("key_id"), items)
    assert got.columns == plain.columns and sorted(got.collect()) == sorted(plain.collect())
    assert {r["key"]: r["fold"] for r in evaluation.with_fold(log).collect()} == {"a b": 2, "c": 3, "": 1}
    assert evaluation.leaked_texts(log.where("key = 'c'").select("key"), log) == 1
    evaluation.assert_folds(log, [0, 4])


def test_tables_of_the_registered_log_are_made_once(spark):
    from corvane.plans import registry

    made = {}
    w = registry.World(spark, "/root/testdata/sf0.001")
    w.keep = lambda frame, name: made.setdefault(name, frame) if name not in made else pytest.fail(f"{name} is made twice")
    assert w.units is w.units and w.past.count() < w.clicks.count()
    assert set(made) == {"clicks", "asked", "keys", "searches", "units"}
    assert not {"search_query", "search_infm_params_text", "key"} & {*made["clicks"].columns}


def test_a_grid_counts_relevant_items_once(spark):
    rows = spark.createDataFrame([("q1", "a", 1.0, 0.0), ("q1", "b", 0.5, 2.0), ("q2", "c", 1.0, 0.0)], "qid string, item_id string, word double, char double")
    units = spark.createDataFrame([("q1", ["a", "b", "b", "x", "y"]), ("q2", ["z"]), ("q3", ["c"])], "qid string, relevant_items array<string>")
    got = evaluation.grid_recalls(rows, units, [{"word": 1.0}, {"char": 1.0}], ["word", "char"], top_k=1)
    assert {r["trial"]: r["recall"] for r in got.collect()} == pytest.approx({0: 0.25 / 3, 1: 0.25 / 3})
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    exploded = [line for line in lines if "Generate explode(array_distinct(relevant_items" in line]
    assert exploded and all("), [" in line for line in exploded)  # names what is dropped: an array that stayed would be counted for each of its items


def test_a_search_of_several_places_scans_once(spark, items, queries, limits, monkeypatch):
    index = Index(items, limits)
    words = index.query_words(queries)
    places = [spark.createDataFrame(rows, "qid string, location long") for rows in ([("q1", 20), ("q2", 30)], [("q1", 10), ("q2", 10), ("zz", 20)])]
    rows = lambda f: sorted(tuple(r) for r in f.select("qid", "item_id", "score", "rank").collect())
    asked = [None, *places]
    each = index.word_vectors.nearest_each(words, 2, asked)
    assert each._jdf.queryExecution().executedPlan().toString().count("MapInArrow best(") == 1
    for most in (packed.QUERY_ROWS, 0):
        monkeypatch.setattr(packed, "QUERY_ROWS", most)
        each = index.word_vectors.nearest_each(words, 2, asked)
        for k, place in enumerate(asked):
            assert rows(each.where(F.col("part") == k)) == rows(index.word_vectors.nearest(words, 2, place))
    found = candidates.channel(each, "word", ["all", "near", "far"]).groupBy("source").count().collect()
    assert {r["source"] for r in found} == {"all", "near", "far"}


def test_totals_are_added_up_before_they_are_shuffled(spark, monkeypatch):
    """A task gives each term once, or several times where it holds few; the totals are the same."""
    from corvane.operators import packed

    monkeypatch.setattr(packed, "ROWS", 2)
    docs = spark.createDataFrame([(t,) for t in ["a b a", "a b", "", None, "b c", "a b", "c"] * 5], "text string").coalesce(1)
    want = {("a", 15, 20), ("b", 20, 20), ("c", 10, 10), ("a b", 15, 15), ("b a", 5, 5), ("b c", 5, 5)}
    for held in (1_500_000, 1):
        monkeypatch.setattr(packed, "HELD", held)
        found = packed.totals(docs, "words")
        assert {tuple(r) for r in found.collect()} == want
        monkeypatch.setattr(packed.F, "sum", packed.F.count)  # of the rows of each term that are shuffled
        given = [r["df"] for r in packed.totals(docs, "words").collect()]
        monkeypatch.undo()
        monkeypatch.setattr(packed, "ROWS", 2)
        assert len(given) == 6 and (max(given) == 1) == (held > 1)


def test_known_words_make_the_vectors_of_all_grams(spark):
    """Pairs whose words are no terms themselves, words that are only parts of pairs, unknown words between known ones."""
    import pyarrow as pa

    from corvane.operators import packed

    texts = pa.array(["a b a b x a", "x", "", None, "b c  b c", "квартиры новые новый", "a x b"], pa.string())
    for terms in (["a", "a b", "b c", "квартир", "квартир нов"], ["a b"], ["b"], ["нов нов", "x"], []):
        held = pa.array(sorted(terms), pa.string())
        owner, code, tf, found = packed.word_grams(texts)
        names = [found[int(c)].as_py() for c in code]
        expected = {(int(o), n, int(t)) for o, n, t in zip(owner, names, tf, strict=True) if n in terms}
        owner, ids, tf = packed.Known.of(held).counted(texts)
        assert {(int(o), held[int(k)].as_py(), int(t)) for o, k, t in zip(owner, ids, tf, strict=True)} == expected and (np.diff(owner) >= 0).all()


def test_scans_are_fine_only_while_tables_are_made(spark, tmp_path):
    spark.range(4).selectExpr("id", "repeat(uuid(), 400000) AS x").repartition(4).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    parts = lambda: spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions()
    before = parts()
    with io.fine_scans(spark):
        with io.fine_scans(spark):
            assert parts() > 2 * before
        assert parts() > 2 * before
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_words_that_are_rare_make_no_frequent_pairs(spark, monkeypatch):
    """The most frequent terms are those of all totals, with ties at the end, few words, and words that are too many to travel."""
    from corvane.operators import packed

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.4, 12), 60)) for _ in range(60)] + ["", None, "новые квартиры новые квартиры", "rare pair", "w1 w1 w1"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    whole, counted = packed.totals(docs, "words"), []
    monkeypatch.setattr(packed, "_added", lambda *a, f=packed._added: counted.append(a[2]) or f(*a))
    for words in (400_000, 3):
        monkeypatch.setattr(packed, "WORDS", words)
        for least, most in ((1, 5), (2, 12), (2, 40), (1, 70), (2, 10_000), (50, 10)):
            few = packed.frequent(docs, least, most, lambda frame: frame.cache())
            rows = lambda x: [tuple(r) for r in lexical.known(x, 65, least, most).select("term", "df", "cf").orderBy(F.desc("cf"), "term").collect()]  # noqa: B023, E731
            assert rows(few) == rows(whole), (words, least, most)
    assert counted.count("term") > 12 and 6 <= counted.count("pair") < 12  # single words each time, and all totals where words were too many
    assert packed.frequent(docs, 1, 5, lambda frame: frame.cache()).count() == whole.count()
    monkeypatch.setattr(packed, "WORDS", 400_000)
    assert packed.frequent(docs, 1, 5, lambda frame: frame.cache()).count() < whole.count() / 4
