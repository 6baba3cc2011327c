"""The pipeline stage by stage, each held against what the stage before kept, on the smallest tables and on odd rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import exact_dedup
from corvane.llm.common import written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PROSE = "Words of an ordinary sentence stand here, and others follow it. They go on for a while, as prose does.\n"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, PROSE * 3 + "One more.", "en", "src1", 1), (2, PROSE * 3 + "One  more.", "en", "src1", 1), (2, PROSE * 3 + "One  more.", "en", "src1", 1), (None, PROSE * 4, "en", None, None), (None, None, None, None, None),
    (3, "", "en", "src2", 0), (4, " \n\t", "en", "src2", 3), (5, "x" * 9000, "en", "src2", 1), (6, " ".join(f"word{k}" for k in range(12_000)), "en", "src3", 1), (7, " ".join(f"word{k}" for k in range(12_050)), "en", "src3", 1),
    (8, "### ||| $$$ 123", "en", "src3", 1), (9, "### ||| $$$ 123 !!", "en", "", 1), (-5, "Ünïcode and others go on for a while, as prose does, and so on.", "fr", "src4", 1),
]


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_components(texts):
    """texts: id, text. The smallest id reachable of each, over pairs of a similarity of 0.8 and more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in sets:
        for a in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def words(rows):
    return sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)


def held(spark, docs, sf):
    """The stages over docs, each against brute force over what the stage before kept."""
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        kept.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(k.columns == columns for k in kept[:-1]) and kept[-1].columns == COLUMNS
    quality, exact, near, mixed, packed = (k.collect() for k in kept)

    groups = {}
    for i, text in sorted(((r["doc_id"], r["text"]) for r in quality), key=lambda r: (r[0] is None, r[0] or 0)):
        groups.setdefault(exact_dedup.normalised(text), i)
    assert Counter(r["doc_id"] for r in exact) == Counter(groups.values())

    texts = {r["doc_id"]: r["text"] for r in exact if r["doc_id"] is not None}
    of = near_components(texts)
    assert Counter(r["doc_id"] for r in near) == Counter(r["doc_id"] for r in exact if r["doc_id"] is None or of[r["doc_id"]] == r["doc_id"])

    total = words(near)
    assert abs(words(mixed) - 1.5 * total) <= 0.01 * total + 200 or len({r["source"] for r in near}) < 8
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in near} or total > 10_000
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}

    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return kept


def test_each_stage_works_on_what_was_kept(spark):
    held(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties and repeated rows, and columns whose names clash with the operators' own."""
    at = tmp_path_factory.mktemp("odd")
    clash = ["size", "taken", "node", "cell", "low", "high", "root", "shard", "range", "border", "row", "parts", "times", "score", "label", "x", "__id", "__text", "piece", "length", "sequence_id"]
    docs = spark.createDataFrame(ODD, DOCS).select("*", *[F.lit(c).alias(c) for c in clash])
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(1, 1, 0), (2, 1, 0), (-5, 1, None), (8, 0, 0), (9, 0, 0), (None, 1, 0), (3, None, 0), (6, 1, 0), (7, 1, 1), (8, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_on_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = held(spark, docs, odd_dir)
    extra = docs.columns[5:]
    assert all(r[c] == c for k in kept[:-1] for r in k.collect() for c in extra)  # carried, whatever their names
    # the same from the second stage on, over all odd rows
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, odd_dir).count() > 0


def test_run_on_odd_rows_agrees_with_itself(spark, odd_dir):
    first, second = (corpus_pipeline.run(spark, odd_dir) for _ in range(2))
    assert first.columns == COLUMNS and sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == COLUMNS and got.count() == 0


def test_run_without_labels_keeps_every_document(spark, odd_dir, tmp_path):
    spark.read.parquet(f"{odd_dir}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.good_documents(spark, docs, str(tmp_path)).count() == len(ODD)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_stage_goes_by_five_word_similarity(spark):
    """Of the pairs of 0.8 and more one document stays, however many bits their fingerprints differ in."""
    docs = exact_dedup.without_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))

    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    near = [(a, b) for b in sets for a in sets if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    left = {r["doc_id"] for r in corpus_pipeline.unlike_documents(spark, docs, SF).collect()}
    assert near and left == {*sets} - {b for _, b in near}
