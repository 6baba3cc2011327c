"""Retrieval plans: the index of a catalog, the behavior of a log, and searches over both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import behavior, candidates, lexical, packed
from ..sources.io import fine_scans, spread


@dataclass(frozen=True)
class Limits:
    pool: int = 120
    min_df: int = 2
    words: int = 140_000
    chars: int = 120_000
    history_neighbors: int = 12
    history_items: int = 30
    fallback: int = 120
    microcat_neighbors: int = 16
    top_k: int = 50
    geo: tuple[int, ...] = (3,)
    #: NFKC before everything; False for texts known to be in that form.
    unicode: bool = True


Keep = Callable[[DataFrame, str], DataFrame]


def in_memory(frame: DataFrame, name: str) -> DataFrame:
    return frame.cache()


class Index:
    """Tables of a catalog of distinct item_id, made when first asked for.

    `keep` holds a table that is used more than once; a service passes one that
    writes it, which also keeps the plans of later queries short. Vectors have a
    row per item, so making and searching them moves no postings.
    """

    def __init__(self, items: DataFrame, limits: Limits = Limits(), keep: Keep = in_memory) -> None:
        self.items, self.limits, self.keep = items, limits, keep

    def norm(self, c: str):
        return text.normalize_text(F.col(c), self.limits.unicode)

    @cached_property
    def fields(self) -> DataFrame:
        """Whole fields are normalised; of the long ones the parts that documents hold are kept."""
        names = {"item_title_raw": "title", "item_infm_params_text": "params", "item_description_raw": "description"}
        cuts = {"title": None, "params": text.PARAMS_CHARS, "description": text.DESCRIPTION_CHARS}
        raw = self.items.select("item_id", "item_location_id", *[text.text_or_empty(F.col(c)).alias(n) for c, n in names.items()])
        with fine_scans(raw.sparkSession):
            raw = spread(raw)
        return self._made(packed.normalized(raw, cuts, self.limits.unicode), "fields")

    def _made(self, frame: DataFrame, name: str) -> DataFrame:
        """A table with a row per item, whose scan is long work: in many tasks. Searches have few, since each gives its own tops."""
        with fine_scans(frame.sparkSession):
            return self.keep(frame, name)

    def words(self, docs: DataFrame, id_: str, document) -> DataFrame:
        """doc, term, tf of word grams."""
        t = docs.select(F.col(id_).alias("doc"), text.stems(text.tokens(document)).alias("tokens"))
        return lexical.term_counts(t, "doc", text.word_grams(F.col("tokens")))

    def chars(self, docs: DataFrame, id_: str, document) -> DataFrame:
        t = docs.select(F.col(id_).alias("doc"), text.tokens(document).alias("tokens"))
        return lexical.term_counts(t, "doc", text.char_grams(F.col("tokens")))

    @cached_property
    def size(self) -> int:
        return self.items.count()

    def _documents(self, document) -> DataFrame:
        return self.fields.select(F.col("item_id").alias("doc"), F.col("item_location_id").cast("long").alias("location"), document.alias("text"))

    @property
    def word_documents(self) -> DataFrame:
        return self._documents(text.item_word_document(F.col("title"), F.col("params"), F.col("description")))

    @property
    def title_documents(self) -> DataFrame:
        return self._documents(F.col("title"))

    @property
    def word_counts(self) -> DataFrame:
        return packed.counts(self.word_documents, "words")

    @cached_property
    def char_totals(self) -> DataFrame:
        return self.keep(packed.totals(self.title_documents, "chars"), "char-totals")

    @cached_property
    def vocabulary(self) -> DataFrame:
        totals = packed.frequent(self.word_documents, self.limits.min_df, self.limits.words, lambda frame: self.keep(frame, "words"))
        return self.keep(lexical.known(totals, self.size, self.limits.min_df, self.limits.words), "vocabulary")

    @cached_property
    def char_vocabulary(self) -> DataFrame:
        return self.keep(lexical.known(self.char_totals, self.size, self.limits.min_df, self.limits.chars), "char-vocabulary")

    @cached_property
    def terms(self) -> packed.Terms:
        return packed.Terms.of(self.vocabulary)

    @cached_property
    def char_terms(self) -> packed.Terms:
        return packed.Terms.of(self.char_vocabulary)

    def _vectors(self, docs: DataFrame, name: str) -> packed.Vectors:
        return packed.Vectors.of(docs, "words", self.terms, lambda frame: self._made(frame, name))

    @cached_property
    def word_vectors(self) -> packed.Vectors:
        return self._vectors(self.word_documents, "word-vectors")

    @cached_property
    def char_vectors(self) -> packed.Vectors:
        return packed.Vectors.of(self.title_documents, "chars", self.char_terms, lambda frame: self._made(frame, "char-vectors"))

    @cached_property
    def filter_vectors(self) -> packed.Vectors:
        return self._vectors(self._documents(text.item_filter_document(F.col("params"))), "filter-vectors")

    @cached_property
    def title_vectors(self) -> packed.Vectors:
        return self._vectors(self.title_documents, "title-vectors")

    @property
    def word_postings(self) -> DataFrame:
        return self.word_vectors.postings()

    @property
    def char_postings(self) -> DataFrame:
        return self.char_vectors.postings()

    @property
    def filter_postings(self) -> DataFrame:
        return self.filter_vectors.postings()

    @property
    def title_postings(self) -> DataFrame:
        return self.title_vectors.postings()

    def make(self) -> None:
        """All tables that a search of every kind needs."""
        _ = self.word_vectors, self.char_vectors, self.filter_vectors, self.title_vectors

    # queries -------------------------------------------------------------

    def query_words(self, queries: DataFrame) -> DataFrame:
        return lexical.postings(self.words(queries, "qid", self.norm("search_query")), self.vocabulary)

    def query_chars(self, queries: DataFrame) -> DataFrame:
        return lexical.postings(self.chars(queries, "qid", self.norm("search_query")), self.char_vocabulary)

    def query_filters(self, queries: DataFrame) -> DataFrame:
        return lexical.postings(self.words(queries, "qid", self.norm("search_infm_params_text")), self.vocabulary)


class Behavior:
    """Tables of a click log against one catalog; a new log needs no new index."""

    def __init__(self, index: Index, train: DataFrame) -> None:
        self.index, self.limits = index, index.limits
        self.train = behavior.keyed(train, lambda c: text.normalize_text(c, index.limits.unicode))

    @cached_property
    def category_prior(self) -> DataFrame:
        return self.index.keep(behavior.pair_prior(self.train, "search_category", "item_category_id"), "category-prior")

    @cached_property
    def location_prior(self) -> DataFrame:
        return self.index.keep(behavior.pair_prior(self.train, "search_location_id", "item_location_id"), "location-prior")

    def locations(self, queries: DataFrame, limit: int) -> DataFrame:
        return behavior.query_locations(queries, behavior.compatible_locations(self.location_prior, limit))

    @cached_property
    def popularity(self) -> DataFrame:
        return self.index.keep(behavior.popularity(self.index.items, self.train), "popularity")

    @cached_property
    def fallback(self) -> DataFrame:
        return self.index.keep(behavior.fallback(self.popularity, self.limits.fallback, self.limits.top_k), "fallback")

    @cached_property
    def history(self) -> DataFrame:
        return self.index.keep(behavior.history(self.train, self.index.items, self.limits.history_items), "history")

    @cached_property
    def microcats(self) -> DataFrame:
        return self.index.keep(behavior.microcat_distribution(self.train), "microcats")

    def make(self) -> None:
        """All tables of the log; none needs a table of the index."""
        _ = self.location_prior, self.category_prior, self.history, self.fallback, self.microcats

    def key_vectors(self, keys: DataFrame) -> packed.Vectors:
        docs = keys.select(F.col("key").alias("doc"), F.lit(None).cast("long").alias("location"), F.col("key").alias("text")).distinct()
        return packed.Vectors.of(docs, "words", self.index.terms)

    def near_keys(self, queries: DataFrame, keys: DataFrame, limit: int) -> DataFrame:
        near = self.key_vectors(keys).nearest(self.index.query_words(queries), limit)
        return near.select("qid", F.col("item_id").alias("key"), "score", "rank")

    def history_channel(self, queries: DataFrame) -> DataFrame:
        near = self.near_keys(queries, self.history, self.limits.history_neighbors)
        return behavior.history_channel(queries.select("qid", self.index.norm("search_query").alias("key")), self.history, near)

    def microcat_transfer(self, queries: DataFrame) -> DataFrame:
        near = self.near_keys(queries, self.microcats, self.limits.microcat_neighbors)
        return behavior.transferred(near, self.microcats, "p", ["item_microcat_id"])


def legacy_features(queries: DataFrame, index: Index, log: Behavior) -> DataFrame:
    """One row per candidate: seven channels, without ranks."""
    n = index.limits.pool
    words, chars = index.query_words(queries), index.query_chars(queries)
    places = log.locations(queries, 3)
    parts = [
        candidates.channel(index.word_vectors.nearest_each(words, n, [None, places]), "word"),
        candidates.channel(index.char_vectors.nearest_each(chars, n, [None, places]), "char"),
        candidates.channel(index.filter_vectors.nearest(index.query_filters(queries), n), "filter"),
        candidates.channel(log.history_channel(queries), "history"),
        candidates.channel(queries.select("qid").join(F.broadcast(log.fallback)).withColumnRenamed("popularity", "score"), "popularity"),  # at most limits.fallback items
    ]
    rows = candidates.merged(parts, ["word", "char", "filter", "history", "category", "location", "popularity"], [])
    return candidates.with_priors(rows, queries, index.items, log.category_prior, log.location_prior)


def improved_features(queries: DataFrame, index: Index, log: Behavior, dense: DataFrame | None = None) -> DataFrame:
    """One wide row per candidate of the largest pool: twelve values, ranks per source, exact similarities and transfer."""
    n = index.limits.pool
    words, chars, filters = (index.keep(q, name) for q, name in ((index.query_words(queries), "query-words"), (index.query_chars(queries), "query-chars"), (index.query_filters(queries), "query-filters")))
    geos = sorted(set(index.limits.geo))
    places = [None, *[log.locations(queries, geo) for geo in geos]]
    parts = [candidates.channel(index.filter_vectors.nearest(filters, n), "filter", "global_filter_rank")]
    for name, q, i in (("word", words, index.word_vectors), ("char", chars, index.char_vectors)):
        parts.append(candidates.channel(i.nearest_each(q, n, places), name, [f"global_{name}_rank", *[f"geo{geo}_{name}_rank" for geo in geos]]))
    sources = ["global_word_rank", "global_char_rank", "global_filter_rank", *[f"geo{geo}_{name}_rank" for geo in geos for name in ("word", "char")]]
    parts.append(candidates.channel(log.history_channel(queries), "history", "history_source"))
    spare = queries.select("qid").join(F.broadcast(log.fallback)).withColumnRenamed("popularity", "score")  # at most limits.fallback items
    parts.append(candidates.channel(spare.where("score > 0"), "popularity", "fallback_source"))
    if dense is not None:
        parts.append(candidates.marker(dense, "dense_source"))
    rows = candidates.merged(parts, candidates.VALUES, [*sources, *candidates.ALWAYS])
    rows = index.keep(rows, "candidates")
    exact = {"exact_word": (words, index.word_vectors), "exact_char": (chars, index.char_vectors), "exact_filter": (filters, index.filter_vectors), "title": (words, index.title_vectors)}
    out = candidates.with_priors(rows, queries, index.items, log.category_prior, log.location_prior)
    for name, (q, i) in exact.items():
        found = i.for_candidates(rows, q).withColumnRenamed("score", f"__{name}")
        out = out.drop(name).join(found, ["qid", "item_id"], "left").withColumn(name, F.coalesce(f"__{name}", F.lit(0.0))).drop(f"__{name}")
    moved = log.microcat_transfer(queries).withColumnRenamed("score", "__microcat")
    out = out.drop("microcat").join(index.items.select("item_id", "item_microcat_id"), "item_id").join(moved, ["qid", "item_microcat_id"], "left")
    out = out.withColumn("microcat", F.coalesce(F.round("__microcat", 9), F.lit(0.0)))
    return out.select("qid", "item_id", *candidates.VALUES, *sources, *candidates.ALWAYS)
