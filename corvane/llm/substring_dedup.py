"""Substring dedup by hashing lines and their sentences.

Units are the sentences of each line, so a repeated line is a run of repeated
units (`unit="line"` takes whole lines only). A unit is normalised (lower case,
single spaces, no punctuation at the ends) and hashed to 128 bits. Digests are
grouped over all documents; the earliest occurrence, by document id and place,
stays. Neighbouring repeats of a document make a run. Where a passage begins or
ends within a sentence, no unit ends with it: so a run grows at both ends, word
by word, as long as the words are those beside the occurrence that stays. Runs
of at least RUN_WORDS words are removed; nothing else is, and words that repeat
nowhere never are. Offsets are code points of the original text.

Counts and earliest places are aggregated before they are shuffled; units meet
their group again in a join, which AQE splits where a digest is frequent. A
document's own lists of repeats are bounded by its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, sized_by_bytes, written

#: Words of a run that is removed, and of a run that is worth growing.
RUN_WORDS = 20
SEED_WORDS = 4

_SENTENCE = re.compile(r"(?:[^\n.!?]|[.!?]+(?=[^\s.!?]))+[.!?]*|[.!?]+")
_LINE = re.compile(r"[^\n]+")
_EDGES = " \t\r\x0b\x0c.,;:!?\"'()[]-|*%$#&"


def _normal(piece: str) -> str:
    return " ".join(piece.lower().split()).strip(_EDGES)


def units(text: str, unit: str = "sentence") -> Iterator[tuple[int, int, str]]:
    """start, end, normalised text of each unit that has words."""
    for m in (_LINE if unit == "line" else _SENTENCE).finditer(text):
        form = _normal(m[0])
        if form:
            yield m.start(), m.end(), form


def _hashed(unit: str):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pieces(batches):
            doc, key, place, start, end, words, digest = [], [], [], [], [], [], []
            for i, k, text in zip(*(some.column(c).to_pylist() for c in range(3)), strict=True):
                n = -1
                for n, (a, b, form) in enumerate(units(text or "", unit)):
                    place.append(n)
                    start.append(a)
                    end.append(b)
                    words.append(form.count(" ") + 1)
                    digest.append(xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
                doc += [i] * (n + 1)
                key += [k] * (n + 1)
            columns = [pa.array(doc, pa.int64()), pa.array(key, pa.int64()), *(pa.array(c, pa.int32()) for c in (place, start, end, words)), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "place", "start", "end", "words", "digest"])

    return made


def hashed_units(docs: DataFrame, unit: str = "sentence") -> DataFrame:
    """docs: doc_id, key, text. doc_id, key, place (in the document's units), start, end, words, digest of every unit."""
    return docs.select("doc_id", "key", "text").mapInArrow(_hashed(unit), "doc_id long, key long, place int, start int, end int, words int, digest binary")


def later_units(found: DataFrame) -> DataFrame:
    """The units whose digest occurs earlier, by document id (null last) and place, with the earliest: first.doc_id, first.key, first.place."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "key")
    groups = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").select(F.col("digest").alias("shared"), "first")
    again = found.join(sized(written(groups, "shared")), F.col("digest") == F.col("shared"))
    return again.where(~rank.eqNullSafe(F.col("first"))).select("doc_id", "key", "place", "start", "end", "words", "first")


def _runs(least: int):
    """Runs of neighbouring repeats of a document, with the earliest occurrences of their first and last unit. Units arrive sorted by place."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            units_ = own.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            place, words = (units_.field(k).to_numpy(zero_copy_only=False) for k in ("place", "words"))
            begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)]) if len(doc) else np.empty(0, np.int64)
            end = np.r_[begin[1:], len(doc)] - 1 if len(begin) else begin
            long = np.add.reduceat(words, begin) >= least if len(begin) else np.empty(0, bool)
            begin, end = pa.array(begin[long], pa.int64()), pa.array(end[long], pa.int64())
            of = pa.array(doc[begin.to_numpy()], pa.int64()) if len(begin) else begin
            columns = [batch.column(0).take(of), batch.column(1).take(of), units_.field("start").take(begin), units_.field("end").take(end), units_.field("first").take(begin), units_.field("first").take(end)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "start", "end", "begins", "ends"])

    return made


def repeated_runs(later: DataFrame, least: int = SEED_WORDS) -> DataFrame:
    own = later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("place", "start", "end", "words", F.struct("first.doc_id", "first.key", "first.place").alias("first")))).alias("own"))
    first = "struct<doc_id:bigint,key:bigint,place:int>"
    return own.mapInArrow(_runs(least), f"doc_id long, key long, start int, end int, begins {first}, ends {first}")


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _beside(unit: str):
    """The unit before and the unit after each asked place."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out: list[tuple] = []
            for doc, key, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = list(units(text or "", unit))
                for p in places:
                    before = text[own[p - 1][0] : own[p - 1][1]] if p else ""
                    after = text[own[p + 1][0] : own[p + 1][1]] if p + 1 < len(own) else ""
                    out.append((doc, key, p, before, after))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["f_doc", "f_key", "f_place", "before", "after"])

    return made


def _same_document(a: str, b: str):
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc")) & (F.col(f"{a}key") == F.col(f"{b}key"))


def with_neighbours(rows: DataFrame, runs: DataFrame, unit: str = "sentence") -> DataFrame:
    """runs with `before` and `after`: the text beside the occurrences that stay. rows: doc_id, key, text."""
    asked = runs.select(F.col("begins").alias("f")).union(runs.select("ends")).distinct()
    asked = written(asked.groupBy(F.col("f.doc_id").alias("f_doc"), F.col("f.key").alias("f_key")).agg(F.collect_list("f.place").alias("places")), "asked")
    texts = rows.join(sized(asked), _same_document("", "f_"))
    beside = texts.select("doc_id", "key", "text", "places").mapInArrow(_beside(unit), "f_doc long, f_key long, f_place int, before string, after string")
    beside = written(beside.dropDuplicates(["f_doc", "f_key", "f_place"]), "beside")  # rows may repeat
    beside = sized_by_bytes(beside, ["before", "after"])
    for side, of in (("before", "begins"), ("after", "ends")):
        held = beside.select("f_doc", "f_key", "f_place", side)
        runs = runs.join(held, _same_document(f"{of}.", "f_") & (F.col(f"{of}.place") == F.col("f_place")), "left").drop("f_doc", "f_key", "f_place")
    return runs


def _word(piece: str) -> str:
    return piece.lower().strip(_EDGES)


def grown(text: str, start: int, end: int, before: str, after: str) -> tuple[int, int]:
    """The span with the words beside it that are also beside the occurrence that stays."""
    for w in reversed(before.split()):
        b = start
        while b and text[b - 1].isspace():
            b -= 1
        a = b
        while a and not text[a - 1].isspace():
            a -= 1
        if a == b or _word(text[a:b]) != _word(w):
            break
        start = a
    for w in after.split():
        a = end
        while a < len(text) and text[a].isspace():
            a += 1
        b = a
        while b < len(text) and not text[b].isspace():
            b += 1
        if a == b or _word(text[a:b]) != _word(w):
            break
        end = b
    return start, end


def cut(text: str, runs: list[tuple[int, int, str, str]], least: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The spans to remove: grown runs, joined where only white space is between them, if together long enough."""
    joined: list[list[int]] = []
    for a, b in sorted(grown(text, *r) for r in runs):
        if joined and (a <= joined[-1][1] or not text[joined[-1][1] : a].strip()):
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined if len(text[a:b].split()) >= least]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _cleaned(least: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in _pieces(batches):
            texts, removed, gone = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text = text or ""
                spans = cut(text, [(r["start"], r["end"], r["before"] or "", r["after"] or "") for r in found], least) if found else []
                texts.append(without_spans(text, spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
                gone.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, span), pa.array(gone, pa.int64())], names=["doc_id", "text", "removed", "removed_chars"])

    return made


def deduplicate_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", least: int = RUN_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, text (without repeats), removed (start and end of each span of the original), removed_chars, one row per input row.

    Null texts give empty ones; rows that repeat an id with the same text are
    the same document and keep the same parts, and so do rows without id that
    have the same text; a null id ranks last. Repeats within a document count
    too. Only the two named columns are read, so others may have any name.
    Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = written(hashed_units(rows, unit), "units")
    runs = with_neighbours(rows, written(repeated_runs(later_units(found), seed), "runs"), unit)
    spans = runs.groupBy(F.col("doc_id").alias("r_doc"), F.col("key").alias("r_key")).agg(F.collect_list(F.struct("start", "end", "before", "after")).alias("runs"))
    joined = rows.join(spans, _same_document("", "r_"), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_cleaned(least), "doc_id long, text string, removed array<struct<start:int,end:int>>, removed_chars long")
