"""Document fingerprints: a canonical exact digest, checked by byte comparison.

The canonical form folds Unicode compatibility forms (NFKC), case and white
space; its 128-bit XXH3 is the fingerprint. Two fingerprints are alike (1.0) if
the digests and then the canonical bytes are equal, else not (0.0). Documents
whose digest another document shares are range-partitioned by digest and
identifier and compared with their neighbours, byte by byte, and across the
borders of ranges by SHA-256; should a digest ever hold unlike texts, its members' fingerprints get a suffix of their canonical text's SHA-256.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

#: Hash slots of the pre-filter before duplicates' texts are shuffled: its broadcast never holds more rows.
SLOTS = 1 << 20


def canonical(text: str | None) -> bytes:
    """NFKC, case fold, NFKC again, and each run of white space as one space, trimmed."""
    t = text or ""
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, bits: int = 128) -> str:
    """bits below 128 are for tests of what happens when digests collide."""
    return f"{xxhash.xxh3_128_intdigest(form) >> (128 - bits):0{max(1, bits // 4)}x}"


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("canonical_sha256", pa.string()), ("range", pa.int32()), ("head", pa.string()), ("tail", pa.string()),
]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canonical_sha256 string, range int, head string, tail string"


class _Rows:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, *row) -> None:
        self.rows.append(row)

    def drained(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _compared(doc_id, text: str, form: bytes, following: str, next_form: bytes, bits: int) -> tuple:
    new = edited(text, following)
    new_form = canonical(new)
    own, other, third = digest(form, bits), digest(new_form, bits), digest(next_form, bits)
    return (
        doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, other,
        float(own == other and form == new_form), float(own == third and form == next_form), hashlib.sha256(form).hexdigest(),
    )


def _streamed(bits: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the next of its range; a range's first text and last row wait for the ranges beside it."""
        at = TaskContext.get().partitionId()
        out = _Rows()
        last = None
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                form = canonical(text)
                if last is None:
                    out.add(None, None, None, None, None, None, None, None, at, text, None)
                else:
                    out.add(*_compared(*last, text, form, bits), None, None, None)
                last = (i, text, form)
            yield out.drained()
        if last is not None:
            out.add(last[0], None, None, None, None, None, None, None, at, None, last[1])
        yield out.drained()

    return made


def _paired(bits: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for batch in batches:
            for i, text, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out.add(*_compared(i, text, canonical(text), following, canonical(following), bits), None, None, None)
            yield out.drained()

    return made


def _mixed(bits: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests whose neighbouring rows differ; also each range's first and last row, for the ranges beside it."""
        at = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            rows = []
            for d, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None:
                    rows.append((d, at, 0, hashlib.sha256(form).digest()))
                elif last[0] == d and last[1] != form:
                    rows.append((d, at, -1, None))
                last = (d, form)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["digest", "range", "place", "form"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([at], pa.int32()), pa.array([1], pa.int32()), pa.array([hashlib.sha256(last[1]).digest()], pa.binary())], names=["digest", "range", "place", "form"])

    return made


def mixed_digests(docs: DataFrame, digests: DataFrame, bits: int = 128) -> DataFrame:
    """digest: those that unlike canonical texts share, by comparing bytes within each digest that several rows have.

    docs: doc_id, text; digests: doc_id, fingerprint.
    """
    shared = written(digests.groupBy(F.col("fingerprint").alias("f")).count().where("count > 1").select("f"), "shared-digests")
    ids = written(digests.join(sized(shared), F.col("fingerprint") == F.col("f"), "left_semi").select(F.col("doc_id").alias("id")).distinct(), "shared")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(ids.select(slot(F.col("id")).alias("slot")).distinct())  # at most SLOTS rows
    some = docs.join(slots, slot(F.col("doc_id")) == F.col("slot"), "left_semi")
    some = some.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f, bits) for f in forms], pa.string()), pa.array(forms, pa.binary())], names=["doc_id", "digest", "form"])

    forms = some.select("doc_id", "text").mapInArrow(formed, "doc_id long, digest string, form binary")
    key = ["digest", "doc_id"]
    found = written(forms.repartitionByRange(*key).sortWithinPartitions(*key).select("digest", "form").mapInArrow(_mixed(bits), "digest string, range int, place int, form binary"), "mixed")
    order = Window.orderBy("range", "place")  # two rows of digests per range at most
    ends = found.where("place >= 0").select("digest", (F.lag("digest").over(order) == F.col("digest")).alias("same"), (F.lag("form").over(order) != F.col("form")).alias("unlike"))
    return found.where("place < 0").select("digest").union(ends.where("same and unlike").select("digest")).distinct()


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text takes the beginning of the next row in descending order of
    doc_id (null ids last; rows with one id by text), after the last the first;
    a single row follows itself. Null texts count as empty; only the two named
    columns are read, so others may have any name; empty tables give no rows.
    Whole texts are shuffled once, by ranges of the identifier.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    by_id = F.col("doc_id").desc_nulls_last()
    stream = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, F.col("text"))
    made = written(stream.mapInArrow(_streamed(bits), _SCHEMA), "compared")
    # a range's last row meets the first text of the range behind it: numbers of ranges find each other, then texts by number
    heads = made.where("head is not null").select("range", "head")
    order = Window.orderBy("range")  # one number per range
    after = heads.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("next"))
    tails = made.where("tail is not null").select("doc_id", "tail", "range").join(after, "range")
    pairs = tails.join(heads.select(F.col("range").alias("next"), F.col("head").alias("following")), "next").select("doc_id", "tail", "following").mapInArrow(_paired(bits), _SCHEMA)
    out = written(made.where("range is null").union(pairs).drop("range", "head", "tail"), "fingerprints")
    mixed = mixed_digests(rows, out.select("doc_id", "fingerprint"), bits)
    out = out.join(sized(written(mixed, "unlike")), F.col("fingerprint") == F.col("digest"), "left")
    own = F.when(F.col("digest").isNotNull(), F.concat("fingerprint", F.lit("-"), F.substring("canonical_sha256", 1, 16))).otherwise(F.col("fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next")
