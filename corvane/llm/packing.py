"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokens are made where the text lies; only piece lengths travel. Pieces are dealt
by hash to shards of about equal tokens, and each shard is packed by
bounded-space online best-fit in order of arrival (the pieces' hash): OPEN_BINS
open bins at most, kept in a bitset by free space. A piece goes to the open bin
with the least room that holds it; if none does and the bins are used up, the
fullest closes first. State is the open bins alone, whatever a shard holds. What
a shard loses beside best-fit itself is its last open bins, a fixed share of it.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, written

#: Tokens of a sequence; the id that ends a document; sequences' worth of tokens of a shard; open bins of a shard.
CAPACITY = 4096
END_ID = 1
SHARD_SEQUENCES = 2_048
OPEN_BINS = 64
#: Words whose ids a task remembers in each of two generations.
CACHED_WORDS = 150_000


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit numbers, remembered by word in two generations.

    Valid for tokenizers whose pieces never cross ASCII white space, which they drop.
    """

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        return array("I", self.encode(word.decode("utf-8", "replace"))).tobytes()

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


class LowerCaseWordIds(WordIds):
    """For vocabularies that fold to NFC and lower case and make one byte-level piece of a run of letters.

    Such runs go to the merges directly, and ASCII punctuation after letters is a piece of its own.
    Everything else takes the whole tokenizer.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__(lambda word: tokenizer.encode(word, add_special_tokens=False).ids)
        self.merges = tokenizer.model.tokenize

    def made(self, word: bytes) -> bytes:
        ascii_ = word.isascii()
        if ascii_ and word.isalpha() and word.islower():
            return array("I", [t.id for t in self.merges(word.decode())]).tobytes()
        if b"<|" in word:  # perhaps a special token
            return super().made(word)
        text = word.decode("utf-8", "replace")
        low = text.lower()
        if low != text and (ascii_ or not _UNEVEN.search(text)):
            return self[low.encode()]
        if low == text and text.isalpha() and unicodedata.is_normalized("NFC", text):
            return array("I", [t.id for t in self.merges(word.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
        if m := _MARKED.fullmatch(text):
            return self[m[1].encode()] + self[m[2].encode()]
        return super().made(word)


#: Letters whose lower case depends on their neighbours or has two characters.
_UNEVEN = re.compile("[\u03a3\u0130]")
#: Letters, then ASCII punctuation without apostrophes: two pieces.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def _byte_chars() -> dict[int, int]:
    """The character of each byte in byte-level vocabularies: itself if visible, else the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}


_BYTE_CHARS = _byte_chars()
_PROBES = ["the", "tokens", "internationalisation", "\u00e9l\u00e8ve", "stra\u00dfe", "ni\u00f1o"]


@cache
def word_ids(vocabulary: str) -> WordIds:
    """vocabulary: a file of the tokenizers library, or the name of one that every executor has.

    A Python worker keeps it, and the words it remembers, for its later tasks.
    """
    from tokenizers import Tokenizer

    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    tokenizer = Tokenizer.from_file(vocabulary)
    whole = lambda word: tokenizer.encode(word, add_special_tokens=False).ids
    fast = LowerCaseWordIds(tokenizer)
    probes = [p for w in _PROBES for p in (w, w + ".", w.capitalize() + "!?")]
    if all(fast.made(p.encode()) == array("I", whole(p)).tobytes() for p in probes):
        return fast
    return WordIds(whole)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the end id, cut only where longer than a sequence."""
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Bounded-space online best-fit over bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.opened = 0  # bit f is set while a bin with f free is open

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the place in it of the next item, 1 <= size <= capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self.by_free[free]
            bin_ = own.pop()
            if not own:
                self.bits ^= 1 << free
        else:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            bin_, free = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_, self.capacity - free


def packed(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    table = written(parts, "pieces")
    columns = table.columns
    tokens = table.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = buckets_for(tokens, shard_sequences * capacity)
    dealt = table.withColumn("arrival", F.xxhash64("doc_id", "piece", "ids_crc32", "length"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("arrival"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "arrival", "doc_id", "piece", "length", "ids_crc32", "start")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            sequence, offset = [], []
            for shard, size in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if shard != now:
                    now, bins = shard, BestFit(capacity, open_bins)
                bin_, at = bins.put(size)
                sequence.append((shard << 32) | bin_)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*columns, "sequence_id", "offset"])

    return dealt.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id alone. Repeated rows are
    packed as often as they come; a null id is kept as null. Only the two named
    columns are read, so others may have any name. Empty tables give no rows.
    Reruns agree: equal rows are alike, and all others arrive in one order.
    """
    return packed(pieces(docs, vocabulary, id_col, text_col, capacity), capacity)
