"""Near copies: SimHash finds the candidates, the exact similarity decides.

Texts are near copies if the Jaccard similarity of their sets of five-word
shingles is at least `least` (0.8). Two such sets have a cosine of 2s / (1 + s)
at least, so each bit of their SimHash fingerprints differs with a chance of at
most acos(cosine) / pi: 0.152 at 0.8. Four differing bits of 64, the distance of
op3's own contract, would miss nearly all of them. So this search has a
fingerprint of two words (128 bits), a distance three standard deviations beyond
the mean (`reach`), and the segment-popcount embedding of op3: 64 segments of
two bits, counts in unary, the Manhattan distance as the lower bound.

At that distance no exact covering of the segments leaves small cells. The grids
here are random choices of `agree` segments: a pair shares a grid's cell with a
chance of (1 - p)^2 + p^2 / 2 to the power `agree`, and there are so many grids
that at most MISSED of the pairs at `least` share none (fewer of more similar
ones). `agree` grows with the logarithm of the texts, so unlike texts fill a cell
with no more than CELL; the grids then grow with a root (the power 0.32) of the
texts. Within a cell the Manhattan bound is tested, then the Hamming distance.

Equal shingle sets meet as one node. Candidate links are spanning forests of
cells, and their components are the groups within which texts are compared: the
sizes of two sets first, then their exact similarity on 64-bit shingle hashes, so
no pair below `least` is ever linked. Sets travel once, to the task of their
group; groups beyond `block` nodes are dealt to tiles of two blocks each. A group
gives a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .components import components
from .simhash import _cells as _fingerprint_cells
from .simhash import _Forest, _signed, embedded, tiled

#: Pairs at the least similarity that may share no cell; unlike texts that may share one.
MISSED = 0.005
CELL = 256
SEED = 42


def differing(least: float) -> float:
    """The chance that a bit differs between the fingerprints of texts of that similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def reach(least: float, bits: int = 128) -> int:
    """Differing bits up to which fingerprints are candidates."""
    p = differing(least)
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def random_grids(points: int, least: float, seed: int = SEED) -> list[tuple[int, int]]:
    """Masks (low and high word) of the segments that each grid compares."""
    agree = math.ceil(math.log(max(1.0, points / CELL)) / math.log(8 / 3))
    if not agree:  # all texts fit a cell
        return [(0, 0)]
    p = differing(least)
    n = math.ceil(math.log(MISSED) / math.log(1 - ((1 - p) ** 2 + p * p / 2) ** agree))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        mask = sum(0b11 << (2 * int(s)) for s in rng.choice(64, min(64, agree), replace=False))
        out.append((mask & ((1 << 64) - 1), mask >> 64))
    return out


def shingles(text: str | None, words: int = 5, seed: int = SEED) -> list[bytes]:
    """The word shingles as bytes: A-Z in lower case, ASCII white space; fewer words make one shingle, none no shingle. Repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= words:
        return [joined]
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)]


def hashed(parts: list[bytes], seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes, by which sets are compared."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(p, seed) for p in parts], np.uint64))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """The two words of the fingerprint: a bit is 1 if set in over half of the set's hashes. The second word's hashes are made from the first's."""
    out = []
    for k in range(2):
        x = hashes
        if k:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):  # bounded memory for very long texts
            counts += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(x), bitorder="little").view("<u8")[0]))
    return out[0], out[1]


def _sketched(words: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, low, high = [], [], []
            for t in batch.column(1):
                s = hashed(shingles(t.as_py(), words))
                a, b = fingerprint(s)
                node.append(_signed(xxhash.xxh64_intdigest(s.tobytes())) if len(s) else None)
                low.append(_signed(a))
                high.append(_signed(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (node, low, high))], names=["doc_id", "node", "low", "high"])

    return made


def _set_of(words: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(shingles(t.as_py(), words)).tobytes() for t in batch.column(0)]
            node = [_signed(xxhash.xxh64_intdigest(s)) if s else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return made


def _similar_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (indices) that span the components of one group or tile, by breadth-first search."""
    size = np.array([len(s) for s in sets])
    flat, begin = np.concatenate(sets), np.r_[0, np.cumsum(size)[:-1]]
    links = []
    left = np.arange(len(sets))
    front: list[int] = []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        a = front.pop()
        fits = left[np.minimum(size[left], size[a]) >= least * np.maximum(size[left], size[a])]
        if not len(fits):
            continue
        of = np.repeat(np.arange(len(fits)), size[fits])
        at = np.arange(len(of)) + np.repeat(begin[fits] - np.r_[0, np.cumsum(size[fits])[:-1]], size[fits])
        own, value = sets[a], flat[at]
        same = own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value
        shared = np.bincount(of[same], minlength=len(fits))
        near = fits[shared >= least * (size[fits] + size[a] - shared)]
        links += [(a, int(b)) for b in near]
        front += near.tolist()
        left = left[~np.isin(left, near)]
    return links


def _groups(least: float):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; one group (at most two blocks) and one batch are held."""
        forest = _Forest()
        group, nodes, sets = None, [], []

        def links_of() -> list[tuple[int, int]]:
            if len({forest.root(x) for x in nodes}) < 2:
                return []
            found = [(nodes[i], nodes[j]) for i, j in _similar_forest(sets, least)]
            return [link for a, b in found if (link := forest.join(a, b))]

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            links = []
            for c, n, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != group:
                    links += links_of()
                    group, nodes, sets = c, [], []
                nodes.append(n)
                sets.append(np.frombuffer(s, np.uint64))
            yield out(links)
        yield out(links_of())

    return joined


def candidate_links(points: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """a, b: links that connect what fingerprints within reach() that share a grid's cell connect. points: node, low, high."""
    masks = random_grids(points.count(), least)
    x = points.select("node", "low", "high", embedded(F.col("low")).alias("t_low"), embedded(F.col("high")).alias("t_high"))
    at = [F.xxhash64(F.lit(g), F.col("t_low").bitwiseAND(F.lit(_signed(a))), F.col("t_high").bitwiseAND(F.lit(_signed(b)))) for g, (a, b) in enumerate(masks)]
    cells = tiled(x.select(F.explode(F.array(*at)).alias("cell"), "low", "high", "t_low", "t_high", "node"), block)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_fingerprint_cells(reach(least), 2), "a long, b long")


def similar_links(docs: DataFrame, least: float = 0.8, words: int = 5, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """sketches (doc_id, node, low, high) and links (a, b) that connect what candidates of at least that similarity connect.

    docs: doc_id, text. node is null for texts without words.
    """
    sketches = written(docs.mapInArrow(_sketched(words), "doc_id long, node long, low long, high long"), "sketches")
    points = written(sketches.where("node is not null").groupBy("node").agg(F.first("low").alias("low"), F.first("high").alias("high")), "points")
    group = written(components(written(candidate_links(points, least), "candidates")).select(F.col("root").alias("cell"), "node"), "groups")
    # the text of one document of each node in a group
    asked = sketches.groupBy("node").agg(F.min("doc_id").alias("__doc")).join(sized(group.select("node")), "node", "left_semi")
    texts = docs.join(sized(written(asked.select("__doc").distinct(), "asked")), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    sets = texts.select("text").mapInArrow(_set_of(words), "node long, hashes binary")
    sets = written(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
    dealt = tiled(group, block).join(sets, "node").select("cell", "node", "hashes").repartition("cell").sortWithinPartitions("cell")
    return sketches, dealt.mapInArrow(_groups(least), "a long, b long")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5, block: int = 256) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component of similar texts, the document with the smallest id.

    Rows without an id and texts without words (null and empty ones too) stay;
    rows that repeat an id stay or go together. Columns may have any name. Empty
    tables give no rows. Reruns agree.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches, links = similar_links(own, least, words, block)
    roots = components(written(links, "near"))
    of_node = sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = written(of_node.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"), "named")
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    stays = named.join(stays, "root").select("node", "stays")
    gone = written(sketches.join(stays, "node").where("doc_id > stays").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(sized(gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
