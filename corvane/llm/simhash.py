"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are 32 segments of two; the embedding is the vector of
the segments' bit counts. Two fingerprints that differ in d bits lie at most d
apart under the Manhattan distance, which is the lower bound. Each count (0, 1
or 2) is kept in unary (00, 01, 11), so a vector is one long and a Manhattan
distance is the popcount of an exclusive or.

The range-join within distance d works on grids of cell side one: the 32
coordinates are dealt to d + k groups, and vectors within distance d agree
entirely on at least k groups. For each choice of k groups, equal coordinates
there make a cell, so every link shares a cell in at least one of the grids,
and the join is an equi-join on cells. k is 2, and more for very many
fingerprints, so cells stay small; the links are the same for every k. Within a cell the Manhattan bound is
tested, then the exact Hamming distance. A cell gives a spanning forest of its
links, never all its pairs. Cells beyond `block` fingerprints are dealt to
tiles of two blocks each, so a hot cell is spread over many tasks and no task
holds more than two blocks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, written
from .components import components

_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :], strict=False)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), one row per input row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """The counts of the 32 segments in unary, one bit pair each."""
    low = F.lit(_LOW)
    odd = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(odd).bitwiseAND(low), 1).bitwiseOR(fp.bitwiseOR(odd).bitwiseAND(low))


def grids(distance: int, agree: int = 2) -> list[int]:
    """Masks of the coordinates of each choice of `agree` groups; the coordinates are dealt to distance + agree groups."""
    n = distance + agree
    if n > 32:
        raise ValueError("distance and agreeing groups must be at most 32 together")
    groups = [sum(0b11 << (2 * s) for s in range(g, 32, n)) for g in range(n)]
    return [sum(chosen) for chosen in combinations(groups, agree)]


def agreeing(points: int, distance: int = 4, cell: int = 150) -> int:
    """Groups that a cell holds: the fewest for which unlike fingerprints fill a cell with no more than `cell`. Every choice finds the same links."""
    for agree in range(2, 33 - distance):
        if points * (3 / 8) ** (32 * agree / (distance + agree)) <= cell:  # two random bits have equal counts in 3 of 8 cases
            return agree
    return 32 - distance


class _Forest:
    """Union-find over the nodes that have links; memory follows the links of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> tuple[int, int] | None:
        """The two roots, smaller first, if they were apart: the same link between smaller nodes, so that links of many tasks meet in few nodes."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return None
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        return a, b


def _near(fa: np.ndarray, ta: np.ndarray, fb: np.ndarray, tb: np.ndarray, distance: int) -> np.ndarray:
    """The Manhattan bound first, then the Hamming distance of what passes it. The last axis holds a fingerprint's words of 64 bits."""
    near = np.bitwise_count(ta ^ tb).sum(axis=-1, dtype=np.int16) <= distance
    a, b = np.broadcast_to(fa, (*near.shape, fa.shape[-1])), np.broadcast_to(fb, (*near.shape, fb.shape[-1]))
    near[near] = np.bitwise_count(a[near] ^ b[near]).sum(axis=-1, dtype=np.int16) <= distance
    return near


def _cell_forest(f: np.ndarray, t: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (indices) that span the components of one cell or tile: first who has a partner at all, then a breadth-first search among those."""
    n = len(f)
    partner = np.zeros(n, bool)
    step = max(1, 500_000 // n)
    for k in range(0, n, step):
        near = _near(f[k : k + step, None], t[k : k + step, None], f[None], t[None], distance)
        partner[k : k + step] = near.sum(axis=1) > 1
    links = []
    left = np.flatnonzero(partner)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hit = np.full(len(left), -1)
            step = max(1, 500_000 // len(left))
            for k in range(0, len(front), step):
                open_ = np.flatnonzero(hit < 0)
                if not len(open_):
                    break
                some, to = front[k : k + step], left[open_]
                near = _near(f[some][:, None], t[some][:, None], f[to][None], t[to][None], distance)
                new = near.any(axis=0)
                hit[open_[new]] = some[near[:, new].argmax(axis=0)]
            got = hit >= 0
            links += zip(hit[got].tolist(), left[got].tolist(), strict=True)
            front, left = left[got], left[~got]
    return links


#: Cells up to this size are compared together, vectorised over cells.
_SMALL = 16


def _cells(distance: int, lanes: int = 1):
    """Columns: cell, the words of the fingerprint, those of its embedding, node."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by cell. Only one cell (at most two blocks) and one batch are held."""
        forest = _Forest()
        held: list[np.ndarray] | None = None

        def links_of(cells: list[np.ndarray]) -> tuple[list[int], list[int]]:
            cell, fp, t, node = cells
            if not len(cell):
                return [], []
            begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[begin, len(cell)])
            of = np.repeat(size, size)
            a, b = [], []
            for d in range(1, min(_SMALL, int(size.max()))):
                pair = np.flatnonzero((cell[d:] == cell[:-d]) & (of[d:] <= _SMALL))
                near = _near(fp[pair], t[pair], fp[pair + d], t[pair + d], distance)
                pair = pair[near]
                a += node[pair].tolist()
                b += node[pair + d].tolist()
            for k in np.flatnonzero(size > _SMALL):
                s = slice(begin[k], begin[k] + size[k])
                own = node[s]
                for x, y in _cell_forest(fp[s], t[s], distance):
                    a.append(int(own[x]))
                    b.append(int(own[y]))
            kept = [link for x, y in zip(a, b, strict=True) if (link := forest.join(x, y))]
            return [x for x, _ in kept], [y for _, y in kept]

        def out(a: list[int], b: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        def words(batch: pa.RecordBatch, at: int) -> np.ndarray:
            return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in range(at, at + lanes)], axis=-1)

        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), words(batch, 1), words(batch, 1 + lanes), batch.column(1 + 2 * lanes).to_numpy(zero_copy_only=False)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = len(now[0]) - int(np.argmax((now[0] != now[0][-1])[::-1])) if now[0][0] != now[0][-1] else 0
            held = [x[cut:] for x in now]
            if cut:
                yield out(*links_of([x[:cut] for x in now]))
        if held is not None:
            yield out(*links_of(held))

    return joined


def tiled(cells: DataFrame, block: int) -> DataFrame:
    """cells (cell, node, ...) with cells of more than `block` nodes dealt to tiles of two blocks each, so that each pair of nodes shares one."""
    hot = written(cells.groupBy("cell").count().where(F.col("count") > block).select(F.col("cell").alias("hot"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    n = hot.count()
    if not n:
        return cells
    columns = cells.columns
    cells = cells.join(sized(hot, n), F.col("cell") == F.col("hot"), "left")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("cell", F.least(own, x), F.greatest(own, x)))
    cells = cells.withColumn("__tile", F.explode(F.coalesce(F.when(F.col("hot").isNotNull(), tiles), F.array("cell"))))
    return cells.select(*[F.col("__tile").alias("cell") if c == "cell" else F.col(c) for c in columns])


def near_links(points: DataFrame, distance: int = 4, block: int = 4096, agree: int | None = None) -> DataFrame:
    """a, b: links that connect exactly what fingerprints within the distance connect.

    points: fp, node, one row per fingerprint. Each row is sent once to each
    grid: 15 for distance 4 and two agreeing groups.
    """
    t = embedded(F.col("fp"))
    masks = grids(distance, agree or agreeing(points.count(), distance))
    cells = points.withColumn("t", t).select("fp", "t", "node", F.posexplode(F.array(*[F.col("t").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("grid", "at"))
    cells = tiled(cells.select(F.xxhash64("grid", "at").alias("cell"), "fp", "t", "node"), block)
    return cells.select("cell", "fp", "t", "node").repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included), one row per input row.

    Texts are compared whole, A-Z in lower case, over shingles of `words` words
    at ASCII white space; fewer words make one shingle; none (null and empty
    texts too) the fingerprint zero, linked like any other. Rows with equal
    fingerprints, repeated rows among them, meet as one node, so copies are not
    expanded. A null id has the fingerprint's component but names none (null if
    all its ids are null and it has no link). Empty tables give no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    links = near_links(least.select("fp", F.col("fp").alias("node")), distance, block)
    roots = components(written(links, "near"))
    linked = written(roots.join(least, F.col("node") == F.col("fp")).select("node", "root", "least"), "linked")
    of_root = linked.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    linked = linked.join(of_root, F.col("root") == F.col("r")).select("node", "component")
    named = least.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "least").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component, the document with the smallest id.

    Rows that repeat an id count as one document; rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, words, distance)
    gone = written(found.where("doc_id > component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(sized(gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
