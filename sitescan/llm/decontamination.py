"""Benchmark decontamination: which documents contain a short test item.

Containment is the share of an item's distinct word shingles that the document holds. The search follows the idea of size
partitions: items are put into classes of doubling size, and for the class of up to L shingles a document is seen as windows of
2L shingles every L, so any passage of L shingles lies in one window, and the sizes compared differ by a bounded factor however
long the document is. Windows and items get a one-permutation MinHash sketch (the smallest hash in each of `bins` bins); a
window and an item that agree in a bin make the pair a candidate, and candidates are verified on the exact shingle sets of
the whole document and item. Items of up to 8 shingles are too small for sketches, as another shingle of the window can take the
bin of the only one: all their shingles are looked up in the document's, which is exact.

Items are the stated query set. They go to the tasks in blocks of a bounded number of shingles, each block against all documents and only
one at a time, so documents are never shuffled. No rows give none; other columns may have any name. Nulls and empty texts have no shingles: they contain nothing and are contained in nothing. A text
of fewer words than a shingle is one shingle as a whole. Repeated rows are answered row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hashed_words, shingles, slices, small_batches

#: Shingles of items that one block may send to the tasks (8 bytes each).
BLOCK_SHINGLES = 2_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FILTER = 1 << 22
#: Shingles of a text whose windows are sketched at once.
_CHUNK = 1 << 16
#: Up to so many shingles an item is looked up whole.
_SMALL = 8


class Items:
    """The sketches and sets of one block of items."""

    def __init__(self, rows: list[tuple[int, str | None]], shingle: int, percent: int, bins: int):
        self.shingle, self.percent, self.bins = shingle, percent, bins
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, text in rows:
            s = np.unique(shingles(hashed_words(text), shingle))
            if len(s):
                size = max(_SMALL, 1 << (len(s) - 1).bit_length())
                classes.setdefault(size, []).append((len(self.ids), s))
                self.ids.append(i)
                self.sets.append(s)
        #: size -> (bin values in order, the item of each, filter over their low bits)
        self.classes = {}
        for size, members in classes.items():
            values, owners = [], []
            for number, s in members:
                sketch = s if size == _SMALL else self.sketch(s, np.zeros(len(s), np.int64), 1)[0]
                values.append(sketch if size == _SMALL else sketch[sketch != _NONE])
                owners.append(np.full(len(values[-1]), number))
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            seen = np.zeros(_FILTER, bool)
            seen[(v & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.classes[size] = (v[order], o[order], seen)

    def sketch(self, h: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
        """The smallest hash per part and bin; a hash's bin is its top bits, so equal hashes meet in one bin."""
        out = np.full(parts * self.bins, _NONE)
        bins = ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out, part * self.bins + bins, h * np.uint64(0x9E3779B97F4A7C15))
        return out.reshape(parts, self.bins)

    def contained(self, text: str | None) -> list[tuple[int, int]]:
        """(number of the item, shared shingles) of all items contained in the text."""
        h = shingles(hashed_words(text), self.shingle)
        if not len(h):
            return []
        candidates: set[int] = set()
        out: list[tuple[int, int]] = []
        for size, (values, owners, seen) in self.classes.items():
            if size == _SMALL:
                out = self.looked_up(h, values, owners, seen)
                continue
            parts, step = -(-len(h) // size), max(1, _CHUNK // size)
            # a long text's windows are sketched some at a time
            for first in range(0, max(1, parts - 1), step):
                stop = min(parts, first + step + 1)
                piece = h[first * size : stop * size]
                blocks = self.sketch(piece, np.arange(len(piece)) // size, stop - first)
                if stop - first > 1:
                    blocks = np.minimum(blocks[:-1], blocks[1:])
                flat = blocks.reshape(-1)
                flat = flat[seen[(flat & np.uint64(_FILTER - 1)).astype(np.int64)]]
                if len(flat):
                    lo, hi = np.searchsorted(values, flat), np.searchsorted(values, flat, side="right")
                    for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True):
                        candidates.update(owners[a:b].tolist())
        if not candidates:
            return out
        whole = np.unique(h)
        for number in sorted(candidates):
            s = self.sets[number]
            both = len(np.intersect1d(s, whole, assume_unique=True))
            if 100 * both >= self.percent * len(s):
                out.append((number, both))
        return sorted(out)

    def looked_up(self, h: np.ndarray, values: np.ndarray, owners: np.ndarray, seen: np.ndarray) -> list[tuple[int, int]]:
        """(number of the item, shared shingles) of the small items contained in a document of shingles `h`."""
        h = np.unique(h[seen[(h & np.uint64(_FILTER - 1)).astype(np.int64)]])
        lo, hi = np.searchsorted(values, h), np.searchsorted(values, h, side="right")
        found = [owners[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]
        if not found:
            return []
        numbers, both = np.unique(np.concatenate(found), return_counts=True)
        return [(n, b) for n, b in zip(numbers.tolist(), both.tolist(), strict=True) if 100 * b >= self.percent * len(self.sets[n])]


def blocks(items: DataFrame, id_col: str, shingle: int, percent: int, bins: int) -> Iterator[tuple[Items, bool]]:
    """The items, in blocks of a bounded number of words, and whether it is the only one. Only the stated query set passes through the
    driver, a block at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    words = rows.select(F.sum(F.length("t") / 2)).first()[0] or 0
    n = max(1, -(-int(words) // BLOCK_SHINGLES))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Items([tuple(r) for r in part.collect()], shingle, percent, bins), n == 1


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, bins: int = 64, id_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared: one row per document row and item contained in it.

    Of more than one block of items each is searched, and its rows are written, before the next is read."""
    small_batches(docs.sparkSession)
    rows, scratch = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), Scratch(docs.sparkSession)
    found = None
    for block, only in blocks(items, id_col, shingle, percent, bins):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                out = [(d, block.ids[n], len(block.sets[n]), both) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for n, both in block.contained(t.as_py())]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_shared"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, n_item long, n_shared long")
        part = part if only else scratch.written(part, "found")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, bins: int = 64, id_col: str = "item_id") -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no item; nothing is shuffled. Of more than one block of items each is
    searched, and the rows that are left are written, before the next is read."""
    small_batches(docs.sparkSession)
    at, scratch, before = docs.columns.index("text"), Scratch(docs.sparkSession), None
    for block, only in blocks(items, id_col, shingle, percent, bins):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                yield batch.filter(pa.array([not block.contained(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not only:
            docs = scratch.written(docs, "clean")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
