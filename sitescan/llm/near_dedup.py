"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Data flow, all of it on Spark:

1. every text becomes the set of its word shingles (64-bit hashes), a digest of that set and SuperMinHash band keys;
2. texts with equal sets form one class, whose smallest id stands for it from then on, so exact copies cost one row;
3. in each band bucket every class is paired with one centre only (never all pairs of a bucket); candidate pairs are
   verified on full sets, and links are grouped by union-find;
4. buckets whose classes are still in different groups get further centres, and at last what is still in different groups is
   compared block by block under an exact bound, so no link between different texts is lost, while nothing is spent on
   pairs inside a group.

Nulls, empty and blank texts have an empty set and are linked with nothing. Rows with a null id come back with a null
component and are kept. Rows that repeat an id count as one document, which has the links of all its texts. Other columns of the
input are ignored; an input without rows gives none. A text of any length is worked through in pieces of fixed size; only its set,
eight bytes for each shingle, is held whole, in batches of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, hashed_words, mix, shingles, slices, small_batches, times_golden

#: Elements handled at once: bounds the rank tables to a few MB.
_CHUNK = 1 << 15
#: Bits of a set's bitmap, and classes in a block of a bucket.
_BITS, _BLOCK = 2048, 256
_LOW = np.uint64(0xFFFFFFFF)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, owner: np.ndarray, docs: int, size: int = 128) -> np.ndarray:
    """SuperMinHash signatures of many sets at once.

    `elements` are distinct 64-bit hashes within each set, `owner` the ascending set number of each. An element deals out
    the ranks 0, 1, ... over the `size` slots in the order of its own pseudo-random permutation (Fisher-Yates, one swap
    per rank); slot values are rank + fraction, kept as rank << 32 | fraction. A set is finished, and its elements stop
    dealing, once every slot holds a value below the next rank. Slots of an empty set hold the largest value.

    Elements are dealt `_CHUNK` at a time, so memory does not grow with a set; a set's later elements start from the slots that its
    earlier ones have filled, and stop the earlier.
    """
    sig = np.full((docs, size), _NONE)
    flat = sig.reshape(-1)
    for at in range(0, len(elements), _CHUNK):
        part, own = elements[at : at + _CHUNK], owner[at : at + _CHUNK]
        rows = np.arange(len(part))
        perm = np.empty((len(part), size), np.uint8 if size <= 256 else np.int32)
        perm[:] = np.arange(size)
        for rank in range(size):
            x = mix(part + times_golden(rank + 1))
            pick = rank + ((x & _LOW) % np.uint64(size - rank)).astype(np.int64)
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, rank]
            np.minimum.at(flat, own * size + slot, np.uint64(rank << 32) | (x >> np.uint64(32)))
            live = np.unique(own)
            open_docs = np.zeros(docs, bool)
            open_docs[live] = sig[live].max(1) >= np.uint64((rank + 1) << 32)
            keep = open_docs[own]
            if not keep.all():
                if not keep.any():
                    break
                part, own, perm = part[keep], own[keep], perm[keep]
                rows = rows[: len(part)]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` slots; the number of the band is part of the key."""
    docs, size = sig.shape
    cut = sig.reshape(docs, size // rows, rows)
    key = np.broadcast_to(mix(np.arange(size // rows, dtype=np.uint64) + GOLDEN), cut.shape[:2])
    for i in range(rows):
        key = mix(key ^ cut[:, :, i] + times_golden(i + 1))
    return key


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingles(hashed_words(text), size))


def signatures(docs: DataFrame, shingle: int = 5, size: int = 128, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set, null if empty), bands (array<long>, empty if the set is)."""
    per = size // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            keys = band_keys(super_minhash(np.concatenate(sets), owner, len(sets), size), rows)
            lens = np.array([per if len(s) else 0 for s in sets], np.int64)
            flat = keys[lens > 0].reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key string, bands array<long>")


def outlines(docs: DataFrame, shingle: int) -> DataFrame:
    """rep, n, cells, bits of each text: the size of its set, the sorted shingle hashes, and a bitmap with a bit per shingle by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            on = np.zeros((len(sets), _BITS), bool)
            for row, s in zip(on, sets, strict=True):
                row[(mix(s) % np.uint64(_BITS)).astype(np.int64)] = True
            bits = np.packbits(on, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([b.tobytes() for b in bits], pa.binary())],
                ["rep", "n", "cells", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "rep long, n long, cells binary, bits binary")


def _between(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but different groups that may reach the threshold, without forming all pairs as rows.

    A bucket of c rows is cut by hash into about sqrt(c / 256) blocks, each row of the join is a pair of blocks, and each pair of blocks has
    a key of its own, so a large bucket is dealt over all tasks. Inside, a bit that
    only one of two bitmaps has is a shingle that the other set lacks, which bounds the intersection from above: exact, so no
    link is lost, and sharp enough that few pairs below the threshold are left.
    """
    parts = F.ceil(F.sqrt(F.col("c") / _BLOCK)).cast("long")
    sized = left.join(left.groupBy("key").agg(F.count("*").alias("c")), "key").withColumn("parts", parts)
    member = F.struct("rep", "n", "g", "bits")
    blocks = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts"))).groupBy("key", "block").agg(F.collect_list(member).alias("x"), F.max("parts").alias("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = blocks.select("key", "x", "block", other.alias("other"))
    pairs = dealt.filter("block <= other").join(dealt.filter("other <= block").select("key", F.col("block").alias("other"), F.col("other").alias("block"), F.col("x").alias("y")), ["key", "block", "other"])

    def columns(cell) -> tuple[np.ndarray, ...]:
        rep, n, g = (np.asarray(cell.field(i).to_numpy(zero_copy_only=False)) for i in range(3))
        bits = np.frombuffer(b"".join(cell.field(3).to_pylist()), np.uint64).reshape(len(rep), -1)
        return rep, n, g, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                rep, n, g, bits = columns(x.values)
                rep2, n2, g2, bits2 = columns(y.values)
                ones, ones2 = np.bitwise_count(bits).sum(1, dtype=np.int64), np.bitwise_count(bits2).sum(1, dtype=np.int64)
                out = []
                for i in range(len(rep)):
                    ok = np.flatnonzero((g2 != g[i]) & (100 * np.minimum(n2, n[i]) >= percent * np.maximum(n2, n[i])))
                    for at in range(0, len(ok), 4096):
                        some = ok[at : at + 4096]
                        both = np.bitwise_count(bits2[some] & bits[i]).sum(1, dtype=np.int64)
                        most = np.minimum(n[i] - (ones[i] - both), n2[some] - (ones2[some] - both))
                        some = some[100 * most >= percent * (n[i] + n2[some] - most)]
                        out.append(np.stack([np.maximum(rep[i], rep2[some]), np.minimum(rep[i], rep2[some])]))
                if out:
                    a, b = np.unique(np.concatenate(out, 1), axis=1)
                    yield from slices([pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])], rows=1 << 16)

    return pairs.select("x", "y").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets (rep, cells) have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_cells"), batch.column("b_cells"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("cells").alias("a_cells")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("cells").alias("b_cells")), "b")
    return both.select("a", "b", "a_cells", "b_cells").mapInArrow(run, "a long, b long").distinct()


def _forest(edges: DataFrame) -> DataFrame:
    """Union-find over each batch of edges: at most one edge (node, root) per node of a batch, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while up.setdefault(root, root) != root:
                    root = up[root]
                while up[x] != root:
                    up[x], x = root, up[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            out = [(x, find(x)) for x in up]
            out = [(x, r) for x, r in out if x != r]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (smallest id reachable) of an undirected edge table (a, b) of long ids.

    Union-find contracts each batch of edges, then large-star and small-star rounds, which need O(log n) of them, join the
    forests of different tasks. A hub's neighbours are never gathered: a round takes the minimum per node and joins it back.
    The result is a table of `scratch`, or stays as long as the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = scratch.written(_forest(edges.filter("a != b")).distinct(), "edges")
    state = None
    while True:
        # large star: each larger neighbour is linked to the node's smallest neighbour (or itself)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: each smaller neighbour, and the node itself, is linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b"))
        edges, before = scratch.written(small.distinct(), "edges"), edges
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(now)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = 128, rows: int = 4, rounds: int = 1) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id and kept (it is the one of its component that stays).

    Two texts are linked if 100 * intersection >= percent * union of their sets of `shingle`-word shingles. A link at 0.8
    is missed by all 32 bands of 4 rows with a probability of 5e-8.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sigs = scratch.written(signatures(docs, shingle, size, rows), "signatures")
    full = sigs.filter("set_key is not null and doc_id is not null")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = full.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep")
    reps = full.join(classes, "set_key").filter("doc_id = rep").dropDuplicates(["rep", "set_key"])
    bands = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("centre"), F.count("*").alias("c")).filter("c > 1")
    # classes that share a bucket, each with the bucket's centre; size alone rules out some pairs but never some members
    buckets = scratch.written(bands.join(shared.select("key", "centre"), "key"), "buckets")
    # the sets of those classes are made and written once; texts that repeat under one id are taken once
    near = docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    near = near.groupBy("doc_id", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = scratch.written(outlines(near, shingle), "sets")
    copies = member.filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # first centre: of all buckets of a class, the smallest
    star = buckets.filter("rep != centre").groupBy("rep").agg(F.min("centre").alias("b")).withColumnRenamed("rep", "a")
    links = scratch.written(verified(star, sets, percent), "links")
    opened = buckets
    for step in range(rounds + 1):
        g = components(links, scratch).withColumnRenamed("node", "rep")
        placed = opened.join(g, "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("g"))
        mixed = placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi").select("key")
        opened = scratch.written(placed.join(mixed, "key", "left_semi"), "mixed")
        if opened.isEmpty():
            break
        if step < rounds:
            # another centre per bucket, chosen by hash: each class outside the centre's group is tried against it
            other = opened.groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("g").alias("h")), F.xxhash64("rep", F.lit(step))).alias("c"))
            pairs = opened.join(other.select("key", "c.*"), "key").filter("g != h").filter(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)")
            pairs = pairs.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()
        else:
            # no link is lost: what is still in different groups is compared
            pairs = _between(opened.select("key", "rep", "g").join(sets.select("rep", "n", "bits"), "rep"), percent)
        pairs = scratch.written(pairs, "pairs")
        links = scratch.written(links.unionByName(verified(pairs, sets, percent)), "links")
        scratch.drop_all_but(sigs, sets, opened, links)
    found = components(links.unionByName(copies)).withColumnRenamed("node", "doc_id")
    scratch.drop_all_but(sigs)
    return (
        sigs.join(found, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80, size: int = 128, rows: int = 4, rounds: int = 1) -> DataFrame:
    """The rows of `docs`, all columns, of the document that stays of each group.

    Rows with a null id stay. Of rows that repeat an id, which count as one document, the one with the least text stays."""
    groups = near_duplicates(docs, shingle, percent, size, rows, rounds).select(F.col("doc_id").alias("_id"), "kept")
    by_id = F.col("doc_id").cast("long") == F.col("_id")
    out = docs.join(groups.filter("not kept").select("_id").distinct(), by_id, "left_anti")
    again = groups.filter("kept and _id is not null").groupBy("_id").count().filter("count > 1").select("_id")
    if again.isEmpty():
        return out
    least = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")
    once = out.join(again, by_id, "left_semi").groupBy(F.col("doc_id").cast("long")).agg(least).select("row.*")
    return out.join(again, by_id, "left_anti").unionByName(once)
