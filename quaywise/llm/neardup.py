"""Near-duplicates by circulant MinHash.

A document is the set of its distinct 5-word shingles. Two permutations of the 64-bit
shingle codes make the whole signature: the first scatters the set, the second is read
at circularly shifted places, one shift a coordinate. Bands of coordinates put documents
into buckets. Documents with one and the same sequence of lower-cased words, known by its
SHA-256, are one class from the start.

Every link is confirmed on the full sets: 100 * intersection >= 75 * union, where a shingle
counts as shared only if its bytes are equal. Buckets are not expanded into pairs. Members
carry the label of the component found so far. In each of a few rounds a bucket's largest
component sends one member, drawn by a hash, to meet the members of all other components;
links join components and most buckets end with one. In the last round the members still
outside a bucket's largest component meet all other components' members of the bucket, so
no link is lost, and a bucket of thousands of copies costs a few comparisons a member.

Pairs are ruled out before their texts are read by an exact bound. The shingles of a set
are dealt to ``CELLS`` cells, of which a bitmap tells which are taken. A shared shingle
lies in a cell that both sets take, and a set has only so many shingles more than cells
taken; so the intersection is at most the cells taken by both and the smaller of the two
surpluses. No pair that is alike enough is ever dropped by it.

Components come from alternating large-star and small-star steps on edge tables in the
shared folder; nothing about single documents reaches the driver. Joins of tables that grow
with the documents shuffle at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, read_table
from .textbytes import LOWER, U64, Runs, chunks, join_words, mix64, same_bytes, signed, span_hashes, word_bounds

SHINGLE = 5
# A pair of likeness 0.75 shares no band with probability (1 - 0.75 ** 6) ** 70, about one in a million.
BANDS, ROWS = 70, 6
#: Cells of the bitmap that bounds intersections.
CELLS = 1024
#: Rounds in which one member of a bucket's largest component meets the others.
PIVOTS = 2
PERCENT = 75

_SCATTER = U64(0x5851F42D4C957F2D)
_SHIFT = np.uint32(0x9E3779B1)


class Shingles:
    """The sets of distinct shingles of some texts: sorted codes, where each set begins, the bytes of each shingle.

    Texts of fewer words than ``width`` have all their words as one shingle. ``text`` holds
    the lower-cased words one space apart.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
        data = LOWER[data]
        starts, ends, first = word_bounds(data, offsets)
        self.text, starts, ends = join_words(data, starts, ends)
        runs = Runs(span_hashes(self.text, starts, ends))
        words = np.diff(first)
        self.word_starts, self.first = starts, first
        n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
        owner = np.repeat(np.arange(len(n)), n)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        end = begin + np.minimum(words, width)[owner]
        codes = runs.of(begin, end)
        order = np.lexsort((codes, owner))
        codes, owner = codes[order], owner[order]
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        self.codes, pick = codes[keep], order[keep]
        self.at = np.searchsorted(owner[keep], np.arange(len(words) + 1))
        self.begins = starts[begin[pick]] if len(pick) else pick
        self.sizes = ends[end[pick] - 1] - self.begins if len(pick) else pick

    def sequence_digests(self) -> list[bytes]:
        """SHA-256 of the words of each text."""
        edge = np.append(self.word_starts, len(self.text))[self.first].tolist()
        raw = self.text.tobytes()
        return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edge, edge[1:])]

    def cells(self, cells: int = CELLS) -> np.ndarray:
        """(sets, cells / 64) of 64 bits: which cells the shingles of each set take."""
        out = np.zeros((len(self.at) - 1, cells), dtype=np.uint8)
        owner = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        out[owner, (mix64(self.codes) % U64(cells)).astype(np.int64)] = 1
        return np.packbits(out, axis=1, bitorder="little").view("<u8")

    def shared(self, x: int, y: int) -> int:
        """How many shingles sets x and y share, compared on bytes."""
        a, b = slice(self.at[x], self.at[x + 1]), slice(self.at[y], self.at[y + 1])
        _, i, j = np.intersect1d(self.codes[a], self.codes[b], assume_unique=True, return_indices=True)
        i, j = i + a.start, j + b.start
        same = self.sizes[i] == self.sizes[j]
        i, j = i[same], j[same]
        return int(same_bytes(self.text, self.begins[i], self.text, self.begins[j], self.sizes[i]).sum())


def _permute32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers (multiply, xor-shift, multiply, xor-shift), in place."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(codes: np.ndarray, at: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: (sets, coordinates) of 32 bits. Empty sets get all ones.

    The first permutation scatters a code to its place in 0 .. 2**32-1; coordinate k reads
    the second permutation at that place shifted circularly by k steps.
    """
    out = np.full((len(at) - 1, coordinates), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    place = (mix64(codes * _SCATTER) >> U64(32)).astype(np.uint32)
    begin = at[full]
    for k in range(coordinates):
        shifted = place + np.uint32((k * int(_SHIFT)) & 0xFFFFFFFF)
        out[full, k] = np.minimum.reduceat(_permute32(shifted), begin)
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, n_shingles, words, bands, cells): set size, digest of the word sequence, a hash a band, the bitmap of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2), 1 << 19):
                sets = Shingles(data, offsets)
                n = np.diff(sets.at)
                sig = signature(sets.codes, sets.at, bands * rows)
                hashed = np.zeros((len(n), bands), dtype=np.uint64)
                for r in range(rows):
                    hashed = mix64(hashed + sig[:, r::rows][:, :bands].astype(np.uint64) + U64(0x9E3779B97F4A7C15))
                hashed ^= band_salt
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(sets.sequence_digests(), pa.binary()), lists(hashed), lists(sets.cells())],
                    ["doc_id", "row", "n_shingles", "words", "bands", "cells"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_shingles long, words binary, bands array<long>, cells array<long>")


def may_link(size: str, cells: str, other_size: str, other_cells: str, percent: int = PERCENT) -> Column:
    """False only if two sets, by their sizes and cells, can't be alike enough."""
    taken = lambda c: reduce(add, [F.bit_count(F.col(c)[i]) for i in range(CELLS // 64)])
    both = reduce(add, [F.bit_count(F.col(cells)[i].bitwiseAND(F.col(other_cells)[i])) for i in range(CELLS // 64)])
    most = both + F.least(F.col(size) - taken(cells), F.col(other_size) - taken(other_cells))
    most = F.least(most, size, other_size)
    return 100 * most >= percent * (F.col(size) + F.col(other_size) - most)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                joined = pa.concat_arrays([part.column(k).cast(pa.large_string()) for k in (2, 3)])
                keep = []
                for _, _, data, offsets in chunks(joined, 1 << 40):
                    sets, half = Shingles(data, offsets), part.num_rows
                    n = np.diff(sets.at).tolist()
                    for k in range(half):
                        same = sets.shared(k, half + k)
                        keep.append(same > 0 and 100 * same >= percent * (n[k] + n[half + k] - same))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable."""
    now = work.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = work.table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        # an edge (u, v) of a node with the least neighbour m becomes (v, m), the least one (u, m)
        moved = large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = work.table(moved.distinct(), "edges")
        work.drop(now, large)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            labels = after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            labels = work.table(labels, "labels")
            work.drop(after)
            return labels
        now, before = after, state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Null, empty and blank texts have empty sets and are linked with nothing. Texts are read
    whole, however long. Ties and repeated texts fall into one class. A repeated doc_id gives
    a row for each of its rows and counts as one document that is linked with whatever any of
    its rows is linked with; rows without doc_id are left out. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text").filter("doc_id is not null")
    sketches = work.table(sketch(base), "sketches")
    # documents with one word sequence are one class, named by its smallest id
    smallest = F.min(F.struct("doc_id", "row")).alias("first")
    classes = work.table(sketches.filter("n_shingles > 0").groupBy("words").agg(smallest), "classes")
    names = work.table(sketches.select("doc_id", "n_shingles", "words").join(classes.select("words", F.col("first.doc_id").alias("class_id")), "words", "left").drop("words"), "names")
    firsts = classes.select("first.doc_id", "first.row").distinct()
    first_sketches = work.table(sketches.select("doc_id", "row", "n_shingles", "bands", "cells").join(firsts.hint("merge"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]), "firsts")
    # an id with several rows of its own: its classes are one component from the start
    own = names.filter("class_id is not null").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    twice = own.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).filter("least < most").select("a")
    tied = work.table(own.join(twice, "a", "left_semi").distinct(), "tied")
    work.drop(sketches, classes)
    labels = _link(base, first_sketches, tied, work)
    node = F.coalesce("class_id", "doc_id").alias("node")
    found = names.select("doc_id", "n_shingles", node).join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    result = work.table(found.withColumn("kept", F.col("doc_id") == F.col("component_id")), "result")
    work.keep(result)
    return result


def _link(base: DataFrame, sketches: DataFrame, tied: DataFrame, work: Workspace) -> DataFrame:
    """(node, root) of the classes that are linked to others. A node may have several sketches and texts."""
    entries = sketches.select("doc_id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = work.table(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared")
    members = work.table(entries.join(shared.hint("merge"), "bucket"), "members")
    involved = work.table(members.select("doc_id").distinct(), "involved")
    met = work.table(sketches.select("doc_id", "row", F.col("n_shingles").alias("size"), "cells").join(involved.hint("merge"), "doc_id"), "met")
    texts = work.table(base.join(met.select("doc_id", "row").hint("merge"), ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "text"), "texts")
    cells = met.select("doc_id", "size", "cells")
    work.drop(shared, involved, sketches)
    labels, tried = components(tied, work), None
    for k in range(PIVOTS + 1):
        pairs = work.table(_pairs(members, cells, labels, tried, k, work), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = work.table(confirm(pairs, texts), "links")
        if not found.isEmpty():
            edges = found.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
            labels = components(edges, work)
        work.drop(found)
    return labels


def _pairs(members: DataFrame, cells: DataFrame, labels: DataFrame, tried: DataFrame | None, k: int, work: Workspace) -> DataFrame:
    """Distinct pairs (a < b) of members of one bucket with different labels that may be alike and weren't tried: a pivot with the others, at last all that are left."""
    now = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root")
    now = work.table(now, "labelled")
    pivot = F.min_by(F.struct("doc_id", "size"), F.xxhash64(F.col("doc_id"), F.lit(k)))
    groups = now.groupBy("bucket", "label").agg(F.count("*").alias("n"), pivot.alias("pivot"))
    tops = groups.groupBy("bucket").agg(F.max_by(F.struct("label", "pivot"), F.struct("n", "label")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    tops = work.table(tops.select("bucket", F.col("top.label").alias("top_label"), F.col("top.pivot.doc_id").alias("x"), F.col("top.pivot.size").alias("size_x")), "tops")
    other = cells.select(F.col("doc_id").alias("x"), F.col("size").alias("size_x"), F.col("cells").alias("cells_x"))
    pair = [F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")]
    if k < PIVOTS:
        # a pivot is the same document in many buckets, as the hash doesn't depend on the bucket
        near = (F.col("label") != F.col("top_label")) & (100 * F.least("size", "size_x") >= PERCENT * F.greatest("size", "size_x"))
        pairs = now.join(tops, "bucket").filter(near).select(*pair).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pairs.withColumnsRenamed({"a": "x", "b": "doc_id"})
        pairs = pairs.join(cells.hint("merge"), "doc_id").join(other.hint("merge"), "x").filter(may_link("size", "cells", "size_x", "cells_x"))
        return pairs.select(*pair).distinct()
    # every member outside a bucket's largest component with every other label's members, none twice
    left = now.join(tops.select("bucket", "top_label"), "bucket").select("bucket", "doc_id", "label", "top_label")
    rest = left.filter("label <> top_label").select("bucket", F.col("doc_id").alias("x"), F.col("label").alias("label_x"))
    rest = work.table(rest.distinct().join(other.hint("merge"), "x"), "rest")
    left = work.table(left.distinct().join(cells.hint("merge"), "doc_id"), "left")
    once = (F.col("label") != F.col("label_x")) & ((F.col("label") == F.col("top_label")) | (F.col("doc_id") > F.col("x")))
    pairs = left.join(rest, "bucket").filter(once & may_link("size", "cells", "size_x", "cells_x")).select(*pair).distinct()
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: see near_duplicates, also for the odd cases."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
