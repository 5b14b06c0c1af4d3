"""Line dedup: a sharded minimal perfect hash over line digests.

The key of a line is the line without blanks (0x20, 0x09-0x0D) at its ends, A-Z in lower
case; a key of at least ``least`` code points counts once a document. Digests of keys
(128 bits of BLAKE2b) that stand in at least ``floor`` documents are dealt to shards by
their first half. Each shard is one row of arrays: the bits of a minimal perfect hash in
levels (a level holds the digests that are alone in their place, the others go on to the
next), and in its order the other half of each digest as fingerprint, the number of
documents and the largest id. Documents are then read once more, and each of their lines
probes those arrays; no lines are joined and texts are never shuffled.

Shards are files in the shared folder. A worker opens a shard when lines first probe it,
takes the lines of many documents shard by shard, and keeps a bounded number of bytes of
shards. A digest outside the index passes for one inside only if all 64 bits of the
fingerprint of its place agree.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, qualified, read_table
from .textbytes import chunks, mix64

BLANKS = b" \t\n\x0b\x0c\r"
U64 = np.uint64

#: Digests of a shard, on average.
SHARD = 1 << 16
#: Bytes of shards that a worker keeps open.
KEPT_BYTES = 64 << 20
#: Bytes of text whose lines are probed together.
PROBED_BYTES = 8 << 20

_SLOT = np.dtype([("finger", "<i8"), ("documents", "<i8"), ("keeper", "<i8")])


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line; None if it has fewer than ``least`` code points."""
    key = line.strip(BLANKS)
    if len(key) < least:
        return None
    if len(key) < 4 * least and not key.isascii() and sum((c & 0xC0) != 0x80 for c in key) < least:
        return None
    return key.lower()


def digests(lines: list[bytes], least: int) -> tuple[list[int], bytes]:
    """The numbers of the lines with keys, and the digests of these keys, one after another."""
    at, out = [], []
    for k, line in enumerate(lines):
        if len(line) >= least and (key := line_key(line, least)) is not None:
            at.append(k)
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return at, b"".join(out)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers, as levels of bits."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum((sizes + 63) // 64)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(mix64(a + U64((level * 0x9E3779B97F4A7C15) % (1 << 64))) ^ b) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], np.arange(len(a))
        while len(left):
            size = len(left) + len(left) // 4 + 1
            place = cls._place(a[left], b[left], len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair, 0 to n-1 for those built in; any place or -1 for others."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            place = self._place(a[left], b[left], level, size)
            word = self.first[level] + (place >> 6)
            bit = (place & 63).astype(U64)
            here = (self.words[word] >> bit) & U64(1) == 1
            low = self.words[word] & ((U64(1) << bit) - U64(1))
            out[left[here]] = (self.ranks[word] + np.bitwise_count(low))[here]
            left = left[~here]
        return out


class LineIndex:
    """Shards of line digests in the shared folder: build it with ``index_lines``."""

    def __init__(self, path: str, shards: int, floor: int, least: int):
        self.path, self.shards, self.floor, self.least = path, shards, floor, least
        self._open: OrderedDict[int, tuple[PerfectHash, np.ndarray] | None] = OrderedDict()
        self._bytes = 0

    def __getstate__(self):
        return {"path": self.path, "shards": self.shards, "floor": self.floor, "least": self.least}

    def __setstate__(self, state):
        self.__init__(**state)

    def _shard(self, k: int) -> tuple[PerfectHash, np.ndarray] | None:
        if k in self._open:
            self._open.move_to_end(k)
            return self._open[k]
        store, root = fs.FileSystem.from_uri(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(f"{root}/shard={k}", allow_not_found=True)) if x.base_name.endswith(".parquet")]
        shard = None
        for file in found:
            for row in pq.ParquetFile(file.path, filesystem=store).read(columns=["sizes", "words", "slots"]).to_pylist():
                shard = PerfectHash(np.array(row["sizes"], np.int64), np.frombuffer(row["words"], "<u8")), np.frombuffer(row["slots"], _SLOT)
        self._open[k] = shard
        self._bytes += _weight(shard)
        while self._bytes > KEPT_BYTES and len(self._open) > 1:
            self._bytes -= _weight(self._open.popitem(last=False)[1])
        return shard

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest id) of each digest, 0 documents for those outside the index."""
        documents, keeper = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        shard = (a % U64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts, cuts[1:]):
            rows = order[lo:hi]
            held = self._shard(int(shard[rows[0]]))
            if held is None:
                continue
            slot = held[0].slots(a[rows], b[rows])
            inside = (slot >= 0) & (held[1]["finger"][slot] == b[rows].view(np.int64))
            documents[rows[inside]] = held[1]["documents"][slot[inside]]
            keeper[rows[inside]] = held[1]["keeper"][slot[inside]]
        return documents, keeper


def _weight(shard: tuple[PerfectHash, np.ndarray] | None) -> int:
    return 64 if shard is None else shard[0].words.nbytes * 2 + shard[1].nbytes


#: Stands for a missing doc_id, below all others.
_NO_ID = -(1 << 63)


def index_lines(docs: DataFrame, work: Workspace, floor: int = 5, least: int = 40) -> LineIndex:
    """The index of the lines that stand in at least ``floor`` documents.

    Texts are read whole. A key counts once a document; rows of a repeated doc_id are one
    document, and so are all rows without doc_id, whose id is below all others. Null, empty and
    blank texts have no keys; an empty table gives an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                raw, cuts = data.tobytes(), offsets.tolist()
                own, found = [], []
                for k in range(hi - lo):
                    at, keys = digests(raw[cuts[k] : cuts[k + 1]].split(b"\n"), least)
                    if at:
                        distinct = np.unique(np.frombuffer(keys, dtype="V16"))
                        own.append(np.full(len(distinct), ids[lo + k]))
                        found.append(distinct)
                if found:
                    halves = np.concatenate(found).view("<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc", "a", "b"])

    pairs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "text").mapInArrow(run, "doc long, a long, b long")
    counted = pairs.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents"), F.max("doc").alias("keeper"))
    often = work.table(counted.filter(F.col("documents") >= floor), "lines")
    shards = max(1, -(-often.count() // SHARD))

    def build(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy().view(U64) for c in ("a", "b"))
        hashed = PerfectHash.build(a, b)
        slots = np.zeros(len(a), _SLOT)
        place = hashed.slots(a, b)
        slots["finger"][place] = b.view(np.int64)
        slots["documents"][place] = table.column("documents").to_numpy()
        slots["keeper"][place] = table.column("keeper").to_numpy()
        return pa.table({"shard": table.column("shard").slice(0, 1), "sizes": [hashed.sizes.tolist()], "words": [hashed.words.tobytes()], "slots": [slots.tobytes()]})

    # unsigned remainder, as the probing side takes it
    shard = F.pmod(F.pmod(F.shiftrightunsigned("a", 1), F.lit(shards)) * 2 + F.col("a").bitwiseAND(F.lit(1)), F.lit(shards))
    built = often.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, words binary, slots binary")
    path = work.path("shards")
    built.write.partitionBy("shard").parquet(path)
    work.drop(often)
    return LineIndex(qualified(docs.sparkSession, path), shards, floor, least)


def drop_repeated_lines(docs: DataFrame, index: LineIndex, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): lines whose key stands in ``min_docs`` documents stay in the one of largest id only.

    Null text is one empty line, as is empty text. Texts are read whole; the other lines stay
    as they are and in order, all lines of the document that keeps them too. Rows of a repeated
    doc_id are one document in the counts and keep alike; ties can't be, ids being distinct.
    Rows without doc_id share an id below all others. An empty table gives no rows; further
    columns are ignored, whatever their names. Bytes that aren't UTF-8 stay as they are.
    """
    if min_docs < index.floor:
        raise ValueError(f"the index holds lines of {index.floor} documents or more, asked for {min_docs}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column(1), PROBED_BYTES):
                raw, cuts = data.tobytes(), offsets.tolist()
                texts, owners, places, keys = [], [], [], []
                for k in range(hi - lo):
                    texts.append(lines := raw[cuts[k] : cuts[k + 1]].split(b"\n"))
                    at, found = digests(lines, index.least)
                    owners += [k] * len(at)
                    places += at
                    keys.append(found)
                halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
                documents, keeper = index.probe(halves[:, 0].copy(), halves[:, 1].copy())
                gone = (documents >= min_docs) & (keeper != named[lo:hi][np.array(owners, np.int64)])
                total, dropped = [len(x) for x in texts], [0] * len(texts)
                for i in np.flatnonzero(gone).tolist():
                    texts[owners[i]][places[i]] = None
                    dropped[owners[i]] += 1
                kept = [b"\n".join([x for x in t if x is not None] if d else t) for t, d in zip(texts, dropped)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "text"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without its repeated lines: see drop_repeated_lines, also for the odd cases."""
    docs = read_table(spark, sf_dir, "documents")
    work = Workspace(spark, "lines")
    out = drop_repeated_lines(docs, index_lines(docs, work))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
