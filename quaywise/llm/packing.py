"""Packing documents into sequences by cutting-stock column generation.

A document of n tokens gives floor(n / 1024) full sequences; what is left over is its
tail. The tails' length histogram (at most 1023 classes, however many documents there
are) is a cutting-stock problem: a linear program over patterns, where a knapsack
dynamic program over the LP's dual prices finds each next pattern until none improves.
Pattern counts are rounded down and filled with documents ranked inside their length
class. Tails beyond the rounded patterns, and those of patterns that would waste more
than ``waste`` tokens, are laid end to end and cut at the sequence border; the very last
stretch is cut into powers of two, which need no padding.

Ranks are counted inside (length, salt) cells and shifted by the cells' cumulated sizes. A
length has salts in proportion to its pieces, about ``CELLS`` cells a shuffle partition
over all lengths, so neither a common length nor the whole table meets in one task, and the
driver sees 1024 + CELLS x partitions counters at most.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, tokenizer
from .store import Workspace, partitions, read_table
from .textbytes import chunks

SEQUENCE = 1024
END_ID = 0
CELLS = 4


class CuttingStock:
    """Minimise the number of bins of ``size`` for ``demand[i]`` items of length ``lengths[i]``."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, size: int = SEQUENCE):
        self.w, self.d, self.size = lengths.astype(np.int64), demand.astype(np.float64), size

    def solve(self, rounds: int | None = 60, columns: int = 24, gap: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, amounts): columns of item counts and how many bins of each, fractional.

        Primal simplex on the pattern matrix with an explicit basis inverse, from a feasible
        triangular basis; each round prices up to ``columns`` patterns by one dynamic program.
        Demand is shaken a little against cycling and restored for the amounts. It ends when no
        pattern improves, or within ``gap`` of the dual bound, or after ``rounds``; with
        rounds=None and gap=0 at the optimum.
        """
        m = len(self.w)
        if not m:
            return np.zeros((0, 0), np.int64), np.zeros(0)
        shaken = self.d * (1 + 1e-9 * np.arange(1, m + 1)) + 1e-7 * np.arange(1, m + 1)
        basis = self._first_basis(shaken)
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ shaken, 0)
        pivots = 0
        for _ in itertools.count() if rounds is None else range(rounds):
            prices = inverse.sum(axis=0)
            value, found = self._price(prices, columns)
            if value <= 1 + 1e-7 or x.sum() <= prices @ shaken / value * (1 + gap):
                break
            for column in found:
                if inverse.sum(axis=0) @ column <= 1 + 1e-9:
                    continue
                step = inverse @ column
                grows = step > 1e-9
                if not grows.any():
                    continue
                ratio = np.where(grows, x / np.where(grows, step, 1), np.inf)
                out = int(np.argmin(ratio))
                theta = ratio[out]
                x -= theta * step
                x[out] = theta
                np.maximum(x, 0, out=x)
                pivot = inverse[out] / step[out]
                inverse -= np.outer(step, pivot)
                inverse[out] = pivot
                basis[:, out] = column
                pivots += 1
                if pivots % 500 == 0:
                    inverse = np.linalg.inv(basis)
                    x = np.maximum(inverse @ shaken, 0)
        return basis.astype(np.int64), np.maximum(np.linalg.solve(basis, self.d), 0)

    def _first_basis(self, demand: np.ndarray) -> np.ndarray:
        """Patterns filled around the longest class left, each used until one of its classes runs out.

        Pattern k holds no class that ran out before it and does hold the one it exhausts, so
        the matrix is triangular up to order, and its amounts are not negative: a feasible basis.
        """
        m = len(self.w)
        place = {int(w): i for i, w in enumerate(self.w)}
        left = demand.copy()
        there = np.zeros(self.size + 1, dtype=bool)
        there[self.w] = True
        basis = np.zeros((m, m))
        for k in range(m):
            longest = int(np.flatnonzero(there)[-1])
            items = [longest, *self._fill(self.size - longest, there)]
            for w in items:
                basis[place[w], k] += 1
            used = np.flatnonzero(basis[:, k])
            ratio = left[used] / basis[used, k]
            out = used[int(np.argmin(ratio))]
            left -= basis[:, k] * ratio.min()
            left[out] = 0
            there[self.w[out]] = False
        return basis

    @staticmethod
    def _fill(room: int, there: np.ndarray, tries: int = 12) -> list[int]:
        """Lengths that fill ``room`` exactly if one, two or three do, else longest first."""

        def two(r: int) -> list[int]:
            if r <= 0:
                return []
            if there[r]:
                return [r]
            pairs = np.flatnonzero(there[1:r] & there[r - 1 : 0 : -1])
            return [int(pairs[-1]) + 1, r - int(pairs[-1]) - 1] if len(pairs) else []

        out: list[int] = []
        while room > 0:
            found = two(room)
            if found:
                return out + found
            fits = np.flatnonzero(there[: room + 1])[::-1]
            if not len(fits):
                break
            for w in fits[:tries].tolist():
                rest = two(room - w)
                if rest or room == w:
                    return [*out, w, *rest]
            out.append(int(fits[0]))
            room -= int(fits[0])
        return out

    def _price(self, prices: np.ndarray, most: int) -> tuple[float, list[np.ndarray]]:
        """The greatest price of a pattern that fits, and patterns dearer than a bin, best first.

        A knapsack dynamic program over the room used; the best pattern that holds each
        class comes from the same table, so one pass prices many patterns.
        """
        dense = np.full(self.size + 1, -np.inf)
        dense[self.w] = prices
        best = np.zeros(self.size + 1)
        pick = np.zeros(self.size + 1, dtype=np.int64)
        buffer = np.empty(self.size + 1)
        for room in range(1, self.size + 1):
            value = np.add(dense[1 : room + 1], best[room - 1 :: -1], out=buffer[:room])
            j = int(value.argmax())
            if value[j] > best[room - 1] + 1e-12:
                best[room], pick[room] = value[j], j + 1
            else:
                best[room] = best[room - 1]
        place = {int(w): i for i, w in enumerate(self.w)}
        through = prices + best[self.size - self.w]
        out, seen = [], set()
        for i in np.argsort(-through)[: 4 * most]:
            if through[i] <= 1 + 1e-7 or len(out) == most:
                break
            column, room = np.zeros(len(self.w)), self.size - int(self.w[i])
            column[i] = 1
            while room > 0:
                w = int(pick[room])
                if w:
                    column[place[w]] += 1
                room -= w or 1
            key = column.tobytes()
            if key not in seen:
                seen.add(key)
                out.append(column)
        return float(best[self.size]), out


def plan(lengths: np.ndarray, demand: np.ndarray, size: int = SEQUENCE, waste: int = 8) -> tuple[list[tuple[int, int, int, int, int, int]], np.ndarray, int]:
    """Rows (length, first rank, copies, bins, first bin, offset in the bin), tails placed per class, bins used."""
    rows, placed, bins = [], np.zeros(len(lengths), np.int64), 0
    patterns, amounts = CuttingStock(lengths, demand, size).solve()
    for j in np.argsort(-amounts, kind="stable"):
        column = patterns[:, j]
        if size - int(column @ lengths) > waste or not column.any():
            continue
        used = np.flatnonzero(column)
        room = int(np.min((demand[used] - placed[used]) // column[used]))
        n = min(int(np.floor(amounts[j] + 1e-6)), room)
        if n <= 0:
            continue
        offset = 0
        for i in used:
            rows.append((int(lengths[i]), int(placed[i]), int(column[i]), n, bins, offset))
            offset += int(column[i] * lengths[i])
            placed[i] += n * column[i]
        bins += n
    return rows, placed, bins


def _pieces(docs: DataFrame, path: str, size: int) -> DataFrame:
    """One row per full sequence and per tail: (piece, doc_id, start, length, ids_crc32, doc_tokens, tail_ids).

    ``piece`` numbers the rows; it is stable once the rows are written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        piece = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = bpe.encode_joined(data, offsets)
                names = batch.column(0).slice(lo, hi - lo).to_pylist()
                rows = []
                for k, name in enumerate(names):
                    own = np.append(ids[at[k] : at[k + 1]], END_ID).astype("<u4")
                    for start in range(0, len(own), size):
                        part = own[start : start + size]
                        rows.append((piece, name, start, len(part), zlib.crc32(part.tobytes()), len(own), None if len(part) == size else part.astype("<u4" if len(bpe.token_bytes) > 65536 else "<u2").tobytes()))
                        piece += 1
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail_ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tail_ids binary")


def _ranks(table: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Adds ``rank``, 0, 1, ... inside each length, and returns each length's count."""
    spark = table.sparkSession
    counts = dict(tuple(r) for r in table.groupBy("length").count().collect())  # at most 1024 rows
    share = CELLS * partitions(spark) / max(1, sum(counts.values()))
    salts = spark.createDataFrame([(k, 1 + int(share * n)) for k, n in counts.items()], "length long, _salts int")
    salted = table.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("piece"), F.col("_salts")).cast("int")).drop("_salts")
    cells = salted.groupBy("length", "_salt").count().collect()
    totals: dict[int, int] = {}
    shifts = []
    for k, s, n in sorted(tuple(c) for c in cells):
        shifts.append((k, s, totals.get(k, 0)))
        totals[k] = totals.get(k, 0) + n
    shift = spark.createDataFrame(shifts, "length long, _salt int, _shift long")
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(shift), ["length", "_salt"])
    return ranked.withColumn("rank", F.col("_shift") + F.col("_row") - 1).drop("_salt", "_row", "_shift"), totals


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, waste: int = 8) -> DataFrame:
    """Pieces of documents in sequences: see the module.

    Null or empty text: the closing id alone. Long texts are packed whole. Rows of a repeated
    doc_id, and repeated rows, are packed one by one, as are rows without doc_id. Tails of one
    length are ties; the smaller doc_id comes first inside a cell. An empty table gives no rows;
    further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.table(_pieces(docs, path or default_path(), size), "pieces")
    ranked, totals = _ranks(pieces.drop("tail_ids"))
    n_full = totals.pop(size, 0)

    lengths = np.array(sorted(totals), dtype=np.int64)
    demand = np.array([totals[i] for i in lengths.tolist()], dtype=np.int64)
    rows, placed, bins = plan(lengths, demand, size, waste) if len(lengths) else ([], np.zeros(0, np.int64), 0)
    schema = "length long, first long, copies long, bins long, bin long, at long"
    patterns = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows], schema)  # a few thousand rows at most
    rest = demand - placed
    base = np.cumsum(rest * lengths) - rest * lengths
    stretch = spark.createDataFrame([(int(w), int(p), int(b)) for w, p, b in zip(lengths, placed, base)], "length long, placed long, base long")
    ranked = work.table(ranked.join(F.broadcast(stretch), "length", "left"), "ranked")

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = ranked.filter(F.col("length") == size).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    nth = F.col("rank") - F.col("first")
    fitted = (
        ranked.filter("rank < placed")
        .join(F.broadcast(patterns), "length")
        .filter("rank >= first and rank < first + copies * bins")
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (n_full + F.col("bin") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"))
    )
    loose = ranked.filter("rank >= placed").withColumn("from", F.expr("base + (rank - placed) * length"))
    total = int((rest * lengths).sum())
    cut = _cut(loose.select("piece", "length", "from"), pieces, total, n_full + bins, size, work)
    result = work.table(whole.unionByName(fitted).unionByName(cut).select(*out), "result")
    work.keep(result)
    return result


def last_stretch(total: int, size: int) -> list[tuple[int, int]]:
    """(from, length) of the last, partly filled sequence: its bits as powers of two."""
    at, out = total - total % size, []
    for b in range(size.bit_length() - 1, -1, -1):
        if total % size >> b & 1:
            out.append((at, 1 << b))
            at += 1 << b
    return out


def _cut(loose: DataFrame, pieces: DataFrame, total: int, first_sequence: int, size: int, work: Workspace) -> DataFrame:
    """Loose tails laid end to end, cut at every sequence border."""
    marks = last_stretch(total, size)
    even = total - total % size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, start, tokens, at, raw, length in zip(*(batch.column(k).to_pylist() for k in range(6))):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * length else "<u4").astype("<u4")
                done = 0
                while done < length:
                    here = at + done
                    if here < even:
                        sequence, offset = here // size, here % size
                        room = size - offset
                    else:
                        k = next(k for k, (a, n) in enumerate(marks) if a <= here < a + n)
                        sequence, offset = even // size + k, here - marks[k][0]
                        room = marks[k][1] - offset
                    n = min(room, length - done)
                    rows.append((name, start + done, n, zlib.crc32(ids[done : done + n].tobytes()), tokens, first_sequence + sequence, offset))
                    done += n
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # Spark broadcasts the loose tails' places if they are few, by its own threshold, and sorts otherwise
    ids = pieces.filter("tail_ids is not null").select("piece", "doc_id", "start", "doc_tokens", "tail_ids")
    with_ids = loose.join(ids, "piece").select("doc_id", "start", "doc_tokens", "from", "tail_ids", "length")
    return with_ids.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 1024 tokens: see pack, also for the odd cases."""
    return pack(read_table(spark, sf_dir, "documents"))
