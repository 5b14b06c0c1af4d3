"""Substring dedup with a log-structured fingerprint index.

A window is 50 consecutive words of one document; a word goes if some window over it
also starts in a document with a smaller id. Every window rests on an anchor: of the
12-word grams in it the one with the least hash (the leftmost of equal ones). Equal windows
have equal anchors at equal places, so two documents share a window only if they share an
anchor, and there is about one anchor to 20 words. An anchor's context is all the words
that a window around it can hold; two documents with one context share all the windows on
the anchor.

The index (``FingerprintIndex``) is a folder of sorted immutable runs, bucketed by their
key, and a manifest of them. It holds

* text runs: the digest of a text of 50 words or more, and the first document with it;
* anchor runs: an anchor with its context and first document while it has only one
  context, and a mark that it is mixed from the second context on;
* window runs: the digest of each window on a mixed anchor, and of each span of ``SPAN``
  neighbouring ones, and its first document.

A batch of documents with ids above all before it is merge-joined with the runs: its rows
are shuffled and sorted, the history is neither. Whole copies of a known text go at once
and are not looked at further. Where an anchor has only one context, what comes later with
that context goes. Where it becomes mixed, its candidates are verified against the stored
texts: the windows of each context's first document are digested, looked up and remembered,
first whole spans of them, then one by one those of spans that are new. Digests are 128 bits of BLAKE2b over the bytes of the words, 160 bits for whole
texts, and decide what is equal; the 64-bit anchors only find candidates.

After each batch but a final one runs of like size are compacted, by a merge join of two runs, and a new
manifest is written before old runs are deleted. ``FingerprintIndex.open`` carries on where
an earlier session stopped. An anchor in a third of all documents is one row a run; its
contexts and windows are keyed by their own digests, so no key gathers them. Joins of tables
that grow with the documents shuffle at every size; where texts meet what is known of them,
by ids that are in no two rows of it, the texts are hashed and not sorted.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import RUNNING, Workspace, partitions, read_table, settings
from .textbytes import Runs, chunks, join_words, ragged, signed, span_hashes, word_bounds

WINDOW = 50
GRAM = 12
BATCHES = 3
#: Windows on one anchor that are compared at once, those that begin at the same distance from it.
SPAN = 8


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of ``width`` (the leftmost of equals), by doubling."""
    n = len(values) - width + 1
    place = np.arange(len(values))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        reach += step
    return place[:n]


class Anchors:
    """Anchors of the texts of one chunk: which gram each window rests on."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        self.words = np.diff(self.first)
        self.window, self.gram = window, gram
        # the words one space apart: equal words are equal bytes
        text, self.text_starts, self.text_ends = join_words(data, self.starts, self.ends)
        self.text = text.tobytes()
        n = len(self.starts)
        self.owner = np.repeat(np.arange(len(self.words)), self.words)
        if n >= window:
            # windows that lie in one text: all starts but the last 49 of each text
            at = np.arange(n - window + 1)
            self.window_starts = np.flatnonzero(self.owner[at] == self.owner[at + window - 1])
            grams = Runs(span_hashes(text, self.text_starts, self.text_ends)).of(np.arange(n - gram + 1), np.arange(gram, n + 1))
            on = least_in_windows(grams, window - gram + 1)[self.window_starts]
            new = np.ones(len(on), dtype=bool)
            new[1:] = (on[1:] != on[:-1]) | (self.owner[self.window_starts[1:]] != self.owner[self.window_starts[:-1]])
            self.low = np.flatnonzero(new)  # first window of each anchor, as an index of window_starts
            self.count = np.diff(np.append(self.low, len(on)))
            self.at = on[self.low]
            self.hash = grams[self.at]
        else:
            self.window_starts = self.low = self.count = self.at = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)

    def digests(self, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray | None = None, size: int = 16) -> list[bytes]:
        """Digests of runs of words, each with a small number in front if given."""
        a = self.text_starts[starts].tolist() if len(starts) else []
        b = self.text_ends[ends - 1].tolist() if len(starts) else []
        text, hashed = self.text, hashlib.blake2b
        if marks is None:
            return [hashed(text[x:y], digest_size=size).digest() for x, y in zip(a, b)]
        return [hashed(text[x:y], digest_size=size, key=bytes((m + 1,))).digest() for x, y, m in zip(a, b, marks.tolist())]

    def contexts(self) -> list[bytes]:
        """Digest of all words that the windows around each anchor can hold, and of where among them it stands."""
        text = self.owner[self.at]
        lo = np.maximum(self.at - (self.window - self.gram), self.first[text])
        hi = np.minimum(self.at + self.window, self.first[text + 1])
        return self.digests(lo, hi, self.at - lo)

    def places(self) -> np.ndarray:
        """Word number of each anchor in its text."""
        return self.at - self.first[self.owner[self.at]]

    def text_digests(self) -> list[bytes | None]:
        """Digest of each whole text, null for texts without a window."""
        long = np.flatnonzero(self.words >= self.window)
        found = dict(zip(long.tolist(), self.digests(self.first[long], self.first[long + 1], size=20)))
        return [found.get(k) for k in range(len(self.words))]


def sketch(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, whole, anchors, contexts, places) of every whole text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                a = Anchors(data, offsets, window, gram)
                edge = pa.array(np.searchsorted(a.owner[a.at], np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(signed(a.hash)), pa.array(a.contexts(), pa.binary()), pa.array(a.places().astype(np.int32)))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(a.text_digests(), pa.binary()), *lists], ["doc_id", "row", "whole", "anchors", "contexts", "places"])
                yield out.filter(pc.is_valid(out.column(2)))

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, whole binary, anchors array<long>, contexts array<binary>, places array<int>")


class FingerprintIndex:
    """A folder of sorted, immutable, bucketed runs with a manifest: see the module.

    ``add`` takes the next batch (ids above all before it) and returns what to remove from
    it; ``store`` gives the texts of documents, new and historical, for verification.
    """

    #: Each kind of run: its key and its columns.
    KINDS = {
        "texts": ("whole", "whole binary, first_id long"),
        "anchors": ("anchor", "anchor long, context binary, first_id long, mixed boolean"),
        "windows": ("window", "window binary, first_id long"),
    }

    def __init__(self, spark: SparkSession, root: str, buckets: int, version: int = 0):
        self.spark, self.root, self.buckets, self.version = spark, root, buckets, version
        self.runs: dict[str, list[tuple[str, int]]] = {kind: [] for kind in self.KINDS}
        self._names: dict[str, str] = {}

    @classmethod
    def create(cls, spark: SparkSession, root: str, buckets: int | None = None) -> FingerprintIndex:
        """An empty index. ``buckets`` (the session's shuffle partitions if not given) holds for all its runs."""
        return cls(spark, root, buckets or partitions(spark))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index that an earlier ``add`` left in the folder ``root``, by its newest manifest."""
        rows = spark.read.schema("kind string, path string, n long, place int, buckets int, version int").json(f"{root}/manifest")
        newest = rows.agg(F.max("version")).head()[0]
        lines = rows.filter(F.col("version") == newest).orderBy("kind", "place").collect()
        index = cls(spark, root, lines[0].buckets, newest)
        for r in lines:
            if r.path:
                index.runs[r.kind].append((r.path, r.n))
        return index

    def run(self, kind: str, path: str) -> DataFrame:
        """A run as a bucketed table, which Spark joins by its key without a shuffle."""
        if path not in self._names:
            key, schema = self.KINDS[kind]
            name = self._names[path] = f"quaywise_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._names[path])

    def close(self) -> None:
        """Forget the runs' names in the session's catalog; the files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()

    def keep_texts(self, texts: DataFrame) -> DataFrame:
        """(doc_id, row, text) stored by buckets of doc_id: later batches fetch single texts without a shuffle of all."""
        path, name = f"{self.root}/store-{uuid.uuid4().hex}", f"quaywise_{uuid.uuid4().hex}"
        with settings(self.spark, RUNNING):
            texts.repartition(self.buckets, "doc_id").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, "doc_id").saveAsTable(name)
        self._names[path] = name
        return self.spark.table(name)

    def lookup(self, keys: DataFrame, kind: str) -> DataFrame:
        """``keys`` with the key's columns of each run, ``past_first_0`` and so on (null where it isn't there)."""
        key = self.KINDS[kind][0]
        for k, (path, _) in enumerate(self.runs[kind]):
            run = self.run(kind, path)
            past = run.select(key, *(F.col(c).alias(f"past_{c}_{k}") for c in run.columns if c != key))
            keys = keys.join(past.hint("merge"), key, "left")
        return keys

    def _past(self, kind: str, column: str, of) -> F.Column:  # noqa: ANN001
        """What the runs know of a column, put together by ``of``; null if there is no run."""
        found = [F.col(f"past_{column}_{k}") for k in range(len(self.runs[kind]))]
        type_ = "boolean" if column == "mixed" else "binary" if column == "context" else "long"
        return of(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast(type_)

    def add(self, batch: DataFrame, store: DataFrame, work: Workspace, final: bool = False) -> DataFrame:
        """(doc_id, row, place, nth) of what goes from a batch of (doc_id, row, text).

        place -1: the whole text; nth -1: all windows on the anchor at that place; else windows
        among them, as the first's number + 256 times how many. After a ``final`` batch no run
        is looked up again, so none is compacted.
        """
        sketches = work.table(sketch(batch), "sketches")
        copies, texts = self._copies(sketches, work)
        fresh = sketches.join(copies.hint("merge"), ["doc_id", "row"], "left_anti")
        rows = fresh.select("doc_id", "row", F.explode(F.arrays_zip("anchors", "contexts", "places")).alias("x"))
        found = work.table(rows.select("doc_id", "row", F.col("x.anchors").alias("anchor"), F.col("x.contexts").alias("context"), F.col("x.places").alias("place")), "found")
        work.drop(sketches)
        classes = work.table(found.groupBy("anchor", "context").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")), "classes")
        anchors = self._anchors(classes, work)
        hits = self._hits(found, classes, anchors, work)
        work.drop(found)
        singles, windows = self._windows(classes, anchors, store, work)
        single_context = F.col("mixed") == F.lit(False)
        news = anchors.filter("not seen or mixed and not past_mixed").select("anchor", F.when(single_context, F.col("context")).alias("context"), F.when(single_context, F.col("first_id")).alias("first_id"), "mixed")
        self._append({"texts": texts, "anchors": news, "windows": windows}, work, final)
        work.drop(classes, anchors, texts, windows)
        gone = hits.unionByName(singles).unionByName(copies.select("doc_id", "row", F.lit(-1).alias("place"), F.lit(-1).alias("nth")))
        out = work.table(gone, "gone")
        work.drop(hits, singles, copies)
        return out

    def _copies(self, sketches: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        """(doc_id, row) of texts that stand whole in a smaller document, and the batch's new texts."""
        heads = sketches.groupBy("whole").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        heads = self.lookup(heads, "texts").withColumn("past_id", self._past("texts", "first_id", F.least))
        heads = work.table(heads.select("whole", "past_id", "first_id", "last_id", F.coalesce("past_id", "first_id").alias("least")), "heads")
        copied = heads.filter("least < last_id").select("whole", "least")
        copies = sketches.select("doc_id", "row", "whole").join(copied.hint("merge"), "whole").filter("doc_id > least").select("doc_id", "row").distinct()
        copies = work.table(copies, "copies")
        return copies, work.table(heads.filter("past_id is null").select("whole", "first_id"), "texts")

    def _anchors(self, classes: DataFrame, work: Workspace) -> DataFrame:
        """The batch's anchors and what the runs know of them."""
        own = classes.groupBy("anchor").agg(F.min("context").alias("context"), F.max("context").alias("other"), F.min("first_id").alias("first_id"))
        known = self.lookup(own, "anchors")
        known = known.withColumns(
            {
                "past_context": self._past("anchors", "context", F.coalesce),
                "past_first": self._past("anchors", "first_id", F.least),
                "past_any": self._past("anchors", "mixed", F.greatest),
            }
        )
        known = known.select("anchor", "context", "other", "first_id", "past_context", "past_first", F.col("past_any").isNotNull().alias("seen"), F.coalesce("past_any", F.lit(False)).alias("past_mixed"))
        other = (F.col("context") != F.col("other")) | F.coalesce(F.col("past_context") != F.col("context"), F.lit(False))
        return work.table(known.withColumn("mixed", F.col("past_mixed") | other).drop("other"), "anchors")

    @staticmethod
    def _hits(found: DataFrame, classes: DataFrame, anchors: DataFrame, work: Workspace) -> DataFrame:
        """Anchors whose context stands in a smaller document: all their windows go."""
        again = classes.filter("first_id < last_id").select("anchor", "context", "first_id")
        past = anchors.filter("seen and not mixed").select("anchor", "context", F.col("past_first").alias("first_id"))
        # a table of its own: adaptive execution can then split a common context's rows in the join
        known = work.table(again.unionByName(past).groupBy("anchor", "context").agg(F.min("first_id").alias("first_id")), "again")
        hits = found.join(known.hint("merge"), ["anchor", "context"]).filter("first_id < doc_id")
        hits = work.table(hits.select("doc_id", "row", "place", F.lit(-1).alias("nth")), "hits")
        work.drop(known)
        return hits

    def _windows(self, classes: DataFrame, anchors: DataFrame, store: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
        """Windows of the batch that stand in a smaller document, and what is new to the runs.

        Looked at are the windows on mixed anchors of each context's first document in the
        batch, and those of the one historical document of anchors that have just become mixed.
        A span of windows that is known goes as one row; the windows of a new span are looked
        up for the first document that has it.
        """
        mixed = anchors.filter("mixed")
        new = classes.join(mixed.select("anchor").hint("merge"), "anchor").select(F.col("first_id").alias("doc_id"), "anchor", F.lit(True).alias("new"))
        old = mixed.filter("not past_mixed and past_first is not null").select(F.col("past_first").alias("doc_id"), "anchor", F.lit(False).alias("new"))
        wanted = work.table(new.unionByName(old).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.max("new").alias("new")), "wanted")
        spans = work.table(_locate(store.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "row", "text", "anchors", "new")), "spans")
        head = F.min(F.struct("doc_id", "row", "place", "nth", "new", "windows")).alias("head")
        known = self._known(spans.groupBy("window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), head), work)
        whole = self._repeated(spans, known, F.col("nth") + F.shiftleft(F.size("windows"), 8), work)
        heads = known.filter("past_id is null").select("head.*")
        single = heads.select("doc_id", "row", "place", "nth", "new", F.posexplode("windows").alias("k", "window"))
        single = work.table(single.select("window", "doc_id", "row", "place", (F.col("nth") + F.col("k")).alias("nth"), "new"), "windows")
        seen = self._known(single.groupBy("window").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")), work)
        singles = self._repeated(single, seen, F.col("nth") + 256, work)
        fresh = seen.filter("past_id is null").select("window", "first_id").unionByName(known.filter("past_id is null and size(head.windows) > 1").select("window", "first_id"))
        fresh = work.table(fresh, "fresh")
        both = work.table(whole.unionByName(singles), "singles")
        work.drop(wanted, spans, known, single, seen, whole, singles)
        return both, fresh

    def _known(self, own: DataFrame, work: Workspace) -> DataFrame:
        """Digests with the first document that has each, in the batch and before."""
        found = self.lookup(own, "windows").withColumn("past_id", self._past("windows", "first_id", F.least))
        return work.table(found.select(*own.columns, "past_id", F.least("past_id", "first_id").alias("least")), "known")

    @staticmethod
    def _repeated(rows: DataFrame, known: DataFrame, nth: F.Column, work: Workspace) -> DataFrame:
        """The batch's rows whose digest stands in a smaller document."""
        repeated = known.filter("least < last_id").select("window", "least")
        hits = rows.filter("new").join(repeated.hint("merge"), "window").filter("least < doc_id")
        return work.table(hits.select("doc_id", "row", "place", nth.cast("int").alias("nth")), "repeated")

    def _append(self, news: dict[str, DataFrame], work: Workspace, final: bool) -> None:
        """Write the new rows of each kind as a run, compact, then the manifest; old runs go last."""
        stale: list[str] = []
        for kind, rows in news.items():
            key = self.KINDS[kind][0]
            self.runs[kind].append(self._write(kind, rows.repartition(self.buckets, key)))
            while not final and len(self.runs[kind]) > 1 and 2 * self.runs[kind][-1][1] >= self.runs[kind][-2][1]:
                b, a = self.runs[kind].pop(), self.runs[kind].pop()
                self.runs[kind].append(self._write(kind, self._merged(kind, a[0], b[0])))
                stale += [a[0], b[0]]
        self.version += 1
        lines = [(kind, path, n, place, self.buckets) for kind, runs in self.runs.items() for place, (path, n) in enumerate(runs or [("", 0)])]
        self.spark.createDataFrame(lines, "kind string, path string, n long, place int, buckets int").coalesce(1).write.json(f"{self.root}/manifest/version={self.version}")
        for path in stale:
            if path in self._names:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(path)}")
            work.delete(path)

    def _merged(self, kind: str, a: str, b: str) -> DataFrame:
        """Two runs as one: a merge join of both, without a shuffle."""
        key = self.KINDS[kind][0]
        x, y = self.run(kind, a), self.run(kind, b)
        if kind == "anchors":
            x, y = (t.select(key, F.struct("context", "first_id", "mixed").alias(n)) for t, n in ((x, "x"), (y, "y")))
            mixed = F.coalesce("x.mixed", F.lit(False)) | F.coalesce("y.mixed", F.lit(False))
            columns = [F.when(~mixed, F.coalesce("x.context", "y.context")).alias("context"), F.when(~mixed, F.coalesce("x.first_id", "y.first_id")).alias("first_id"), mixed.alias("mixed")]
        else:
            x, y = (t.select(key, F.col("first_id").alias(n)) for t, n in ((x, "x"), (y, "y")))
            columns = [F.least("x", "y").alias("first_id")]
        return x.join(y.hint("merge"), key, "full_outer").select(key, *columns)

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, int]:
        """A run of rows that are already dealt by the key: one file a bucket."""
        key = self.KINDS[kind][0]
        path, name = f"{self.root}/{kind}-{uuid.uuid4().hex}", f"quaywise_{uuid.uuid4().hex}"
        with settings(self.spark, RUNNING):
            rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        self._names[path] = name
        return path, self.spark.table(name).count()


def _locate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """(window, windows, doc_id, row, place, nth, new) of the windows on the given anchors of each
    (doc_id, row, text, anchors, new): a row a span of windows with its digest and theirs; ``nth``
    is the first one's number on its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for lo, hi, data, offsets in chunks(batch.column(2)):
                a = Anchors(data, offsets, window, gram)
                if not len(a.at):
                    continue
                part = lists.slice(lo, hi - lo)
                sizes = np.diff(np.asarray(part.offsets))
                salt = lambda text, h: h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                wanted = salt(np.repeat(np.arange(hi - lo), sizes), np.asarray(part.flatten()).view(np.uint64))
                pick = np.flatnonzero(np.isin(salt(a.owner[a.at], a.hash), wanted))
                for low in range(0, len(pick), 20_000):
                    group, nth = ragged(a.count[pick[low : low + 20_000]])
                    k = pick[low : low + 20_000][group]
                    begin = a.window_starts[a.low[k] + nth]
                    place = (a.at[k] - begin) // span
                    edge = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])])
                    last = np.append(edge[1:], len(begin)) - 1
                    owner = pa.array(a.owner[a.at[k[edge]]] + lo)
                    windows = pa.ListArray.from_arrays(pa.array(np.append(edge, len(begin)).astype(np.int32)), pa.array(a.digests(begin, begin + window), pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.digests(begin[edge], begin[last] + window), pa.binary()), windows, batch.column(0).take(owner), batch.column(1).take(owner), pa.array(a.places()[k[edge]].astype(np.int32)), pa.array(nth[edge].astype(np.int32)), batch.column(4).take(owner)],
                        ["window", "windows", "doc_id", "row", "place", "nth", "new"],
                    )

    return docs.mapInArrow(run, "window binary, windows array<binary>, doc_id long, row long, place int, nth int, new boolean")


def _keep_masks(a: Anchors, places: pa.ListArray, nths: pa.ListArray) -> np.ndarray:
    """False for each word covered by a window that goes."""
    covered = np.zeros(len(a.starts) + 1, dtype=np.int32)
    text = np.repeat(np.arange(len(places)), np.diff(np.asarray(places.offsets)))
    place, nth = np.asarray(places.flatten(), dtype=np.int64), np.asarray(nths.flatten(), dtype=np.int64)
    if len(text):
        whole = text[place < 0]
        np.add.at(covered, a.first[whole], 1)
        np.add.at(covered, a.first[whole + 1], -1)
        text, place, nth = (x[place >= 0] for x in (text, place, nth))
    if len(text):
        k = np.searchsorted(a.at, a.first[text] + place)
        first = a.low[k] + np.where(nth < 0, 0, nth & 255)
        last = np.where(nth < 0, a.low[k] + a.count[k], first + (nth >> 8)) - 1
        begin, end = a.window_starts[first], a.window_starts[last] + a.window
        np.add.at(covered, begin, 1)
        np.add.at(covered, end, -1)
    return np.cumsum(covered)[: len(a.starts)] == 0


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` tells apart the texts of a repeated doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")


def find_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, row, places, nths) of what goes, one row for each text that loses anything.

    The documents are added to a new index in batches of ascending doc_id. Null, empty and
    short texts have no windows; texts are read whole, however long, and judged as they are
    given, not on what is left. Rows of one doc_id are one document: none removes from
    another. Rows without doc_id lose nothing. An empty table gives no rows; further columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    base = keyed(docs).filter("doc_id is not null")
    bounds = base.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [1.0], 10_000)).head()[0] or []
    bounds = sorted(set(bounds[: batches - 1]))
    index, parts = FingerprintIndex.create(spark, f"{work.root}/index"), []
    try:
        base = index.keep_texts(base)
        for k in range(len(bounds) + 1):
            batch = base
            if k:
                batch = batch.filter(F.col("doc_id") > bounds[k - 1])
            if k < len(bounds):
                batch = batch.filter(F.col("doc_id") <= bounds[k])
            store = base if k == len(bounds) else base.filter(F.col("doc_id") <= bounds[k])
            parts.append(index.add(batch, store, work, final=k == len(bounds)))
    finally:
        index.close()
    work.delete(index.root)
    removal = work.table(removal_rows(parts), "removal")
    work.keep(removal)
    return removal


def removal_rows(parts: list[DataFrame]) -> DataFrame:
    """(doc_id, row, places, nths) from what ``FingerprintIndex.add`` returned for some batches, one row a text."""
    gone = reduce(DataFrame.unionByName, parts)
    gone = gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.struct("place", "nth"))).alias("gone"))
    return gone.select("doc_id", "row", F.col("gone.place").alias("places"), F.col("gone.nth").alias("nths"))


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with repeated windows cut out; kept words joined by single spaces where anything went.

    Documents that lose nothing keep their text as it is (null too); other columns stay, also
    ones named like the operator's own. The odd cases are those of find_repeats.
    """
    gone = find_repeats(docs, batches).select(*(F.col(c).alias(f"__gone_{c}") for c in ("doc_id", "row", "places", "nths")))
    columns = docs.columns
    same = (F.col("doc_id").cast("long") == F.col("__gone_doc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__gone_row"))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left").select(*columns, "__gone_places", "__gone_nths")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, nths = batch.column(len(columns)), batch.column(len(columns) + 1)
            lost = np.flatnonzero(np.asarray(pc.is_valid(places)))
            texts = batch.column(at)
            if len(lost):
                pick = pa.array(lost)
                cut = [t.decode("utf-8", "replace") for _, _, part in _kept(texts.take(pick), places.take(pick), nths.take(pick)) for t in part]
                own = np.full(batch.num_rows, -1)
                own[lost] = np.arange(len(lost))
                whole = pa.concat_arrays([texts.cast(pa.large_string()), pa.array(cut, pa.large_string())])
                texts = whole.take(pa.array(np.where(own >= 0, own + batch.num_rows, np.arange(batch.num_rows))))
            yield pa.RecordBatch.from_arrays([batch.column(k) if k != at else texts.cast(pa.string()) for k in range(len(columns))], columns)

    return joined.mapInArrow(run, docs.schema)


def _kept(texts: pa.Array, places: pa.ListArray, nths: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Per chunk: words, removed words and kept text of each row."""
    empty = pa.array([[]], pa.list_(pa.int32()))
    fill = lambda x: pc.coalesce(x, empty[0])
    for lo, hi, data, offsets in chunks(texts):
        a = Anchors(data, offsets)
        keep = _keep_masks(a, fill(places.slice(lo, hi - lo)), fill(nths.slice(lo, hi - lo)))
        # the bytes of kept words, each followed by a space
        flags = np.zeros(len(data) + 1, dtype=np.int8)
        flags[a.starts[keep]] += 1
        flags[a.ends[keep]] -= 1
        inside = np.cumsum(flags[:-1], dtype=np.int8).view(bool)
        kept = np.zeros(len(a.words) + 1, dtype=np.int64)
        n_kept = np.bincount(a.owner[keep], minlength=len(a.words))
        width = np.bincount(a.owner[keep], weights=(a.ends - a.starts)[keep], minlength=len(a.words)).astype(np.int64)
        size = a.ends[keep] - a.starts[keep]
        out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
        group, k = ragged(size)
        before = np.cumsum(size + 1) - (size + 1)
        out[before[group] + k] = data[:len(inside)][inside] if len(data) else out[:0]
        np.cumsum(width + n_kept, out=kept[1:])
        raw = out.tobytes()
        yield a.words, a.words - n_kept, [raw[x : max(x, y - 1)] for x, y in zip(kept[:-1].tolist(), kept[1:].tolist())]


def repeats_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """n_words, n_removed and the digest of the kept words of every row; the odd cases are those of find_repeats."""
    return apply_report(keyed(docs), find_repeats(docs, batches))


def apply_report(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """n_words, n_removed and kept_sha256 of (doc_id, row, text), given the rows of find_repeats."""
    joined = texts.join(gone.hint("shuffle_hash"), ["doc_id", "row"], "left").select("doc_id", "text", "places", "nths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, digests = [], [], []
            for w, r, texts in _kept(batch.column(1), batch.column(2), batch.column(3)):
                words.append(w)
                removed.append(r)
                digests += [hashlib.sha256(t).hexdigest() for t in texts]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(words).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), pa.array(digests)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` that repeated windows cover: see find_repeats, also for the odd cases."""
    return repeats_report(read_table(spark, sf_dir, "documents"))
