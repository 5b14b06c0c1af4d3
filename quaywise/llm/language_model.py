"""Language-model scoring with a hidden Markov model.

Texts are sequences of lower-cased words and one end token. The latent states emit word
classes, and a class emits its words: the ``TOP`` most frequent training words and the end
token are classes of their own, all other words fall into ``TAILS`` classes by the hash of
their last three bytes. Inside a class a word has probability (c + 1) / (N_k + V_k + 1),
with c its training count, N_k and V_k the class's training tokens and distinct words; what
is left is the probability of words that weren't seen. So the probabilities of all texts
sum to one.

Counts of all words cover the whole training part, and so does Baum-Welch: each pass adds
up expected starts, transitions and emissions of every partition, and the sums re-estimate
the model. The first guess is made from the counts of all training words. A pass keeps the
forward messages of every ``BLOCK``-th token only and computes those between them again on
its way back, so memory is bounded by the block while the counts are those of the whole
sequence. The likelihood of a text is exact as well: one scaled forward recursion.

Counts of frequent words (``LOCAL`` of them, a fixed number) travel to the tasks; the other
words of a document meet their counts in a join. Words are known by 64 bits: 10 of their
class and 54 of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, read_table
from .textbytes import LOWER, U64, chunks, mix64, signed, span_hashes, word_bounds

STATES = 8
TOP = 2_000
TAILS = 1_024
LOCAL = 1 << 17
BLOCK = 1024
PASSES = 6
#: Messages that a group of sequences holds at once, and its tokens (one sequence at least).
HELD, TOKENS = 300_000, 2_000_000


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each word, first word of each text): the class by ending in the top 10 bits, the hash below."""
    lower = LOWER[data]
    starts, ends, first = word_bounds(lower, offsets)
    tail = span_hashes(lower, np.maximum(starts, ends - 3), ends) % U64(TAILS)
    return (tail << U64(54)) | (span_hashes(lower, starts, ends) >> U64(10)), first


def tail_class(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(54)).astype(np.int64)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): how often each word stands in all texts; pre-counted in each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                k, n = np.unique(word_keys(data, offsets)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2_000_000:
                    k, n = _counted(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n)], ["word", "n"])
                        keys, counts, held = [], [], 0
        if held:
            k, n = _counted(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(n)], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Lexicon:
    """Counts of the most frequent words, class totals, and the corpus totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, ends: int, tokens: int, distinct: int, tail_n: np.ndarray, tail_v: np.ndarray):
        """``words`` in falling order of count; ``tail_n``, ``tail_v``: totals of each ending over all words."""
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        place = np.empty(len(words), dtype=np.int64)
        place[order] = np.arange(len(words))
        self.top = np.full(len(words), -1)
        self.top[place[:TOP]] = np.arange(min(TOP, len(words)))
        self.ends, self.tokens, self.distinct = ends, tokens, distinct
        tail_n, tail_v = tail_n.astype(np.float64).copy(), tail_v.astype(np.float64).copy()
        own = tail_class(words[:TOP])
        np.subtract.at(tail_n, own, counts[:TOP])
        np.subtract.at(tail_v, own, 1)
        self.tail_log = np.log10(tail_n + tail_v + 1)
        # how often each class stands in the training part
        self.frequency = np.zeros(TOP + 1 + TAILS)
        self.frequency[: len(counts[:TOP])] = counts[:TOP]
        self.frequency[TOP], self.frequency[TOP + 1 :] = ends, tail_n
        self.end_class = TOP
        self.classes = TOP + 1 + TAILS

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or 0, found)."""
        if not len(self.words):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return at, self.words[at] == keys


def sequences(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """What a document's score is made of, a row each: its class sequence, what is known in the
    task, and the words that are not (``others``, ``other_n``). ``row`` numbers the rows."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # LOCAL words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        log_c = np.log10(lex.counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                keys, first = word_keys(data, offsets)
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                at, found = lex.find(keys)
                top = np.where(found, lex.top[at], -1) if len(lex.words) else np.full(len(keys), -1)
                observed = np.full(len(keys) + len(n), lex.end_class, dtype="<u2")
                spot = np.arange(len(keys)) + owner
                observed[spot] = np.where(top >= 0, top, lex.end_class + 1 + tail_class(keys))
                logs = np.where(found, log_c[at], 0.0) if len(lex.words) else np.zeros(len(keys))
                sums = lambda w: np.bincount(owner, weights=w, minlength=len(n))  # noqa: E731, B023
                raw, edge = observed.tobytes(), 2 * (first + np.arange(len(first)))
                others, other_owner, other_n = _distinct(keys[~found], owner[~found])
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.searchsorted(other_owner, np.arange(len(n) + 1)).astype(np.int32)), pa.array(x))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(n))),
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary()),
                        pa.array(n + 1),
                        pa.array(sums(found).astype(np.int64) + (lex.ends > 0)),
                        pa.array(sums(logs) + np.log10(lex.ends + 1)),
                        pa.array(sums(np.where(top < 0, logs, 0.0))),
                        lists(signed(others)),
                        lists(other_n),
                    ],
                    ["row", "doc_id", "held_out", "observed", "n_tokens", "known", "logs", "tail_logs", "others", "other_n"],
                )
                row += len(n)

    schema = "row long, doc_id long, held_out boolean, observed binary, n_tokens long, known long, logs double, tail_logs double, others array<long>, other_n array<long>"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, count) of the distinct keys of each owner, by owner."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return keys[at], owner[at], np.diff(np.append(at, len(keys)))


class HiddenMarkov:
    """Start, transition and emission probabilities of a discrete hidden Markov model."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, frequency: np.ndarray, states: int = STATES, seed: int = 2) -> HiddenMarkov:
        """Sticky states, each with the overall class frequencies shaken by random factors."""
        rng = np.random.default_rng(seed)
        emit = (frequency + 1.0) * rng.gamma(1.5, size=(states, len(frequency)))
        move = np.full((states, states), 0.2 / (states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(move, 0.8)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))

    def expected(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Expected counts, flat: starts, transitions, emissions, then log-likelihood and tokens."""
        s, m = self.emit.shape
        total = np.zeros(s + s * s + s * m + 2)
        ordered = sorted((x for x in sequences if len(x)), key=len, reverse=True)
        tokens = np.concatenate([[0], np.cumsum([len(x) for x in ordered])])
        lo = 0
        while lo < len(ordered):
            # what a group holds is bounded: messages of a block of each sequence, and all its tokens
            n = max(1, min(1024, HELD // min(len(ordered[lo]), BLOCK), int(np.searchsorted(tokens, tokens[lo] + TOKENS, side="right")) - 1 - lo))
            total += self._group(ordered[lo : lo + n])
            lo += n
        return total

    def _group(self, group: list[np.ndarray]) -> np.ndarray:
        """Forward and backward over sequences in falling order of length, in blocks of ``BLOCK`` tokens.

        A row of a message is a state, a column a sequence. Messages are scaled at each token and
        held in single precision; all sums are double.
        """
        s, m = self.emit.shape
        moves, emits = np.zeros((s, s)), np.zeros((s, m))
        size = np.array([len(x) for x in group])
        flat, first = np.concatenate(group), np.cumsum(size) - size
        n, long = len(group), int(size[0])
        alive = np.searchsorted(-size, -np.arange(long), side="left")  # sequences longer than t
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        forth, begin = np.ascontiguousarray(move.T), self.start.astype(np.float32)[:, None]
        at = lambda t: flat[first[: alive[t]] + t]

        def forward(t: int, a: np.ndarray | None, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a = begin * b if a is None else (forth @ a[:, : alive[t]]) * b
            c = a.sum(axis=0)
            a /= c
            return a, c

        likelihood, a = 0.0, None
        before: list[np.ndarray | None] = []
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(long):
            if t % BLOCK == 0:
                before.append(a)
                kept = []
            x = at(t)
            b = emit.take(x, axis=1)
            a, c = forward(t, a, b)
            kept.append((a, c, b, x))
            likelihood += float(np.log(c, dtype=np.float64).sum())
        beta = np.ones((s, n), np.float32)
        starts = np.zeros(s)
        for k in range(len(before) - 1, -1, -1):
            lo, hi = k * BLOCK, min(long, (k + 1) * BLOCK)
            if k < len(before) - 1:  # the last block's messages are there from the way forward
                a, kept = before[k], []
                for t in range(lo, hi):
                    x = at(t)
                    b = emit.take(x, axis=1)
                    a, c = forward(t, a, b)
                    kept.append((a, c, b, x))
            seen, weight = [], []
            for t in range(hi - 1, lo - 1, -1):
                a, c, b, x = kept[t - lo]
                ahead = beta[:, : alive[t]]
                g = np.multiply(a, ahead, dtype=np.float64)
                g /= g.sum(axis=0)
                seen.append(x)
                weight.append(g)
                if t:
                    b *= ahead
                    b /= c
                    last = kept[t - lo - 1][0] if t > lo else before[k]
                    moves += last[:, : alive[t]] @ b.T
                    beta[:, : alive[t]] = move @ b
                else:
                    starts += g.sum(axis=1, dtype=np.float64)
            seen, weight = np.concatenate(seen), np.concatenate(weight, axis=1)
            for i in range(s):
                emits[i] += np.bincount(seen, weights=weight[i], minlength=m)
        return np.concatenate([starts, (self.move * moves).ravel(), emits.ravel(), [likelihood, len(flat)]])

    @classmethod
    def estimate(cls, counts: np.ndarray, states: int, smooth: float = 0.01) -> HiddenMarkov:
        """The model of the summed expected counts, with a little added to each."""
        starts, rest = counts[:states], counts[states:-2]
        moves, emits = rest[: states * states].reshape(states, states), rest[states * states :].reshape(states, -1)
        norm = lambda x: (x + smooth) / (x + smooth).sum(axis=-1, keepdims=True)
        return cls(norm(starts), norm(moves), norm(emits))

    def log_likelihoods(self, observed: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the exact probability of each sequence: the scaled forward recursion over all of it."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        long = int(size.max(initial=0))
        alive = np.searchsorted(-size[order], -np.arange(long), side="left")
        at, out = first[:-1][order], np.zeros(len(size))
        a, forth = None, np.ascontiguousarray(self.move.T)
        for t in range(long):
            k = alive[t]
            b = self.emit.take(observed[at[:k] + t], axis=1)
            a = self.start[:, None] * b if a is None else (forth @ a[:, :k]) * b
            c = a.sum(axis=0)
            a /= c
            out[:k] += np.log10(c)
        back = np.empty(len(size))
        back[order] = out
        return back


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(observations, first of each row) of a binary column of 16-bit numbers."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u2").astype(np.int64), (offsets - offsets[0]) // 2


def baum_welch_pass(train: DataFrame, model: HiddenMarkov) -> np.ndarray:
    """Expected counts of all sequences: summed in each task, then over tasks by Spark."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = sent.value, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                observed, first = _joined(batch.column(0).slice(lo, 4096))
                counts = own.expected([observed[a:b] for a, b in zip(first[:-1], first[1:])])
                total = counts if total is None else total + counts
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "amount"])

    summed = train.select("observed").mapInArrow(run, "cell int, amount double").groupBy("cell").agg(F.sum("amount").alias("amount"))
    found = summed.toPandas()  # a fixed number of cells, whatever the corpus
    out = np.zeros(len(model.start) + model.move.size + model.emit.size + 2)
    out[found["cell"]] = found["amount"]
    return out


def train_model(train: DataFrame, lexicon: Lexicon, states: int = STATES, passes: int = PASSES) -> HiddenMarkov:
    """Baum-Welch over all of ``train`` (observed), from a first guess by the counts of all its words."""
    model = HiddenMarkov.guess(lexicon.frequency, states)
    for _ in range(passes if lexicon.ends else 0):
        model = HiddenMarkov.estimate(baum_welch_pass(train, model), states)
    return model


def build_lexicon(counts: DataFrame, ends: int) -> Lexicon:
    """From (word, c) of the training part and its number of texts."""
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).head()
    ending = F.shiftrightunsigned("word", 54).alias("ending")
    tails = counts.groupBy(ending).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # TAILS rows
    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for k, n, v in tails:
        tail_n[k], tail_v[k] = n, v
    # how many words have which count, large counts by their logarithm: some thousand rows
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log(F.col("c") / 4096.0) * 1000)).cast("long")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = (sizes[0][0] + 1 if sizes else 1), 0
    for k, n in sizes:
        held += n
        if held > LOCAL:
            break
        least = k
    frequent = counts.filter(level >= least).toArrow()  # LOCAL rows at most
    words, c = np.asarray(frequent.column(0)).view(np.uint64), np.asarray(frequent.column(1))
    order = np.lexsort((words, -c))
    words, c = words[order], c[order]
    return Lexicon(words, c, ends, int(total["n"]) + ends, int(total["v"]) + (ends > 0), tail_n, tail_v)


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of all texts (doc_id, text) by a model of those that aren't held out (boolean column ``held_out``).

    Null and empty texts are the end token alone; long texts are read whole. Rows are scored
    one by one: ties and repeated rows, also of one doc_id, get equal scores, null ids stay
    null. An empty table gives no rows; with no training text, the smoothed model of nothing
    scores. Further columns are ignored, whatever their names.
    """
    work = Workspace(docs.sparkSession, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(True)).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = work.table(word_counts(training), "counts")
    lexicon = build_lexicon(counts, training.count())
    encoded = work.table(sequences(docs, lexicon), "sequences")
    others = encoded.select("row", F.explode(F.arrays_zip("others", "other_n")).alias("x")).select("row", F.col("x.others").alias("word"), F.col("x.other_n").alias("n"))
    rest = others.join(counts.hint("merge"), "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.expr("n * log10(coalesce(c, 0) + 1D)")).alias("rest_logs"), F.sum(F.expr("if(c is null, 0, n)")).alias("rest_known"))
    rest = work.table(rest, "rest")
    work.drop(counts)
    model = train_model(encoded.filter(~F.col("held_out")), lexicon)
    sent = docs.sparkSession.sparkContext.broadcast((model, lexicon.tail_log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail_log = sent.value
        price = np.concatenate([np.zeros(TOP + 1), tail_log])
        for batch in batches:
            observed, first = _joined(batch.column(1))
            if batch.num_rows:
                inside = np.concatenate([[0.0], np.cumsum(price[observed])])
                path = own.log_likelihoods(observed, first) - (inside[first[1:]] - inside[first[:-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in range(2, 8)), pa.array(path)], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "tail_logs", "path"])

    columns = ["row", "observed", "doc_id", "held_out", "n_tokens", "known", "logs", "tail_logs"]
    scored = encoded.select(*columns).mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, tail_logs double, path double")
    rest_logs = F.coalesce("rest_logs", F.lit(0.0))
    result = scored.join(rest.hint("merge"), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + rest_logs - F.col("n_tokens") * F.lit(float(np.log10(lexicon.tokens + lexicon.distinct + 1)))).alias("base_score"),
        (F.col("path") + F.col("tail_logs") + rest_logs).alias("score"),
    )
    result = work.table(result, "result")
    work.keep(result)
    return result


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``: see score_texts, also for the odd cases."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_texts(docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
