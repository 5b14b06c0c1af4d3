"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every position a distribution
over the learned languages, and a document's probabilities are the mean over all of its
positions. It is trained in numpy by backpropagation through time.

Texts are read whole. So that the cost is the same a byte for every text, a text is read
as stretches of ``SPAN`` bytes, each with the ``CONTEXT`` bytes before it and after it:
every position is labelled by states that have read that many bytes of its text on either
side at least (fewer only at the text's own ends). Training draws windows of ``TRAIN`` bytes
from anywhere in the whole texts, a text as likely as another, anew at every step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .store import hashed_sample, read_table
from .textbytes import chunks

SPAN = 256
CONTEXT = 64
TRAIN = 64
HIDDEN = 8
#: Labelled documents that a fit reads at most, those of least hash of doc_id.
SAMPLE = 2_000
UNKNOWN = "und"
_BLOCK = 2048
#: Bytes of a block's stretches that are labelled at once.
_POSITIONS = 16


def stretches(offsets: np.ndarray, span: int = SPAN, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(where a stretch's window begins, its first and end labelled byte in the window, first stretch of each text).

    A window is span + 2 * context bytes long and may stick out of its text.
    """
    sizes = np.diff(offsets)
    n = -(-sizes // span)
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    begin = offsets[owner] + (np.arange(len(owner)) - first[owner]) * span
    used = np.minimum(span, offsets[owner + 1] - begin)
    return begin - context, np.full(len(owner), context), context + used, first


def windows(data: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the windows, whether each is inside lo .. hi); what lies outside is byte 0."""
    at = begin[:, None] + np.arange(length)
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8), inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGru:
    """Two gated recurrent units, one a direction, and a softmax over their states at each position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 4):
        self.languages, self.hidden = languages, hidden
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.normal(size=s) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": f(256, 3 * hidden) if k == "w" else f(hidden, 3 * hidden) for d in "fb" for k in "wu"}
        self.p |= {"v": f(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    def _run(self, x: np.ndarray, inside: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after each byte; x: (time, stretches). A state is zero while its text hasn't begun."""
        w, u, h_ = self.p[f"w{d}"], self.p[f"u{d}"], self.hidden
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        out = np.empty((*x.shape, h_), dtype=np.float32)
        h = np.zeros((x.shape[1], h_), dtype=np.float32)
        for t in steps:
            a, b = w[x[t]], h @ u
            gates = _sigmoid(a[:, : 2 * h_] + b[:, : 2 * h_])
            r, z = gates[:, :h_], gates[:, h_:]
            c = np.tanh(a[:, 2 * h_ :] + r * b[:, 2 * h_ :])
            if trace is not None:
                trace.append((t, h, r, z, c, b[:, 2 * h_ :], inside[t]))
            h = (c + z * (h - c)) * inside[t]
            out[t] = h
        return out

    def _positions(self, states: np.ndarray) -> np.ndarray:
        y = states @ self.p["v"] + self.p["c"]
        y -= y.max(axis=-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=-1, keepdims=True)
        return y

    def _states(self, x: np.ndarray, inside: np.ndarray, d: str) -> np.ndarray:
        """The states of ``_run`` at the labelled bytes; only steps that these depend on are taken.

        Gates have arrays of their own and steps reuse them; tanh(x) is 2 / (1 + exp(-2x)) - 1.
        """
        h_, n = self.hidden, x.shape[1]
        scaled = [(np.ascontiguousarray(self.p[f"w{d}"][:, g * h_ : (g + 1) * h_] * s), np.ascontiguousarray(self.p[f"u{d}"][:, g * h_ : (g + 1) * h_] * s)) for g, s in enumerate(np.float32([-1, -1, -2]))]
        steps = range(CONTEXT + SPAN) if d == "f" else range(len(x) - 1, CONTEXT - 1, -1)
        out = np.empty((SPAN, n, h_), dtype=np.float32)
        h, (a, r, z, c) = np.zeros((n, h_), dtype=np.float32), np.empty((4, n, h_), dtype=np.float32)
        with np.errstate(over="ignore"):  # a gate that is shut
            for t in steps:
                for gate, (w, u) in zip((r, z), scaled):
                    np.take(w, x[t], axis=0, out=gate, mode="clip")
                    gate += np.matmul(h, u, out=a)
                    np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                w, u = scaled[2]
                r *= np.matmul(h, u, out=a)
                np.take(w, x[t], axis=0, out=c, mode="clip")
                c += r
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                h -= c
                h *= z
                h += c
                h[~inside[t]] = 0
                if CONTEXT <= t < CONTEXT + SPAN:
                    out[t - CONTEXT] = h
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Language probabilities of each text; zeros for empty texts."""
        begin, lo, hi, first = stretches(offsets)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        sums = np.zeros((len(begin) + 1, len(self.languages)))
        v, c = self.p["v"].T, self.p["c"][:, None]
        for k in range(0, len(begin), _BLOCK):
            part = slice(k, k + _BLOCK)
            x, inside = windows(data, begin[part], offsets[owner[part]], offsets[owner[part] + 1], SPAN + 2 * CONTEXT)
            x, inside = np.ascontiguousarray(x.T).astype(np.intp), np.ascontiguousarray(inside.T)
            forward, backward = self._states(x, inside, "f"), self._states(x, inside, "b")
            n = x.shape[1]
            for t in range(0, SPAN, _POSITIONS):
                # languages come first, so that sums over them run along the memory
                y = v[:, : self.hidden] @ forward[t : t + _POSITIONS].reshape(-1, self.hidden).T
                y += v[:, self.hidden :] @ backward[t : t + _POSITIONS].reshape(-1, self.hidden).T
                y += c
                y -= y.max(axis=0)
                np.exp(y, out=y)
                weight = (np.arange(CONTEXT + t, CONTEXT + min(t + _POSITIONS, SPAN))[:, None] < hi[part]).ravel() / y.sum(axis=0)
                y *= weight.astype(np.float32)
                sums[k + 1 : k + 1 + n] += y.reshape(len(y), -1, n).sum(axis=1).T
        sums = np.cumsum(sums, axis=0)
        total = sums[first[1:]] - sums[first[:-1]]
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)

    def gradients(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions inside and its gradients, by backpropagation through time."""
        x, inside = np.ascontiguousarray(x.T), np.ascontiguousarray(inside.T)
        traces = {"f": [], "b": []}
        states = np.concatenate([self._run(x, inside[:, :, None], d, traces[d]) for d in "fb"], axis=2)
        p = self._positions(states)
        mask = inside.astype(np.float32)
        total = mask.sum()
        who = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, who, y] + 1e-9) * mask).sum() / total)
        delta = p
        delta[:, who, y] -= 1
        delta *= (mask / total)[:, :, None]
        flat = delta.reshape(-1, delta.shape[2])
        g = {"v": states.reshape(-1, states.shape[2]).T @ flat, "c": flat.sum(axis=0)}
        up = delta @ self.p["v"].T
        h_ = self.hidden
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            gu = np.zeros_like(u)
            da = np.empty((*x.shape, 3 * h_), dtype=np.float32)
            dh = np.zeros((x.shape[1], h_), dtype=np.float32)
            for t, h, r, z, c, b, there in reversed(traces[d]):
                dh = (dh + up[t, :, k * h_ : (k + 1) * h_]) * there
                dc = dh * (1 - z) * (1 - c * c)
                a = da[t]
                a[:, :h_] = dc * b * r * (1 - r)
                a[:, h_ : 2 * h_] = dh * (h - c) * z * (1 - z)
                a[:, 2 * h_ :] = dc
                du = a.copy()
                du[:, 2 * h_ :] *= r
                gu += h.T @ du
                dh = dh * z + du @ u.T
            gw = np.zeros((256, 3 * h_), np.float32)
            np.add.at(gw, x.reshape(-1), da.reshape(-1, 3 * h_))
            g |= {f"w{d}": gw, f"u{d}": gu}
        return loss, g

    def fit(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 384, rate: float = 0.02, seed: int = 7) -> BiGru:
        """Adam with a falling step size over windows of the texts; languages are drawn alike. No texts: the network stays as it was."""
        texts = np.flatnonzero(np.diff(offsets) > 0)
        if not len(texts):
            return self
        rng = np.random.default_rng(seed)
        weight = 1.0 / np.bincount(y[texts], minlength=len(self.languages))[y[texts]]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.choice(texts, batch, p=weight / weight.sum())
            room = np.maximum(offsets[pick + 1] - offsets[pick] - TRAIN, 0)
            begin = offsets[pick] + rng.integers(0, room + 1)
            x, inside = windows(data, begin, offsets[pick], offsets[pick + 1], TRAIN)
            _, g = self.gradients(x, inside, y[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step = rate * (1 - 0.9 * t / steps)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def fit_languages(labelled: DataFrame, sample: int = SAMPLE) -> BiGru:
    """Fit on at most ``sample`` distinct rows of (doc_id, text, lang) with a text and a language, whole texts.

    Rows of one doc_id count one by one, copies of a row once; rows are put in order, so a fit
    of the same rows is the same. No labelled row: a network of no languages.
    """
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    found = hashed_sample(rows, sample, ["lang"]).toArrow().to_pandas()
    found = found.sort_values(["doc_id", "text", "lang"], kind="stable")
    languages = sorted(found["lang"].unique())
    if not languages:
        return BiGru([])
    raw = [t.encode("utf-8", "replace") for t in found["text"]]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    return BiGru(languages).fit(data, offsets, np.searchsorted(languages, found["lang"].to_numpy()))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    raw = data.tobytes()
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
    return out


def predict_languages(docs: DataFrame, model: BiGru, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, the predicted language and its probability, by the given names.

    ``und`` with score 0 for null, empty and letterless texts, and where no language was
    learned. Texts are read whole, however long. Rows are independent: ties and repeated rows
    get equal predictions, an empty table gives no rows. A column of ``docs`` that has one of
    the names is replaced; give others to keep it.
    """
    docs = docs.drop(*names)
    columns = docs.columns
    at_text = columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 30 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        learned = np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(at_text)):
                best, score = np.full(hi - lo, len(learned) - 1), np.zeros(hi - lo)
                if net.languages:
                    p = net.documents(data, offsets)
                    known = has_letter(data, offsets)
                    best[known], score[known] = p.argmax(axis=1)[known], np.clip(p.max(axis=1), 0, 1)[known]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(len(columns))), pa.array(learned[best], pa.string()), pa.array(score)], [*columns, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def _fold(folds: int) -> "F.Column":
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every whole text of ``documents``: see fit_languages and predict_languages, also for the odd cases."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(_fold(4) != 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(4) == 2).alias("held_out"))
    return predict_languages(texts, model).drop("text")
