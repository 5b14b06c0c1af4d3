"""Cross-tokenizer alignment with inverted pair bitmaps.

Two tokenizers cut the same bytes (a space and the text): A is a byte-level BPE, B a piece
model. An A token and a B token that overlap are a link of the pair of their ids. Every
elementary stretch between neighbouring ends of either kind of token is one link, so all
links of a batch of texts come from one merge of the two lists of ends.

For each pair an inverted list tells in which documents it is linked: rows are numbered,
``BLOCK`` rows make a block, and a pair has one container a block, a compressed bitmap of
documents (a list of places, or bits where that is shorter) and, for links beyond the
first in a document, multiplicity planes: plane k holds the documents whose further links
have bit k. Containers of one block are OR-merged where batches meet. Population counts of
the bitmaps are a pair's documents, those of the planes weighted with powers of two its
links. The counts, and whether a pair has the highest of its B id, go back along the
containers: a block's postings add them up for each of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, tokenizer
from .store import Workspace, read_table
from .textbytes import chunks, ragged

#: Rows of a block: a power of two.
BLOCK = 2048
#: Ids are below this; a pair is A's id times this, and B's id.
B_IDS = 1 << 16

_WORDS_KEPT = 400_000


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """B: encodes a text word by word, where no piece can cross from one into the next."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if len(names) >= B_IDS:
            raise ValueError(f"{path} has {len(names)} pieces, {B_IDS} are the most")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        #: No piece has a space after another character: a space after one is a certain cut.
        self.cut_at_spaces = not any(" " in n.replace("▁", " ").lstrip(" ") for n in names)
        self.kept: dict[bytes, bytes] = {}
        self.odd: set[bytes] = set()

    def words(self, text: bytes) -> list[bytes]:
        """A space and the text, cut before each run of spaces."""
        if not self.cut_at_spaces:
            return [b" " + text]
        parts = text.split(b" ")
        if b"" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part:
                out.append(b" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(b" " * (spaces - 1))
        return out

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words not met before; those whose pieces aren't their bytes are odd."""
        if len(self.kept) > _WORDS_KEPT:
            self.kept.clear()
            self.odd.clear()
            new = list(words)
        else:
            new = [w for w in words if w not in self.kept]
        raw = self.bytes
        for w, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            if not w:
                ids = [self.space]  # a lone space: the model gives nothing for an empty text
            if b"".join([raw[i] for i in ids]) != b" " + w:
                # of an odd word the piece model may give nothing at all
                self.odd.add(w)
            self.kept[w] = np.array(ids, np.uint16).tobytes()


_LOADED: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


#: How ids are written: A's, A's last in a group, B's, B's last in a group.
_WRITTEN = [f"{i}{end}" for end in ",|,;" for i in range(B_IDS)]


def align(texts: list[bytes], a_path: str, b_path: str) -> dict[str, np.ndarray | list]:
    """Groups and links of texts (UTF-8): counts, digests of the groups, and the distinct pairs with their links.

    Texts that are empty or that B doesn't give back have no tokens.
    """
    a, b = tokenizer(a_path), piece_model(b_path)
    words = [b.words(t) if t else [] for t in texts]
    b.learn({w for own in words for w in own})
    if b.odd:
        words = [[] if own and not b.odd.isdisjoint(own) else own for own in words]
    used = [k for k, own in enumerate(words) if own]
    n = len(texts)
    count = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digest = [""] * n
    if not used:
        return count | {"digest": digest, "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64), "owner": np.zeros(0, np.int64)}
    raw = [b" " + texts[k] for k in used]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    joined = b"".join(raw)
    a_ids, a_at = a._plain(joined.decode(), np.frombuffer(joined, np.uint8), at)  # without special tokens
    b_parts = [b"".join([b.kept[w] for w in words[k]]) for k in used]
    b_at = np.concatenate([[0], np.cumsum([len(p) // 2 for p in b_parts])]).astype(np.int64)
    b_ids = np.frombuffer(b"".join(b_parts), np.uint16).astype(np.int64)
    a_ids = a_ids.astype(np.int64)
    a_size = np.array([len(x) for x in a.token_bytes], np.int64)
    a_ends, b_ends = np.cumsum(a_size[a_ids]), np.cumsum(b.size[b_ids])
    if a_ends[-1] != len(joined) or b_ends[-1] != len(joined):
        raise ValueError("tokens don't add up to the text")
    ends = np.union1d(a_ends, b_ends)
    a_of, b_of = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    shared = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
    owner = np.searchsorted(at, ends, side="left") - 1  # an end belongs to the text it stands in or ends
    rows = np.array(used, np.int64)
    count["n_a"][rows], count["n_b"][rows] = np.diff(a_at), np.diff(b_at)
    count["n_links"][rows] = np.bincount(owner, minlength=len(rows))
    count["n_groups"][rows] = np.bincount(np.searchsorted(at, shared, side="left") - 1, minlength=len(rows))

    # the ids of each group, A's before B's
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
    a_before, b_before = np.searchsorted(a_group, b_group, side="right"), np.searchsorted(b_group, a_group, side="left")
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + b_before] = a_ids + np.where(a_last, B_IDS, 0)
    order[np.arange(len(b_ids)) + a_before] = b_ids + np.where(b_last, 3 * B_IDS, 2 * B_IDS)
    written = list(map(_WRITTEN.__getitem__, order.tolist()))
    cuts = (a_at + b_at).tolist()
    for j, k in enumerate(used):
        digest[k] = hashlib.sha256("".join(written[cuts[j] : cuts[j + 1]])[:-1].encode()).hexdigest()

    pair = a_ids[a_of] * B_IDS + b_ids[b_of]
    # distinct within each text: the text's number above the pair's 32 bits
    both, times = np.unique((owner << 32) | pair, return_counts=True)
    return count | {"digest": digest, "pairs": both & 0xFFFFFFFF, "times": times.astype(np.int64), "owner": rows[both >> 32]}


# --- containers -------------------------------------------------------------------------------------------


def containers(pair: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(pairs, documents, links, container) of the postings of one block; (pair, place) are distinct.

    A container is planes one after another: plane 0 the documents, plane k+1 those whose
    further links have bit k. A plane is a 16-bit head and places as 16-bit numbers (head:
    their number) or bits (head: 0xFFFF).
    """
    order = np.lexsort((place, pair))
    pair, place, times = pair[order], place[order], times[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    keys = pair[first]
    documents = np.diff(np.append(first, len(pair)))
    links = np.add.reduceat(times, first)
    planes = 1 + np.array([int(m - 1).bit_length() for m in np.maximum.reduceat(times, first).tolist()], np.int64)
    # the usual container, one plane of places, in one go
    size = 2 * (1 + documents)
    usual = (planes == 1) & (size < BLOCK // 8)
    row = np.repeat(np.arange(len(keys)), documents)
    parts = {}
    for k in np.flatnonzero(~usual).tolist():
        lo, hi = first[k], first[k] + documents[k]
        parts[k] = b"".join(_plane(place[lo:hi][own]) for own in _planes(times[lo:hi], int(planes[k])))
        size[k] = len(parts[k])
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    words = out.view("<u2")
    own = np.flatnonzero(usual)
    words[at[own] // 2] = documents[own]
    inside = usual[row]
    words[at[row[inside]] // 2 + 1 + (np.arange(len(pair)) - first[row])[inside]] = place[inside]
    for k, part in parts.items():
        out[at[k] : at[k + 1]] = np.frombuffer(part, np.uint8)
    offsets = pa.py_buffer(at.astype(np.int32))
    return keys, documents, links, pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(out)])


def _planes(times: np.ndarray, planes: int) -> Iterator[np.ndarray]:
    yield np.arange(len(times))
    for k in range(planes - 1):
        yield np.flatnonzero(((times - 1) >> k) & 1)


def _plane(places: np.ndarray) -> bytes:
    if 2 * len(places) < BLOCK // 8:
        return np.concatenate([[len(places)], places]).astype("<u2").tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[places] = 1
    return b"\xff\xff" + np.packbits(bits, bitorder="little").tobytes()


def postings(container: bytes) -> list[np.ndarray]:
    """The places of each plane of a container."""
    out, words = [], np.frombuffer(container, "<u2")
    at = 0
    while at < len(words):
        n = int(words[at])
        if n == 0xFFFF:
            bits = words[at + 1 : at + 1 + BLOCK // 16].view(np.uint8)
            out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")))
            at += 1 + BLOCK // 16
        else:
            out.append(words[at + 1 : at + 1 + n].astype(np.int64))
            at += 1 + n
    return out


def score(container: list[bytes], count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seen, count_sum, n_best) of each document of a block from all its containers and their pairs' scores."""
    seen, total, tops = np.zeros(BLOCK, bool), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    size = np.array([len(c) for c in container], np.int64)
    words = np.frombuffer(b"".join(container), "<u2")
    first = (np.cumsum(size) - size) // 2
    head = words[first].astype(np.int64)
    usual = (head != 0xFFFF) & (size == 2 * (1 + head))
    group, k = ragged(head[usual])
    places = words[first[usual][group] + 1 + k]
    seen[places] = True
    # sums of integers, exact in 64 bits
    np.add.at(total, places, count[usual][group])
    np.add.at(tops, places, best[usual][group].astype(np.int64))
    for j in np.flatnonzero(~usual).tolist():
        for plane, own in enumerate(postings(container[j])):
            weight = 1 << max(0, plane - 1)
            seen[own] = True
            total[own] += weight * count[j]
            tops[own] += weight * best[j]
    return seen, total, tops


# --- the operator -----------------------------------------------------------------------------------------


def align_tokenizers(docs: DataFrame, work: Workspace, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the alignment of every whole text.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; n_best are
    the links of pairs that no other pair of the same B id exceeds (ties included), count_sum the
    links of each link's pair in the whole corpus, added up. pairs: a, b, documents, links, best.

    Null and empty texts, and texts that B doesn't give back (those with U+2581), have zeros and
    an empty groups_sha256. Rows are counted one by one: repeated rows or ids each count. A null
    doc_id stays null. An empty table gives empty results; further columns are ignored, whatever
    their names. Bytes that aren't UTF-8 count as U+FFFD.
    """
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    fields = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, pair long, documents long, links long, container binary"
    kinds = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in fields.split(", ")])

    def some(n: int, **columns) -> pa.RecordBatch:  # noqa: ANN003
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows are numbered by task and place, so neighbours share blocks
        row = TaskContext.get().partitionId() << 33
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def ended(block: int) -> Iterator[pa.RecordBatch]:
            if held:
                keys, documents, links, packed = containers(*(np.concatenate(x) for x in zip(*held)))
                held.clear()
                yield some(len(keys), block=pa.array(np.full(len(keys), block)), pair=pa.array(keys), documents=pa.array(documents), links=pa.array(links), container=packed)

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    texts = [t.decode("utf-8", "replace").encode() for t in texts]
                got = align(texts, a_path, b_path)
                own = row + np.arange(hi - lo)
                yield some(hi - lo, row=pa.array(own), doc_id=batch.column(0).slice(lo, hi - lo), groups_sha256=pa.array(got["digest"], pa.string()), **{c: pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")})
                place = own[got["owner"]]
                edge = row - row % BLOCK
                while edge < row + hi - lo:
                    i, j = np.searchsorted(place, [edge, edge + BLOCK])
                    if i < j:
                        held.append((got["pairs"][i:j], place[i:j] % BLOCK, got["times"][i:j]))
                    edge += BLOCK
                    if edge <= row + hi - lo:
                        yield from ended(edge // BLOCK - 1)
                row += hi - lo
        yield from ended(row // BLOCK)

    stored = work.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields), "aligned")
    rows, lists = stored.filter("pair is null"), stored.filter("pair is not null")
    counts = lists.groupBy("pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")).withColumn("b", F.col("pair") % B_IDS)
    counts = work.table(counts, "counts")
    highest = counts.groupBy("b").agg(F.max("links").alias("highest"))
    pairs = work.table(counts.join(highest, "b").select("pair", "documents", "links", (F.col("links") == F.col("highest")).alias("best")), "pairs")

    def give_back(table: pa.Table) -> pa.Table:
        seen, total, tops = score(table.column("container").to_pylist(), table.column("links").to_numpy(), table.column("best").to_numpy(zero_copy_only=False).astype(bool))
        own = np.flatnonzero(seen)
        return pa.table({"row": int(table.column("block")[0].as_py()) * BLOCK + own, "n_best": tops[own], "count_sum": total[own]})

    scored = lists.select("block", "pair", "container").join(pairs.select("pair", "links", "best").hint("shuffle_hash"), "pair")
    given = work.table(scored.select("block", "container", "links", "best").groupBy("block").applyInArrow(give_back, "row long, n_best long, count_sum long"), "scores")
    own = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = own.join(given.hint("shuffle_hash"), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    a_id = F.floor(F.col("pair") / B_IDS).cast("int").alias("a")
    return out, pairs.select(a_id, (F.col("pair") % B_IDS).cast("int").alias("b"), "documents", "links", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of every whole text of ``documents``: see align_tokenizers, also for the odd cases."""
    return align_tokenizers(read_table(spark, sf_dir, "documents"), Workspace(spark, "alignment"))[0]
