"""BPE encoding and decoding of text columns (see ``bpe`` for the method)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import default_path, tokenizer
from .store import read_table
from .textbytes import chunks


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text.

    Null or empty text: no ids; a null doc_id stays null. Texts are encoded whole, however
    long. Rows are independent: ties and repeated rows get equal ids, an empty table no rows;
    further columns are ignored, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = bpe.encode_joined(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), lists], ["doc_id", "n_tokens", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids).

    Null ids give empty text, ids outside the vocabulary raise IndexError. Rows are independent,
    however long; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them.

    Null text counts as empty (no ids, empty decoded text); the odd cases are those of encode.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        word, raw = bpe.token_text.__getitem__, bpe.token_bytes.__getitem__
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids, at = bpe.encode_joined(data, offsets)
                flat, cuts = ids.tolist(), at.tolist()
                id_digests, text_digests = [], []
                for a, b in zip(cuts, cuts[1:]):
                    own = flat[a:b]
                    id_digests.append(hashlib.sha256("".join(map(word, own))[:-1].encode()).hexdigest())
                    text_digests.append(hashlib.sha256(b"".join(map(raw, own)).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(id_digests), pa.array(text_digests)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of ``documents``: see round_trip and encode, also for the odd cases."""
    return round_trip(read_table(spark, sf_dir, "documents"))
