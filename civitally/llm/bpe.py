"""BPE encoding and decoding by per-prefix dynamic programming.

``encode`` adds the ids of every text, ``decode`` turns ids back to text.
Rows never move: one narrow Arrow pass, a bounded piece cache per Python
worker, nothing kept between rows but that cache. A null text is the empty
text: no ids. Extra columns are not read; row order and repeated rows do not
matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import prefix_codec
from .common import map_rows

DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers)."""

    def rows(batch: pa.RecordBatch) -> dict:
        codec = prefix_codec(vocab)
        return {
            "doc_id": batch.column("doc_id"),
            "ids": [codec.encode(t.as_py()) for t in batch.column("text")],
        }

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"),
                    "doc_id bigint, ids binary", rows)


def decode(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, text from the packed ids of ``encode``."""

    def rows(batch: pa.RecordBatch) -> dict:
        codec = prefix_codec(vocab)
        return {
            "doc_id": batch.column("doc_id"),
            "text": [codec.decode(i.as_py() or b"").decode() for i in batch.column("ids")],
        }

    return map_rows(encoded.select("doc_id", "ids"), "doc_id bigint, text string", rows)


def round_trip(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass, so that ids need not be stored."""

    def rows(batch: pa.RecordBatch) -> dict:
        codec = prefix_codec(vocab)
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text"):
            ids = codec.encode(text.as_py())
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids_sha256": ids_sha,
                "decoded_sha256": text_sha}

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"),
                    DIGEST, rows)
