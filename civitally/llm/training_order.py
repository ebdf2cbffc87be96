"""Token-id output in training order.

Documents become fixed-length token sequences. Each sequence has a dense index
(an offset for its part of the stored layer plus its place there), and a keyed
Feistel permutation of the index, cycle-walked into the range, is its global
slot: no sort, no random numbers kept, the same order for the same key. Slots
are dealt by range to shards; a shard is one binary value of fixed-stride
records, so record ``s`` starts at byte ``(s mod per_shard) * stride`` and a
reader can resume at any slot. ``write_shards`` puts them into files, skipping
those that are there already.

Null texts are empty texts (one sequence with the separator only); repeated
rows and rows without doc_id are sequences like others; extra columns are not
read; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitally.session import settle

from .bytebpe import rank_codec
from .common import map_rows

SEQUENCES = "doc_id bigint, piece int, n_tokens int, ids binary"
MOST_PARTS = 1_000_000
HEADER = 4  # bytes of a record's token count


def as_width(ids: np.ndarray, id_bytes: int) -> np.ndarray:
    """``ids`` as little-endian numbers of that many bytes; an id that does not fit is
    an error."""
    if len(ids) and int(ids.max()) >> (8 * id_bytes):
        raise ValueError(f"token id {int(ids.max())} does not fit into {id_bytes} bytes")
    return ids.astype(f"<u{id_bytes}")


def sequences(docs: DataFrame, length: int = 1024, vocab: str | None = None,
              id_bytes: int = 2) -> DataFrame:
    """doc_id, piece, n_tokens, ids (unsigned, of ``id_bytes`` bytes: 2, or 4 for a
    vocabulary above 65,536)."""

    def rows(batch: pa.RecordBatch) -> dict:
        codec = rank_codec(vocab)
        out: dict[str, list] = {"doc_id": [], "piece": [], "n_tokens": [], "ids": []}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = as_width(np.frombuffer(codec.encode(text.as_py()) + bytes(4), "<u4"), id_bytes)
            for i, at in enumerate(range(0, len(ids), length)):
                one = ids[at: at + length]
                out["doc_id"].append(doc_id)
                out["piece"].append(i)
                out["n_tokens"].append(len(one))
                out["ids"].append(one.tobytes())
        return out

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"),
                    SEQUENCES, rows)


def mix(values: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser; the round function of the permutation."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..total-1. The network permutes the next power of four;
    values that leave the range are sent through it again until they return."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for turn in range(rounds):
            left, right = right, left ^ (mix(right, key * 1_000_003 + turn * 0x9E3779B9) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(total)]
    return out.astype(np.int64)


def with_slots(layer: DataFrame, total: int, key: int) -> DataFrame:
    """``layer`` (stored, with part and place) with a dense index and its slot."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("bigint")
    def slot(index):
        import pandas as pd

        return pd.Series(feistel(index.to_numpy(), total, key))

    parts = layer.groupBy("part").agg((F.max("place") + 1).alias("rows"))
    # One row for each task that wrote the layer; the running sum gives its first index.
    before = parts.select(
        "part",
        F.coalesce(
            F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("before"),
    )
    if parts.count() <= MOST_PARTS:  # 16 MB at most
        before = F.broadcast(before)
    return layer.join(before, "part").withColumn("slot", slot(F.col("before") + F.col("place")))


def shards(
    docs: DataFrame, key: int = 2024, length: int = 1024, per_shard: int = 2048,
    vocab: str | None = None, id_bytes: int = 2,
) -> DataFrame:
    """shard, payload (fixed-stride records), and the slot's owner for each record:
    doc_ids, pieces. A record is its token count, its ids, and zeros up to the stride."""
    stride = HEADER + id_bytes * length
    made = sequences(docs, length, vocab, id_bytes).withColumn("n", F.monotonically_increasing_id())
    layer = settle(
        made.selectExpr("*", "shiftright(n, 33) as part", "n & 8589934591L as place").drop("n"),
        "sequences",
    )
    total = layer.count()
    slots = with_slots(layer, total, key) if total else layer.withColumn("slot", F.lit(0))
    schema = "shard bigint, payload binary, doc_ids array<bigint>, pieces array<int>"
    arrow = pa.schema([
        ("shard", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
        ("pieces", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard_of(number, records, owners, pieces):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(
                    ([number], [b"".join(records)], [owners], [pieces]), arrow)],
                schema=arrow,
            )

        current, records, owners, pieces = None, [], [], []
        for batch in batches:
            columns = (batch.column(n).to_pylist()
                       for n in ("shard", "n_tokens", "ids", "doc_id", "piece"))
            for number, n, ids, doc_id, piece in zip(*columns):
                if number != current and records:
                    yield shard_of(current, records, owners, pieces)
                    records, owners, pieces = [], [], []
                current = number
                records.append((struct.pack("<I", n) + ids).ljust(stride, b"\0"))
                owners.append(doc_id)
                pieces.append(piece)
        if records:
            yield shard_of(current, records, owners, pieces)

    wanted = slots.select(
        F.expr(f"slot div {per_shard}").alias("shard"), "slot", "n_tokens", "ids", "doc_id", "piece"
    )
    count = max(1, min(-(-total // per_shard), 100_000))
    return (
        wanted.repartition(count, "shard").sortWithinPartitions("shard", "slot")
        .mapInArrow(run, schema)
    )


def records(made: DataFrame, length: int = 1024, per_shard: int = 2048,
            id_bytes: int = 2) -> DataFrame:
    """One row for each record of the shards, read back from the binary values."""
    stride = HEADER + id_bytes * length

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in (
            "doc_id", "piece", "slot", "shard", "byte_offset", "n_tokens", "ids_crc32")}
        columns = (batch.column(n).to_pylist() for n in ("shard", "payload", "doc_ids", "pieces"))
        for shard, payload, owners, pieces in zip(*columns):
            for i, (doc_id, piece) in enumerate(zip(owners, pieces)):
                at = i * stride
                (n,) = struct.unpack_from("<I", payload, at)
                ids = np.frombuffer(payload, f"<u{id_bytes}", n, at + HEADER).astype("<u4")
                for k, v in zip(out, (doc_id, piece, shard * per_shard + i, shard, at, n,
                                      zlib.crc32(ids.tobytes()))):
                    out[k].append(v)
        return out

    return map_rows(made, "doc_id bigint, piece int, slot bigint, shard bigint, "
                          "byte_offset bigint, n_tokens int, ids_crc32 bigint", rows)


def write_shards(made: DataFrame, folder: str) -> DataFrame:
    """Write each shard to ``folder`` (a URI that pyarrow's file systems open on
    every executor). A file is renamed into place when whole; one that is there
    with the right size is left, so a run that broke off can be repeated.
    Returns shard, path, bytes, written."""
    from pyarrow import fs

    def rows(batch: pa.RecordBatch) -> dict:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out: dict[str, list] = {"shard": [], "path": [], "bytes": [], "written": []}
        for shard, payload in zip(batch.column("shard").to_pylist(),
                                  batch.column("payload").to_pylist()):
            path = f"{base}/shard-{shard:08d}.bin"
            there = store.get_file_info(path)
            write = there.type != fs.FileType.File or there.size != len(payload)
            if write:
                import uuid

                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as file:
                    file.write(payload)
                store.move(part, path)
            for k, v in zip(out, (shard, path, len(payload), write)):
                out[k].append(v)
        return out

    return map_rows(made.select("shard", "payload"),
                    "shard bigint, path string, bytes bigint, written boolean", rows)


def read_slot(payload: bytes, place: int, length: int = 1024, id_bytes: int = 2) -> list[int]:
    """Ids of the record at a place of a shard."""
    at = place * (HEADER + id_bytes * length)
    (n,) = struct.unpack_from("<I", payload, at)
    return np.frombuffer(payload, f"<u{id_bytes}", n, at + HEADER).tolist()
