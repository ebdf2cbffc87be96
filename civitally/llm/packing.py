"""Best-fit packing by hierarchical residuals.

Documents become token pieces, pieces become sequences of at most ``capacity``
tokens. Every partition packs its own pieces by best fit, longest first, and
emits the bins that are nearly full. Underfull bins become items of the next
round, in fewer partitions, until one small partition holds the rest or a round
joins (almost) nothing any more. A partition holds ``per_task`` items on
average whatever the input; only numbers travel, never ids.

Every round's bins are written to the shared folder, so a lost executor repeats
one partition of one round, and ids given to pieces never change.

Null texts are empty texts (one token, the separator); rows without a doc_id,
repeated rows and repeated doc_ids are packed like any other row; extra columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitally.session import settle

from .bytebpe import rank_codec
from .common import map_rows

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
BINS = "items array<bigint>, lengths array<int>, total int, full boolean"
SEPARATOR = bytes(4)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = 2048, vocab: str | None = None) -> DataFrame:
    """The pieces of every document's ids, id 0 at its end."""

    def rows(batch: pa.RecordBatch) -> dict:
        codec = rank_codec(vocab)
        out: dict[str, list] = {n: [] for n in "doc_id piece start length ids_crc32".split()}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = codec.encode(text.as_py()) + SEPARATOR
            view = memoryview(ids)
            for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                out["doc_id"].append(doc_id)
                out["piece"].append(i)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(view[4 * start: 4 * (start + length)]))
        return out

    return map_rows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"),
                    PIECES, rows)


class Bins:
    """Best fit over whole-number sizes: open bins are found by their free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set while some open bin has room r
        self.bins: list[tuple[list[int], list[int]]] = []

    def add(self, items: list[int], lengths: list[int], total: int) -> None:
        fitting = self.rooms >> total
        if fitting:
            room = total + (fitting & -fitting).bit_length() - 1
            at = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
            self.bins[at][0].extend(items)
            self.bins[at][1].extend(lengths)
        else:
            room, at = self.capacity, len(self.bins)
            self.bins.append((list(items), list(lengths)))
        left = room - total
        if left:
            self.by_room[left].append(at)
            self.rooms |= 1 << left


def pack_round(items: DataFrame, capacity: int, partitions: int, slack: int, turn: int):
    """One round: local best fit in each of ``partitions`` partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bins = Bins(capacity)
        for batch in batches:
            for one in zip(*(batch.column(n).to_pylist() for n in ("items", "lengths", "total"))):
                open_bins.add(*one)
        done = open_bins.bins
        for at in range(0, len(done), 4096):
            part = done[at: at + 4096]
            totals = [sum(lengths) for _, lengths in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part], arrow.field(0).type),
                    pa.array([n for _, n in part], arrow.field(1).type),
                    pa.array(totals, pa.int32()),
                    pa.array([capacity - t <= slack for t in totals], pa.bool_()),
                ],
                schema=arrow,
            )

    first = F.col("items")[0]
    if partitions > 1:
        dealt = items.repartition(partitions, F.xxhash64(first, F.lit(turn)))
    else:
        dealt = items.repartition(1)
    return dealt.sortWithinPartitions(F.desc("total"), first).mapInArrow(run, BINS)


def pack(
    pieces: DataFrame,
    capacity: int = 2048,
    per_task: int = 50_000,
    slack_share: float = 1 / 128,
) -> DataFrame:
    """Place rows with a unique ``item_id`` and a ``length`` of 1 to capacity.

    Returns item_id, sequence_id (the item_id of the sequence's first piece) and
    offset. A piece of full length is a sequence of its own from the start.
    """
    slack = int(capacity * slack_share)
    items = pieces.filter(F.col("length") < capacity).select(
        F.array("item_id").alias("items"),
        F.array(F.col("length").cast("int")).alias("lengths"),
        F.col("length").cast("int").alias("total"),
    )
    count, turn, finished = items.count(), 0, []
    while count:
        partitions = math.ceil(count / per_task)
        layer = settle(pack_round(items, capacity, partitions, slack, turn), f"bins-{turn}")
        items = layer.filter(~F.col("full")).select("items", "lengths", "total")
        left = items.count()
        if partitions == 1 or left > 0.99 * count:
            finished.append(layer)
            break
        finished.append(layer.filter("full"))
        count, turn = left, turn + 1
    alone = pieces.filter(F.col("length") >= capacity).selectExpr(
        "item_id", "item_id as sequence_id", "cast(0 as bigint) as offset"
    )
    if not finished:
        return alone
    bins = reduce(DataFrame.unionByName, finished)
    placed = bins.select(
        F.col("items")[0].alias("sequence_id"),
        F.col("lengths"),
        F.posexplode("items").alias("place", "item_id"),
    ).select(
        "item_id",
        "sequence_id",
        F.aggregate(F.slice("lengths", 1, F.col("place")), F.lit(0).cast("bigint"),
                    lambda a, x: a + x).alias("offset"),
    )
    return alone.unionByName(placed)


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    vocab: str | None = None,
    per_task: int = 50_000,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = settle(
        token_pieces(docs, capacity, vocab).withColumn(
            "item_id", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    placed = pack(pieces.select("item_id", "length"), capacity, per_task)
    return pieces.join(placed, "item_id").drop("item_id")
