"""N-gram Jaccard join with an index of group counts.

A document's set holds the hashes of its distinct word shingles. Hashing tokens
into groups gives a point of counts for each document, and the overlap of two
sets is at most the sum of the smaller counts of each group. Points are found
in two steps:

* **Cells.** Sizes are put into bands, and a band has more groups than two
  linked sets of its size can differ in tokens, so linked sets agree in whole
  groups. The content of a group is the key of a cell. Each cell has its
  smallest document as centre; centre and members are candidates, so a cell of
  any size gives as many pairs as it has members, and a chunk of documents sends
  a cell one row only. Linked sets agree in a number of groups, not in one only, so
  a document leaves as many of its most crowded cells but one (those of a passage
  that many texts quote), and all of them if it has no more.
* **Count trees.** Where members of a centre's cells did not link with it, the
  documents around that centre are packed into a tree of bounding boxes over
  their group counts, and it is searched for partners in other components by
  summed minima. Large neighbourhoods are split into pairs of blocks. A block pair
  verifies what its tree lets through at once and passes on only the links that
  join components: fewer than it has members, however many pairs it looked at.

Every candidate is verified on the shingles of the whole texts. The result is
exact but for collisions of 64-bit shingle hashes: components are those of all
links, and only pairs inside a component that is known already are not looked
at. A set whose tokens fall into too few groups (about one in a million) is
compared with every set that shares a token.

A null or empty text has no shingles and no links; fewer words than a shingle
are one shingle. Rows without a doc_id are returned with their n_shingles and no
component. Repeated rows are one document with several rows; a doc_id with
several texts is linked by any of them. Extra columns are not read. An empty
table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civitally.session import settle

from .common import map_rows
from .components import components

WORDS = 4
PERCENT = 85
COORDINATES = 64
CHUNK = 4000
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000  # 16 MB of hashes
SALTS = 16
SENT_IDS = 4_000_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles. ``bytes`` splits at and lowers
    exactly the ASCII white space and letters."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if n < words:
        if not n:
            return np.zeros(0, np.uint64)
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), n)], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    with np.errstate(over="ignore"):
        all_of = one[: n - words + 1].copy()
        for k in range(1, words):
            all_of = mix(all_of * K1 + one[k: n - words + 1 + k])
    return np.unique(all_of)


def needed(a, b, percent: int = PERCENT):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Size bands and their numbers of groups."""

    def __init__(self, percent: int = PERCENT, ratio: float = 1.4, spare: int = 16):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * max(ratio, 110 / percent))))
        self.lows = lows
        self.groups, self.least = [], []
        for k in range(len(lows) - 1):
            top = lows[k + 1] - 1
            differ = self.differ(top)
            self.groups.append(differ + differ // 8 + spare)
            self.least.append(1 if top < 256 else 2)

    def differ(self, n: int) -> int:
        """The most tokens in which a set of n and a linked set that is not
        smaller can differ."""
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of n tokens is looked for: its own, and the one
        below if a set there can link with it."""
        k = bisect_right(self.lows, n) - 1
        below = k and (self.lows[k] - 1) * 100 // self.percent >= n
        return [k, k - 1] if below else [k]


def cells(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, bool, int]:
    """The keys of a set's cells, whether they are too few for its size, and how many of
    them a linked set shares at least: each token that differs spoils one cell."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), False, 1
    out, weak, common = [], False, []
    inner = mix(tokens + K2)
    for turn, k in enumerate(bands.of(n)):
        group = ((tokens >> np.uint64(32)) * np.uint64(bands.groups[k])) >> np.uint64(32)
        starts = np.append(0, np.flatnonzero(np.diff(group)) + 1)
        counts = np.diff(np.append(starts, n))
        keep = counts >= bands.least[k]
        with np.errstate(over="ignore"):
            content = np.add.reduceat(inner, starts) + group[starts] * K1 + np.uint64(k) * K2
        out.append(mix(content)[keep])
        # The smaller set of a linked pair is in this band, if the pair meets here.
        common.append(int(keep.sum()) - bands.differ(min(n, bands.lows[k + 1] - 1)))
        if turn == 0:
            weak = common[0] <= 0
    return np.concatenate(out).view(np.int64), weak, max(1, min(common))


def counts_of(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens % np.uint64(COORDINATES)).astype(np.int64),
                       minlength=COORDINATES).astype("<u2" if len(tokens) < 65536 else "<u4")


def unpack(counts: bytes) -> np.ndarray:
    kind = "<u2" if len(counts) == 2 * COORDINATES else "<u4"
    return np.frombuffer(counts, kind).astype(np.int32)


def keepers(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the first owner of that key, and whether it is there again. A chunk
    has a few hundred keys for each document, so few arrays of their length are made."""
    if not len(keys):
        return owner, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    starts = np.append(0, np.flatnonzero(np.diff(keys[order])) + 1)
    held_by = np.diff(np.append(starts, len(keys)))
    keeper, shared = np.empty_like(owner), np.empty(len(keys), bool)
    keeper[order] = np.repeat(owner[order[starts]], held_by)
    shared[order] = np.repeat(held_by > 1, held_by)
    return keeper, shared


LISTS = pa.list_(pa.field("element", pa.int64()))


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of ``n`` owners, in whose order they are, as a list column."""
    ends = np.searchsorted(owner, np.arange(n + 1, dtype=np.int32)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), type=LISTS)


LAYER = ("doc_id bigint, n_shingles bigint, copy_of bigint, weak boolean, common int, lent int, "
         "counts binary, cells array<bigint>, met array<bigint>, met_by array<bigint>")


def describe(docs: DataFrame, bands: Bands, words: int) -> DataFrame:
    """One row for each document: set size, counts, and cells. Within a chunk the
    first document of a cell keeps it; the others note that document. A copy of an
    earlier set of the chunk notes only whose copy it is. ``common``: the least cells
    it shares with a linked set; ``lent``: its kept cells that others noted."""

    def rows(batch: pa.RecordBatch) -> dict:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        n = len(ids)
        size, weak, counts = [0] * n, [False] * n, [b""] * n
        copy_of: list = [None] * n
        common = [1] * n
        keys, first = [np.zeros(0, np.int64)] * n, {}
        for i, text in enumerate(texts):
            tokens = shingles(text.as_py(), words)
            size[i] = len(tokens)
            if ids[i] is None or not len(tokens):
                continue
            at = first.setdefault(xxhash.xxh3_128_digest(tokens.tobytes()), i)
            if at != i:
                copy_of[i] = ids[at]
                continue
            keys[i], weak[i], common[i] = cells(tokens, bands)
            counts[i] = counts_of(tokens).tobytes()
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(k) for k in keys])
        joined = np.concatenate(keys)
        del keys
        keeper, shared = keepers(joined, owner)
        own = keeper == owner
        lent = np.bincount(owner[own & shared], minlength=n)
        of_own, of_met = owner[own], owner[~own]
        met_by = np.array([-1 if i is None else i for i in ids], np.int64)[keeper[~own]]
        return {
            "doc_id": ids, "n_shingles": size, "copy_of": copy_of, "weak": weak, "counts": counts,
            "common": common, "lent": lent, "cells": lists(joined[own], of_own, n),
            "met": lists(joined[~own], of_met, n), "met_by": lists(met_by, of_met, n),
        }

    return map_rows(docs, LAYER, rows, CHUNK)


def met_pairs(layer: DataFrame) -> DataFrame:
    """a (the smallest that keeps a cell), b for all members of cells, a itself too if
    another chunk has one; n: in how many cells."""
    # The filter is that of the join below, so that both read the same exchange.
    kept = layer.select(F.explode("cells").alias("cell"), F.col("doc_id").alias("b")).filter(
        "cell is not null")
    cell = Window.partitionBy("cell")
    shared = kept.withColumns(
        {"a": F.min("b").over(cell), "held_by": F.count("b").over(cell)}).filter("held_by > 1")
    noted = layer.filter(F.size("met") > 0).select(
        F.explode(F.arrays_zip("met", "met_by")).alias("m"), F.col("doc_id").alias("b")
    ).select(F.col("m.met").alias("cell"), F.col("m.met_by").alias("by"), "b")
    centres = shared.filter("a <> b").select("cell", F.col("b").alias("by"), "a")
    near = noted.join(centres, ["cell", "by"], "left").select(
        F.coalesce("a", "by").alias("a"), "b"
    )
    return shared.select("a", "b").unionByName(near).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"))


def star_pairs(layer: DataFrame) -> DataFrame:
    """a (the centre of a cell) and b for members of cells; ``both``: a can link too.

    A document that shares ``common`` cells with a linked one stays around that one's
    centres if it leaves the ``common - 1`` cells of the most crowded centres: the least
    crowded cell of a linked pair is in none of both. Some cells are counted twice here,
    which leaves fewer; a document with fewer cells than ``common`` is left out.
    """
    met = settle(met_pairs(layer), "jaccard-met")
    shared = met.groupBy("b").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("own"))
    able = settle(
        layer.filter("copy_of is null and n_shingles > 0 and doc_id is not null")
        .groupBy(F.col("doc_id").alias("b"))
        .agg(F.min("common").alias("common"), F.sum("lent").alias("lent"))
        .join(shared, "b", "left").filter("coalesce(n, 0) + lent >= common")
        .selectExpr("b", "common - lent - coalesce(own, 0) as need"), "jaccard-able")
    stars = met.filter("a <> b")
    crowds = stars.groupBy("a").agg(F.count(F.lit(1)).alias("crowd"))
    crowded_first = Window.partitionBy("b").orderBy(F.desc("crowd"), F.desc("a")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    left = stars.join(crowds, "a").join(able, "b").withColumn(
        "cells", F.sum("n").over(crowded_first)).filter("cells >= need").select("a", "b")
    centre = able.select(F.col("b").alias("a"), F.lit(True).alias("both"))
    return left.join(centre, "a", "left").select(
        "a", "b", F.coalesce("both", F.lit(False)).alias("both"))


def weak_pairs(docs: DataFrame, layer: DataFrame, words: int) -> DataFrame | None:
    """Pairs of the sets that have too few cells with all that share a token."""
    weak = layer.filter("weak").select("doc_id")
    if weak.isEmpty():
        return None

    def rows(batch: pa.RecordBatch) -> dict:
        ids, tokens = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = shingles(text.as_py(), words).view(np.int64)
            tokens.extend(found.tolist())
            ids.extend([doc_id] * len(found))
        return {"doc_id": ids, "token": tokens}

    schema = "doc_id bigint, token bigint"
    of_weak = map_rows(docs.join(weak, "doc_id", "left_semi"), schema, rows)
    met = map_rows(docs, schema, rows).join(
        of_weak.select(F.col("doc_id").alias("w"), "token"), "token"
    ).filter("w <> doc_id")
    return met.select(F.least("w", "doc_id").alias("a"), F.greatest("w", "doc_id").alias("b")
                      ).distinct()


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose summed count minima reach the overlap they need."""
    left = points.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"),
                         F.col("counts").alias("ca"))
    right = points.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"),
                          F.col("counts").alias("cb"))
    near = pairs.join(left, "a").join(right, "b").filter(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    )

    def rows(batch: pa.RecordBatch) -> dict:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        ca = np.stack([unpack(x) for x in batch.column("ca").to_pylist()])
        cb = np.stack([unpack(x) for x in batch.column("cb").to_pylist()])
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        keep = np.minimum(ca, cb).sum(1) >= needed(na, nb, percent)
        return {"a": a[keep], "b": b[keep]}

    return map_rows(near, "a bigint, b bigint", rows)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs that link, from the shingles of their whole texts."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb")):
                ta = ta.as_py()
                if ta != last:  # rows of a centre mostly follow each other
                    last, held = ta, shingles(ta, words)
                other = shingles(tb.as_py(), words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct()


class CountTree:
    """Bounding boxes over points of counts, packed bottom-up from points in order
    of size; every level has one box for ``fan`` boxes or points below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.order = np.argsort(sizes, kind="stable")
        self.points, self.sizes, self.fan = points[self.order], sizes[self.order], fan
        self.levels = []
        most, low, high = self.points, self.sizes, self.sizes
        while len(most) > 1:
            at = np.arange(0, len(most), fan)
            most = np.maximum.reduceat(most, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((most, low, high))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (as given) of the points that may link with this one."""

        def may(most, low, high):
            reach = np.minimum(most, point).sum(1)
            return (
                (reach >= needed(size, np.maximum(low, -(-percent * size // 100)), percent))
                & (100 * high >= percent * size) & (percent * low <= 100 * size)
            )

        at = np.zeros(1, np.int64)
        for most, low, high in reversed(self.levels):
            at = at[at < len(most)]
            at = at[may(most[at], low[at], high[at])]
            at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
        at = at[at < len(self.points)]
        good = may(self.points[at], self.sizes[at], self.sizes[at])
        return self.order[at[good]]


SETS = "doc_id bigint, n_shingles bigint, counts binary, tokens binary"


def open_sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sizes, counts and shingles of the wanted documents, a repeated row of a chunk
    only once."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": [], "n_shingles": [], "counts": [], "tokens": []}
        seen = set()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            tokens = shingles(text.as_py(), words)
            packed = tokens.tobytes()
            key = (doc_id, xxhash.xxh3_128_digest(packed))
            if not len(tokens) or key in seen:
                continue
            seen.add(key)
            for k, v in zip(out, (doc_id, len(tokens), counts_of(tokens).tobytes(), packed)):
                out[k].append(v)
        return out

    # The hashes are as large as the texts, so fewer rows are held at once.
    return map_rows(texts.join(wanted, "doc_id", "left_semi"), SETS, rows, 500)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common values of two sorted arrays without repetitions."""
    at = np.minimum(a.searchsorted(b), len(a) - 1)
    return int((a[at] == b).sum())


def spanning_links(rows: pd.DataFrame, percent: int) -> tuple[list[int], list[int]]:
    """Links of one pair of blocks that join different components, verified. Pairs
    that the links before them join already are not looked at."""
    i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
    tree_rows, probes = rows[rows["block"] == j], rows[rows["block"] == i]
    out_a: list[int] = []
    out_b: list[int] = []
    if not len(tree_rows) or not len(probes):
        return out_a, out_b
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    ids, root = tree_rows["doc_id"].to_numpy(), tree_rows["root"].to_numpy()
    held = [np.frombuffer(t, np.uint64) for t in tree_rows["tokens"]]
    tree = CountTree(np.stack([unpack(c) for c in tree_rows["counts"]]),
                     tree_rows["n_shingles"].to_numpy())
    for doc_id, own, size, counts, packed in zip(*(probes[c] for c in (
            "doc_id", "root", "n_shingles", "counts", "tokens"))):
        at = tree.search(unpack(counts), size, percent)
        at = at[root[at] != own]
        if i == j:
            at = at[ids[at] > doc_id]
        tokens = np.frombuffer(packed, np.uint64)
        for k in at:
            x, y = top(own), top(int(root[k]))
            if x == y:
                continue
            if overlap(tokens, held[k]) >= needed(size, len(held[k]), percent):
                above[max(x, y)] = min(x, y)
                out_a.append(min(doc_id, int(ids[k])))
                out_b.append(max(doc_id, int(ids[k])))
    return out_a, out_b


def tree_links(
    pairs: DataFrame, roots: DataFrame, points: DataFrame, texts: DataFrame, percent: int, words: int
) -> DataFrame:
    """Links that join different components around the same centre. ``roots`` has id
    and root of the components found so far. Centres themselves need no search, as
    all pairs with them are verified."""
    around = pairs.select(F.col("a").alias("centre"), F.col("b").alias("doc_id")).join(
        roots.withColumnRenamed("id", "doc_id"), "doc_id", "left"
    ).withColumn("root", F.coalesce("root", "doc_id"))
    sizes = points.groupBy("doc_id").agg(F.sum("n_shingles").alias("n"))
    around = settle(around.join(sizes, "doc_id"), "jaccard-around")
    open_centres = around.groupBy("centre").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"),
    ).filter("low < high").select(
        "centre", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)
                             ).cast("int").alias("blocks"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    placed = settle(
        around.withColumn("salt", salt).join(open_centres, ["centre", "salt"])
        .select("centre", "doc_id", "root", "blocks"), "jaccard-open")
    wanted = settle(placed.select("doc_id").distinct(), "jaccard-wanted")
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    sets = open_sets(texts, wanted, words)
    dealt = (
        placed.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(sets, "doc_id")
        .select("centre", F.least("block", "other").alias("i"),
                F.greatest("block", "other").alias("j"), "block", "doc_id", "root",
                "n_shingles", "counts", "tokens")
    )

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = spanning_links(rows, percent)
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return dealt.groupBy("centre", "i", "j").applyInPandas(search, "a bigint, b bigint").distinct()


def join(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, bands: Bands | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    bands = bands or Bands(percent)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    layer = settle(describe(narrow, bands, words), "jaccard-sets")
    known = narrow.filter("doc_id is not null")
    points = layer.filter("copy_of is null and n_shingles > 0 and doc_id is not null").select(
        "doc_id", "n_shingles", "counts"
    )
    pairs = star_pairs(layer)
    more = weak_pairs(known, layer, words)
    if more is not None:
        pairs = pairs.unionByName(more.withColumn("both", F.lit(True))).groupBy("a", "b").agg(
            F.bool_or("both").alias("both"))
    pairs = settle(pairs, "jaccard-pairs")
    direct = pairs.filter("both").select("a", "b")
    copies = layer.filter("copy_of is not null and doc_id is not null").select(
        F.col("copy_of").alias("a"), F.col("doc_id").alias("b")
    )
    surviving = settle(bounded(direct, points, percent), "jaccard-bounded")
    involved = direct.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    involved = settle(involved, "jaccard-involved")
    if involved.count() <= SENT_IDS:
        involved = F.broadcast(involved)
    texts = settle(known.join(involved, "doc_id", "left_semi"), "jaccard-texts")
    links = settle(verified(surviving, texts, percent, words), "jaccard-links")
    roots = components(copies.unionByName(links))
    found = settle(tree_links(pairs, roots, points, texts, percent, words), "jaccard-tree-links")
    if not found.isEmpty():
        joined = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        roots = components(joined.unionByName(found))
    return layer.select("doc_id", "n_shingles").join(
        roots.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
