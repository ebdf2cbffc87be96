"""Phrases whose words occur together, by weighted acyclic automata.

A count transducer is an acyclic automaton that reads a phrase and gives the number
of its occurrences: a path for each window of up to ``longest`` words, a weight at
each state, which is the number of windows that pass it. Each shard builds its own
from its windows in sorted order, one path after another (``grown``). Shards send
their paths; ranges of sorted paths, cut anywhere inside a prefix, are united by
adding weights (``united``). A prefix that crosses the border of two ranges gets a
weight from each, which a last sum joins. Composing candidates with the united
transducer (``parts``) gives the counts of their first parts and rests.

Windows go no further than their words can belong to a phrase with ``least``
occurrences: a word or a pair of words with a 64-bit hash that occurs less often ends
them, and a window of no words only adds to its language's words. Counts of hashes
are exact sums, and frequent ones are kept in a Bloom filter of ``filter_bits`` bits,
whatever the input. Both err to one side only: a window may be longer than needed, so
counts are exact, also where the filter is full.

Texts are lower-cased in A-Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words
at spaces and tabs; phrases lie within a piece. A null text is empty, a null lang is
``und``, an empty table gives no phrases; repeated rows count each, and doc_id and
other columns take no part. A score is cut to a whole number before it is compared.
No language, word or phrase is handled by one task: equal paths are added up within
a shard first, ranges are cut by rows, joins on parts salt hot parts, and the first
phrases of a language are chosen in salted groups first.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civitally.config import Skew
from civitally.operators.ranking import attach_group_stats
from civitally.session import settle

LEAST, LONGEST, SHARE, TOP = 30, 4, 80, 2000
FILTER_BITS = 1 << 25
BLOCK_BITS = 1 << 19
TRIES = 3
SHARD_WORDS = 1_000_000
SLICE_DOCS = 2000
BREAK = b"."
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BREAK * 10)
PATHS = "path string, weight bigint"
CHUNK_ROWS = 200_000


class Shard:
    """Words of some documents, by language, as numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {BREAK: 0}
        self.by_lang: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str | None, text: str | None) -> None:
        if not text:
            return
        raw = text.encode("utf-8", "surrogatepass").lower().translate(CUTS)
        words = raw.replace(BREAK, b" . ").split()
        if not words:
            return
        known = self.known
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = [known.setdefault(w, len(known)) for w in words]
        ids[-1] = 0
        self.by_lang.setdefault("und" if lang is None else lang, []).append(ids)
        self.size += len(ids)

    def streams(self) -> Iterator[tuple[str, np.ndarray]]:
        for lang, parts in self.by_lang.items():
            yield lang, np.concatenate(parts)

    def hashes(self, lang: str) -> np.ndarray:
        """64-bit hash of each word by its number, for one language."""
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w, seed) for w in self.known), np.uint64, len(self.known))


def pair_keys(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word pair at each place, whether there is one)."""
    h = hashes[ids]
    mixed = h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= (mixed >> np.uint64(29)) ^ h[1:]
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed, (ids[:-1] != 0) & (ids[1:] != 0)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            shard.add(lang, text.as_py())
            if shard.size >= SHARD_WORDS:
                yield shard
                shard = Shard()
    if shard.size:
        yield shard


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of single words, apart from those of pairs."""
    return (hashes ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xA0761D6478BD642F)


def frequent_keys(docs: DataFrame, least: int) -> DataFrame:
    """key: hashes of words and word pairs with ``least`` occurrences.

    Each shard sends its keys and counts as sorted arrays, cut by the key's first bits
    into slices, at least one for each ``SLICE_DOCS`` documents, which are summed alone.
    """
    bits = max(8, (docs.count() // SLICE_DOCS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            for lang, ids in shard.streams():
                hashes = shard.hashes(lang)
                pairs, there = pair_keys(ids, hashes)
                words = np.bincount(ids, minlength=len(hashes))
                words[0] = 0
                used = np.flatnonzero(words)
                pairs, weight = np.unique(pairs[there], return_counts=True)
                single = word_keys(hashes[used])
                order = np.argsort(single)
                for keys, counts in ((pairs, weight), (single[order], words[used][order])):
                    slices = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    cut = np.flatnonzero(np.diff(slices, prepend=-1, append=1 << bits))
                    ends = list(zip(cut[:-1], cut[1:]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(slices[cut[:-1]]),
                        pa.array([keys[i:j].tobytes() for i, j in ends], pa.binary()),
                        pa.array([counts[i:j].astype(np.int32).tobytes() for i, j in ends], pa.binary()),
                    ], names=["slice", "keys", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()])

        keys, counts = joined("keys", np.int64), joined("counts", np.int32)
        order = np.argsort(keys)
        keys = keys[order]
        start = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        total = np.add.reduceat(counts[order], start, dtype=np.int64)
        return pa.table({"key": keys[start[total >= least]]})

    return docs.mapInArrow(run, "slice bigint, keys binary, counts binary").groupBy(
        "slice").applyInArrow(add, "key bigint")


def filter_words(keys: DataFrame, bits: int) -> DataFrame:
    """slot, value: the 64-bit words of a filter of ``bits`` (a power of two) bits, with
    ``TRIES`` bits for each key. Spark's own columns, as a second Python function behind
    the one that counts would be a second Python worker for each task."""
    last = F.lit(bits - 1).cast("bigint")
    key = F.col("key").bitwiseAND(last)
    step = F.shiftrightunsigned("key", 33).bitwiseOR(F.lit(1).cast("bigint"))
    at = F.explode(F.array(*[(key + step * t).bitwiseAND(last) for t in range(TRIES)]))
    value = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("slot"), value.alias("value")
                                              ).groupBy("slot").agg(F.bit_or("value").alias("value"))


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the keys as bytes. Spark joins its 64-bit words, then blocks of
    them; the driver gets ``bits`` bits in blocks, whatever the number of keys."""
    block_bits = min(bits, BLOCK_BITS)

    def block(rows: pa.Table) -> pa.Table:
        slot = rows.column("slot").to_numpy()
        words = np.zeros(block_bits // 64, np.int64)
        words[slot % len(words)] = rows.column("value").to_numpy()
        return pa.table({"block": pa.array([slot[0] // len(words)], pa.int64()),
                         "data": pa.array([words.tobytes()], pa.binary())})

    of_block = F.floor(F.col("slot") * 64 / block_bits)
    blocks = filter_words(keys, bits).groupBy(of_block).applyInArrow(block, "block bigint, data binary")
    table = np.zeros(bits // 8, np.uint8)
    for row in blocks.collect():
        at = row["block"] * block_bits // 8
        table[at: at + block_bits // 8] = np.frombuffer(row["data"], np.uint8)
    return table


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter holds each key; one try after another, in few arrays."""
    keys = keys.view(np.uint64)
    last, step = np.uint64(len(table) * 8 - 1), (keys >> np.uint64(33)) | np.uint64(1)
    found, reached = np.ones(len(keys), bool), keys.copy()
    for _ in range(TRIES):
        at = reached & last
        bit = table[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        found &= (bit & 1).view(bool)
        reached += step
    return found


def grown(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths and weights of a shard's transducer: its sorted windows, one row each."""
    if not len(windows):
        return windows, np.zeros(0, np.int64)
    bits = max(int(windows.max()).bit_length(), 1)
    per_key = 64 // bits  # so many numbers make one sort key
    keys = []
    for at in range(0, windows.shape[1], per_key):
        key = np.zeros(len(windows), np.uint64)
        for column in windows.T[at: at + per_key]:
            key = (key << np.uint64(bits)) | column.astype(np.uint64)
        keys.append(key)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    first = np.ones(len(windows), bool)
    first[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    start = np.flatnonzero(first)
    return windows[order[start]], np.diff(np.append(start, len(windows)))


def windows_of(ids: np.ndarray, begin: np.ndarray, go_on: np.ndarray, longest: int) -> np.ndarray:
    """The window at each place that begins one: as many words as pairs go on, then 0."""
    at = np.flatnonzero(begin)
    out = np.zeros((len(at), longest), np.int32)
    out[:, 0] = ids[at]
    rows = np.arange(len(at))
    for k in range(1, longest):
        rows = rows[at[rows] + k < len(ids)]
        rows = rows[go_on[at[rows] + k - 1]]
        out[rows, k] = ids[at[rows] + k]
    return out


def shard_paths(docs: DataFrame, table: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """path, weight: the paths of each shard's count transducer. A path is the language
    and the words, each with a tab behind it, so that the paths of a prefix are next to
    each other in byte order."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            names = pa.array([w.decode("utf-8", "surrogatepass") for w in shard.known])
            for lang, ids in shard.streams():
                hashes = shard.hashes(lang)
                known = holds(sent.value, word_keys(hashes))
                known[0] = False
                begin = known[ids]
                keys, go_on = pair_keys(ids, hashes)
                go_on &= begin[:-1] & begin[1:]
                go_on[go_on] = holds(sent.value, keys[go_on])
                rows, weight = grown(windows_of(ids, begin, go_on, longest))
                rest = np.count_nonzero(ids) - np.count_nonzero(begin)
                if rest:
                    rows = np.concatenate((np.zeros((1, longest), np.int32), rows))
                    weight = np.concatenate(([rest], weight))
                head = quote(lang, safe="") + "\t"  # no tab, url_decode reads it
                for at in range(0, len(rows), CHUNK_ROWS):
                    part = rows[at: at + CHUNK_ROWS]
                    ends = np.concatenate(([0], np.cumsum((part != 0).sum(axis=1))))
                    lists = pa.ListArray.from_arrays(
                        pa.array(ends, pa.int32()), names.take(pa.array(part[part != 0])))
                    joined = pc.binary_join(lists, "\t")
                    tail = np.where(np.diff(ends) > 0, "\t", "")
                    path = pc.binary_join_element_wise(head, joined, pa.array(tail), "")
                    yield pa.RecordBatch.from_arrays(
                        [path, pa.array(weight[at: at + CHUNK_ROWS], pa.int64())],
                        names=["path", "weight"])

    return docs.mapInArrow(run, PATHS)


def states_of(path: pa.Array, weight: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray]:
    """(path to each state, weight) of the automaton of sorted paths: states with
    ``least`` passes, languages, and all states of the first and the last path."""
    split = pc.split_pattern(path, "\t")
    ends = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    sizes = np.diff(ends) - 1  # the last tab is followed by nothing
    n, depth = len(sizes), int(sizes.max())
    codes = np.zeros((n, depth), np.int32)
    for d in range(depth):
        there = np.flatnonzero(sizes > d)
        codes[there, d] = coded.indices.to_numpy()[ends[there] + d] + 1
    changed = np.zeros(n, bool)
    changed[0] = True
    found, sums = [], []
    for d in range(depth):
        changed[1:] |= codes[1:, d] != codes[:-1, d]
        start = np.flatnonzero(changed)
        total = np.add.reduceat(weight, start)
        keep = total >= least
        keep[[0, -1]] = True
        keep &= codes[start, d] > 0
        if d == 0:
            keep[:] = True
        if keep.any():
            at = start[keep]
            words = codes[at, : d + 1].ravel() - 1
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(at) + 1) * (d + 1), pa.int32()),
                coded.dictionary.take(pa.array(words)))
            found.append(pc.binary_join(lists, "\t"))
            sums.append(total[keep])
    return pa.concat_arrays(found), np.concatenate(sums)


def united(paths: DataFrame, least: int) -> DataFrame:
    """lang, words, weight: the states of the united transducer with ``least`` passes,
    and of each language (no words) one with all its windows.

    Paths are dealt by ranges and read in order. A state is complete in a range, or a
    part of it, unless it lies on the first or the last path there; those are summed.
    """
    ranged = paths.repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(some).combine_chunks()
            path, weight = states_of(
                rows.column("path").chunk(0), rows.column("weight").to_numpy(), least)
            return pa.RecordBatch.from_arrays([path, pa.array(weight)], names=["path", "weight"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                yield chunk(held)
                held = []
        if held:
            yield chunk(held)

    states = ranged.mapInArrow(run, PATHS).groupBy("path").agg(F.sum("weight").alias("weight"))
    parts_of = F.split("path", "\t")
    lang = F.url_decode(F.get(parts_of, F.lit(0)))
    words = F.slice(parts_of, F.lit(2), F.size(parts_of))
    return states.select(lang.alias("lang"), words.alias("words"), "weight").filter(
        (F.col("weight") >= least) | (F.size("words") == 0))


def transducer(docs: DataFrame, least: int, longest: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """(states with their weights, number of words of each language), both stored."""
    narrow = docs.select(F.col("lang").cast("string").alias("lang"),
                         F.col("text").cast("string").alias("text"))
    table = bloom(frequent_keys(narrow, least), filter_bits)
    paths = settle(shard_paths(narrow, table, longest), "paths")
    states = settle(united(paths, least), "transducer")
    empty = F.size("words") == 0
    return states.filter(~empty), states.filter(empty).select("lang", F.col("weight").alias("n"))


def wide(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def parts(candidates: DataFrame, states: DataFrame, skew: Skew) -> DataFrame:
    """Candidates composed with the transducer: lang, words, a, and per cut k the
    weights l of the first k words and r of the rest."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    asked = cuts.select(
        "lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"),
        F.slice("words", F.col("k") + 1, F.size("words")).alias("rest"),
        F.xxhash64("words").alias("spread"),
    )
    for part, weight in (("first", "l"), ("rest", "r")):
        # A part is asked for by at most as many phrases as it has occurrences / least.
        known = states.select("lang", F.col("words").alias(part), F.col("weight").alias(weight))
        asked = attach_group_stats(asked, known, ["lang", part], size=weight, spread="spread",
                                   skew=skew)
    return asked.select("lang", "words", "a", "k", "l", "r")


def best_of_each(rows: DataFrame, group: str, order: list[Column], spread: Column, top: int,
                 per_task: int = 100_000) -> DataFrame:
    """The first ``top`` rows of each group with their rank; chosen among salts first."""
    salts = max(1, -(-rows.count() // per_task))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    within = Window.partitionBy(group, "_salt").orderBy(*order)
    some = salted.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
    whole = Window.partitionBy(group).orderBy(*order)
    return some.drop("_salt").withColumn("rank", F.row_number().over(whole)).filter(
        F.col("rank") <= top)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE,
    top: int = TOP, filter_bits: int = FILTER_BITS, skew: Skew = Skew(),
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    states, words = transducer(docs, least, longest, filter_bits)
    candidates = states.filter(F.size("words") > 1).withColumnRenamed("weight", "a")
    per_cut = parts(candidates, states, skew).withColumn(
        "score", (wide("a") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"))
    per_cut = per_cut.withColumn(
        "score", F.expr("cast(score div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"))
    scored = per_cut.groupBy("lang", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    ).select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    # Contiguous phrases inside each candidate, two words or more and shorter than it.
    n = F.size("words")
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), n - 1),
        lambda size: F.transform(F.sequence(F.lit(1), n - size + 1),
                                 lambda at: F.slice("words", at, size))))
    inside = candidates.filter(n > 2).select(
        "lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("words")
    ).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "words"], "left").filter(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * share))
    listed = settle(kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r",
                                "score"), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = best_of_each(listed, "lang", order, F.col("phrase"), top)
    return ranked.join(F.broadcast(words), "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS pid,
         list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS MATERIALIZED (SELECT lang, pid, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
grams AS MATERIALIZED (
  SELECT lang, size, g, count(*) AS f FROM (
    SELECT lang, size, w[i:i + size - 1] AS g FROM words, (VALUES (1), (2), (3), (4)) s(size)
    WHERE i + size - 1 <= len(w)) GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY 1),
cand AS MATERIALIZED (SELECT lang, size, g, f AS a FROM grams WHERE size > 1 AND f >= 30),
cuts AS (SELECT lang, size, g, a, unnest(range(1, size)) AS k FROM cand),
scored AS (
  SELECT c.lang, c.size, c.g, c.a, k, x.f AS l, y.f AS r,
         (CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.size = k AND x.g = c.g[1:k]
  JOIN grams y ON y.lang = c.lang AND y.size = c.size - k AND y.g = c.g[k + 1:c.size]),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, g[i:i + z - 1] AS g FROM (
    SELECT lang, size, g, a, z, unnest(range(1, size - z + 2)) AS i
    FROM cand, (VALUES (2), (3)) t(z) WHERE z < size)),
longer AS (SELECT lang, g, max(a) AS f FROM inner_phrases GROUP BY 1, 2),
kept AS (
  SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score FROM lowest w
  LEFT JOIN longer o ON o.lang = w.lang AND o.g = w.g WHERE o.f IS NULL OR 100 * o.f < 80 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
