"""Periodic runs of words, by a suffix automaton and link-cut access.

A text's words are appended one after another. The suffix links of the automaton
form a tree; appending word i recolours the path from the root to the state of the
first i + 1 words with i (the access of a link-cut tree). Each segment of one old
colour e on that path says: the longest text that ends at both e and i has the
length of the segment's deepest state. If the distance p = i - e is no more than
that length L, a square of period p ends at i, and the stretch of period p that ends
there starts at i - L - p + 1. The newest colour of a length is that of its nearest
earlier end, so p is the smallest period; a run shows at each of its ends from the
second period on and thus grows with i, until a word breaks it.

The automaton of a stretch is finished before the colouring, so the tree does not
change: segments of a colour (the preferred paths) are kept as stacks along heavy
paths, in place of splay trees. An access takes O(log n) amortised segments.

Only words that can lie in a run of ``least`` words and ``times`` periods are fed to
the automaton: each three words of such a run occur three times within it, so
stretches are cut at words whose triples occur less often, again and again until
nothing changes (``stretches``). That holds for any run looked for, with
``times`` >= 4 and ``least`` >= 5, else nothing is cut.

A document is handled in one task and its words fit in memory; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digits_of_id, map_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 6, 4
SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)
SPANS = "doc_id bigint, start bigint, length bigint, period bigint, words array<string>"


class Automaton:
    """Suffix automaton of a sequence: link and length of each state, and the state
    of each prefix."""

    def __init__(self, ids: list[int]):
        length, link, nexts = [0], [-1], [{}]
        self.prefix = []
        last = 0
        for c in ids:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nexts.append({})
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    nexts.append(nexts[q].copy())
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
            self.prefix.append(state)
        self.length, self.link = length, link


class Colours:
    """Colours of the link tree's root paths, with access."""

    def __init__(self, automaton: Automaton):
        link, length = automaton.link, automaton.length
        n = len(link)
        # A link leads to a shorter state, so falling length visits children first.
        order = sorted(range(n), key=length.__getitem__)
        size, heavy = [1] * n, [-1] * n
        for v in reversed(order[1:]):
            p = link[v]
            size[p] += size[v]
            if heavy[p] < 0 or size[v] > size[heavy[p]]:
                heavy[p] = v
        top = list(range(n))
        for v in order[1:]:
            if heavy[link[v]] == v:
                top[v] = top[link[v]]
        self.top, self.link, self.length = top, link, length
        # Per heavy path, from its deepest coloured end up: (length of the deepest
        # state of the segment, colour); the last entry begins at the top.
        self.stacks: dict[int, list[tuple[int, int]]] = {}

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from the root; (old colour, length of its deepest state
        on the path) of each segment met."""
        met = []
        length, stacks = self.length, self.stacks
        while state >= 0:
            top, reach = self.top[state], length[state]
            stack = stacks.get(top)
            if stack is None:
                stacks[top] = [(reach, colour)]
            else:
                deepest = 0
                while stack and stack[-1][0] <= reach:
                    deepest, old = stack.pop()
                    met.append((old, deepest))
                if stack and deepest < reach:
                    # This segment goes on below the state: here its path ends at it.
                    met.append((stack[-1][1], reach))
                stack.append((reach, colour))
            state = self.link[top]
        return met


def all_runs(ids: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, in no order."""
    automaton = Automaton(ids)
    colours = Colours(automaton)
    growing: dict[int, tuple[int, int]] = {}
    found = []

    def close(period: int) -> None:
        start, end = growing[period]
        if end - start + 1 >= max(least, times * period):
            found.append((start, end - start + 1, period))

    for i, state in enumerate(automaton.prefix):
        longest: dict[int, int] = {}
        for old, length in colours.access(state, i):
            # One colour may lie on several heavy paths; its deepest state counts.
            if i - old <= length and length > longest.get(old, 0):
                longest[old] = length
        for old, length in longest.items():
            period, start = i - old, old - length + 1
            known = growing.get(period)
            if known is not None and known[1] != i - 1:
                close(period)
                known = None
            growing[period] = (start, i)
    for period in growing:
        close(period)
    return found


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(from, to) of stretches that hold all runs; see the module's text."""
    if times < 4 or least < 5:
        return [(0, len(ids))] if len(ids) >= least else []
    done, todo = [], [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = ids[low:high]
        if len(part) > 2:
            _, part = np.unique(part, return_inverse=True)
            k = int(part.max()) + 1
            pair = part[:-1] * k + part[1:]
            _, pair = np.unique(pair, return_inverse=True)
            _, where, count = np.unique(
                pair[:-1] * k + part[2:], return_inverse=True, return_counts=True)
            often = count[where] >= 3
        if often.all():
            done.append((low, high))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2]):
            todo.append((low + int(a), low + int(b) + 2))
    return done


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = []
    for low, high in stretches(ids, least, times):
        part = ids[low:high].tolist()
        found += [(low + s, n, p) for s, n, p in all_runs(part, least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def with_tail(words: list[str], crc: int) -> list[str]:
    """The words, for every tenth id with a tail that repeats some of them."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a: a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that lie in a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [words[i] for i in np.flatnonzero(keep)] if runs else words


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        digits_of_id("doc_id").alias("crc"),
    )


def spans(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period and the repeated words of each run in the texts
    as they are. Null and empty texts have none."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "period", "words")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = WORD.findall(text.as_py() or "")
            for start, length, period in runs_of(numbered(words), least, times):
                for name, value in zip(out, (doc_id, start, length, period, words[start: start + period])):
                    out[name].append(value)
        return out

    return map_rows(_texts(docs), SPANS, rows)


def summary(docs: DataFrame) -> DataFrame:
    """One row for each document, its tail repeated as ``with_tail`` says: number of
    runs, the longest one, hashes of all runs and of the collapsed text.

    A null text has no words. Rows without a doc_id count as if the id were the empty
    text; repeated rows give repeated rows; other columns are left out.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in (
            "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
            "collapsed_sha256")}
        for doc_id, text, crc in zip(
            batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("crc").to_pylist()
        ):
            words = with_tail(WORD.findall(text.as_py() or ""), crc)
            runs = runs_of(numbered(words))
            start, length, period = min(
                runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            kept = " ".join(collapse(words, runs)).encode("utf-8", "surrogatepass")
            for name, value in zip(out, (
                doc_id, len(runs), start, length, period,
                1000 * length // period if runs else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
            )):
                out[name].append(value)
        return out

    return map_rows(_texts(docs), SCHEMA, rows, at_once=500)


def drop_repeats(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with texts cut to one period of each run; a text without a run stays as
    it is, and null stays null. n_chars follows if it is there."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                text = text.as_py()
                words = WORD.findall(text or "")
                runs = runs_of(numbered(words), least, times)
                texts.append(" ".join(collapse(words, runs)) if runs else text)
            changed = {"text": texts}
            if "n_chars" in schema.names:
                before = batch.column("n_chars").to_pylist()
                same = batch.column("text").to_pylist()
                changed["n_chars"] = [
                    b if t == s else len(t) for t, s, b in zip(texts, same, before)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(changed[f.name], batch.schema.field(f.name).type)
                 if f.name in changed else batch.column(f.name) for f in schema],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)
