"""Benchmark decontamination (op 7): CGK random-walk embedding and bit-sampling LSH, then exact edit verification.

Texts are sequences of words (runs of ASCII letters, digits and non-ASCII bytes, lower-cased; characters from U+3000
to U+DFFF, of scripts that are written without spaces, are words of their own).  A document
holds an item of n words if some stretch of it is within floor(n / 4) word edits of the item.  Items are grouped
into size classes.  For each repetition a random walk embeds windows of the class's size, started at every word,
so that edit distance becomes Hamming distance; ``K`` sampled places of the embedding are the LSH key, and the
number of repetitions reaches ``RECALL`` for windows whose embedding differs in up to ``DIFFERENT`` of its
places (an unchanged passage always meets its item).  What meets is verified by exact edit distance.

Windows that the q-gram lemma rules out (a match within e edits keeps at least n - 1 - 2e of the item's word
pairs) are not embedded; that loses no match.  Items are a query set given to all executors in blocks of
``BLOCK`` items; more items mean more passes.

Items of fewer than ``SHORTEST`` words allow no edit and are looked up by the hash of the whole sequence, then compared.
Items without a word or with a null id match nothing; items of one id count as one.  Null or empty texts hold no item;
repeated rows are judged one by one and very long texts whole; an empty table of either kind gives no match.  Other
columns pass through ``scan``, whose added column is renamed if it clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.common import Workspace, free_name, mapped

SHORTEST = 8
SAMPLED = 2
DIFFERENT = 0.6
RECALL = 0.95
BLOCK = 20_000
RATIO = 1.15  # of the largest to the smallest size of a class

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = False
_APART[128:] = False
_BITS = 1 << 22


def edits(n: int) -> int:
    return n // 4


def repetitions() -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFERENT) ** SAMPLED))


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts (never 0) and the n + 1 offsets of the texts into them."""
    buf, off = K.flat(pc.utf8_lower(col))
    lead = np.flatnonzero((buf >= 0xE3) & (buf <= 0xED))  # of three bytes each
    begin = np.concatenate((lead, lead + 3))
    starts, ends, at = K.word_spans(buf, off, _APART, begin[begin < len(buf)])
    return K.span_hash(buf, starts, ends) | np.uint64(1), at


def pairs(w: np.ndarray) -> np.ndarray:
    return K.mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])


def sequences(w: np.ndarray, n: int) -> np.ndarray:
    """A key of the n words from each word on."""
    out = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        out = K.mix(out + w[j : j + len(out)])
    return out


def walk(w: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, places: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """CGK walks over w from each start, none beyond its end: at each wanted place the symbol and how far it stands."""
    out, i, bits, wanted = {}, np.zeros(len(start), np.int64), None, set(places)
    last = max(0, len(w) - 1)
    for j in range(max(places) + 1):
        if j % 64 == 0:
            bits = K.mix(w ^ np.uint64((seed * 0x2545F4914F6CDD1D + (j // 64 + 1) * 0x9E6C63D0876A9A63) & (2**64 - 1)))
        at = np.minimum(start + i, last)
        inside = start + i < end
        if j in wanted:
            out[j] = (np.where(inside, w[at], np.uint64(0)), i.copy())
        i += np.where(inside, (bits[at] >> np.uint64(j % 64)) & np.uint64(1), np.uint64(0)).astype(np.int64)
    return out


def distance(item: np.ndarray, region: np.ndarray) -> int:
    """Fewest word edits between the item and any stretch of the region."""
    d = np.zeros(len(region) + 1, np.int64)
    step = np.arange(len(region) + 1)
    for k, word in enumerate(item, 1):
        e = np.empty_like(d)
        e[0] = k
        np.minimum(d[:-1] + (region != word), d[1:] + 1, out=e[1:])
        d = np.minimum.accumulate(e - step) + step
    return int(d.min())


@dataclass
class Class:
    size: int  # of the windows: the smallest size in the class
    span: int  # of the longest match
    least: int  # word pairs that a match keeps
    places: list[list[int]]  # sampled places by repetition
    keys: list[tuple[np.ndarray, np.ndarray]]  # by repetition: ascending keys, items


def key(seen: dict[int, tuple[np.ndarray, np.ndarray]], places: list[int], size: int) -> np.ndarray:
    out = np.zeros(len(seen[places[0]][0]), np.uint64)
    for k, j in enumerate(places):
        symbol, i = seen[j]
        out += np.where(i < size, symbol, np.uint64(0)) * np.uint64(2 * 0x9E3779B97F4A7C15 * (k + 1) + 1 & (2**64 - 1))
    return K.mix(out)


class Index:
    def __init__(self, ids: list[int], texts: list[str]):
        w, at = words(pa.array(texts, pa.string()))
        rows = sorted((int(at[k + 1] - at[k]), k) for k in range(len(ids)) if at[k + 1] - at[k] >= SHORTEST)
        self.ids = ids
        self.short: dict[int, dict[int, list[int]]] = {}  # by length and key of the sequence
        self.brief = {k: w[at[k] : at[k + 1]] for k in range(len(ids)) if 0 < at[k + 1] - at[k] < SHORTEST}
        for k, x in self.brief.items():
            self.short.setdefault(len(x), {}).setdefault(int(sequences(x, len(x))[0]), []).append(k)
        self.words = {k: w[at[k] : at[k + 1]] for _, k in rows}
        self.kinds = {k: frozenset(x.tolist()) for k, x in self.words.items()}
        self.classes: list[Class] = []
        rng = np.random.default_rng(20240611)
        while rows:
            size = rows[0][0]
            own = [k for n, k in rows if n <= RATIO * size]
            rows = rows[len(own) :]
            sizes = [len(self.words[k]) for k in own]
            made = Class(size, max(n + edits(n) for n in sizes), min(n - 1 - 2 * edits(n) for n in sizes), [], [])
            # A walk passes a window of n words in 2n steps on average; places past its end hold nothing.
            flat = np.concatenate([self.words[k] for k in own])
            start = np.concatenate(([0], np.cumsum(sizes)))
            for r in range(repetitions()):
                places = sorted(int(x) for x in rng.choice(2 * size, SAMPLED, replace=False))
                got = key(walk(flat, start[:-1], start[1:], r, places), places, size)
                order = np.argsort(got, kind="stable")
                made.places.append(places)
                made.keys.append((got[order], np.array(own)[order]))
            self.classes.append(made)
        known = np.unique(np.concatenate([pairs(x) for x in self.words.values()])) if self.words else np.zeros(0, np.uint64)
        self.pairs = known
        self.bits = np.zeros(_BITS, bool)
        self.bits[(known & np.uint64(_BITS - 1)).astype(np.int64)] = True

    def matches(self, w: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) of every match found in the texts at the offsets."""
        return self._exact(w, at) + self._near(w, at)

    def _exact(self, w: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Matches of the items that allow no edit."""
        out: set[tuple[int, int]] = set()
        for n, known in self.short.items():
            if len(w) < n:
                continue
            got = sequences(w, n)
            for p in np.flatnonzero(np.isin(got, np.array(list(known), np.uint64))).tolist():
                text = int(np.searchsorted(at, p, "right")) - 1
                if p + n <= at[text + 1]:
                    out |= {(text, k) for k in known[int(got[p])] if (self.brief[k] == w[p : p + n]).all()}
        return sorted(out)

    def _near(self, w: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        if not self.classes or len(w) < 2:
            return []
        two = pairs(w)
        hit = self.bits[(two & np.uint64(_BITS - 1)).astype(np.int64)]
        hit[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(w))] - 1] = False  # pairs across two texts
        maybe = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(self.pairs, two[maybe]), len(self.pairs) - 1)
        hit[maybe] = self.pairs[place] == two[maybe]
        if not hit.any():
            return []
        sums = np.concatenate(([0], np.cumsum(hit), [hit.sum()]))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        end = at[1:][text]
        alive, longest = [], 0
        for c in self.classes:
            stop = np.minimum(np.arange(len(w)) + c.span, end)
            alive.append(sums[np.maximum(stop - 1, 0)] - sums[: len(w)] >= c.least)
            longest = max(longest, c.span)
        any_alive = np.logical_or.reduce(alive)
        starts = np.flatnonzero(any_alive)
        if not len(starts):
            return []
        # Only the words that a window reaches are embedded.
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + longest, end[starts]), -1)
        reach = np.cumsum(edge[:-1]) > 0
        to = np.cumsum(reach) - 1
        near, begin = w[reach], to[starts]
        stop = begin + np.minimum(longest, end[starts] - starts)
        found: set[tuple[int, int, int]] = set()
        for r in range(repetitions()):
            seen = walk(near, begin, stop, r, sorted({j for c in self.classes for j in c.places[r]}))
            for c, ok in zip(self.classes, alive):
                own = np.flatnonzero(ok[starts])
                keys, items = c.keys[r]
                got = key({j: (seen[j][0][own], seen[j][1][own]) for j in c.places[r]}, c.places[r], c.size)
                a, b = np.searchsorted(keys, got), np.searchsorted(keys, got, "right")
                for k in np.flatnonzero(b > a):
                    p = int(starts[own[k]])
                    for item in items[a[k] : b[k]]:
                        found.add((int(text[p]), int(item), p))
        return self._verified(found, w, at)

    def _verified(self, found: set[tuple[int, int, int]], w: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        done: tuple[int, int] | None = None
        upto = 0
        for t, item, p in sorted(found):
            if (t, item) in out or (t, item) == done and p < upto:
                continue
            words_ = self.words[item]
            n, e = len(words_), edits(len(words_))
            # Windows that start near each other share one region.
            a, b = max(int(at[t]), p - e), min(int(at[t + 1]), p + 2 * n + e)
            done, upto = (t, item), p + n - e
            region = w[a:b]
            if len(self.kinds[item].intersection(region.tolist())) >= len(self.kinds[item]) - e and distance(words_, region) <= e:
                out.add((t, item))
        return sorted(out)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with ``items`` added last, renamed if it clashes: the ascending ids of the items each text holds."""
    names, added = docs.columns, free_name(docs, "items")
    kind = T.StructType(list(docs.schema.fields)).add(added, T.ArrayType(T.LongType()))
    out = docs.withColumn(added, F.array().cast("array<long>"))
    chosen = benchmark.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), F.col(item_text)).orderBy(item, item_text)
    ws, rows, before = Workspace(docs.sparkSession, "leaks"), chosen.toLocalIterator(), None
    for k, part in enumerate(iter(lambda: list(islice(rows, block)), [])):
        if before is not None:  # one block at a time: its matches are written before the next is built
            out = ws.put(out, f"block-{k}")
            before.unpersist()
            if k > 1:
                ws.drop(f"block-{k - 1}")
        index = before = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in part], [r[1] for r in part]))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            known = index.value
            w, at = words(batch.column(text))
            had = batch.column(added).to_pylist()
            for t, k in known.matches(w, at):
                had[t] = sorted({*had[t], known.ids[k]})
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(had, pa.list_(pa.int64()))], [*names, added])

        out = mapped(out, [*names, added], text, run, kind)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined) of every row."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"))
