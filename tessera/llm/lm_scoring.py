"""Language-model scoring (op 9): a weighted backoff automaton of every counted context, and an exact word-unigram base.

The text is its words joined by one space, A-Z lower-cased, then an end mark.  Every context of up to ``ORDER - 1``
bytes that the training rows hold counts, so the model grows with the corpus; probabilities are Witten-Bell
interpolated, which is backing off: a byte seen after a context has its own probability there, any other that of
the context's ending times the context's weight of failure.

Contexts are the states of an ``Automaton`` with failure arcs, which reads each text once from left to right.  The most
frequent contexts, with ``HOT_GRAMS`` arcs at most, are on all executors; at a byte where a longer context than the
state's could be counted, the byte's n-gram is joined with the written model of all contexts instead, so none is
dropped.  That model has the n-grams of all rows, those of held-out rows with their backed-off probability.  Up to
two bytes of context are settled on the driver (2**24 n-grams at most), longer ones in partitions by the three bytes
before the symbol, which hold all that longer contexts need.

The base needs the count of every word.  Words of at least an N / ``HOT`` share, of which there can be ``HOT``
at most, go to all executors; the rest is joined by a shuffle.

Learns from rows whose crc32(doc_id as text) modulo 5 isn't 1 (a null doc_id is learnt from).  Null text is
empty: one token, the end.  Repeated rows count and are scored one by one.  Very long texts are read in lanes.  Equal
counts leave nothing to choose: contexts of one count are all states or none.  Other columns are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import Workspace, bounded, released, slices

ORDER = 7
HOT = 1 << 21
HOT_GRAMS = 3 << 20
LANE = 512  # bytes that one lane reads of a long text
PART = 1 << 18  # mean n-grams of a partition of the model
END = 10
END_HASH = -0x5E4D3C2B1A09  # the end token's key beside 64-bit word hashes


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


class Tally:
    """Counts by 64-bit key within a task, merged whenever the unmerged part grows past a bound.

    A task gives its counts out and starts anew once ``bound`` distinct keys are held, so its memory is bounded.
    """

    def __init__(self, bound: int = 1 << 21):
        self.keys, self.counts, self.loose, self.bound = [], [], 0, bound

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(n)
        self.loose += len(key)
        if self.loose > self.bound:
            self.flush()

    def held(self) -> int:
        """Distinct keys of the merged part."""
        return len(self.keys[0]) if self.keys and not self.loose else 0

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            key, n = merged(self.keys, self.counts)
            self.keys, self.counts = [key], [n]
        self.loose = 0
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def stream(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one run of bytes, each ended by END, and their n + 1 offsets."""
    n_words = np.diff(at)
    empty = np.concatenate(([0], np.cumsum(n_words == 0)))
    solid = ~K.SPACE[buf]
    rank = np.concatenate(([0], np.cumsum(solid)))
    word = np.repeat(np.arange(len(starts)), ends - starts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    out = np.full(rank[-1] + len(starts) + empty[-1], END, np.uint8)
    symbol = K.LOWER[buf[solid]]
    symbol[(symbol < 9) | (symbol > 13) & (symbol < 32)] = 1  # control characters are one symbol; 0 means no byte
    out[np.arange(len(symbol)) + word + empty[doc[word]]] = symbol
    gap = np.ones(len(starts), bool)
    gap[at[1:][n_words > 0] - 1] = False
    after = rank[ends] + np.arange(len(starts)) + empty[doc]
    out[after[gap]] = 32
    lengths = rank[off[1:]] - rank[off[:-1]] + n_words + (n_words == 0)
    return out, np.concatenate(([0], np.cumsum(lengths)))


def grams_of(s: np.ndarray, off: np.ndarray, chosen: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The ORDER-gram that ends at each chosen byte of a stream: the byte lowest, the one before it next, 0 before the text."""
    place = (np.arange(len(s)) - np.repeat(off[:-1], np.diff(off)))[chosen]
    at = np.arange(len(s))[chosen] + ORDER
    padded = np.concatenate((np.zeros(ORDER, np.uint8), s))
    key = padded[at].astype(np.int64)
    early = np.flatnonzero(place < ORDER - 1)
    for k in range(1, ORDER):
        prior = padded[at - k]
        own = early[place[early] < k]
        prior[own] = np.where(place[own] == k - 1, END, 0)  # a text begins after an end
        key |= prior.astype(np.int64) << (8 * k)
    return key


def packed(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, those of one significance together, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, size: int) -> np.ndarray:
    apart = np.frombuffer(pa.decompress(raw, 8 * size, codec="zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(apart.T).view(np.int64).ravel()


def tallied(keys: np.ndarray, off: np.ndarray) -> pa.Array:
    """The distinct keys of every text and how often each stands in it; off are the n + 1 offsets of the texts."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))) if len(keys) else np.zeros(0, bool))
    times = np.diff(np.append(first, len(keys)))
    found = pa.StructArray.from_arrays([pa.array(keys[first]), pa.array(times.astype(np.int64))], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(len(off))).astype(np.int32)), found)


def counts(docs: DataFrame, ws: Workspace) -> DataFrame:
    """kind 0: words of training rows by hash, kind 1: byte n-grams of ORDER of all rows; n counts training rows. Written.

    A task deals its counts to the shuffle's partitions itself, keys and counts of a partition as one row, so that no
    engine row is spent on each; a partition then merges sorted runs.  A run's keys are its steps from key to key.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def given(kind: int, tally: Tally):
        key, n = tally.flush()
        tally.keys, tally.counts = [], []
        part = (K.mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # keys of a part stay in order
        key, n, ends = key[order], n[order].astype(np.int64), np.cumsum(np.bincount(part, minlength=parts))
        for r in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            own = slice(int(ends[r - 1]) if r else 0, int(ends[r]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int32()) for x in (kind, r, len(key[own]))), *(pa.array([packed(x)], pa.binary()) for x in (np.diff(key[own], prepend=0), n[own]))], ["kind", "part", "size", "keys", "n"]
            )

    def run(batches):
        words, grams = Tally(), Tally()
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                learnt = ~np.asarray(part.column("held_out"))
                buf, off = K.flat(part.column("text"))
                starts, ends, at = K.word_spans(buf, off)
                if learnt.any():
                    own = np.repeat(learnt, np.diff(at))
                    words.add(np.array([END_HASH]), np.array([learnt.sum()]))
                    words.add(*distinct(K.span_hash(buf, starts[own], ends[own]).view(np.int64)))
                s, so = stream(buf, off, starts, ends, at)
                key = grams_of(s, so)
                own = np.repeat(learnt, np.diff(so))
                grams.add(*distinct(key[own]))
                other = distinct(key[~own])[0]
                grams.add(other, np.zeros(len(other), np.int64))
                for kind, tally in ((0, words), (1, grams)):
                    if tally.held() > tally.bound:
                        yield from given(kind, tally)
        yield from given(0, words)
        yield from given(1, grams)

    def add(table: pa.Table) -> pa.Table:
        keys, n = ([unpacked(x.as_py(), size.as_py()) for x, size in zip(table.column(c), table.column("size"))] for c in ("keys", "n"))
        key, n = merged([np.cumsum(x) for x in keys], n)
        return pa.table({"kind": pa.array(np.full(len(key), table.column("kind")[0].as_py(), np.int32)), "key": pa.array(key), "n": pa.array(n)})

    rows = docs.select(held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "kind int, part int, size int, keys binary, n binary")
    return ws.put(rows.groupBy("kind", "part").applyInArrow(add, "kind int, key long, n long"), "counts")


def deepened(key: np.ndarray, n: np.ndarray, p: np.ndarray, m: int, least: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """From the probability of each n-gram's byte after m - 1 bytes that after m; all n-grams of its context are given.

    Also the arcs that leave the contexts of m bytes: n-gram of m + 1 bytes, occurrences of its context, the context's
    weight of failure, the byte's probability.
    """
    arc, first, of_key = np.unique(key & ((1 << 8 * (m + 1)) - 1), return_index=True, return_inverse=True)
    c = np.bincount(of_key, n, len(arc))
    ctx, of_arc = np.unique(arc >> 8, return_inverse=True)
    total, kinds = np.bincount(of_arc, c, len(ctx)), np.bincount(of_arc, c > 0, len(ctx))
    known = (total > 0) & (total >= least)
    if m:  # a context with a missing byte is no context of this length
        known &= ctx >= 1 << 8 * (m - 1)
    back = kinds / np.maximum(1, total + kinds)
    p = np.where(known[of_arc], c / np.maximum(1, total + kinds)[of_arc] + back[of_arc] * p[first], p[first])
    left = np.flatnonzero(known[of_arc] & (c > 0))
    return p[of_key], (arc[left], total[of_arc[left]].astype(np.int64), back[of_arc[left]], p[left])


class Table:
    """The places of 64-bit keys, which are sorted by buckets of about one key."""

    def __init__(self, key: np.ndarray):
        self.bits = len(key).bit_length()
        place = self.bucket(key)
        self.first = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(place, minlength=1 << self.bits), out=self.first[1:])
        self.order = np.argsort(place, kind="stable").astype(np.int32)
        del place
        self.key = np.append(key[self.order], -1)  # there is always one to look at

    def bucket(self, key: np.ndarray) -> np.ndarray:
        place = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place >>= np.uint64(64 - self.bits)
        return place.view(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't held."""
        place = self.bucket(key)
        at = self.first[place]
        hit = self.key[at] == key
        found = np.where(hit, at, np.int32(-1))
        left = np.flatnonzero(~hit)
        at, end = at[left] + 1, self.first[place[left] + 1]
        while len(left):
            more = at < end
            left, at, end = left[more], at[more], end[more]
            hit = self.key[at] == key[left]
            found[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return found


class Automaton:
    """States are contexts, the empty one first; each has arcs for the bytes seen after it and one failure arc.

    An arc carries its byte's log-probability and leads to the longest state that ends the text read so far; a failure
    arc carries the weight of falling back and leads to the state's longest proper ending.  The empty state has an arc
    for every byte.  States are closed under endings, which hold at least as many occurrences.
    """

    def __init__(self, arc: np.ndarray, logp: np.ndarray, back: np.ndarray, complete: bool):
        order = np.argsort(arc).astype(np.int32)
        arc = arc[order]
        first = np.flatnonzero(np.concatenate(([True], (arc[1:] ^ arc[:-1]) > 255))).astype(np.int32)
        ctx = arc[first] >> 8
        states = Table(ctx)
        state = np.empty(len(ctx), np.int32)
        state[states.order] = np.arange(len(ctx))  # states are numbered by their places
        held = states.key[:-1]

        def ending(text: np.ndarray, size: int) -> np.ndarray:
            """The longest state of at most size bytes that ends each text."""
            out = np.full(len(text), state[0], np.int32)
            for a in range(0, len(text), 1 << 17):  # a part at a time, for memory
                left = np.arange(a, min(a + (1 << 17), len(text)))
                for k in range(size, 0, -1):
                    own = text[left] & ((1 << 8 * k) - 1)
                    at = np.where(own >= 1 << 8 * (k - 1), states.find(own), -1)
                    out[left[at >= 0]] = at[at >= 0]
                    left = left[at < 0]
            return out

        self.root, self.complete = int(state[0]), complete
        self.begin = int(ending(np.array([END]), 1)[0])  # a text begins after an end
        self.length = length = sum((held >= 1 << 8 * k).astype(np.int8) for k in range(ORDER - 1))
        self.back = back[order[first]][states.order].astype(np.float32)
        self.fail = np.empty(len(ctx), np.int32)
        for k in range(ORDER):
            own = np.flatnonzero(self.length == k)
            self.fail[own] = ending(held[own], k - 1)
        to, source = ending(arc, ORDER - 1), np.repeat(state, np.diff(np.append(first, len(arc))))
        full = length[to] == np.minimum(length[source] + 1, ORDER - 1)
        arc &= 255
        arc |= source.astype(np.int64) << 8
        del source, ending, states
        self.arcs = Table(arc)
        del arc
        # An arc's key stands beside what it carries: the state it leads to, that state's length, whether the arc's
        # whole text or its last ORDER - 1 bytes are that state, and the bits of the log-probability.
        self.cells = np.full((len(to) + 1, 2), -1)
        self.cells[:, 0] = self.arcs.key
        self.arcs.key = None
        carried = (to.astype(np.int64) << 4 | length[to] << 1 | full) << 32
        del to, full
        carried |= logp[order].astype(np.float32).view(np.uint32).astype(np.int64)
        self.cells[:-1, 1] = carried[self.arcs.order]
        self.arcs.order = None

    def read(self, s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each byte's log-probability, and whether no longer context than the state's can count for it.

        None can if the state is as long as contexts get, or if it was so before and the arc's whole text is a state; a
        text that has no arc was never counted, so the states that failure arcs lead to are no shorter than they should be.
        Reads all texts side by side from left to right.  Long ones are read in lanes that start ``ORDER`` - 1 bytes
        early, after which the state is that of a pass from the text's start.
        """
        self.arcs.key = self.cells[:, 0]
        carried = self.cells[:, 1]
        size = np.diff(off)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = off[text] + LANE * k
        start = own - np.where(k > 0, ORDER - 1, 0)
        steps = np.minimum(own + LANE, off[text + 1]) - start
        order = np.argsort(-steps, kind="stable")
        start, own, steps, state = start[order], own[order], steps[order], np.where(k > 0, self.root, self.begin)[order].astype(np.int32)
        length = self.length[state]
        sure = length == np.where(k > 0, ORDER - 1, 1)[order]
        active = len(steps) - np.cumsum(np.bincount(steps, minlength=1))  # lanes longer than j steps
        logp, at_state, settled = np.zeros(len(s), np.float64), np.zeros(len(s), np.int8), np.zeros(len(s), bool)
        for j in range(int(steps[0]) if len(steps) else 0):
            a = int(active[j])
            start, own, state, length, sure = start[:a], own[:a], state[:a], length[:a], sure[:a]
            at = start + j
            byte = s[at].astype(np.int64)
            weight = np.zeros(a)
            arc = self.arcs.find(state.astype(np.int64) << 8 | byte)
            lost = np.flatnonzero(arc < 0)
            while len(lost):
                weight[lost] += self.back[state[lost]]
                state[lost] = self.fail[state[lost]]
                arc[lost] = self.arcs.find(state[lost].astype(np.int64) << 8 | byte[lost])
                lost = lost[arc[lost] < 0]
            got = carried[arc]
            weight += got.astype(np.uint32).view(np.float32)
            if j < ORDER - 1:
                given = at >= own
                at, weight, length, sure_of = at[given], weight[given], length[given], sure[given]
            else:
                sure_of = sure
            logp[at], at_state[at], settled[at] = weight, length, sure_of
            got >>= 32
            state, length = (got >> 4).astype(np.int32), (got >> 1 & 7).astype(np.int8)
            sure = sure & (got & 1).astype(bool) | (length == ORDER - 1)
        place = np.arange(len(s)) - np.repeat(off[:-1], size)
        return logp, self.complete | settled | (at_state == np.minimum(place + 1, ORDER - 1))


def modelled(grams: DataFrame, positions: int, ws: Workspace, capacity: int | None) -> tuple[DataFrame, tuple[np.ndarray, ...]]:
    """The model, written, and the arcs of contexts of at most two bytes; with a capacity only contexts at 1 / capacity of all positions count.

    Rows of level ``ORDER`` are all n-grams, those of lower levels the arcs of contexts of that many bytes: key, logp, and
    for arcs the occurrences of their context (else 0) and its log weight of failure.
    """
    least = positions / capacity if capacity else 0.0
    low = (1 << 24) - 1
    got = grams.groupBy(F.col("key").bitwiseAND(F.lit(low)).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()  # 2**24 rows at most
    key, n = np.asarray(got.column("key")), np.asarray(got.column("n"))
    byte = (np.bincount(key & 255, n, 256) + 0.5) / (positions + 0.5 * 256)
    p, short = byte[key & 255], [(np.arange(256), np.full(256, positions), np.ones(256), byte)]
    for m in (1, 2):
        p, arcs = deepened(key, n, p, m, least)
        short.append(arcs)
    shared = grams.sparkSession.sparkContext.broadcast((key, p))

    def rows(level: int, key: np.ndarray, total: np.ndarray, back: np.ndarray, p: np.ndarray):
        logs = [np.log10(x).astype(np.float32) for x in (back, p)]
        for i in range(0, len(key), 1 << 16):
            part = slice(i, i + (1 << 16))
            made = [np.full(len(key[part]), level, np.int32), key[part], total[part], *(x[part] for x in logs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["level", "key", "total", "back", "logp"])

    def run(batches):
        held = [(np.asarray(x.column("key")), np.asarray(x.column("n"))) for x in batches]
        if not held:
            return
        key, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        key, n = key[order], n[order]
        short, p = shared.value
        p = p[np.searchsorted(short, key & low)]
        for m in range(3, ORDER - 1):
            p, arcs = deepened(key, n, p, m, least)
            yield from rows(m, *arcs)
        p, (arc, total, back, _) = deepened(key, n, p, ORDER - 1, least)
        every, weight = np.zeros(len(key), np.int64), np.ones(len(key))
        at = np.searchsorted(key, arc)
        every[at], weight[at] = total, back
        yield from rows(ORDER, key, every, weight, p)

    context = F.shiftrightunsigned(F.col("key"), 8).bitwiseAND(F.lit(low))
    dealt = grams.select("key", "n").repartition(-(-grams.count() // PART), context)
    made = ws.put(dealt.mapInArrow(run, "level int, key long, total long, back float, logp float"), "model")
    return made, tuple(np.concatenate(x) for x in zip(*short))


def frequent_contexts(model: DataFrame, short: tuple[np.ndarray, ...], most: int) -> Automaton:
    """The automaton of the contexts from the least number of occurrences on at which they have no more than most arcs."""
    key, total = short[:2]
    back, logp = (np.log10(x).astype(np.float32) for x in short[2:])
    released()
    fine = 16.0  # steps for each doubling of the number of occurrences
    found = model.where("total > 0").groupBy(F.floor(F.log2("total") * fine).alias("step")).count().collect()
    size = Counter({int(r["step"]): r["count"] for r in found})
    size.update(np.floor(np.log2(total[256:]) * fine).astype(int).tolist())
    steps = sorted(size, reverse=True)
    fits = [x for x, held in zip(steps, np.cumsum([size[x] for x in steps])) if held <= most]
    complete = len(fits) == len(steps)
    least = 1 if complete else math.ceil(2 ** (fits[-1] / fine)) if fits else None
    own = np.arange(len(key)) < 256  # the empty context is always a state
    if least is None:
        return Automaton(key[own], logp[own], back[own], complete)
    own |= total >= least
    got = model.where((F.col("total") > 0) & (F.col("total") >= least)).select("key", "back", "logp").toArrow()  # most rows at most
    key, back, logp = (np.concatenate([x[own], *(np.asarray(part) for part in got.column(c).chunks)]) for c, x in (("key", key), ("back", back), ("logp", logp)))
    del got
    return Automaton(key, logp, back, complete)


def score(docs: DataFrame, capacity: int | None = None, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    bounded(spark)
    ws = Workspace(spark, "lm")
    known = counts(docs.select(F.col("doc_id").cast("long"), "text"), ws)
    words, grams = known.where("kind = 0").select("key", "n"), known.where("kind = 1").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    positions = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") * hot >= total).orderBy("key").toArrow()  # hot rows at most
    model, short = modelled(grams, positions, ws, capacity) if positions else (None, None)
    common = frequent_contexts(model, short, hot_grams) if positions else None
    ends = words.where(F.col("key") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = spark.sparkContext.broadcast((np.asarray(frequent.column("key")), np.asarray(frequent.column("n")).astype(np.float64), common))

    def run(batches):
        keys, n, common = shared.value
        logs = np.log10(n + 0.5)
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                buf, off = K.flat(part.column("text"))
                starts, stops, at = K.word_spans(buf, off)
                h = K.span_hash(buf, starts, stops).view(np.int64)
                size = np.diff(at)
                place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hot_word = keys[place] == h if len(keys) else np.zeros(len(h), bool)
                base = K.segment_sum(np.where(hot_word, logs[place] if len(keys) else 0.0, 0.0), at) + np.log10(ends + 0.5)
                sure = K.segment_sum(hot_word.astype(np.int64), at) + int(ends > 0)
                rest = h[~hot_word]
                tail = np.concatenate(([0], np.cumsum(~hot_word)))[at]
                s, so = stream(buf, off, starts, stops, at)
                lm, rare, rares = np.zeros(len(size)), np.zeros(0, np.int64), np.zeros(len(size) + 1, np.int64)
                if common:
                    logp, sure_of = common.read(s, so)
                    lm = K.segment_sum(np.where(sure_of, logp, 0.0), so)
                    if not sure_of.all():
                        rare, rares = grams_of(s, so, ~sure_of), np.concatenate(([0], np.cumsum(~sure_of)))[so]
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(size + 1), pa.array(sure), pa.array(base), pa.array(lm), tallied(rest, tail), tallied(rare, rares)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "hot_known", "hot_sum", "hot_score", "tail", "rare"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = "array<struct<key: bigint, times: bigint>>"
    first = rows.mapInArrow(run, f"doc_id long, held_out boolean, n_tokens long, hot_known long, hot_sum double, hot_score double, tail {kind}, rare {kind}")
    first = ws.put(first.withColumn("row", F.monotonically_increasing_id()), "first")
    tail = first.select("row", F.inline("tail")).join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("tail_sum"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known")
    )
    per = float(np.log10(total + 0.5 * (kinds + 1)))
    out = first.drop("tail", "rare").join(tail, "row", "left")
    lm = F.col("hot_score")
    if model:
        rare = first.select("row", F.inline("rare"))
        rare = rare.join(model.where(F.col("level") == ORDER).select("key", "logp"), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("logp").cast("double")).alias("rare_sum"))
        out, lm = out.join(rare, "row", "left"), lm + F.coalesce("rare_sum", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hot_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * per).alias("base_score"),
        lm.alias("score"),
    )
