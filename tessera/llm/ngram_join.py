"""N-gram Jaccard join (op 3): adaptive multi-match prefixes over sets of five-word shingles.

Exact copies (equal sets) are one representative, its smallest doc_id.  Shingles have one global order, rarest
first by a hashed count table over all representatives.  A set of n shingles that is to overlap another by
o = ceil(3n / 4) shares at least l shingles of its first n - o + l with any partner: each document picks its l by
the estimated cost of scanning those lists and verifying what they propose, and a pair must share min(l, l')
prefix shingles before it is verified on the whole sets.

Only components are asked for, so links that are implied need no verification.  Prefix shingles that are in no
other prefix bound what two documents can share, which rules out most pairs.  Each list then proposes its members
to its most central one; last, for lists that still hold several components, every pair across components that
shares enough and can overlap enough is verified: a pair that meets inside its own shortest prefix is one row,
on which the prefixes of both are compared.  No link between different texts is lost, and a group of n near
copies costs about n verifications, not their square.  Hot shingles' lists are cut into parts of about ``SPLIT``
documents by the count table before they are sorted.

Nulls: a null or wordless text has an empty set and is linked with nothing; a row with a null doc_id keeps its
n_shingles, has a null component_id and links nothing.  Rows sharing a doc_id are one node with several sets.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import Workspace, ints, mapped, slices, small
from tessera.llm.components import connected

SHINGLE = 5
BUCKETS = 1 << 20
CHUNK = 1 << 14
MOST = 4  # largest l
VERIFY = 8.0  # cost of verifying a candidate, in list entries
SPLIT = 4096
SALTS = 4096, 64


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit signature of the set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, off, _ = K.shingles(batch.column("text"), SHINGLE)
        s1 = K.segment_sum(K.mix(h ^ np.uint64(0x51ED270B7A3D1E95)), off)
        s2 = K.segment_sum(K.mix(h + np.uint64(0xA0761D6478BD642F)), off)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], ["doc_id", "n_shingles", "s1", "s2"])

    return mapped(docs, ["doc_id", "text"], "text", run, "doc_id long, n_shingles long, s1 long, s2 long")


def frequencies(docs: DataFrame) -> np.ndarray:
    """Shingle counts by hash bucket over all given texts; its size is fixed."""

    def tally(batches):
        from pyspark import TaskContext

        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in slices(batch, "text"):
                h, _, _ = K.shingles(batch.column("text").slice(a, b - a), SHINGLE)
                seen += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        salt = TaskContext.get().partitionId() % SALTS[0]
        for k, part in enumerate(seen.reshape(-1, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([salt]), pa.array([part.tobytes()], pa.binary())], ["chunk", "salt", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for raw in table.column("n"):
            total += np.frombuffer(raw.as_buffer(), np.int64)
        return pa.table({"chunk": table.column("chunk")[:1], "salt": table.column("salt")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    kind = "chunk long, salt long, n binary"
    parts = docs.select("text").mapInArrow(tally, kind)
    for salts in SALTS:  # a group of the first level sums a few tasks' counts, one of a later level 64 sums at most
        parts = parts.withColumn("salt", F.col("salt") % salts).groupBy("chunk", "salt").applyInArrow(add, kind)
    out = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for row in parts.groupBy("chunk").applyInArrow(add, kind).collect():  # BUCKETS numbers in all
        out[row["chunk"]] = np.frombuffer(row["n"], np.int64)
    return out.ravel()


def postings(docs: DataFrame, seen: np.ndarray) -> DataFrame:
    """token, salt, id and meta (n << 35 | place in the order << 7 | l) of every prefix shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    noise = float(seen.sum()) / BUCKETS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, off, _ = K.shingles(batch.column("text"), SHINGLE)
        n = np.diff(off)
        doc = np.repeat(np.arange(len(n)), n)
        d = shared.value[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]
        order = np.argsort((doc << 40) | np.minimum(d, (1 << 40) - 1), kind="stable")  # shingles of a text come sorted by hash
        h, d = h[order], d[order]
        cost = np.concatenate(([0.0], np.cumsum(np.maximum(1.0, d - noise))))
        need = -(-3 * n // 4)
        best, ell = np.full(len(n), np.inf), np.ones(len(n), np.int64)
        for k in range(1, MOST + 1):
            fits = (k <= need) & (n > 0)
            scan = cost[np.where(fits, off[:-1] + n - need + k, off[:-1])] - cost[off[:-1]]
            total = scan * (1 + VERIFY / k)
            better = fits & (total < best)
            best, ell = np.where(better, total, best), np.where(better, k, ell)
        size = np.where(n > 0, n - need + ell, 0)
        of = np.repeat(np.arange(len(n)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = off[of] + place
        ids = ints(batch, "doc_id")[of]
        parts = np.maximum(1, (np.maximum(1.0, d[at] - noise) / SPLIT).astype(np.int64) + 1)
        salt = np.where(parts > 1, (K.mix(ids.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64) + 1, 0)
        meta = (n[of].astype(np.int64) << 35) | (place << 7) | ell[of]
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids), pa.array(meta)], ["token", "salt", "id", "meta"])

    return mapped(docs, ["doc_id", "text"], "text", run, "token long, salt int, id long, meta long")


def lists(posts: DataFrame, n: int) -> DataFrame:
    """token, id and meta of the entries of lists with two members or more, or cut into parts."""

    def run(batches):
        held = None  # token, salt, id, meta of the last entry so far; waits: it was not given out yet
        waits = False
        for batch in batches:
            token, salt, id_, meta = (np.asarray(batch.column(k)).astype(np.int64) for k in ("token", "salt", "id", "meta"))
            if not len(token):
                continue
            if held is not None:
                token, salt, id_, meta = (np.concatenate(([x], y)) for x, y in zip(held, (token, salt, id_, meta)))
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            out = salt > 0
            out[1:] |= same
            out[:-1] |= same
            if held is not None and not waits:
                out[0] = False
            waits = not out[-1] and not (len(token) == 1 and held is not None and not waits)
            held = (token[-1], salt[-1], id_[-1], meta[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (token, id_, meta)], ["token", "id", "meta"])

    ordered = posts.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", "id")
    return ordered.mapInArrow(run, "token long, id long, meta long")


def size_of(meta: str):
    return F.shiftright(F.col(meta), 35)


def match_of(meta: str):
    return F.col(meta).bitwiseAND(F.lit(127))


def verified(pairs: DataFrame, docs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The (a, b) among written pairs whose whole sets have a Jaccard similarity of 3/4 or more, written."""
    wanted = ws.put(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, off, _ = K.shingles(batch.column("text"), SHINGLE)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))], ["id", "set"])

    sets = ws.put(mapped(docs.join(small(wanted, 16), "doc_id", "left_semi"), ["doc_id", "text"], "text", run, "id long, set array<long>"), f"{name}-sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    good = both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("n")).where(100 * F.col("i") >= 75 * (F.col("n") - F.col("i")))
    good = ws.put(good.select("a", "b").distinct(), f"{name}-good")
    ws.drop(f"{name}-sets")
    return good


def enough(met: DataFrame, rows: DataFrame, ws: Workspace) -> DataFrame:
    """The (a, b) among written pairs that share as many shingles of their own prefixes as their l asks for.

    Each document's prefix is one row, so a pair is one row too, however many shingles it shares.
    """
    wanted = ws.put(met.select(F.col("a").alias("wanted")).union(met.select("b")).distinct(), "met-ids")
    entry = F.struct("token", "left")
    prefix = rows.join(small(wanted, 16), F.col("id") == F.col("wanted")).groupBy("id", "n", "l", "u").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    prefix = ws.put(prefix, "prefixes")
    side = lambda s: prefix.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "l", "u", "p")])
    both = met.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            n, l, u = ([np.asarray(batch.column(f"{c}{s}")) for s in "ab"] for c in "nlu")
            off = [np.asarray(batch.column(f"p{s}").offsets) for s in "ab"]
            token, left = ([np.asarray(batch.column(f"p{s}").values.field(c)) for s in "ab"] for c in ("token", "left"))
            keep = np.zeros(batch.num_rows, bool)
            total, least = n[0] + n[1], np.minimum(*l)
            sized = (4 * np.minimum(*n) >= 3 * np.maximum(*n)) & (7 * np.maximum(*u) >= 3 * total)
            for i in np.flatnonzero(sized):
                at = [slice(off[k][i], off[k][i + 1]) for k in (0, 1)]
                _, x, y = np.intersect1d(token[0][at[0]], token[1][at[1]], assume_unique=True, return_indices=True)
                rest = np.minimum(left[0][at[0]][x], left[1][at[1]][y])
                inside = 7 * (rest + least[i] - 1) >= 3 * total[i]
                # From the first shared shingle on, the shorter rest bounds the overlap.
                keep[i] = inside.sum() >= least[i] and 7 * rest[inside].max() >= 3 * total[i]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    columns = ["a", "b", *[f"{c}{s}" for s in "ab" for c in ("n", "l", "u", "p")]]
    return both.select(*columns).mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig = ws.put(signatures(docs), "sig")
    some = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = ws.put(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    # Ids all of whose sets have a smaller holder; the others' texts stand for their classes.
    reps = ws.put(classes.select("rep").distinct(), "reps")
    copies = some.select("doc_id").distinct().join(small(reps, 16), F.col("doc_id") == F.col("rep"), "left_anti")
    copies = ws.put(copies, "copies")
    own = docs.where("doc_id IS NOT NULL").join(small(copies, 16), "doc_id", "left_anti")

    shared = ws.put(lists(postings(own, frequencies(own)), n), "lists")
    # Of two documents, take the one whose prefix ends first in the order: what it shares with the other of its
    # prefix is in the other's prefix too, hence in a list.  So its u, its size without prefix shingles that are in
    # no list, bounds the overlap; which of the two it is isn't kept, so the larger u has to do.
    sizes = shared.groupBy("id", size_of("meta").alias("n"), match_of("meta").alias("l")).agg(F.count(F.lit(1)).alias("held"))
    prefix = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + F.col("l")
    sizes = sizes.select("id", "n", "l", (F.col("n") - F.greatest(F.lit(0), prefix - F.col("held"))).cast("long").alias("u"))
    sizes = ws.put(sizes, "sizes")
    live = shared.withColumns({"n": size_of("meta"), "l": match_of("meta"), "place": F.shiftright("meta", 7).bitwiseAND(F.lit((1 << 28) - 1))})
    live = ws.put(live.join(small(sizes, 32), ["id", "n", "l"]).select("token", "id", "n", "l", "u", (F.col("n") - F.col("place")).alias("left")), "live")
    ws.drop("lists")

    def possible(a: str, b: str):
        """Sizes near enough, enough shingles that can be shared, and the shared one inside the pair's own prefixes.

        A linked pair overlaps by o, 3/7 of the sum of sizes or more, so it shares min(l, l') shingles of its first
        n - o + min(l, l'), which for sizes alike is a seventh of the set rather than a quarter.
        """
        na, nb, ua, ub, la, lb, lefta, leftb = (F.col(x + y) for x in ("n", "u", "l", "left") for y in (a, b))
        inside = 7 * (F.least(lefta, leftb) + F.least(la, lb) - 1) >= 3 * (na + nb)
        return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (7 * F.greatest(ua, ub) >= 3 * (na + nb)) & inside

    # Stars: each list's members against its most central one, the one with the least share of shingles of its own.
    hub = F.struct(F.floor(1000 * (F.col("n") - F.col("u")) / F.col("n")).alias("own"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("l").alias("la"), F.col("left").alias("lefta"))
    hubs = ws.put(live.groupBy("token").agg(F.min(hub).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", "hub.*"), "hubs")
    star = live.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("l").alias("lb"), F.col("left").alias("leftb")).join(hubs, "token").where((F.col("a") != F.col("b")) & possible("a", "b"))
    star = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(F.least("la", "lb")).alias("l"))
    star = ws.put(star.where("c >= l").select("a", "b"), "star")
    first = connected(verified(star, own, ws, "star"), ws, "first")

    # Across: of lists that still hold several components, every pair across them that shares enough.
    first = ws.put(first, "roots")
    known = ws.put(live.join(small(first, 16), F.col("id") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "id")).drop("node", "root"), "known")
    ws.drop("live")
    mixed = known.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"))
    mixed = ws.put(mixed.where("k > 1").select("token", "top"), "mixed")
    rows = ws.put(known.join(small(mixed, 16), "token"), "across")
    x = rows.where("comp <> top").select("token", *[F.col(c).alias(f"{c}a") for c in ("comp", "id", "n", "l", "u", "left")])
    y = rows.select("token", "top", *[F.col(c).alias(f"{c}b") for c in ("comp", "id", "n", "l", "u", "left")])
    once = (F.col("compa") != F.col("compb")) & ((F.col("compb") == F.col("top")) | (F.col("compa") < F.col("compb")))
    # A linked pair meets in the part of its prefixes that a single match needs; few pairs do, and for these the
    # shared shingles of the longer parts are counted.
    soon = 7 * F.least("lefta", "leftb") >= 3 * (F.col("na") + F.col("nb"))
    met = x.join(y, (x["token"] == y["token"]) & once & possible("a", "b") & soon)
    met = ws.put(met.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct(), "met")
    pairs = ws.put(enough(met, rows, ws), "pairs")
    more = verified(pairs, own, ws, "across")
    # An id with several sets is one node, so it links the classes of all of them.
    shape = F.struct("s1", "s2", "n_shingles")
    several = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(shape).alias("x"), F.max(shape).alias("y")).where("x <> y").select("doc_id")
    several = ws.put(several, "several")
    held = ws.put(some.join(small(several, 8), "doc_id", "left_semi").join(classes, ["s1", "s2"]).select("doc_id", "rep").distinct(), "held")
    ends = ws.put(held.groupBy("doc_id").agg(F.min("rep").alias("least")), "ends")
    ties = ws.put(held.join(small(ends, 16), "doc_id").where("least <> rep").select("least", "rep").distinct(), "ties")
    more = more.union(ties)
    if more.isEmpty():
        roots = first
    else:
        roots = ws.put(connected(more.union(first.select("node", "root")), ws, "second"), "final")

    ws.only("sig", "classes", "ends", "roots", "final")
    out = sig.join(small(classes, 40).withColumnsRenamed({"s1": "t1", "s2": "t2"}), (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    out = out.join(small(ends.withColumnRenamed("doc_id", "id"), 16), F.col("doc_id") == F.col("id"), "left").withColumn("rep", F.coalesce("least", "rep"))
    out = out.join(small(roots, 16), F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))


#: DuckDB SQL of op3_ngram_join.
ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM texts),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
hot AS (SELECT g FROM items GROUP BY g HAVING count(*) > 1),
kept AS (SELECT items.* FROM items SEMI JOIN hot ON items.g = hot.g),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM kept a JOIN kept b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
