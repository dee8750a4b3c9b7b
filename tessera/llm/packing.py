"""Packing (op 5): optimal length buckets over the global histogram, token-budget batches inside each bucket.

A length is the number of the tokenizer's ids of the whole text, the end id included.  A dynamic programme over the exact histogram of
lengths picks at most ``n_buckets`` boundaries that minimise padding, each document being padded to its
bucket's boundary.  A bucket of boundary L holds batches of max(1, budget // L) documents in order of
(length, doc_id); no document is cut or dropped, one longer than the budget is a batch of its own.

Null and empty texts have length 1 (the end mark).  Null doc_ids sort first; ties and repeated rows each get a
place of their own.  Very long texts are counted whole.  An empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import token_output
from tessera.llm.common import Workspace, mapped

BUCKETS = 12
TOKEN_BUDGET = 16384


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and length of each row, by the tokenizer file at the path."""
    path = path or token_output.vocabulary()

    def run(batch):
        known = token_output.encoder(path)
        size = pc.divide(pc.binary_length(known.encode(batch.column("text"))), known.width)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), size.cast(pa.int64())], ["doc_id", "length"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, ["doc_id", "text"], "text", run, "doc_id long, length long")


def boundaries(length: np.ndarray, count: np.ndarray, n_buckets: int) -> list[int]:
    """At most n_buckets of the given ascending lengths, the last included, with least total padding.

    The padding of a bucket that ends at j and starts after i obeys the quadrangle inequality, so the best
    split moves one way as j grows and each layer is solved by divide and conquer: O(buckets * D * log D).
    """
    d = len(length)
    if not d:
        return []
    length, count = length.astype(np.float64), count.astype(np.float64)
    docs, tokens = np.concatenate(([0.0], np.cumsum(count))), np.concatenate(([0.0], np.cumsum(count * length)))

    def cost(i, j):  # lengths i..j-1 padded to length[j-1]
        return length[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i])

    best = np.concatenate(([0.0], cost(0, np.arange(1, d + 1))))
    cuts = []
    for _ in range(min(n_buckets, d) - 1):
        new, cut = best.copy(), np.zeros(d + 1, np.int64)
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            new[j], cut[j] = total[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        best = new
    out, j = [], d
    for cut in reversed(cuts):
        out.append(int(length[j - 1]))
        j = int(cut[j])
        if not j:
            break
    if j:
        out.append(int(length[j - 1]))
    return sorted(set(out))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", n_buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, path: str | None = None) -> DataFrame:
    """doc_id, length, bucket_length, batch (from 0 in each bucket), slot (from 0 in each batch)."""
    ws = Workspace(docs.sparkSession, "packing")
    sized = ws.put(lengths(docs, key, text, path), "lengths")
    # One row for each distinct length: D of them take D * (D + 1) / 2 ids of corpus at least.
    histogram = sorted((r["length"], r["count"]) for r in sized.groupBy("length").count().collect())
    ends = boundaries(np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), n_buckets)
    if not ends:
        return sized.select("doc_id", "length", F.lit(0).cast("long").alias("bucket_length"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
    # Ordered over the cluster, ranked inside each partition, then shifted by what earlier partitions hold.
    ordered = sized.withColumn("bucket_length", bucket.cast("long")).repartitionByRange(n, "length", "doc_id").sortWithinPartitions("length", "doc_id")

    def rank(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            of = np.asarray(batch.column("bucket_length"))
            place = np.empty(len(of), np.int64)
            for b in np.unique(of):
                at = np.flatnonzero(of == b)
                place[at] = seen.get(b, 0) + np.arange(len(at))
                seen[b] = seen.get(b, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(of), part, np.int64)), pa.array(place)], [*batch.schema.names, "part", "place"])

    ranked = ws.put(ordered.mapInArrow(rank, "doc_id long, length long, bucket_length long, part long, place long"), "ranked")
    ws.only("ranked")
    shifts, total = [], {}
    for r in sorted(ranked.groupBy("part", "bucket_length").count().collect()):  # at most partitions + buckets rows
        shifts.append((r["part"], r["bucket_length"], total.get(r["bucket_length"], 0)))
        total[r["bucket_length"]] = total.get(r["bucket_length"], 0) + r["count"]
    shift = docs.sparkSession.createDataFrame(shifts, "part long, bucket_length long, shift long")
    rows = ranked.join(F.broadcast(shift), ["part", "bucket_length"])
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_length"))).cast("long")
    place = F.col("place") + F.col("shift")
    return rows.select("doc_id", "length", "bucket_length", F.floor(place / per).cast("long").alias("batch"), (place % per).alias("slot"))
