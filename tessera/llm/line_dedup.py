"""Line deduplication (op 4): explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys compare by a 128-bit
hash.  Keys of ``min_chars`` code points or more that ``threshold`` documents or more hold are dropped from all
documents but the smallest doc_id holding them.

Null or empty text is one empty line.  A row whose doc_id is null neither counts as a document nor loses a line.
Rows that share a doc_id are one document for counting and are each filtered alike, so no ties arise between them.
Very long texts are split whole; a key may be as long as its text.  An empty table gives an empty result.  Other
columns pass through; added ones are renamed if their names clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import Workspace, free_name, ints, mapped

MIN_CHARS = 10
THRESHOLD = 2


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (without the line feed) and the n + 1 offsets of the texts into them."""
    feeds = np.flatnonzero(buf == 10)
    text_of = np.searchsorted(off, feeds, "right") - 1
    at = np.concatenate(([0], np.cumsum(np.bincount(text_of, minlength=len(off) - 1) + 1)))
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    ends = np.empty(at[-1], np.int64)
    ends[last], ends[~last] = off[1:], feeds
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[at[:-1]] = off[:-1]
    return starts, ends, at


def trimmed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at both ends; a blank span is empty."""
    solid = np.flatnonzero(~K.SPACE[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    first = np.where(some, solid[np.minimum(a, max(0, len(solid) - 1))] if len(solid) else 0, starts)
    last = np.where(some, (solid[np.maximum(b - 1, 0)] if len(solid) else 0) + 1, starts)
    return first, last


def keyed_lines(col: pa.Array, min_chars: int):
    """Buffer, offsets, line spans and offsets, two hashes of each line's key, and whether the key is long enough."""
    buf, off = K.flat(col)
    starts, ends, at = line_spans(buf, off)
    a, b = trimmed(buf, starts, ends)
    return buf, off, starts, ends, at, K.span_hash(buf, a, b), K.span_hash(buf, a, b, 1), K.code_points(buf, a, b) >= min_chars


def line_keys(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """One row for each line of a document whose key is long enough: doc_id, h1, h2."""

    def run(batch):
        _, _, _, _, at, h1, h2, wide = keyed_lines(batch.column(1), min_chars)
        doc = np.repeat(ints(batch, "doc_id"), np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(doc[wide]), pa.array(h1[wide].view(np.int64)), pa.array(h2[wide].view(np.int64))], ["doc_id", "h1", "h2"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, ["doc_id", "text"], "text", run, "doc_id long, h1 long, h2 long")


def dropped_keys(docs: DataFrame, ws: Workspace, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and the array of (h1, h2) keys whose lines that document loses."""
    keys = ws.put(line_keys(docs, key, text, min_chars).distinct(), "keys")
    common = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where(F.col("n") >= threshold)
    # Written, so that both sides of the join are plain exchanges and a hot line's rows can be split.
    common = ws.put(common.select("h1", "h2", "first"), "common")
    lost = keys.join(common, ["h1", "h2"]).where(F.col("doc_id") != F.col("first"))
    lost = ws.put(lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")), "lost")
    ws.only("lost")
    return lost


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, threshold: int = THRESHOLD, name: str = "lines") -> DataFrame:
    """docs with ``text`` reassembled and n_lines, n_dropped, kept_sha256 added last, renamed if they clash."""
    added = [free_name(docs, c) for c in ("n_lines", "n_dropped", "kept_sha256")]
    lost_name, key_name = free_name(docs, "_lost"), free_name(docs, "_key")
    ws = Workspace(docs.sparkSession, name)
    lost = dropped_keys(docs, ws, key, text, min_chars, threshold)
    marked = docs.withColumn(key_name, F.col(key).cast("long")).join(lost.select(F.col("doc_id").alias(key_name), F.col("lost").alias(lost_name)), key_name, "left")

    names = docs.columns

    def reassemble(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off, starts, ends, at, h1, h2, wide = keyed_lines(batch.column(text), min_chars)
        keep = np.ones(len(starts), bool)
        col = batch.column(lost_name)
        for i in np.flatnonzero(np.asarray(col.is_valid())):
            gone = col[int(i)].values
            gone = set(zip(gone.field("h1").to_pylist(), gone.field("h2").to_pylist()))
            for j in range(at[i], at[i + 1]):
                if wide[j] and (int(h1[j].view(np.int64)), int(h2[j].view(np.int64))) in gone:
                    keep[j] = False
        n, left = np.diff(at), K.segment_sum(keep.astype(np.int64), at)
        raw, texts = buf.tobytes(), []
        for i in range(len(n)):
            if left[i] == n[i]:
                texts.append(raw[off[i] : off[i + 1]])
            else:
                texts.append(b"\n".join([raw[starts[j] : ends[j]] for j in range(at[i], at[i + 1]) if keep[j]]))
        shas = [hashlib.sha256(x).hexdigest() for x in texts]
        text_out = pa.array(texts, pa.binary()).cast(pa.string())
        cols = [text_out if c == text else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(n - left), pa.array(shas)], [*names, *added])

    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in docs.columns]).schema
    schema = schema.add(added[0], "long").add(added[1], "long").add(added[2], "string")
    return mapped(marked, [*docs.columns, lost_name], text, reassemble, schema)


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).drop("text")


#: DuckDB SQL of op4_line_dedup.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(l, i) AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, (bad.k IS NOT NULL AND doc_id <> bad.first) AS gone FROM keyed LEFT JOIN bad ON keyed.k = bad.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
