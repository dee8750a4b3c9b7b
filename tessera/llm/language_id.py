"""Language identification (op 1): multilingual mixture inference by expectation maximisation.

Byte trigrams of the text (A-Z lower-cased, other ASCII characters that aren't letters as spaces) have a
smoothed likelihood in each learned language.  A document is a mixture of languages: EM estimates its
proportions, and a language joins the set of a document only if it raises the likelihood by more than a
penalty that grows with the log of the number of trigrams.

Only text and non-null lang of rows whose crc32(doc_id as text) modulo 5 isn't 0 are learnt from; a null
doc_id counts as held out.  Null text or text without a letter is ``und`` with score 0, as is everything if no
language was learnt.  Repeated rows are judged one by one.  Other columns pass through ``label`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.common import bounded, free_name, mapped, slices

SMOOTH = 0.5
ROUNDS = 12
#: A further language must gain PENALTY * log(trigrams) nats; trigrams overlap threefold, hence more than BIC's 1/2.
PENALTY = 6.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def remainder(key: Column, parts: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % parts


def trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of every text, their counts, and the n + 1 offsets of the texts into them."""
    buf, off = K.flat(col)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    b = np.insert(_FOLD[buf], off, 32)
    at = np.arange(len(buf)) + doc
    x, y, z = b[at], b[at + 1], b[at + 2]
    some = ~((x == 32) & (y == 32) | (y == 32) & (z == 32))
    key = (doc[some] << 24) | (x[some].astype(np.int64) << 16) | (y[some].astype(np.int64) << 8) | z[some]
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    where = np.flatnonzero(first)
    count = np.diff(np.append(where, len(key)))
    key = key[where]
    return key & 0xFFFFFF, count, np.searchsorted(key, np.arange(n + 1) << 24)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # ascending
    p: np.ndarray  # (grams + 1, languages); the last row is of unseen trigrams


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Counts over all training rows; at most 2**24 trigrams for each language reach the driver."""

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            g, c = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            grams, inv = np.unique(g, return_inverse=True)
            return grams, np.bincount(inv, c, len(grams)).astype(np.int64)

        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                grams, counts, off = trigrams(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                of = np.repeat(langs, np.diff(off))
                for name in set(langs):
                    own = of == name
                    parts = held.setdefault(name, [])
                    parts.append((grams[own], counts[own]))
                    if sum(len(g) for g, _ in parts) > 1 << 20:
                        held[name] = [merged(parts)]
        for name, parts in held.items():
            grams, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    bounded(docs.sparkSession)
    rows = docs.where((remainder(F.col(key)) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    got = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    name, gram, n = (np.asarray(got.column(c)) for c in ("lang", "gram", "n"))
    languages = sorted(set(name.tolist()))
    grams = np.unique(gram)
    table = np.zeros((len(grams) + 1, len(languages)))
    for j, language in enumerate(languages):
        own = name == language
        table[np.searchsorted(grams, gram[own]), j] = n[own]
    return Model(languages, grams.astype(np.int64), (table + SMOOTH) / (table.sum(0) + SMOOTH * len(table)))


def _sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def mixture(p: np.ndarray, n: np.ndarray, off: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from the given proportions (documents, languages): new proportions and log-likelihoods; zeros stay zeros."""
    doc, total = np.repeat(np.arange(len(off) - 1), np.diff(off)), np.maximum(_sum(n, off), 1)[:, None]
    pi = start
    for _ in range(ROUNDS):
        r = p * pi[doc]
        r *= (n / np.maximum(r.sum(1), 1e-300))[:, None]
        pi = _sum(r, off) / total
    return pi, _sum(n * np.log(np.maximum((p * pi[doc]).sum(1), 1e-300)), off)


def infer(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents, languages) over the selected set of each text, and the confidence of its top language."""
    grams, count, off = trigrams(col)
    n = count.astype(np.float64)
    at = np.minimum(np.searchsorted(model.grams, grams), max(0, len(model.grams) - 1))
    p = model.p[np.where(model.grams[at] == grams, at, len(model.grams))]
    docs, langs = len(off) - 1, len(model.languages)
    single = _sum(n[:, None] * np.log(p), off)
    best = single.argmax(1)
    pi = np.zeros((docs, langs))
    pi[np.arange(docs), best] = 1
    # Confidence among single languages, tempered for the threefold overlap of trigrams.
    tempered = np.exp((single - single.max(1, keepdims=True)) / 3)
    sure = tempered.max(1) / tempered.sum(1)
    total = _sum(n, off)
    price = PENALTY * np.log(np.maximum(total, 2))
    at_best = single.max(1)
    _, full = mixture(p, n, off, np.full((docs, langs), 1 / langs))
    # All languages together bound what any set can gain.
    todo = np.flatnonzero(full - at_best > price)
    for i in todo:
        a, b = off[i], off[i + 1]
        own, m, o = p[a:b], n[a:b], np.array([0, b - a])
        chosen, level, share = [int(best[i])], at_best[i], pi[i]
        while len(chosen) < langs:
            tries = []
            for j in range(langs):
                if j not in chosen:
                    start = np.zeros((1, langs))
                    start[0, [*chosen, j]] = 1 / (len(chosen) + 1)
                    got, ll = mixture(own, m, o, start)
                    tries.append((ll[0], j, got[0]))
            ll, j, got = max(tries, key=lambda x: (x[0], -x[1]))
            if ll - level <= price[i]:
                break
            chosen, level, share = [*chosen, j], ll, got
        pi[i] = share
    return pi, np.where(pi.max(1) < 1, 1.0, sure)


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_mix (language -> proportion) added last, renamed if they clash."""
    added = [free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_mix")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        col = pc.fill_null(batch.column(text), "")
        letters = np.asarray(pc.match_substring_regex(col, r"\p{L}"))
        pred, score, mix = ["und"] * len(col), np.zeros(len(col)), [[] for _ in range(len(col))]
        if known.languages and letters.any():
            pi, sure = infer(known, col)
            for i in np.flatnonzero(letters):
                j = int(pi[i].argmax())
                pred[i], score[i] = known.languages[j], min(1.0, max(0.0, float(pi[i, j] * sure[i])))
                mix[i] = [(known.languages[k], float(pi[i, k])) for k in np.flatnonzero(pi[i] > 0)]
        kind = pa.map_(pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(mix, kind)], [*names, *added])

    schema = T.StructType(list(docs.schema.fields)).add(added[0], "string").add(added[1], "double").add(added[2], T.MapType(T.StringType(), T.DoubleType()))
    return mapped(docs, names, text, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of every row."""
    model = learn(docs)
    rows = docs.select("doc_id", (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "text")
    return label(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_mix")
