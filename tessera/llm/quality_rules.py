"""Quality rules as a short-circuit cascade (op 6), in DataFrame functions only.

Every rule is a cheap boolean over the base counts or the text.  On a bounded sample each rule's cost (timed)
and selectivity (share rejected) are measured; rules then run in falling order of rejection per cost, inside
one nested CASE, so that a row stops at the first rule that rejects it.  The verdict is a conjunction and does
not depend on the order.

Nulls: a null text has no words, hence base_failed.  Empty texts alike.  Very long texts are judged whole.  Repeated
rows are judged one by one, an empty table gives an empty result, and columns of the input other than the key and the
text are not read.  Rules of one rate run in order of cost, then of name.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
WINDOW = 5
SAMPLE_ROWS = 2000
REPEAT = 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five that occur twice or more; windows compare by 64-bit hash."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    both = lambda a, b: F.xxhash64(a, b)

    def windows(w: Column) -> Column:
        # Words 1-2, then 1-4, then 1-5: what runs past the end is cut off last.
        n = F.size(w)
        fours = let(F.zip_with(w, F.slice(w, 2, n), both), lambda p: F.zip_with(p, F.slice(p, 3, n), both))
        return F.slice(F.zip_with(fours, F.slice(w, 5, n), both), 1, n - 4)

    def covered(s: Column) -> Column:
        """s: (hash, position) in order; a window repeats if a neighbour has its hash."""
        h = F.transform(s, lambda x: x["h"])
        last = F.size(s) - 1
        same = F.concat(F.array(F.lit(False)), F.zip_with(F.slice(h, 1, last), F.slice(h, 2, last), lambda a, b: a == b), F.array(F.lit(False)))
        flags = F.zip_with(F.slice(same, 1, last + 1), F.slice(same, 2, last + 1), lambda a, b: a | b)
        at = F.array_sort(F.array_compact(F.zip_with(s, flags, lambda x, hit: F.when(hit, x["i"]))))
        zero = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum"), i.alias("last"))
        return F.aggregate(at, zero, step, lambda acc: acc["sum"])

    def repeats(h: Column) -> Column:
        # The common case, no window twice, needs the plain hashes alone.
        ordered = F.sort_array(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(let(let(hashed, windows), repeats))


def base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and the base counts of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("doc_id"), whole.alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") == 0, F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def default_rules() -> dict[str, Column]:
    """Name -> condition under which the rule rejects a document of ten words or more."""
    c = F.col
    return {
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "dup_lines": 10 * c("n_dup_lines") > 3 * F.size(F.split("text", "\n")),
        "shouting": 2 * F.length(F.regexp_replace("text", r"[^A-Z]+", "")) > c("word_chars"),
        "bullets": 10 * F.regexp_count("text", F.lit(r"(?md)^[\x20\x09]*[-*•]")) > 9 * F.size(F.split("text", "\n")),
        "letters": 10 * F.regexp_count("text", F.lit(r"\p{L}")) < 7 * c("word_chars"),
    }


def sampled(docs: DataFrame, key: str, sample_rows: int) -> DataFrame:
    """About sample_rows rows spread over the whole table by the hash of their key; all if there are no more."""
    share = docs.count() // max(1, sample_rows)
    return docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0) if share > 1 else docs


def order_rules(rows: DataFrame, rules: Mapping[str, Column], repeat: int = REPEAT) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds a row) by falling rejection per second, measured on the rows, which are few.

    A rule runs ``repeat`` times over the cached rows; what a rule that does nothing takes is no part of its cost.
    """
    # Counted columns are materialised first: a filter pushed below them would compute them again for each use.
    sample = rows.repartition(2).persist()
    again = sample.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(repeat))))
    turn = F.col("_turn") > 0  # ties the rule to the turn, or else it would run once for all turns

    def measured(bad: Column) -> tuple[float, int]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hit = again.where(F.when(turn, bad)).count()
            took.append(time.perf_counter() - began)
        return min(took), hit

    try:
        n = max(1, sample.count())
        idle, _ = measured(F.col("_turn") < 0)
        found = []
        for name, bad in rules.items():
            took, hit = measured(~F.col("base_failed") & bad)
            found.append((name, hit / (n * repeat), max(took - idle, 1e-4) / (n * repeat)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Mapping[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, base counts, base_failed and kept of every row."""
    rules = default_rules() if rules is None else rules
    order = order_rules(base(sampled(docs, key, sample_rows), key, text), rules) if rules else []
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for name, _, _ in order:
        verdict = verdict.when(rules[name], F.lit(name))
    df = base(docs, key, text).withColumn("failed_rule", verdict)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept")
    )


#: DuckDB SQL of op6_quality_rules with the default rules.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t)),
again AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, sum(least(coalesce(nxt - i, 5), 5)) AS n FROM again GROUP BY rid),
base AS (
  SELECT doc_id, text, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN covered USING (rid)),
judged AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 3 * len(l)
       OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars
       OR 10 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) > 9 * len(l)
       OR 10 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 7 * word_chars) AS kept FROM judged
"""
