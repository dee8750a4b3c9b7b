"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on texts of every kind."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import common, decontaminate, html_text, kernels, language_id, line_dedup, lm_scoring, ngram_join, packing, pii, quality_rules, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
words = lambda t: WORD.findall(low(t))
rows_of = lambda df: [r.asDict() for r in df.collect()]


def by_text(corpus):
    return [(r.doc_id, r.text, r.lang) for r in corpus.collect()]


def test_kernels_see_words_and_shingles(corpus):
    texts = [t for _, t, _ in by_text(corpus)]
    buf, off = kernels.flat(pa.array(texts))
    starts, ends, at = kernels.word_spans(buf, off)
    raw = buf.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]
    h, off, n = kernels.shingles(pa.array(texts))
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(words, texts)]
    assert np.diff(off).tolist() == [len(s) for s in want] and n.tolist() == [len(words(t)) for t in texts]
    seen = {}
    for i, s in enumerate(want):
        assert len(set(h[off[i] : off[i + 1]].tolist())) == len(s)
        key = frozenset(s)
        assert seen.setdefault(key, frozenset(h[off[i] : off[i + 1]].tolist())) == frozenset(h[off[i] : off[i + 1]].tolist())


def test_language_id(corpus, empty, spark):
    got = rows_of(language_id.identify(corpus))
    assert len(got) == corpus.count() and {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"}
    lang = {d: (t, x) for d, t, x in by_text(corpus)}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] not in (5, 401):
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in lang[r["doc_id"]][0] or ""))
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 100]
    assert len(held) > 8 and all(r["lang_pred"] == lang[r["doc_id"]][1] for r in held)
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in rows_of(language_id.identify(corpus.selectExpr("doc_id", "text", "cast(null as string) lang")))} == {"und"}
    named = language_id.label(corpus, language_id.learn(corpus))
    assert named.columns[:8] == corpus.columns and named.columns[8] == "_lang_pred" and named.count() == corpus.count()


def test_mixtures_are_seen(corpus):
    model = language_id.learn(corpus)
    text = {x: " ".join(t for _, t, lang in by_text(corpus) if lang == x and t)[:4000] for x in ("en", "de")}
    pi, _ = language_id.infer(model, pa.array([text["en"] + text["de"], text["en"]]))
    assert (pi > 0.25).sum(1).tolist() == [2, 1] and abs(pi.sum(1) - 1).max() < 1e-9


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    p, n, off = rng.random((50, 3)) + 1e-3, rng.integers(1, 9, 50).astype(float), np.array([0, 20, 20, 50])
    rounds, last = language_id.ROUNDS, None
    try:
        for k in range(1, 8):
            language_id.ROUNDS = k
            _, ll = language_id.mixture(p, n, off, np.full((3, 3), 1 / 3))
            assert last is None or (ll >= last - 1e-9).all()
            last = ll
    finally:
        language_id.ROUNDS = rounds


def plain_mixture(model, text):
    """Proportions by loops: trigrams of the folded text, expectation maximisation, one language more while it pays."""
    b = [32, *[c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()], 32]
    grams = Counter(b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2) if not (b[i + 1] == 32 and 32 in (b[i], b[i + 2])))
    row = {int(g): i for i, g in enumerate(model.grams)}
    p = {g: model.p[row.get(g, len(model.grams))] for g in grams}
    total = sum(grams.values())

    def fitted(some):
        pi = {j: 1 / len(some) for j in some}
        for _ in range(language_id.ROUNDS):
            new = dict.fromkeys(some, 0.0)
            for g, n in grams.items():
                whole = sum(pi[j] * p[g][j] for j in some)
                for j in some:
                    new[j] += n * pi[j] * p[g][j] / whole
            pi = {j: x / total for j, x in new.items()}
        return pi, sum(n * math.log(sum(pi[j] * p[g][j] for j in some)) for g, n in grams.items())

    langs = range(len(model.languages))
    pi, level = max((fitted([j]) for j in langs), key=lambda x: x[1])
    while len(pi) < len(langs):
        more, ll = max((fitted([*pi, j]) for j in langs if j not in pi), key=lambda x: x[1])
        if ll - level <= language_id.PENALTY * math.log(max(total, 2)):
            break
        pi, level = more, ll
    return pi


def test_language_mixtures_against_loops(corpus):
    model = language_id.learn(corpus)
    texts = [t for _, t, _ in by_text(corpus) if t and len(t) < 900 and any(c.isalpha() for c in t)][::6]
    texts += [texts[k] + " " + texts[k + 1] + " " + texts[k + 2] for k in range(0, 9, 2)]
    got, _ = language_id.infer(model, pa.array(texts))
    for pi, t in zip(got, texts):
        want = plain_mixture(model, t)
        assert all(abs(pi[j] - want.get(j, 0.0)) < 1e-6 for j in range(len(pi))), t[:60]


TOKENS = ["<|endoftext|>x a<|startoftext|>", "it's we'll 12,34 a,b. .. ,", "İstanbul DŽ ﬁ q́w", "क़ खि", "don't,", "THE the The,"]


def test_tokens_round_trip(corpus, spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = corpus.unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(TOKENS)], "doc_id long, text string"), allowMissingColumns=True)
    want = [(d, np.array([*reference.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for d, t, _ in by_text(docs)]
    got = sorted(rows_of(token_output.round_trip(docs)), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_output.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,lanes,check", [(1, 8, 4), (15, 8, 4), (1000, 8, 16), (1003, 7, 16), (5000, 64, 8)])
def test_coder(n, lanes, check):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.4, n), 60000).astype(np.uint32)
    kinds, count = np.unique(ids, return_counts=True)
    freqs = token_output.quantised(count.astype(float))
    assert freqs.sum() == 1 << token_output.PROB and freqs.min() >= 1
    table = token_output.Table(kinds.astype(np.int64), freqs)
    data = token_output.encode(ids, table, lanes, check)
    assert (token_output.decode(data, table) == ids).all()
    marks = token_output.HEAD.unpack_from(data)[6]
    assert (np.concatenate([token_output.decode(data, table, k) for k in range(marks + 1)]) == ids).all()
    for i in (token_output.HEAD.size, len(data) - 1):
        damaged = bytearray(data)
        damaged[i] ^= 1
        with pytest.raises(ValueError):
            token_output.decode(bytes(damaged), table)


def components(texts):
    """doc ids -> smallest reachable id, by comparing all pairs."""
    sets = [(d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for d, t in texts]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            k = len(s & t)
            if k and 100 * k >= 75 * (len(s) + len(t) - k):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return Counter((d, len(s), find(d)) for d, s in sets)


def test_ngram_join(corpus, empty):
    got = rows_of(ngram_join.components(corpus))
    want = components([(d, t) for d, t, _ in by_text(corpus) if d is not None])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.components(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_near_the_threshold(spark, seed, monkeypatch):
    """Chains of edits: links that only hold step by step, hot lists cut into parts, sizes of one word and up."""
    monkeypatch.setattr(ngram_join, "SPLIT", 3)
    rng, texts = random.Random(seed), []
    for k in range(6):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 40))]
        for _ in range(14):
            texts.append((len(texts), " ".join(w)))
            if rng.random() < 0.8:
                w = list(w)
                i = rng.randrange(len(w))
                w[i : i + 1] = [f"w{rng.randrange(60)}"] * rng.randint(0 if len(w) > 1 else 1, 2)
    rng.shuffle(texts)
    got = rows_of(ngram_join.components(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(texts)


def test_ngram_join_ids_with_several_texts(spark):
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(12))
    rows = [(1, text(1)), (2, text(2)), (9, text(1)), (9, text(2)), (9, ""), (3, text(3)), (8, text(3)), (8, ""), (4, text(4)), (7, ""), (7, " ")]
    got = rows_of(ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4), (7, 7), (7, 7), (8, 3), (8, 3), (9, 1), (9, 1), (9, 1)]


def test_line_dedup(corpus, empty):
    texts = [(d, t) for d, t, _ in by_text(corpus)]
    key = lambda line: low(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for d, t in texts:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    want = Counter()
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders[key(x)]) < 2 or d == min(holders[key(x)])]
        want[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = rows_of(line_dedup.op4_line_dedup(corpus))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got) == want
    assert line_dedup.op4_line_dedup(empty).count() == 0
    full = line_dedup.dedup_lines(corpus)
    assert full.columns[:8] == corpus.columns and full.columns[8] == "_n_lines"


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 30))]
        kinds = sorted(Counter(lengths).items())
        for n in (1, 2, 3, 4):
            got = packing.boundaries(np.array([k for k, _ in kinds]), np.array([c for _, c in kinds]), n)
            best = min(padding(lengths, [*c, kinds[-1][0]]) for m in range(min(n, len(kinds))) for c in combinations([k for k, _ in kinds[:-1]], m))
            assert len(got) <= n and padding(lengths, got) == best


@pytest.mark.parametrize("buckets,budget", [(4, 64), (1, 5), (9, 4000)])
def test_packing(corpus, empty, buckets, budget):
    """The whole operator against sorting and counting on the driver, token lengths included."""
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(token_output.vocabulary())
    size = lambda t: len(reference.encode(t or "", add_special_tokens=False).ids) + 1
    sized = sorted(((size(t), d is not None, d or 0) for d, t, _ in by_text(corpus)))
    kinds = sorted(Counter(n for n, *_ in sized).items())
    ends = packing.boundaries(np.array([k for k, _ in kinds]), np.array([c for _, c in kinds]), buckets)
    want, seen = Counter(), Counter()
    for n, some, d in sized:
        end = min(e for e in ends if e >= n)
        per = max(1, budget // end)
        want[d if some else None, n, end, seen[end] // per, seen[end] % per] += 1
        seen[end] += 1
    got = rows_of(packing.pack(corpus, n_buckets=buckets, budget=budget))
    assert Counter((r["doc_id"], r["length"], r["bucket_length"], r["batch"], r["slot"]) for r in got) == want
    assert packing.pack(empty).count() == 0


def test_short_and_unspaced_items(spark):
    """Items of a few words match as they stand only; characters of scripts without spaces are words."""
    bench = [(1, "Call me, Ishmael"), (2, "yes"), (3, "吾輩は猫である。名前はまだ無い"), (4, "call me"), (5, "!!"), (2, "yes")]
    texts = [(1, "They CALL ME ishmael."), (2, "call my Ishmael yesterday"), (3, "x 吾輩は猫である、名前はまた無い y"), (4, "吾輩は犬だ"), (5, "call"), (6, "me call - me yes"), (7, None), (8, "")]
    got = rows_of(decontaminate.report(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert {r["doc_id"]: r["item_ids"] for r in got} == {1: "1,4", 2: "", 3: "3", 4: "", 5: "", 6: "2,4", 7: "", 8: ""}


def test_quality_rules(corpus, empty, spark):
    extra = spark.createDataFrame([(800, "a b c d e f " * 9), (801, "w " * 12), (802, "## $$ %% && " * 8), (803, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)))], "doc_id long, text string")
    docs = corpus.unionByName(extra, allowMissingColumns=True)
    want = Counter()
    for d, t, _ in by_text(docs):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    frame = quality_rules.cascade(docs)
    got = rows_of(frame)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert {r["doc_id"]: r["kept"] for r in got}[803] and not {r["doc_id"]: r["kept"] for r in got}[802]
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    assert quality_rules.cascade(empty).count() == 0
    rules = quality_rules.default_rules()
    turned = quality_rules.cascade(docs, rules=dict(reversed(rules.items())))
    assert Counter((r["doc_id"], r["kept"]) for r in rows_of(turned)) == Counter((r["doc_id"], r["kept"]) for r in got)


def test_decontamination(corpus, empty, spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(9, 60))]) for i in range(25)]
    texts, want = [], set()
    for k, (i, w) in enumerate(items):
        for rate in (0.0, 0.1, 0.6):
            e = list(w)
            for _ in range(int(rate * len(w))):
                j = rng.randrange(len(e))
                e[j : j + 1] = [rng.choice(vocab)] * rng.randint(0, 2)
            d = len(texts)
            pad = [rng.choice(vocab) for _ in range(30)]
            texts.append((d, " ".join(pad + [x.upper() + "," if k % 2 else x for x in e] + pad)))

    def edit(a, b):  # fewest edits from a to a stretch of b
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    for d, t in texts:
        for i, w in items:
            if edit(w, split(t)) <= len(w) // 4:
                want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "too short to tell"), (None, "x " * 30)], "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], int(i)) for r in rows_of(decontaminate.report(docs, bench)) for i in r["item_ids"].split(",") if i}
    assert got <= want and {(d, i) for d, i in want if d % 3 < 2} <= got and len(got) >= decontaminate.RECALL * len(want)
    in_blocks = decontaminate.scan(docs, bench, block=7)
    assert {(r["doc_id"], i) for r in rows_of(in_blocks) for i in r["items"]} == got
    assert decontaminate.report(corpus, bench).count() == corpus.count() and decontaminate.report(empty, bench).count() == 0
    assert decontaminate.scan(corpus, bench.limit(0)).columns[-1] == "_items"


def test_cgk_walk_is_one_for_equal_windows():
    rng = np.random.default_rng(3)
    w = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    twice = np.concatenate((w, w))
    seen = decontaminate.walk(twice, np.array([0, 40]), np.array([40, 80]), 5, [0, 9, 33, 70])
    for symbol, i in seen.values():
        assert symbol[0] == symbol[1] and i[0] == i[1]


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(t):
    out = []
    for kind, rule in PATTERNS.items():
        for m in rule.finditer(t):
            digits = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "x.y-z", "1", "23", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", " ", "-", "300.1.2.3", "10.0.0.1", "é", "(", ")", "\n", "%+", "5555-5555-5555-4444", "00000000000"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "+1" * 50_000, "1.1" * 60_000, "A1b2" * 40_000):
        pii.added_spans(t, pii.base_spans(t), pii.trained())


def test_pii(spark, corpus, empty):
    cases = {
        1: "write to bob (at) mail (dot) com now", 2: "call 555-123-4567 please", 3: 'token = "46d6a7e6a8a7bb8c02c2f090c991ec47d826f64d" end', 4: "iban DE89 3704 0044 0532 0130 00", 5: "ssn 123-45-6789",
        6: "on 2020-10-12 we met at noon and 978 pages", 7: "commit 46d6a7e6a8a7bb8c02c2f090c991ec47d826f64d was 12 days old", 8: "mail é a.b@c.de, 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 123-4567.",
    }
    got = {r["doc_id"]: r for r in rows_of(pii.find(spark.createDataFrame(list(cases.items()), "doc_id long, text string")))}
    assert [got[k]["spans"].split(":")[0] for k in range(1, 6)] == ["email", "phone", "secret", "iban", "ssn"]
    assert got[6]["spans"] == got[7]["spans"] == "" and got[6]["redacted"] == cases[6]
    r = got[8]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and r["redacted"] == "mail é [email], [ip] and [card] or [phone]."
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(cases[8])).encode()).hexdigest()
    out = rows_of(pii.find(corpus))
    assert len(out) == corpus.count() and all(r["redacted"] is not None for r in out) and pii.find(empty).count() == 0


def test_long_secrets_are_proposed():
    rng = random.Random(9)
    key = "".join(rng.choice("ABCDEFGHJKLMNPQRabcdefghkmnpqr0123456789") for _ in range(700))
    for n in (16, 128, 129, 700):
        text = f'token = "{key[:n]}" end'
        assert ("secret", 9, 9 + n) in pii.proposals(text) and pii.added_spans(text, [], pii.trained()) == [("secret", 9, 9 + n)]
    assert ("secret", 0, 702) in pii.proposals(key + "==") and not [x for x in pii.proposals(key + "===") if x[0] == "secret"]


def test_secrets_without_digits_and_every_bracket():
    found = lambda t: pii.added_spans(t, [], pii.trained())
    for text, kind, s in (('password = "kxQwTzLmPrVbNcYd" ok', "secret", "kxQwTzLmPrVbNcYd"), ("token: qzkvmwtrbxnplcjd end", "secret", "qzkvmwtrbxnplcjd"), ("mail bob {at} mail {dot} com now", "email", "bob {at} mail {dot} com"), ("mail: bob[at]mail.com please", "email", "bob[at]mail.com")):
        assert [(k, text[a:b]) for k, a, b in found(text)] == [(kind, s)], text
    for text in ("an internationalisation effort", "Note: donaudampfschifffahrtsgesellschaft", "INTERNATIONALISATION of things"):
        assert not found(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_pii_planted_in_the_documents():
    """Of the keys given to a name in the documents nine in ten are found, and of what is added nine in ten are such keys."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    named = {(i, *m.span(1)) for i, t in enumerate(texts) for m in re.finditer(r"(?i)\b(?:token|secret|password|api_?key) = \"([^\"]{16,})\"", t or "")}
    added = {(i, a, b) for i, t in enumerate(texts) for _, a, b in pii.added_spans(t or "", pii.base_spans(t or ""), pii.trained())}
    assert named and len(added & named) >= 0.9 * max(len(named), len(added))


def test_pii_skips_no_text_that_a_generator_matches(spark):
    rng = random.Random(3)
    ends = ("(at)", "[AT]", "{at}", " at ", " At ", " (at) ", " at  "), ("(dot)", "[dot]", " dot ", " DOT ", ".", " . ", "(DOT) ")
    texts = ["Please contact jane.doe (at) example.com or bob [at] mail.org soon", "write to BOB (AT) MAIL (DOT) COM now"]
    texts += [f"mail: {rng.choice(('bob', 'ſue', 'x'))}{a}{rng.choice(('mail', 'K', 'ſ-x'))}{b}com now" for a in ends[0] for b in ends[1]]
    texts += ["".join(rng.choice(("bob", "at", "dot", " ", " ", ".", "(", ")", "[", "]", "AT", "é")) for _ in range(rng.randint(3, 14))) for _ in range(3000)]
    busy = pc.match_substring_regex(pa.array(texts), pii.BUSY).to_pylist()
    assert not [t for t, b in zip(texts, busy) if not b and (pii.proposals(t) or pii.base_spans(t))]
    assert sum(map(bool, map(pii.proposals, texts))) > 49 and not all(busy)
    got = {r["doc_id"]: r["spans"] for r in rows_of(pii.find(spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")))}
    assert got == {i: pii.joined(pii.added_spans(t, [], pii.trained())) for i, t in enumerate(texts[:20])} and "email" in got[0] + got[1]


def backoff(texts, order, capacity):
    """Witten-Bell backoff by dictionaries."""
    streams = [b" ".join(x.encode() for x in words(t)) for t in texts]
    streams = [bytes(1 if c < 9 or 13 < c < 32 else c for c in s) + b"\n" for s in streams]
    arcs = [defaultdict(Counter) for _ in range(order)]
    n = 0
    for s in streams:
        h = b"\n" + s
        for j in range(1, len(h)):
            n += 1
            for m in range(min(order, j + 1)):
                arcs[m][h[j - m : j]][h[j]] += 1
    kept = [{c: a for c, a in level.items() if sum(a.values()) * capacity >= n} for level in arcs]

    def p(ctx, x):
        if not ctx:
            a = kept[0].get(b"", Counter())
            return (a[x] + 0.5) / (sum(a.values()) + 128)
        a = kept[len(ctx)].get(ctx)
        return p(ctx[1:], x) if a is None else (a[x] + len(a) * p(ctx[1:], x)) / (sum(a.values()) + len(a))

    def score(t):
        s = b" ".join(x.encode() for x in words(t))
        h = b"\n" + bytes(1 if c < 9 or 13 < c < 32 else c for c in s) + b"\n"
        return sum(math.log10(p(h[max(0, j - order + 1) : j], h[j])) for j in range(1, len(h)))

    return score, p


def test_lm_scoring(corpus, empty):
    texts = [(d, t) for d, t, _ in by_text(corpus)]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [t for d, t in texts if not held(d)]
    count = Counter(w for t in train for w in [*words(t), "\n"])
    total, kinds = sum(count.values()), len(count)
    lm, p = backoff(train, lm_scoring.ORDER, 300)
    assert abs(sum(p(b"th", x) for x in range(256)) - 1) < 1e-9
    want = sorted(
        (repr(d), held(d), len(w := [*words(t), "\n"]), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 5), lm(t)) for d, t in texts
    )
    for hot in (4, 1 << 20):  # most words through the join, and none
        got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), r["score"]) for r in rows_of(lm_scoring.score(corpus, 300, hot)))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) <= 2e-5 and abs(g[6] - w[6]) <= 1e-3 + 1e-5 * abs(w[6]) for g, w in zip(got, want))
    assert lm_scoring.score(empty).count() == 0


def test_lm_scoring_keeps_every_context(corpus):
    texts = [(d, t) for d, t, _ in by_text(corpus)]
    lm, _ = backoff([t for d, t in texts if d is None or zlib.crc32(str(d).encode()) % 5 != 1], lm_scoring.ORDER, 10**9)
    want = sorted((repr(d), lm(t)) for d, t in texts)
    for hot_grams in (50, 1 << 20):  # most n-grams through the join, and few
        got = sorted((repr(r["doc_id"]), r["score"]) for r in rows_of(lm_scoring.score(corpus, hot_grams=hot_grams)))
        assert all(g[0] == w[0] and abs(g[1] - w[1]) <= 1e-3 + 1e-5 * abs(w[1]) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("most", (0, 300, 10**9))
def test_automaton_reads_as_definitions_say(spark, monkeypatch, most):
    """Every byte that the automaton settles has the probability of the definition, in lanes as in one pass."""
    rng = random.Random(most)
    texts = ["".join(rng.choice("aab bc d") for _ in range(rng.randint(0, 150))) for _ in range(30)] + ["", "zq"]
    _, p = backoff(texts[:20], lm_scoring.ORDER, 10**9)
    flat, at = kernels.flat(pa.array(texts))
    s, off = lm_scoring.stream(flat, at, *kernels.word_spans(flat, at))
    grams, known = lm_scoring.grams_of(s, off), off[20]
    rows = [(k, n) for k, n in Counter(grams[:known].tolist()).items()] + [(k, 0) for k in {*grams[known:].tolist()} - {*grams[:known].tolist()}]
    monkeypatch.setattr(lm_scoring, "PART", 64)
    ws = common.Workspace(spark, "automaton")
    model, short = lm_scoring.modelled(spark.createDataFrame(rows, "key long, n long"), int(known), ws, None)
    automaton = lm_scoring.frequent_contexts(model, short, most)
    assert automaton.complete == (most == 10**9) and len(automaton.cells) <= most + 257
    want = np.array([math.log10(p(h[max(0, j - lm_scoring.ORDER + 1) : j], h[j])) for a, b in zip(off[:-1], off[1:]) for h in [b"\n" + s[a:b].tobytes()] for j in range(1, len(h))])
    seen = []
    for lane in (lm_scoring.ORDER - 1, 11, 512):
        monkeypatch.setattr(lm_scoring, "LANE", lane)
        logp, sure = automaton.read(s, off)
        assert np.allclose(logp[sure], want[sure], atol=1e-5)
        seen.append((logp, sure))
    assert all((x == logp).all() and not (y & ~sure).any() for x, y in seen)  # lanes may settle less, never otherwise
    assert sure.all() == automaton.complete and sure.any() == (most > 0)
    left = dict(model.where(f"level = {lm_scoring.ORDER}").select("key", "logp").collect())
    assert np.allclose([left[k] for k in grams.tolist()], want, atol=1e-5)


def alone(page):
    """The text of a page without a template."""
    x = html_text.Page(page)
    return html_text.main_text(x.texts, x.token, x.up, x.flags, x.at, set(), None).split("\n")


def test_html_blocks():
    page = (
        '<body><header><h1>Site</h1></header><div id="cookie-notice">x</div><article><header><h1>Title</h1><p>by A</p></header><p>Hello &lt; b<sup>2</sup>&nbsp; c<p>two<br>lines <b>bold'
        '</p><ul><li>a<li>b</ul><form>q<input>r</form><script>var t="</p>";</script><!-- c > --><div class="ad">buy</div>tail 3 < 4<section class="comments"><p>boo</section></article><footer>f'
    )
    assert alone(page) == ["Title", "Hello < b2 c", "two lines bold", "a", "b", "tail 3 < 4"]
    assert alone('<article><section class="related-work"><p>a</section><p id="share-price-analysis">b<div class="alert">c</div><div class="search-result">d</div></article>') == ["a", "b", "c", "d"]
    assert alone("<p>c <span class=ad>x</span>d<footer>e") == ["c d"] and alone("<nav><article><p>left open</article>") == ["left open"]
    for odd in ("", "<", "<p", "</", "<p a='", "a < b > c", "<!--", "<!doctype", "<script>", "&amp;&bogus;", "<p " + "x='" * 3000):
        alone(odd)


def test_html_is_linear_in_long_pages():
    import time

    began = time.process_time()
    for page in ("<div>a" * 100_000, "<div>a</b></p>" * 100_000, "<p>a<span class=ad>q" * 50_000, "<nav>" * 50_000 + "<article>a" * 50_000):
        assert alone(page)
    assert time.process_time() - began < 60


def plain_extract(pages, min_pages, min_share):
    """Templates and slots of the pages (host, html) of a few hosts, by definition."""
    out = []
    read = [(h, html_text.Page(x)) for h, x in pages]
    for h, page in read:
        site = [p for g, p in read if g == h]
        tokens = {t for p in site for t in p.token}
        vectors = defaultdict(list)
        for t in tokens:
            v = tuple(p.token.count(t) for p in site)
            on = sum(n > 0 for n in v)
            if on >= min_pages and on >= min_share * len(site):
                vectors[v].append(t)
        valid = []
        for v, members in vectors.items():
            runs = {tuple(t for t in p.token if t in members) for p in site}
            if len(runs - {()}) == 1:
                valid.append((-sum(n > 0 for n in v), -len(members), members))
        kept = []
        for size, many, members in sorted(valid, key=lambda x: x[:2]):

            def crosses(a, b):
                spans = [set(), set()]
                for p in site:
                    for one, other, span in ((a, b, spans[0]), (b, a, spans[1])):
                        if set(one) & set(p.token) and set(other) & set(p.token):
                            span |= {sum(x in other for x in p.token[:i]) for i, x in enumerate(p.token) if x in one}
                return len(spans[0]) > 1 and len(spans[1]) > 1

            if not any(crosses(members, k) for k in kept):
                kept.append(members)
        texts = lambda p: {p.token[i] for i in p.at}
        shown = lambda p, i: not p.flags[i] & html_text.DROPPED
        fixed = {t for m in kept for t in m if any(t in texts(p) for p in site)}
        own = lambda p: [(i, s) for i, s in zip(p.at, p.texts) if shown(p, i) and p.token[i] not in fixed]

        def around(p, i):
            while i >= 0:
                yield i
                i = p.up[i]

        total, inside, deep = sum(len(s) for p in site for _, s in own(p)), Counter(), {}
        for p in site:
            for i, s in own(p):
                for j in list(around(p, i))[1:]:
                    if any(p.token[j] in m for m in kept) and shown(p, j):
                        inside[bool(p.flags[j] & html_text.ARTICLE), p.token[j]] += len(s)
                        deep[p.token[j]] = len(list(around(p, j)))
        articles = [(n, -deep[t], -t, t) for (art, t), n in inside.items() if art and n >= html_text.MOST * total]
        inner = [(deep[t], n, -t, t) for (_, t), n in inside.items() if n >= html_text.NEARLY * total]
        slot = max(articles)[-1] if articles else max(inner)[-1] if inner else None
        for m in kept:
            weight = sum(len(s) for p in site for i, s in zip(p.at, p.texts) if p.token[i] in m and shown(p, i))
            rest = sum(len(s) for p in site if set(m) & {p.token[i] for i in p.at if shown(p, i)} for i, s in zip(p.at, p.texts) if shown(p, i) and p.token[i] not in m)
            if weight > rest:
                fixed -= set(m)
        left = own(page)
        if any(t == slot for t in page.token):
            left = [(i, s) for i, s in left if any(page.token[j] == slot for j in around(page, i))]
        elif any(page.flags[i] & html_text.ARTICLE for i, _ in left):
            left = [(i, s) for i, s in left if page.flags[i] & html_text.ARTICLE]
        out.append("\n".join(s for _, s in left))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_html_against_definitions(spark, seed):
    rng = random.Random(seed)
    word = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    pages = []
    for h in ("x", "y"):
        wrap, promo, quote = rng.choice(("article", "div", "section")), word(6), word(4)
        for i in range(rng.randint(5, 9)):
            body = "".join(f"<p>{i} {k} {word(rng.randint(3, 20))}</p>" + (f"<p>{quote}</p>" if rng.random() < 0.3 else "") for k in range(rng.randint(1, 4)))
            top = f"<div class=top><p>{promo}</p>{word(rng.randint(0, 2))}</div>" if rng.random() < 0.8 else ""
            pages.append((h, f"<html><body><nav><a>{word(2)}</a></nav>{top}<{wrap} class=c>{body}<p>Read on</p></{wrap}><footer>{h}</footer></body></html>" if rng.random() < 0.9 else f"<p>{word(9)}"))
    rows = [(k, f"http://{h}/{k}", x) for k, (h, x) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in rows_of(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), 3, 0.5))}
    assert [found[k] for k in range(len(pages))] == plain_extract(pages, 3, 0.5)


def test_html_template_decides(spark):
    """Without marks or an article element only the deduced template tells text from the rest."""
    rng = random.Random(8)
    page = lambda i: f"<body><div class=a><p>offer {i} {rng.random()}</p></div><div class=b><h1>Head {i}</h1>" + "".join(f"<p>line {i} {k} {'long ' * 30}</p>" for k in range(4)) + "<p>All rights kept</p></div></body>"
    df = spark.createDataFrame([(i, f"http://s/{i}", page(i)) for i in range(8)], "page_id long, url string, html string")
    on, off = ({r["page_id"]: r["text"].split("\n") for r in rows_of(html_text.extract(df, min_share=share))} for share in (0.5, 2.0))
    assert all(len(on[i]) == 5 and on[i][0] == f"Head {i}" for i in range(8)) and all(len(off[i]) == 7 for i in range(8))


def test_html_templates(spark):
    rng = random.Random(5)
    page = lambda i, host: f"<body><div>Welcome to {host}</div><div><p>Section news</p></div><div>{(body := [f'text {i} {k} ' + str(rng.random()) for k in range(3)])[0]}</div><div>{body[1]}</div><p>{body[2]}</p><div>Copyright {host}</div>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i, f"h{i % 2}")) for i in range(12)] + [(50, "http://one.example/x", "<p>only one page</p>"), (51, None, None), (52, "nonsense", "")]
    got = {r["page_id"]: r for r in rows_of(html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))}
    for i in range(12):
        lines = got[i]["text"].split("\n")
        assert len(lines) == 3 and all(x.startswith(f"text {i} ") for x in lines) and got[i]["n_chars"] == len(got[i]["text"])
    assert got[50]["text"] == "only one page" and got[51]["text"] == "" and got[52]["n_chars"] == 0
    copies = [(i, f"http://c.example/{i}", "<article><p>one</p><p>two</p></article>") for i in range(8)]
    assert {r["text"] for r in rows_of(html_text.extract(spark.createDataFrame(copies, "page_id long, url string, html string")))} == {"one\ntwo"}
    assert html_text.extract(spark.createDataFrame(copies, "page_id long, url string, html string").limit(0)).count() == 0


def test_html_classes_nest(spark):
    page = lambda i, quote: "<body><nav>menu</nav>" + "".join(f"<p>head {k}</p>" + ("<p>a quote</p>" if quote == k else "") + f"<p>own text {i} {k}, long enough to be most of the page</p>" for k in (1, 2)) + "<p>foot</p></body>"
    same = [(i, f"http://same.example/{i}", page(i, 1 if i % 3 else 0)) for i in range(12)]  # always in one slot of the template
    moved = [(20 + i, f"http://moved.example/{i}", page(i, i % 3)) for i in range(12)]  # in one slot or another
    got = {r["page_id"]: r["text"] for r in rows_of(html_text.extract(spark.createDataFrame(same + moved, "page_id long, url string, html string")))}
    for i in range(12):
        own = [f"own text {i} {k}, long enough to be most of the page" for k in (1, 2)]
        assert got[i].split("\n") == own
        assert got[20 + i].split("\n") == own[: i % 3 - 1 if i % 3 else 2] + ["a quote"] * (i % 3 > 0) + own[i % 3 - 1 if i % 3 else 2 :]


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_symbol_patterns_do_not_collide(spark):
    """The texts on which every polynomial modulo a power of two agrees."""
    a, b = thue_morse(11)
    for k in (0, 1):
        buf, off = kernels.flat(pa.array([a, b]))
        h = kernels.span_hash(buf, off[:-1], off[1:], k)
        assert h[0] != h[1]
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r["n_dropped"] for r in rows_of(line_dedup.op4_line_dedup(docs))] == [0, 0]
    assert sorted(r["component_id"] for r in rows_of(ngram_join.components(docs))) == [1, 2]
    buf, off = kernels.flat(pa.array([a, b, a]))
    assert kernels.same_bytes(buf, off[:-1], off[1:], np.array([0, 1, 0])) and not kernels.same_bytes(buf, off[:-1], off[1:], np.array([0, 0, 0]))


def test_tokens_of_words_that_share_a_prefix(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    a, b = thue_morse(11)
    path = P.path("word_bpe_49k.json")
    texts = [f"prefixed{a} prefixed{b} don't, prefixed{a}. x,", "é, ñ. " * 50, "a<|endoftext|>b, c."]
    got = token_output.encoder(path).encode(pa.array(texts)).to_pylist()
    assert [np.frombuffer(x, token_output.encoder(path).kind).tolist() for x in got] == [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]
