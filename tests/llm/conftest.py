import random

import pytest

HARD = [None, "", "   ", "\n", "a", "A b", "é ù ö", "x" * 3000, "word " * 5000, "one two three four five\none two three four five\n\n  One two three FOUR five  \r\nlast", "日本 語 テキスト", "tab\tand\x0bvt\x1cfs", "1234 !! ##"]


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


VOCAB = {
    "en": "the of and that water stone river walking house morning little through every never bridge window".split(),
    "fr": "le la des eau pierre rivière marcher maison matin petit chaque jamais pont fenêtre être où".split(),
    "de": "der die und das wasser stein fluss gehen häuser morgen klein durch jeder niemals brücke fenster".split(),
}


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared lines, hard texts, a null id, a repeated id and clashing columns."""
    rng, rows = random.Random(4), []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        lines = [prose(rng, rng.randint(3, 14), VOCAB[lang]).capitalize() + "." for _ in range(rng.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(rng.randrange(len(lines) + 1), "All rights reserved by the house.")
        rows.append((i, "\n".join(lines), lang))
    long = [prose(rng, 80, [f"{w}{k}" for w in VOCAB["en"] for k in range(40)]) for _ in range(4)]
    for k, base in enumerate(long):
        for j in range(8):
            w = base.split()
            for _ in range(j % 4):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(999)}"
            rows.append((200 + 10 * k + j, " ".join(w).upper() if j == 1 else " ".join(w), "en"))
    rows += [(400 + i, t, None if i % 2 else "en") for i, t in enumerate(HARD)]
    rows += [(None, long[0], "en"), (5, "another text under an id that is taken", "en"), (401, "", "en")]
    full = [(d, t, lang, f"s{i % 3}", len(t) if t is not None else None, i, "x", 1.5) for i, (d, t, lang) in enumerate(rows)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, items int, lang_pred string, n_lines double"
    return spark.createDataFrame(full, kind).repartition(5)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
