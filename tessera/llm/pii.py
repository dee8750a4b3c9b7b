"""Personal data (op 8): high-recall generators propose overlapping spans, boosted trees decide.

Four base kinds follow fixed patterns and always stay: leftmost, non-overlapping within a kind, failing matches
dropped without a retry.  Beyond them, generators propose spans that a pattern alone can't settle (written-out
addresses, national phone numbers, account numbers, keys); trees trained here score each from its format and
its context, isotonic calibration turns scores into probabilities and each kind has a threshold that reaches
``PRECISION`` on held-out cases.  Accepted spans that touch a base span or a better one are left out.

The trees learn from ``TRAIN_CASES`` generated cases, since no table labels spans; the corpus isn't sampled.
Null text is empty; repeated rows are handled one by one and very long texts whole; offsets are code points, ends
exclusive.  Of spans with one probability the first, then the longest, wins.  An empty table gives an empty result.
Columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import Boosted, isotonic
from tessera.llm.common import mapped

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "ssn")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
TRAIN_CASES, SEED, PRECISION = 6000, 11, 0.98

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number can only start at the start of its digits, so the look-behind changes no match; it avoids rescanning.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches: each holds one @, whose left part can't cross the match before."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]


#: High-recall generators; every repetition is bounded or, from the start of its run on, possessive, so each is linear in the text.
GENERATORS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\]|\{at\}|[\x20]at[\x20]|@)[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\(dot\)|\[dot\]|\{dot\}|[\x20]dot[\x20]|\.)[\x20]?[A-Za-z0-9-]{1,63}){1,4}", re.I),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: What any match of a base pattern or a generator holds: a digit, an @, a run as long as a secret, or the email generator's
#: other forms (re.I takes the long s and the Kelvin sign for letters).
BUSY = r"(?i)[0-9@]|[a-z_+/-]{16}|\(at\)|\[at\]|\{at\}| at  ?[a-z0-9\x{17F}\x{212A}-]+ ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z0-9\x{17F}\x{212A}-]"
#: Context words.
SECRET_WORDS = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "private_key", "credential")
PHONE_WORDS = ("tel", "phone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono")
EMAIL_WORDS = ("mail", "contact", "write", "reach", "correo", "schreib")
ID_WORDS = ("ssn", "social", "security", "iban", "account", "konto", "compte", "cuenta")
NOT_WORDS = ("commit", "order", "version", "isbn", "date", "page", "total", "sha", "hash", "checksum", "digest", "md5", "model", "serial")
GROUPS = (SECRET_WORDS, PHONE_WORDS, EMAIL_WORDS, ID_WORDS, NOT_WORDS)


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def keylike(text: str, at: int, s: str) -> bool:
    """Letters with digits or of mixed case, or letters that are given to a name; not plain words and plain numbers."""
    inner = s[1:]
    if not any(c.isalpha() for c in s):
        return False
    return any("0" <= c <= "9" for c in s) or inner != inner.lower() and inner != inner.upper() or text[max(0, at - 4) : at].rstrip(" '\"")[-1:] in ("=", ":")


def proposals(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, rule in GENERATORS.items():
        for m in rule.finditer(text):
            s = m.group()
            if kind == "secret" and not keylike(text, m.start(), s):
                continue
            if kind == "email" and not re.search(r"[\x20(\[{](?:at|dot)[\x20)\]}]|[\x20]@|@[\x20]", s, re.I):
                continue  # the base pattern's own
            out.append((kind, *m.span()))
    return out


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s, before, after = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 12].lower()
    n = len(s)
    digits = digits_of(s)
    letters = [c for c in s if c.isalpha()]
    seps = [c for c in s if not c.isalnum()]
    entropy = -sum(p * math.log2(p) for p in (s.count(c) / n for c in set(s)))
    near = before.split()[-3:]
    return [
        float(ORDER[kind]), n, len(digits), len(digits) / n, len(letters) / n, sum(c.isupper() for c in letters) / n, len(seps), len(set(seps)), entropy,
        float(len(digits) > 8 and luhn(digits)), float(kind == "iban" and iban_ok(s)), float(all(c in "0123456789abcdef" for c in s.lower())),
        float(kind == "email" and bool(re.search(r"dot|\.(?:com|org|net|edu|info|de|fr|es|io|co)\b", s, re.I))), float(bool(re.search(r"[(\[{]", s))),
        *(float(any(w in x for x in near for w in group)) for group in GROUPS),
        float(before.rstrip()[-1:] in ("=", ":")), float(before[-1:] in ("'", '"')), float(before.rstrip(" '\"")[-1:] in ("=", ":")), float(after[:1] in ("'", '"')),
        float(s[:3] in ("000", "666") or s[:1] == "9"), float(bool(re.match(r"(?:19|20)[0-9]{2}[-./ ]", s))), float(kind == "phone" and len(digits) in (9, 10, 11)),
    ]


def _case(r: random.Random) -> tuple[str, str, str, int]:
    """Kind, text, the part that is the candidate, and whether it is personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(r.randint(2, 9)))
    key = lambda n: "".join(r.choice("0123456789abcdef" if r.random() < 0.5 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) + d(1)
    of = lambda group: r.choice(group)
    kind, good = r.choice(("email", "phone", "iban", "secret", "ssn")), r.random() < 0.5
    lead = " ".join(w() for _ in range(r.randint(1, 5)))
    if kind == "email":
        tld = r.choice("com org net edu info de fr es io".split())
        if good:
            style = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")))
            s, cue = f"{w()}.{d(2)}{style[0]}{w()}{style[1]}{tld}" if r.random() < 0.5 else f"{w()}{style[0]}{w()}{style[1]}{tld}", of(EMAIL_WORDS) + ":" if r.random() < 0.5 else ""
        else:
            s, cue = f"{w()} at {w()}.{r.choice((w(), w(), d(2)))}", ""
    elif kind == "phone":
        if good:
            s, cue = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}")), of(PHONE_WORDS) + r.choice((":", "", ".")) if r.random() < 0.8 else ""
        else:
            s, cue = r.choice((f"{r.randint(1900, 2090)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)} {d(3)} {d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(3)}-{d(2)}-{d(4)}")), of(NOT_WORDS) if r.random() < 0.5 else ""
    elif kind == "iban":
        body = r.choice(("DE", "FR", "ES", "GB", "NL")) + "00" + d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        s = body[:2] + f"{check if good else (check + r.randint(1, 80)) % 97:02d}" + body[4:]
        s, cue = " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s, of(ID_WORDS) if r.random() < 0.5 else of(NOT_WORDS) if not good else ""
    elif kind == "secret":
        s = key(r.choice((19, 23, 31, 39, 63)))
        letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz" if shape else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(r.choice((16, 20, 28)))) if (shape := r.choice((None, None, 0, 1))) is not None else ""
        if good:
            s = letters or s
            cue = of(SECRET_WORDS) + r.choice((" = \"", "=\"", ": ", "=", " = '", ": \""))
            lead = f"{lead} {cue}{s}" + (cue[-1] if cue[-1] in "'\"" else "")
            return kind, lead, s, 1
        cue = of(NOT_WORDS) + r.choice((" ", ": ", " ")) if r.random() < 0.6 else ""
        if letters:
            s, cue = (letters, cue) if r.random() < 0.5 else ("".join(w() for _ in range(9)), f"{w()}: ")
        elif r.random() < 0.4:
            s = f"{w()}-{w()}{w()}-{w()}{w()}-{d(r.randint(1, 4))}"
    else:
        s = f"{d(3)}-{d(2)}-{d(4)}"
        cue = of(("ssn", "social security", "SSN:")) if good else (of(NOT_WORDS) if r.random() < 0.7 else "")
    return kind, f"{lead} {cue}{'' if cue.endswith(' ') else ' '}{s} {w()} {w()}", s, int(good)


@lru_cache(1)
def trained() -> tuple[Boosted, np.ndarray, np.ndarray, dict[str, float]]:
    """Trees, calibration and the threshold of each kind, from generated cases alone; the same at every call."""
    r = random.Random(SEED)
    rows, y, kinds = [], [], []
    for _ in range(TRAIN_CASES):
        true_kind, text, s, good = _case(r)
        at = text.index(s)
        for kind, a, b in proposals(text):
            if a < at + len(s) and at < b:
                rows.append(features(text, kind, a, b))
                y.append(float(good and kind == true_kind and a >= at - 1 and b <= at + len(s) + 1 and b - a >= len(s) - 1))
                kinds.append(kind)
    x, t, k = np.array(rows), np.array(y), np.array(kinds)
    part = np.arange(len(t)) % 3
    model = Boosted().fit(x[part == 0], t[part == 0])
    knots, p = isotonic(model.margin(x[part == 1]), t[part == 1])
    held = part == 2
    prob = calibrated(model, knots, p, x[held])
    limits = {}
    for kind in GENERATORS:
        own, good = prob[k[held] == kind], t[held][k[held] == kind]
        fits = [c for c in np.unique(np.concatenate((own, [0.5]))) if c >= 0.5 and (own >= c).any() and good[own >= c].mean() >= PRECISION]
        limits[kind] = float(min(fits, default=2.0))  # 2: no threshold is precise enough, nothing is added
    return model, knots, p, limits


def calibrated(model: Boosted, knots: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return p[np.clip(np.searchsorted(knots, model.margin(x), "right") - 1, 0, len(p) - 1)]


def added_spans(text: str, taken: list[tuple[str, int, int]], model) -> list[tuple[str, int, int]]:
    boosted, knots, p, limits = model
    props = proposals(text)
    if not props:
        return []
    prob = calibrated(boosted, knots, p, np.array([features(text, *x) for x in props]))
    busy = sorted((a, b) for _, a, b in taken)
    out: list[tuple[str, int, int]] = []
    for q, (kind, a, b) in sorted(zip(prob, props), key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if q >= limits[kind] and not any(a < d and c < b for c, d in busy):
            out.append((kind, a, b))
            busy.append((a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (ORDER[x[0]], x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of base kinds, base_sha256, spans, and the redacted text."""
    model = trained()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        busy = np.asarray(pc.match_substring_regex(texts, BUSY))
        n = batch.num_rows
        counts = {k: np.zeros(n, np.int64) for k in BASE}
        shas, spans = [empty] * n, [""] * n
        whole = texts.to_pylist() if busy.any() else None
        redacted = whole if whole is not None else texts
        for i in np.flatnonzero(busy):
            t = whole[i]
            base = base_spans(t)
            every = base + added_spans(t, base, model)
            for k, _, _ in base:
                counts[k][i] += 1
            shas[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            redacted[i] = redact(t, every)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[k]) for k in BASE), pa.array(shas), pa.array(spans), pa.array(redacted, pa.string()) if whole is not None else texts],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted"],
        )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, redacted string"
    return mapped(rows, ["doc_id", "text"], "text", run, schema)
