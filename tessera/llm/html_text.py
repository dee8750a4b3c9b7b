"""HTML extraction (op 10): equivalence-class template deduction over the pages of a host.

A page is read once, in linear time, into tokens in page order: elements, told apart by their place (the names and
classes of the elements around them), and blocks of text, told apart by place and words.  Over all pages of a host the
tokens that share an occurrence vector (how often on which page) form a class; vectors compare by commutative
hashes, so no task ever holds a host.  A class that occurs on ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's
pages or more, and whose tokens keep one order on all of them, is valid.  Two valid classes nest if one lies in a
single gap between the other's tokens, the same on all pages that have both; of two that don't, the one on fewer pages
(then of fewer tokens) is rejected.  The classes left are the host's template, a tree of elements with fixed texts.

Text between the template's tokens fills its slots.  The article's slot is the template element that holds the
host's own text: an article element with ``MOST`` of it, or else the innermost element with ``NEARLY`` all of it and of
the main headings.  What fills other slots is dropped, fixed texts are too.  A class of fixed texts that outweighs all else
on the pages that have it is a copied article, no template, and stays.

What the task names by its kind is never article text: navigation, footers, asides, forms, scripts, styles, hidden
elements, headers but for their headings, and elements all of whose class, id or role words say advert, comments,
notice and the like.  A page that has no template, or not its article slot, keeps its article elements' text, or if it
has none all text that is left.

Null or empty html gives an empty text, a null url the host ''.  Repeated pages count as pages of their own, so
do rows with one page_id.  Ties between classes and slots go to the smaller token.  Very long pages are read whole.
An empty table gives an empty result.  Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, mapped

MIN_PAGES, MIN_SHARE = 4, 0.5
MOST, NEARLY = 0.5, 0.9

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("head nav footer aside form noscript template iframe svg button select textarea dialog menu object canvas audio video".split())
RAW = frozenset("script style textarea title xmp".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div ul ol dl table body blockquote td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BEFORE = frozenset("nav header form div ul li body html head".split())
#: Words in class, id or role that name what is not article text, and words that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments replies cookie cookies consent footer masthead menu modal"
    " nav navbar navigation newsletter notice notices overlay pager pagination popup promo sidebar signup sponsor sponsored subscribe toolbar login"
    " contentinfo complementary disqus".split()
)
BESIDE = frozenset("site page global top bottom left right main primary secondary box bar block area list item items section container wrapper wrap inner outer widget widgets slot unit form user reader thread js".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
DROPPED, ARTICLE, MAIN_HEADING = 1, 2, 4  # flags of elements
LONG = (1 << 63) - 1


@lru_cache(1 << 14)
def marked(attrs: str) -> bool:
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                words = set(re.split(r"[^a-z]+", one)) - {""}
                if words & MARKS and words <= MARKS | BESIDE:
                    return True
    return False


@lru_cache(1 << 14)
def kind(name: str, attrs: str) -> int:
    """A number for an element's name and classes."""
    found = next((a or b or c for n, a, b, c in ATTR.findall(attrs) if n.lower() == "class"), "") if "lass" in attrs.lower() else ""
    return int.from_bytes(hashlib.blake2b(f"{name}.{' '.join(sorted(found.split()))}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def token(place: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{place}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Events of a page in order: an element or a block of text each, with its token and the event of its parent."""

    def __init__(self, html: str):
        self.token: list[int] = []
        self.up: list[int] = []
        self.flags: list[int] = []  # of elements; of a block those of its element, DROPPED if anything around it is
        self.at: list[int] = []  # events that are blocks
        self.texts: list[str] = []  # of the blocks
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int, int]] = []  # name, place, event, flags
        opened: Counter[str] = Counter()
        text: list[str] = []
        pos, end = 0, len(html)

        def flush() -> None:
            if text:
                if s := " ".join(unescape("".join(text)).split()):
                    place, event, flags = stack[-1][1:] if stack else (0, -1, 0)
                    self.at.append(len(self.token))
                    self.texts.append(s)
                    self._event(token(place, s), event, flags)
                text.clear()

        def cut(to: int) -> None:
            for x in stack[to:]:
                opened[x[0]] -= 1
            del stack[to:]

        while pos < end:
            lt = html.find("<", pos)
            if lt < 0:
                lt = end
            if lt > pos:
                text.append(html[pos:lt])
            if lt == end:
                break
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                pos = end if close < 0 else close + 3
                continue
            if html.startswith(("<!", "<?"), lt):
                close = html.find(">", lt)
                pos = end if close < 0 else close + 1
                continue
            m = TAG.match(html, lt)
            if not m:
                nxt = html[lt + 1 : lt + 3].lstrip("/")
                if nxt[:1].isalpha():  # a tag that is cut off or has an odd quote
                    close = html.find(">", lt)
                    pos = end if close < 0 else close + 1
                else:
                    text.append("<")
                    pos = lt + 1
                continue
            pos = m.end()
            shut, name, attrs = m[1], m[2].lower(), m[3]
            if name in INLINE:
                if name in VOID:
                    if name == "br":
                        text.append(" ")
                elif not shut and attrs and marked(attrs) and not (stack and stack[-1][3] & DROPPED):
                    # What is left out inside a block doesn't end it.
                    held = text[:]
                    text.clear()
                    stack.append((f"-{name}", stack[-1][1] if stack else 0, stack[-1][2] if stack else -1, (stack[-1][3] if stack else 0) | DROPPED))
                    opened[f"-{name}"] += 1
                    self.aside = held
                elif shut and stack and stack[-1][0] == f"-{name}":
                    flush()
                    cut(len(stack) - 1)
                    text.extend(self.aside)
                    self.aside = []
                continue
            flush()
            if self.aside and stack and stack[-1][0].startswith("-"):  # a block element ends an inline one that was left open
                cut(next(i for i in range(len(stack) - 1, -2, -1) if i < 0 or not stack[i][0].startswith("-")) + 1)
                text.extend(self.aside)
                self.aside = []
                flush()
            if shut:
                if opened[name]:
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if name in RAW and not attrs.endswith("/"):
                close = _END[name].search(html, pos)
                pos = close.end() if close else end
                continue
            if name in VOID or attrs.endswith("/"):
                continue
            closed = CLOSES.get(name) or {"p"}
            if any(opened[x] for x in closed):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closed:
                        cut(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
            around = stack[-1][3] if stack else 0
            inside = around & ARTICLE
            own = bool(attrs) and marked(attrs)
            if name == "article" and not own:
                if around & DROPPED and all(x[0] in BEFORE for x in stack):
                    cut(next(i for i, x in enumerate(stack) if x[3] & DROPPED))  # left open before the article
                    around = stack[-1][3] if stack else 0
                inside = ARTICLE
            if name == "header" and not inside or inside and stack and stack[-1][0] == "header" and name not in HEADINGS:
                own = True
            flags = (around & DROPPED) | inside | (DROPPED if own or name in LEFT_OUT else 0) | (MAIN_HEADING if name == "h1" else 0)
            parent, above = (stack[-1][1], stack[-1][2]) if stack else (0, -1)
            place = ((parent ^ kind(name, attrs)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & LONG
            stack.append((name, place, len(self.token), flags))
            opened[name] += 1
            self._event(place, above, flags)
        flush()
        text.extend(self.aside)
        self.aside = []
        while stack and stack[-1][0].startswith("-"):
            cut(len(stack) - 1)
        flush()

    aside: list[str] = []

    def _event(self, token: int, up: int, flags: int) -> None:
        self.token.append(token)
        self.up.append(up)
        self.flags.append(flags)


_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the events (toks, up, flags), the blocks (at, texts), and distinct tokens with their counts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Page(html or "") for html in batch.column("html").to_pylist()]
        kinds = [np.unique(np.array(x.token, np.int64), return_counts=True) for x in found]
        listed = lambda rows, of: pa.array(rows, pa.list_(of))
        arrays = [batch.column("page_id"), batch.column("url"), pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string())]
        arrays += [listed([x.texts for x in found], pa.string()), listed([x.token for x in found], pa.int64())]
        arrays += [listed([getattr(x, k) for x in found], pa.int32()) for k in ("up", "flags", "at")] + [listed([x[k].tolist() for x in kinds], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "texts", "toks", "up", "flags", "at", "once", "times"])

    schema = "page_id long, url string, host string, texts array<string>, toks array<long>, up array<int>, flags array<int>, at array<int>, once array<long>, times array<long>"
    return mapped(pages.select(F.col("page_id").cast("long"), "url", "html"), ["page_id", "url", "html"], "html", run, schema)


def gaps(seq: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes of a page's tokens in order: the classes, and the first and last gap [i, j] of class j that class i is in."""
    kinds, of = np.unique(np.array(seq, np.int64), return_inverse=True)
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(kinds) + 1))
    first, last = order[begin[:-1]], order[begin[1:] - 1]
    places = [order[a:b] for a, b in zip(begin[:-1], begin[1:])]
    return kinds, np.stack([np.searchsorted(x, first, "right") for x in places], 1), np.stack([np.searchsorted(x, last, "right") for x in places], 1)


def templates(read: DataFrame, ws: Workspace, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host and the arrays of template tokens and their classes; at most 1 / min_share times a mean page's blocks."""
    vector = F.xxhash64("page_id", "url", "x.times")
    seen = read.select("host", "page_id", "url", F.explode(F.arrays_zip("once", "times")).alias("x"))
    seen = seen.select("host", F.col("x.once").alias("tok"), vector.alias("v"), F.pmod(vector, F.lit(1 << 31)).alias("s"))
    seen = seen.groupBy("host", "tok").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor("v").alias("v"), F.sum("s").alias("s")).where(F.col("pages") >= min_pages)
    of = ws.put(read.groupBy("host").agg(F.count(F.lit(1)).alias("of")), "hosts")
    some = seen.join(of, "host").where(F.col("pages") >= min_share * F.col("of"))
    some = some.groupBy("host").agg(F.collect_list("tok").alias("t"), F.collect_list(F.xxhash64("v", "s", "pages")).alias("c"), F.collect_list("pages").alias("n"))
    some = ws.put(some, "classes")

    def order(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, classes, orders = [], [], []
        for h, toks, t, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            of_tok, seq = dict(zip(t, c)), {}
            for x in toks:
                if x in of_tok:
                    seq.setdefault(of_tok[x], []).append(x)
            for k, row in seq.items():
                hosts.append(h)
                classes.append(k)
                orders.append(token(0, repr(row)))
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(classes, pa.int64()), pa.array(orders, pa.int64())], ["host", "class", "o"])

    used = mapped(read.join(some, "host").select("host", "toks", "t", "c"), ["host", "toks", "t", "c"], None, order, "host string, class long, o long")
    # A token that occurs more than once repeats by different amounts, so classes of repeated tokens seldom keep one order.
    valid = used.groupBy("host", "class").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a = b").groupBy("host").agg(F.collect_list("class").alias("valid"))
    some = ws.put(some.join(ws.put(valid, "valid"), "host"), "ordered")

    def places(batches):
        for batch in batches:
            met: dict[tuple[str, int, int], list[int]] = {}
            for h, toks, t, c, ok in zip(*(x.to_pylist() for x in batch.columns)):
                ok = set(ok)
                of_tok = {x: k for x, k in zip(t, c) if k in ok}
                seq = [of_tok[x] for x in toks if x in of_tok]
                if len(set(seq)) < 2:
                    continue
                kinds, low, high = gaps(seq)
                for i, a in enumerate(kinds.tolist()):
                    for j, b in enumerate(kinds[:i].tolist()):
                        now = (int(low[i, j]), int(high[i, j]), int(low[j, i]), int(high[j, i]))
                        was = met.setdefault((h, a, b), list(now))
                        was[:] = min(was[0], now[0]), max(was[1], now[1]), min(was[2], now[2]), max(was[3], now[3])
            keys = list(zip(*met)) or [(), (), ()]
            spans = list(zip(*met.values())) or [()] * 4
            arrays = [pa.array(keys[0], pa.string()), *(pa.array(x, pa.int64()) for x in (*keys[1:], *spans))]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "a", "b", "a_low", "a_high", "b_low", "b_high"])

    met = read.select("host", "toks").join(some.where(F.size("valid") > 1), "host").select("host", "toks", "t", "c", "valid")
    met = met.mapInArrow(places, "host string, a long, b long, a_low long, a_high long, b_low long, b_high long")
    met = met.groupBy("host", "a", "b").agg(F.min("a_low").alias("a_low"), F.max("a_high").alias("a_high"), F.min("b_low").alias("b_low"), F.max("b_high").alias("b_high"))
    met = met.where("a_low < a_high and b_low < b_high").groupBy("host").agg(F.collect_list(F.array("a", "b")).alias("crossing"))

    def nested(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for c, n, ok, crossing in zip(*(batch.column(k).to_pylist() for k in ("c", "n", "valid", "crossing"))):
            pages, size, foes = dict(zip(c, n)), Counter(c), {}
            for a, b in crossing or ():
                foes.setdefault(a, set()).add(b)
                foes.setdefault(b, set()).add(a)
            taken: set[int] = set()
            for k in sorted(ok, key=lambda k: (-pages[k], -size[k], k)):
                if not taken & foes.get(k, set()):
                    taken.add(k)
            kept.append(sorted(taken))
        return pa.RecordBatch.from_arrays([batch.column("host"), batch.column("t"), batch.column("c"), pa.array(kept, pa.list_(pa.int64()))], ["host", "t", "c", "valid"])

    whole = some.join(ws.put(met, "crossing"), "host", "left")
    return ws.put(mapped(whole, ["host", "t", "c", "n", "valid", "crossing"], None, nested, "host string, t array<long>, c array<long>, valid array<long>"), "templates")


def weights(toks: list[int], up: list[int], flags: list[int], at: list[int], texts: list[str], fixed: set[int]) -> tuple[list[int], list[int], int, int]:
    """Characters of the page's own text inside each event's element, those of main headings, and both in all."""
    own, heads = [0] * len(toks), [0] * len(toks)
    total = main = 0
    for i, text in zip(at, texts):
        if not flags[i] & DROPPED and toks[i] not in fixed:
            own[i] = len(text)
            heads[i] = len(text) if flags[i] & MAIN_HEADING else 0
            total, main = total + own[i], main + heads[i]
    for i in range(len(toks) - 1, -1, -1):  # a parent comes before what it holds
        if up[i] >= 0 and own[i]:
            own[up[i]] += own[i]
            heads[up[i]] += heads[i]
    return own, heads, total, main


def slots(read: DataFrame, known: DataFrame, ws: Workspace) -> DataFrame:
    """host, template tokens and classes, the classes that are copied articles, and the article's slot. Written."""

    def run(batches):
        for batch in batches:
            met: dict[tuple[str, int, int], list[int]] = {}
            for h, texts, toks, up, flags, at, t, c, valid in zip(*(x.to_pylist() for x in batch.columns)):
                ok = set(valid)
                of = {x: k for x, k in zip(t, c) if k in ok}
                blocks = {toks[i] for i in at}
                fixed = blocks & of.keys()
                own, heads, total, main = weights(toks, up, flags, at, texts, fixed)
                rows: dict[tuple[int, int], list[int]] = {(0, 0): [total, main, 0]}
                depth = [0] * len(toks)
                for i, (x, above) in enumerate(zip(toks, up)):
                    depth[i] = depth[above] + 1 if above >= 0 else 0
                    if own[i] and x in of and x not in blocks and not flags[i] & DROPPED:
                        row = rows.setdefault((1 + bool(flags[i] & ARTICLE), x), [0, 0, depth[i]])
                        row[0], row[1] = row[0] + own[i], row[1] + heads[i]
                copied: Counter[int] = Counter()
                for i, text in zip(at, texts):
                    if toks[i] in fixed and not flags[i] & DROPPED:
                        copied[of[toks[i]]] += len(text)
                for k, size in copied.items():
                    rows[3, k] = [size, total + sum(copied.values()) - size, 0]
                for (kind_, x), row in rows.items():
                    was = met.setdefault((h, kind_, x), [0, 0, 0])
                    was[:] = was[0] + row[0], was[1] + row[1], max(was[2], row[2])
            keys, sums = list(zip(*met)) or [(), (), ()], list(zip(*met.values())) or [(), (), ()]
            arrays = [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), *(pa.array(x, pa.int64()) for x in (keys[2], *sums))]
            yield pa.RecordBatch.from_arrays(arrays, ["host", "kind", "x", "own", "other", "depth"])

    columns = ["host", "texts", "toks", "up", "flags", "at", "t", "c", "valid"]
    rows = read.join(known, "host").select(*columns).mapInArrow(run, "host string, kind int, x long, own long, other long, depth long")
    sums = ws.put(rows.groupBy("host", "kind", "x").agg(F.sum("own").alias("own"), F.sum("other").alias("other"), F.max("depth").alias("depth")), "sums")
    whole = sums.where("kind = 0").select("host", F.col("own").alias("total"), F.col("other").alias("heads"))
    here = sums.where("kind IN (1, 2)").join(whole, "host")
    article = here.where(f"kind = 2 AND own >= {MOST} * total").groupBy("host").agg(F.max_by("x", F.struct("own", -F.col("depth"), -F.col("x"))).alias("article"))
    inner = here.where(f"own >= {NEARLY} * total AND other >= {NEARLY} * heads").groupBy("host").agg(F.max_by("x", F.struct("depth", "own", -F.col("x"))).alias("inner"))
    copies = sums.where("kind = 3 AND own > other").groupBy("host").agg(F.collect_list("x").alias("copies"))
    found = known.join(article, "host", "left").join(inner, "host", "left").join(copies, "host", "left")
    return ws.put(found.select("host", "t", "c", "valid", "copies", F.coalesce("article", "inner").alias("slot")), "slots")


def main_text(texts: list[str], toks: list[int], up: list[int], flags: list[int], at: list[int], fixed: set[int], slot: int | None) -> str:
    """The blocks that fill the article's slot; without one, those of article elements, or else all."""
    inside = [False] * len(toks)
    for i, (x, above) in enumerate(zip(toks, up)):
        inside[i] = x == slot or above >= 0 and inside[above]
    own = [(i, s) for i, s in zip(at, texts) if not flags[i] & DROPPED and toks[i] not in fixed]
    if not any(inside):
        inside = [bool(f & ARTICLE) for f in flags]
        if not any(inside[i] for i, _ in own):
            return "\n".join(s for _, s in own)
    return "\n".join(s for i, s in own if inside[i])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ws = Workspace(pages.sparkSession, "html")
    read = ws.put(parsed(pages), "blocks")
    known = slots(read, templates(read, ws, min_pages, min_share), ws)
    ws.only("blocks", "slots")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for texts, toks, up, flags, at, t, c, valid, copies, slot in zip(*(batch.column(k).to_pylist() for k in ("texts", "toks", "up", "flags", "at", "t", "c", "valid", "copies", "slot"))):
            ok = set(valid or ()) - set(copies or ())
            out.append(main_text(texts, toks, up, flags, at, {x for x, k in zip(t or (), c or ()) if k in ok} & {toks[i] for i in at}, slot))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = read.join(known, "host", "left").select("page_id", "url", "texts", "toks", "up", "flags", "at", "t", "c", "valid", "copies", "slot")
    return mapped(joined, joined.columns, None, run, "page_id long, url string, text string, n_chars long")
