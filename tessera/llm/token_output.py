"""Token-ID output (op 2): static range asymmetric numeral system over tokenised documents.

Documents in ascending doc_id order (null first; equal ids by their token bytes) are cut into shards and blocks;
a block never splits a document.  One frequency table, quantised to ``2**PROB`` over the ids that occur anywhere,
is shared by all blocks.  Inside a block, ids are dealt out to interleaved lanes, each with its own 64-bit state,
32 bits moving to one common stream at a time; a vector of lanes is coded per step.  Every ``CHECK`` steps the
states and the stream position are stored, so parts of a block can be decoded side by side, and each block
carries CRC-32 of its stored bytes and of its ids.

File format: a Parquet folder ``blocks`` with a row for each block (shard, block, start, doc_ids, lengths, data),
``data`` being the header and arrays that ``encode`` describes, and a one-row folder ``table`` (ids, freqs).

Null text is empty and gives the end id alone; repeated rows are written one by one.  An empty table gives an
empty result.  Columns other than the key and the text are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.common import Workspace, mapped, slices

END_ID = 2
PROB = 20
BLOCK = 1 << 19
LANES = 512
CHECK = 128
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIQIIQIII")  # magic, version, ids, lanes, steps between checkpoints, words, checkpoints, crc of arrays, crc of ids
CACHE = 64 << 20  # bytes of kept parts and their ids in a worker
SLICE = 2 << 20
JOINED = 2000  # parts encoded in one text
_APART = np.zeros(256, bool)
_APART[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Encoder:
    """Whole texts to ids.  The tokenizer never joins characters across a space or a line feed, so each distinct part
    between them is encoded once and kept, within a bound in bytes.

    Parts are encoded many at a time and told apart again: words, with or without a comma or full stop after them,
    by the vocabulary's word-end mark, of which each piece has exactly one; others by an added token set between
    them.  Where that doesn't come out even, each part is encoded alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.width = 2 if size <= 1 << 16 else 4  # bytes of an id on the way to the files
        self.kind = f"<u{self.width}"
        self.between, self.between_id = next(((t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if self._divides(t.content, i)), (None, -1))
        self.forget()

    def _divides(self, token: str, number: int) -> bool:
        a, b = "don't,", "(x)1"
        return len(token) > 1 and self._ids(a + token + b) == [*self._ids(a), number, *self._ids(b)]

    def forget(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self._ids(x) for x in parts]
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], self.kind)

    def _words(self, text: str, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of the parts of a text, whose numbers of pieces are given; None if pieces don't come out even."""
        ids = self._together([text])[0]
        last = np.flatnonzero(self.ends[ids])
        if len(last) != pieces.sum() or len(last) and last[-1] != len(ids) - 1:
            return None
        cut = last[np.cumsum(pieces) - 1] + 1
        return np.diff(cut, prepend=0), ids

    def _divided(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.between is None or any("<" in x for x in parts):
            return self._alone(parts)
        ids = self._together([self.between.join(parts)])[0]
        cut = np.flatnonzero(ids == self.between_id)
        if len(cut) != len(parts) - 1:
            return self._alone(parts)
        return np.diff(cut, prepend=-1, append=len(ids)) - 1, ids[ids != self.between_id]

    def learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of distinct parts, in their order."""
        n = len(starts)
        width = ends - starts + 1  # with a space after each
        at = np.cumsum(width) - width
        packed = buf[np.minimum(np.repeat(starts - at, width) + np.arange(width.sum()), len(buf) - 1)]
        packed[at + width - 1] = 32
        comma = (packed[at + width - 2] == 44) | (packed[at + width - 2] == 46)
        odd = np.add.reduceat((~_LETTER[packed]).astype(np.int64), at) - 1 - comma
        plain = (odd == 0) & (width - 1 > comma)
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parts, sizes, ids

        def words(of: np.ndarray, text: Callable[[np.ndarray], str], pieces: np.ndarray) -> None:
            for i in range(0, len(of), JOINED):
                some = slice(i, i + JOINED)
                got = self._words(text(of[some]), pieces[some])
                groups.append((of[some], *(got if got else self._alone(strings(of[some])))))

        def strings(of: np.ndarray) -> list[str]:
            return [packed[a : a + w - 1].tobytes().decode() for a, w in zip(at[of].tolist(), width[of].tolist())]

        def packed_text(of: np.ndarray) -> str:
            w = width[of]
            return packed[np.repeat(at[of] - (np.cumsum(w) - w), w) + np.arange(w.sum())].tobytes().decode("ascii")

        own = np.flatnonzero(plain)
        words(own, packed_text, 1 + comma[own].astype(np.int64))
        rest = np.flatnonzero(~plain)
        texts = dict(zip(rest.tolist(), strings(rest)))
        stems = {k: x[:-1] if comma[k] else x for k, x in texts.items()}
        letters = np.array([k for k, x in stems.items() if x.isalpha() and unicodedata.is_normalized("NFC", x)], np.int64)
        words(letters, lambda of: " ".join([texts[k] for k in of.tolist()]), 1 + comma[letters].astype(np.int64))
        other = np.setdiff1d(rest, letters)
        for i in range(0, len(other), JOINED):
            groups.append((other[i : i + JOINED], *self._divided([texts[k] for k in other[i : i + JOINED].tolist()])))
        size, begin, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for of, sizes, ids in groups:
            size[of], begin[of] = sizes, total + np.cumsum(sizes) - sizes
            total += len(ids)
        pool = np.concatenate([ids for *_, ids in groups]) if groups else np.zeros(0, self.kind)
        return size, pool[spread(begin, size)]

    def parts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of distinct parts, given with the ascending first half of their hash."""
        second = K.span_hash(buf, starts, ends, 1, fold=False)
        place = np.minimum(np.searchsorted(self.first, first), max(0, len(self.first) - 1))
        held = (self.first[place] == first) & (self.second[place] == second) if len(self.first) else np.zeros(len(first), bool)
        new = np.flatnonzero(~held)
        at, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at[held], size[held] = self.at[place[held]], self.size[place[held]]
        if len(new):
            sizes, ids = self.learn(buf, starts[new], ends[new])
            at[new], size[new] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
            self.pool = np.concatenate((self.pool, ids))
            where = np.searchsorted(self.first, first[new])
            self.first, self.second = np.insert(self.first, where, first[new]), np.insert(self.second, where, second[new])
            self.at, self.size = np.insert(self.at, where, at[new]), np.insert(self.size, where, sizes)
        return at, size

    def encode(self, col: pa.Array) -> pa.Array:
        """Little-endian ids of each text of a column, the end id last; nulls are empty texts."""
        if 32 * len(self.first) + self.pool.nbytes > CACHE:
            self.forget()
        buf, off = K.flat(col)
        starts, ends, at = K.word_spans(buf, off, _APART)
        # A comma or full stop after a letter begins a piece of its own, so it is a part, and the word before it too.
        cut = (ends - starts > 1) & ((buf[ends - 1] == 44) | (buf[ends - 1] == 46)) & _LETTER[buf[np.maximum(ends - 2, 0)]]
        where = np.flatnonzero(cut)
        starts, ends, at = np.insert(starts, where + 1, ends[where] - 1), np.insert(ends - cut, where + 1, ends[where]), at + np.concatenate(([0], np.cumsum(cut)))[at]
        h = K.span_hash(buf, starts, ends, fold=False)
        order = np.argsort(h)
        first = np.ones(len(h), bool)
        first[1:] = h[order[1:]] != h[order[:-1]]
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(first) - 1
        rep = order[first]
        if K.same_bytes(buf, starts, ends, rep[kind]):
            begin, size = self.parts(buf, starts[rep], ends[rep], h[rep])
            ids, begin, size = self.pool, begin[kind], size[kind]
        else:  # two parts with one hash: every occurrence for itself
            size, ids = self.learn(buf, starts, ends)
            begin = np.cumsum(size) - size
        cum = np.concatenate(([0], np.cumsum(size)))
        bounds = cum[at] + np.arange(len(at))
        out = np.full(bounds[-1], END_ID, self.kind)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        out[inner] = ids[spread(begin, size)]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * self.width, np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0] numbers, then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary() -> str:
    """Path of the tokenizer file that is used unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quantised(count: np.ndarray) -> np.ndarray:
    """Frequencies of 1 or more that sum to 2**PROB, near in proportion to the counts."""
    total = 1 << PROB
    if len(count) > total:
        raise ValueError(f"{len(count)} distinct ids need a table wider than 2**{PROB}")
    f = np.maximum(1, np.floor(count * (total / count.sum()))).astype(np.int64)
    while (over := int(f.sum()) - total) > 0:
        big = np.argsort(-f, kind="stable")[: max(1, min(over, len(f)))]
        f[big] = np.maximum(1, f[big] - np.maximum(1, (f[big] * over) // f[big].sum()))
        if (short := total - int(f.sum())) > 0:
            f[int(np.argmax(f))] += short
    f[int(np.argmax(f))] += total - int(f.sum())
    return f


class Table:
    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freqs.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(freqs)))[:-1].astype(np.uint64)
        self.slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freqs)
        self.place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
        self.place[self.ids] = np.arange(len(ids), dtype=np.uint32)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, check: int = CHECK) -> bytes:
    """One block: HEAD, then first states (u64 by lane), checkpoints (u64 stream position, u64 states), words (u32)."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 16))
    sym = table.place[ids]
    steps = -(-n // lanes)
    x = np.full(lanes, LOW)
    words, emitted, marks = [], 0, []
    for t in range(steps - 1, -1, -1):
        s = sym[t * lanes : (t + 1) * lanes]
        k = len(s)
        f, c, y = table.freq[s], table.cum[s], x[:k]
        full = y >= f << np.uint64(63 - PROB)
        if full.any():
            words.append(y[full].astype(np.uint32))
            emitted += len(words[-1])
            y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:k] = (q << np.uint64(PROB)) + (y - q * f) + c
        if t and t % check == 0:
            marks.append((emitted, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    marks.reverse()
    body = b"".join([x.astype("<u8").tobytes(), *(struct.pack("<Q", emitted - e) + y.astype("<u8").tobytes() for e, y in marks), stream.astype("<u4").tobytes()])
    return HEAD.pack(b"TANS", 1, n, lanes, check, len(stream), len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode(data: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """Ids of a block, all its parts side by side, or of the part alone that begins at checkpoint ``part`` (0: the start)."""
    magic, version, n, lanes, check, n_words, n_marks, crc, crc_ids = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if magic != b"TANS" or version != 1 or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    stream = np.frombuffer(body, "<u4", n_words, 8 * lanes + (8 + 8 * lanes) * n_marks).astype(np.uint64)
    # A row for each part: the stream position (0 for the first), then the states.
    marks = np.frombuffer(body, "<u8", (1 + lanes) * n_marks, 8 * lanes).reshape(n_marks, 1 + lanes)
    pos = np.concatenate(([0], marks[:, 0])).astype(np.int64)
    x = np.concatenate((np.frombuffer(body, "<u8", lanes)[None, :], marks[:, 1:])).astype(np.uint64)
    steps = -(-n // lanes)
    first = np.arange(n_marks + 1) * check
    if part is not None:
        pos, x, first = pos[part : part + 1], x[part : part + 1], first[part : part + 1]
    longest = int(min(check, steps - first[0]))
    out = np.zeros((len(first), longest, lanes), np.uint32)
    mask = np.uint64((1 << PROB) - 1)
    for t in range(longest):
        on = int(np.count_nonzero(first + t < steps))  # the last part may be shorter
        y = x[:on]
        low = y & mask
        s = table.slot[low]
        out[:on, t] = s
        y = table.freq[s] * (y >> np.uint64(PROB)) + low - table.cum[s]
        need = y < LOW
        if first[on - 1] + t == steps - 1:
            need[on - 1, n - (steps - 1) * lanes :] = False
        taken = np.cumsum(need, 1)
        y[need] = (y[need] << np.uint64(32)) | stream[(pos[:on, None] + taken - 1)[need]]
        pos[:on] += taken[:, -1]
        x[:on] = y
    ids = table.ids[out.reshape(-1)[: n - int(first[0]) * lanes]]
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("a block's ids don't match their checksum")
    return ids


def tokenise(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ids of each text as little-endian integers of the encoder's width."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), encoder(path).encode(batch.column("text"))], ["doc_id", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, ["doc_id", "text"], "text", run, "doc_id long, ids binary", max_bytes=SLICE)


def write(tokens: DataFrame, out: str, width: int, block: int = BLOCK, lanes: int = LANES, check: int = CHECK) -> None:
    """Write a tokenised, materialised table, of ids ``width`` bytes wide, in the file format to the folder ``out``."""
    spark = tokens.sparkSession
    kind = f"<u{width}"

    def tally(batches):
        seen = np.zeros(1, np.int64)
        for batch in batches:
            for a, b in slices(batch, "ids"):
                raw = pc.fill_null(batch.column("ids").slice(a, b - a), b"").to_pylist()
                n = np.bincount(np.frombuffer(b"".join(raw), kind))
                if len(n) > len(seen):
                    seen, n = n, seen
                seen[: len(n)] += n
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(seen[ids])], ["id", "n"])

    # One row for each id of the vocabulary at most.
    found = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, count = np.asarray(found.column("id")), np.asarray(found.column("n"))
    freqs = quantised(count.astype(np.float64)) if len(ids) else count
    spark.createDataFrame([(ids.tolist(), freqs.tolist())], "ids array<long>, freqs array<long>").coalesce(1).write.parquet(f"{out}/table")
    table = spark.sparkContext.broadcast((ids, freqs))

    def blocks(batches):
        from pyspark import TaskContext

        shard, number, start, known = TaskContext.get().partitionId(), 0, 0, Table(*table.value)
        docs: list = []
        parts: list[bytes] = []
        size = 0

        def row():
            lengths = [len(p) // width for p in parts]
            data = encode(np.frombuffer(b"".join(parts), kind).astype(np.uint32), known, lanes, check)
            cols = [pa.array([shard]), pa.array([number]), pa.array([start]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "block", "start", "doc_ids", "lengths", "data"])

        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if parts and size + len(raw) // width > block:
                    yield row()
                    number, start, docs, parts, size = number + 1, start + size, [], [], 0
                docs.append(doc)
                parts.append(raw)
                size += len(raw) // width
        if parts:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    rows = ordered.mapInArrow(blocks, "shard long, block long, start long, doc_ids array<long>, lengths array<long>, data binary")
    rows.write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(f"{out}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the ids themselves (32-bit binary), from the files alone."""
    row = spark.read.parquet(f"{folder}/table").first()
    table = spark.sparkContext.broadcast((np.array(row["ids"], np.int64), np.array(row["freqs"], np.int64)))
    stored = spark.read.parquet(f"{folder}/blocks")

    def run(batches):
        known = Table(*table.value)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start, docs, lengths, data = (batch.column(k)[i].as_py() for k in ("shard", "start", "doc_ids", "lengths", "data"))
                raw = decode(data, known).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                begin = ends - lengths
                parts = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist())]
                cols = [pa.array([shard] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(start + begin), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    rows = stored.select("shard", "start", "doc_ids", "lengths", "data").mapInArrow(run, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    # One row for each shard, of which there is one for each partition of the writer.
    sizes = sorted(stored.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    before, total = [], 0
    for shard, size in sizes:
        before.append((shard, total))
        total += size
    base = spark.createDataFrame(before, "shard long, before long")
    out = rows.join(F.broadcast(base), "shard")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the ids of all documents and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = path or vocabulary()
    ws = Workspace(docs.sparkSession, "tokens")
    tokens = ws.put(tokenise(docs, path), "tokens")
    write(tokens, f"{ws.root}/file", encoder(path).width)
    ws.drop("tokens")
    return read(docs.sparkSession, f"{ws.root}/file").drop("ids")
