"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type (BPE) model's pieces are read from its file; nothing is trained. A text is a run of units (spaces and the word
after them; a line break is a unit), across which no piece of such a model merges. Each unit keeps an agenda of candidate
merges: the best score is taken first, then the leftmost. A candidate that is taken is skipped for good if the keyed hash of
(seed, variant, unit, its first character, its piece) falls below the dropout rate; else it is merged and its neighbours make
new candidates. A document's id picks one of VARIANTS, so equal units are segmented in several ways over the corpus and
each way is computed once per worker and kept in a bounded cache. Without dropout the segmentation is the model's own.

Characters without a piece, and a literal U+2581 (which stands for the space), become byte pieces, so that decoding returns
every text exactly. An empty text has no pieces; a null text is carried as null. Repeated rows have equal pieces (same id).
Texts of any length are worked on whole, unit by unit; a unit of over WIDE characters takes a heap in place of arrays.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm._packed import ragged, tidy
from epochal.llm._spark import free, table
from epochal.llm._text import RangeHash, U, chunks, mix64, to_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, VARIANTS, WIDE, CACHE = 0.1, 4, 64, 400_000
SPACE = 0x2581
_NONE = np.iinfo(np.int32).max


class Model:
    """Tables of a merge-type model: symbols are its pieces, then characters that only occur inside pieces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = range(sp.get_piece_size())
        self.byte = np.full(256, -1, np.int32)
        normal = {}
        for i in ids:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[piece] = i
        symbol = dict(normal)
        for piece in normal:
            for c in piece:
                symbol.setdefault(c, len(ids) + len(symbol))
        scores = sorted({-sp.get_score(i) for i in normal.values()})
        place = {s: k for k, s in enumerate(scores)}
        merges = sorted((symbol[p[:k]] << 20 | symbol[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pairs = np.array([m[0] for m in merges], np.int64)
        self.merged = np.array([m[1] for m in merges], np.int32)
        self.rank = np.full(len(ids), _NONE, np.int32)
        for i in normal.values():
            self.rank[i] = place[-sp.get_score(i)]
        chars = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
        self.chars, self.char_symbol = np.array([c[0] for c in chars]), np.array([c[1] for c in chars], np.int32)
        self.n_ids = len(ids)
        text = [b""] * len(ids)
        for p, i in normal.items():
            text[i] = p.replace("▁", " ").encode()
        for b, i in enumerate(self.byte):
            if i >= 0:
                text[i] = bytes([b])
        self.size = np.array([len(x) for x in text])
        self.begin = np.cumsum(self.size) - self.size
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points (the space stands for U+2581); -1: none."""
        find = np.where(points == 32, SPACE, points)
        at = np.minimum(np.searchsorted(self.chars, find), len(self.chars) - 1)
        return np.where((self.chars[at] == find) & (points != SPACE), self.char_symbol[at], -1).astype(np.int32)

    def merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) of two symbols side by side; rank _NONE: they don't merge."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (a >= 0) & (b >= 0)
        piece = np.where(ok, self.merged[at], 0)
        return piece, np.where(ok, self.rank[piece], _NONE)


def _skipped(key: np.ndarray, left: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    h = mix64(key ^ mix64(left.astype(U) * U(0x9E3779B97F4A7C15) + piece.astype(U) + U(1)))
    return (h >> U(11)).astype(np.float64) < rate * float(1 << 53)


def agenda(model: Model, symbols: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Segment n units at once. symbols: n rows padded with -1. Returns final symbols (row by row) and their left positions."""
    n, width = symbols.shape
    sym = symbols.copy()
    nxt = np.minimum(np.arange(1, width + 1)[None, :], size[:, None]).astype(np.int32)
    prv = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
    rank = np.full((n, width), _NONE, np.int32)
    piece = np.zeros((n, width), np.int32)
    if width > 1:
        piece[:, :-1], rank[:, :-1] = model.merge(sym[:, :-1], sym[:, 1:])
    alive = np.arange(width)[None, :] < size[:, None]
    act = np.arange(n)
    while len(act):
        j = np.argmin(rank[act], axis=1)
        go = rank[act, j] != _NONE
        act, j = act[go], j[go]
        rank[act, j] = _NONE
        if rate > 0:
            ok = ~_skipped(key[act], j, piece[act, j], rate)
            a, j = act[ok], j[ok]
        else:
            a = act
        k = nxt[a, j]
        sym[a, j] = piece[a, j]
        alive[a, k] = False
        rank[a, k] = _NONE
        kk = nxt[a, k]
        nxt[a, j] = kk
        more = kk < size[a]
        x, y, z = a[more], j[more], kk[more]
        prv[x, z] = y
        piece[x, y], rank[x, y] = model.merge(sym[x, y], sym[x, z])
        p = prv[a, j]
        has = p >= 0
        x, y, z = a[has], p[has], j[has]
        piece[x, y], rank[x, y] = model.merge(sym[x, y], sym[x, z])
    row, left = np.nonzero(alive)
    return sym[row, left], np.stack([row, left])


def agenda_heap(model: Model, symbols: np.ndarray, key: int, rate: float) -> tuple[list[int], list[int]]:
    """The same for one unit of any length, with a heap."""
    n = len(symbols)
    sym, nxt, prv = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = dict(zip(model.pairs.tolist(), model.merged.tolist(), strict=True)) if not hasattr(model, "_pairs") else model._pairs
    model._pairs = pairs
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int) -> None:
        k = nxt[i]
        if k < n and sym[i] >= 0 and sym[k] >= 0 and (m := pairs.get(sym[i] << 20 | sym[k])) is not None:
            heapq.heappush(heap, (int(model.rank[m]), i, m, sym[i], sym[k]))

    for i in range(n - 1):
        push(i)
    dead = [False] * n
    while heap:
        _, i, m, a, b = heapq.heappop(heap)
        if dead[i] or sym[i] != a or nxt[i] >= n or sym[nxt[i]] != b:
            continue
        if rate > 0 and _skipped(np.array([key], U), np.array([i]), np.array([m]), rate)[0]:
            continue
        k = nxt[i]
        sym[i], dead[k], nxt[i] = m, True, nxt[k]
        if nxt[i] < n:
            prv[nxt[i]] = i
            push(i)
        if prv[i] >= 0:
            push(prv[i])
    left = [i for i in range(n) if not dead[i]]
    return [sym[i] for i in left], left


class Encoder:
    """Encodes texts; segmentations of (unit, variant) are kept until CACHE of them are held."""

    def __init__(self, proto: bytes, rate: float = DROPOUT, seed: int = 11, wide: int = WIDE):
        self.model, self.rate, self.wide = Model(proto), rate, wide
        self.seed = mix64(np.array([seed], U))[0]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.size, self.pool, self.held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        """Segment units [start, end) of data and append them to the pool."""
        raw = data[ragged(start, end - start)]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = (raw & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(heads)])
        cuts = np.cumsum(end - start)
        size = upto[cuts] - upto[cuts - (end - start)]
        first = np.cumsum(size) - size
        symbols = self.model.symbols(points)
        parts, owner = [], []
        low = 0
        for width in (4, 8, 12, 16, 24, 32, 48, 64):
            width = min(width, self.wide)
            for at in np.array_split(np.flatnonzero((size > low) & (size <= width)), max(1, len(size) * width // 2_000_000)):
                if len(at):
                    grid = np.full((len(at), width), -1, np.int32)
                    inside = np.arange(width)[None, :] < size[at][:, None]
                    grid[inside] = symbols[ragged(first[at], size[at])]
                    out, where = agenda(self.model, grid, size[at], key[at], self.rate)
                    parts.append((out, first[at][where[0]] + where[1]))
                    owner.append(at[where[0]])
            low = max(low, width)
        for i in np.flatnonzero(size > low):
            out, left = agenda_heap(self.model, symbols[first[i] : first[i] + size[i]], int(key[i]), self.rate)
            parts.append((np.array(out, np.int32), first[i] + np.array(left)))
            owner.append(np.full(len(out), i))
        out, left, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(owner)
        order = np.argsort(left, kind="stable")
        out, left, own = out[order], left[order], own[order]
        plain = (out >= 0) & (out < self.model.n_ids)
        # a character without a piece: one byte piece for each of its bytes
        edge = np.flatnonzero(heads)
        wide = np.diff(np.concatenate([edge, [len(raw)]]))
        count = np.where(plain, 1, wide[left])
        ids = np.repeat(out, count)
        bare = np.repeat(~plain, count)
        ids[bare] = self.model.byte[raw[ragged(edge[left[~plain]], wide[left[~plain]])]]
        per = np.bincount(own, count, len(size)).astype(np.int64)
        self.begin.append(self.held + np.cumsum(per) - per)
        self.size.append(per)
        self.pool.append(ids)
        self.held += len(ids)

    def encode(self, texts: list[bytes | None], ids: list) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, number of pieces of each text)."""
        if len(self.place) > CACHE:
            self._clear()
        data = np.frombuffer(b"".join(b" " + t if t else b"" for t in texts), np.uint8)
        lengths = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        doc_of = np.repeat(np.arange(len(texts)), lengths)
        new = np.zeros(len(data), bool)
        new[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        space, line = data == 32, data == 10
        new[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(new)
        end = np.concatenate([start[1:], [len(data)]])
        doc = doc_of[start]
        variant = np.array([zlib.crc32(str(i).encode()) % VARIANTS if self.rate > 0 else 0 for i in ids], U)
        key = mix64(RangeHash(data)(start, end) ^ mix64(self.seed + variant[doc]))
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.fromiter(map(self.place.get, unique.tolist(), [-1] * len(unique)), np.int64, len(unique))
        miss = np.flatnonzero(place < 0)
        if len(miss):
            n = len(self.place)
            self._learn(data, start[first[miss]], end[first[miss]], unique[miss])
            place[miss] = np.arange(n, n + len(miss))
            self.place.update(zip(unique[miss].tolist(), range(n, n + len(miss)), strict=True))
            self.begin, self.size, self.pool = ([np.concatenate(x)] for x in (self.begin, self.size, self.pool))
        at = place[inverse]
        begin, size = self.begin[0][at], self.size[0][at]
        return self.pool[0][ragged(begin, size)], np.bincount(doc, size, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Texts of pieces; the space in front of each is the encoder's."""
        m = self.model
        size = m.size[ids]
        raw = m.text[ragged(m.begin[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(count)]
        begins = np.concatenate([[0], ends[:-1]])
        return [raw[a + 1 : b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


_KEEP: dict[tuple, Encoder] = {}


def _encoder(model, rate: float, seed: int) -> Encoder:
    """One encoder for each worker process: its cache outlives a task."""
    key = (zlib.crc32(model.value), rate, seed)
    if key not in _KEEP:
        _KEEP.clear()
        _KEEP[key] = Encoder(model.value, rate, seed)
    return _KEEP[key]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: str = MODEL, rate: float = DROPOUT, seed: int = 11) -> DataFrame:
    """Add ``pieces`` (array of ids) and ``lossless`` (they decode to the very text) to all rows; the text is dropped.

    ``model`` is read by the driver and sent to the executors (a model file has a size of its own, not the corpus's).
    """
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c != text and c.lower() not in ("pieces", "lossless")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(sent, rate, seed)
        for b in it:
            texts, ids = to_bytes(b.column(0)), b.column(1).to_pylist()
            for i, j in chunks(texts):
                out, count = e.encode(texts[i:j], ids[i:j])
                ok = pa.array([a is None or a == x for a, x in zip(texts[i:j], e.decode(out, count), strict=True)], pa.bool_())
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                null = pa.array(np.array([t is None for t in texts[i:j]]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=null)
                yield pa.RecordBatch.from_arrays([lists, ok, *(b.column(k).slice(i, j - i) for k in range(2, b.num_columns))], ["pieces", "lossless", *b.schema.names[2:]])

    names = free(docs.columns, "__text", "__id")
    body = docs.select(F.col(f"`{text}`").cast("string").alias(names[0]), F.col(f"`{id_col}`").alias(names[1]), *(F.col(f"`{c}`") for c in rest))
    fields = "".join(f", `{c}` {body.schema[2 + k].dataType.simpleString()}" for k, c in enumerate(rest))
    return body.mapInArrow(tidy(run), "pieces array<int>, lossless boolean" + fields).select(*(F.col(f"`{c}`") for c in rest), "pieces", "lossless")


def decode_pieces(encoded: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """Replace the pieces by ``text``."""
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in encoded.columns if c not in (pieces, "text")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(sent, 0.0, 0)
        for b in it:
            lists = b.column(0)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = e.decode(lists.flatten().to_numpy(zero_copy_only=False), count)
            null = lists.is_null().to_pylist()
            out = pa.array([None if n else t.decode() for n, t in zip(null, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([out, *b.columns[1:]], ["text", *b.schema.names[1:]])

    body = encoded.select(F.col(f"`{pieces}`"), *(F.col(f"`{c}`") for c in rest))
    fields = "".join(f", `{c}` {body.schema[1 + k].dataType.simpleString()}" for k, c in enumerate(rest))
    return body.mapInArrow(tidy(run), "text string" + fields)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs).select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "lossless")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs.select("doc_id", "text", "lang", "source", "n_chars"))
