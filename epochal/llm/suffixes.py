"""Suffix-array dedup: every byte of a 50-byte string that also starts in a smaller document is removed, exactly.

The suffixes of 100 TB can't be exchanged one by one. Three facts keep the sort small and the result whole.
- Every window of WINDOW bytes holds the same minimizer wherever it stands: the k-gram of smallest hash among its starts, its
  anchor. A window can only repeat if its anchor's k-gram is in two texts; k-grams of one text are dropped after a count,
  by a bitmap of bounded size (where it fills up, more entries are exchanged and none is lost).
- One entry serves all windows of an anchor (about 14): the suffix from the anchor, then the text before it read backwards,
  as far as its windows reach. Equal entries hold equal windows.
- Equal texts are one text, of the smallest id; its copies are removed whole. A sender enters one copy only.

Entries are sorted in runs, and equal ones of a run collapse to the smallest id at once (so a passage in a third of all
documents leaves each sender once). Runs are front-coded (length of the prefix shared with the entry before, then the rest),
exchanged by ranges of their k-gram, and merged by a loser tree whose nodes keep the common prefix with the last winner:
prefixes known to be equal are never compared again. In merged order, equal entries are neighbours, and so are all entries
of a k-gram; where these differ, their windows are compared one by one. A k-gram of more than HEAVY texts is entered window by
window instead, as 50-byte suffixes: nothing of it needs to be held, and each run sends a window once.

The windows of an anchor start within REACH bytes of each other, so those that repeat cover one run of bytes. Runs are dealt by
text and joined there: one row for each text that loses anything, which meets its text once.

Null and empty texts have no bytes. A text shorter than the window keeps everything. Rows of the same id are not smaller than
each other; null ids are the largest. Texts are told apart, and windows within a k-gram compared, by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm._packed import SLICED, batches, cut_by, gathered, pack, ragged, runs, slice_of, unpack
from epochal.llm._spark import cut, parallelism, table
from epochal.llm._text import RangeHash, U, chunks, mix64, signed, to_bytes

WINDOW, GRAM = 50, 24
REACH = WINDOW - GRAM  # bytes before the anchor that a window may start
WIDTH = 1 + WINDOW + REACH + 2  # kind, suffix, text before, first and last offset
HEAVY, FLUSH, NO_ID = 100_000, 3_000_000, np.iinfo(np.int64).max
#: Sampled k-grams a range, and bytes of text of which they are taken: they place the ranges and change no result.
HEADS, SAMPLE_BYTES = 256, 32_000_000
#: Bits (as a power of two) of the bitmaps of shared k-grams, and of marked texts.
MAX_BITS, MARK_BITS = 28, 22
_LOW = U((1 << 32) - 1)


class Anchors:
    """Anchors of some texts: doc, at (in data), near and far (smallest and largest distance of a window's start), k-gram hash."""

    def __init__(self, texts: list[bytes | None]):
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
        self.ends = np.cumsum(lengths)
        n = len(self.data)
        self.doc = self.at = self.near = self.far = np.zeros(0, np.int64)
        self.gram = np.zeros(0, U)
        if n < WINDOW:
            return
        start = np.arange(n - GRAM + 1)
        h = RangeHash(self.data)(start, start + GRAM)
        bits = U(max(22, int(n).bit_length()))
        m = (h >> bits << bits) | start.astype(U)
        span, left = 1, REACH + 1
        while span * 2 <= left:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if left > span:
            m = np.minimum(m[: len(m) - (left - span)], m[left - span :])
        first = np.repeat(self.ends - lengths, np.maximum(lengths - WINDOW + 1, 0))
        count = np.maximum(lengths - WINDOW + 1, 0)
        p = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        a = (m[p] & ((U(1) << bits) - U(1))).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), count)
        if not len(p):
            return
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
        i = np.flatnonzero(new)
        j = np.concatenate([i[1:], [len(p)]]) - 1
        self.doc, self.at = doc[i], a[i]
        self.far, self.near = a[i] - p[i], a[i] - p[j]
        self.gram = mix64(h[self.at] ^ U(0xA5A5))


def _code(gram: np.ndarray, n_slices: int) -> np.ndarray:
    """A k-gram's slice and 32 bits of its hash. Two that collide only look shared, which costs an entry."""
    return slice_of(gram, n_slices).astype(U) << U(32) | mix64(gram) & _LOW


def _fingerprints(texts: list[bytes | None]) -> np.ndarray:
    out = np.zeros(len(texts), U)
    for i, j in chunks(texts):
        lengths = np.array([len(t) if t else 0 for t in texts[i:j]], np.int64)
        ends = np.cumsum(lengths)
        out[i:j] = RangeHash(np.frombuffer(b"".join(t or b"" for t in texts[i:j]) + b"\n", np.uint8))(ends - lengths, ends)
    return out


def _one_copy(texts: list[bytes | None], fps: np.ndarray, ids: np.ndarray) -> None:
    """Empty all but one text of the smallest id of each fingerprint."""
    order = np.lexsort((ids, fps))
    for i in order[1:][fps[order[1:]] == fps[order[:-1]]].tolist():
        texts[i] = None


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = to_bytes(b.column(1))
        sizes = pa.array([len(t) if t else 0 for t in texts], pa.int64())
        shas = pa.array([hashlib.sha256(t or b"").hexdigest() for t in texts], pa.string())
        yield pa.record_batch([b.column(0), pa.array(signed(_fingerprints(texts))), sizes, shas], ["id", "fp", "n_bytes", "sha"])


def _deal(n_slices: int):
    """To each slice of k-grams: text fingerprints, numbers of k-grams, 32 bits of each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            fp, code = (np.concatenate(x) for x in zip(*held, strict=True))
            order, bounds = cut_by((code >> U(32)).astype(np.int32), n_slices)
            for s in range(n_slices):
                x = order[bounds[s] : bounds[s + 1]]
                if len(x):
                    first, size = runs(fp[x])
                    yield s, pack(fp[x][first], size.astype(np.uint32), code[x].astype(np.uint32))

        def rows():
            held, total = [], 0
            for b in it:
                texts = to_bytes(b.column(0))
                fps = _fingerprints(texts)
                _one_copy(texts, fps, np.zeros(len(texts), np.int64))
                for i, j in chunks(texts):
                    a = Anchors(texts[i:j])
                    if len(a.doc):
                        held.append((fps[i:j][a.doc], _code(a.gram, n_slices)))
                        total += len(a.doc)
                    if total >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if held:
                yield from out(held)

        yield from batches(rows())

    return run


def _segments(n_slices: int, bits: int, heavy: int):
    """The slice's part of two bitmaps: k-grams of two texts or more, and of more than ``heavy``."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        fp = np.concatenate([np.repeat(x[0], x[1]) for x in parts])
        code = np.concatenate([x[2].astype(U) for x in parts])
        order = np.lexsort((fp, code))
        fp, code = fp[order], code[order]
        new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (code[1:] != code[:-1])])
        first, size = runs(code[new])
        code = code[new][first]
        out = []
        for least in (1, heavy):
            mark = np.zeros(bits, bool)
            mark[_bit(code[size > least], bits)] = True
            out.append(np.packbits(mark))
        yield from batches([(s, pack(*out))])

    return fn


def _bit(code: np.ndarray, bits: int) -> np.ndarray:
    """Place of a code's lower 32 bits in its slice's part of a bitmap."""
    return ((code & _LOW) * U(bits) >> U(32)).astype(np.int64)


class Shared:
    """The bitmaps as the driver has gathered them: slices by bytes. Hash collisions only let too many k-grams through."""

    def __init__(self, n_slices: int, bits: int):
        self.n, self.bits = n_slices, bits
        self.maps = np.zeros((2, n_slices, bits // 8), np.uint8)

    def test(self, which: int, code: np.ndarray) -> np.ndarray:
        at = _bit(code, self.bits)
        return (self.maps[which, (code >> U(32)).astype(np.int64), at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(bits: int):
    """Bits of the fingerprints' upper hash, packed by 2**16: (part, bytes)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in it:
            seen[(b.column(0).to_numpy().view(U) >> U(64 - bits)).astype(np.int64)] = True
        yield from batches((k, np.packbits(x).tobytes()) for k, x in enumerate(seen.reshape(-1, 1 << min(bits, 16))) if x.any())

    return run


def _marked(sent, bits: int, wanted: bool):
    """Rows (fp, ...) whose fingerprint is in the bitmap (or, not wanted, is not)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(U)
            yield b.filter(pa.array(sent.value[(fp >> U(64 - bits)).astype(np.int64)] == wanted))

    return run


def _with_fingerprint(sent, bits: int):
    """(fp, id, text) of the texts whose fingerprint is in the bitmap."""
    pick = _marked(sent, bits, True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = pa.array(signed(_fingerprints(to_bytes(b.column("text")))))
            yield from pick([pa.RecordBatch.from_arrays([fp, b.column("id"), b.column("text")], ["fp", "id", "text"])])

    return run


def _entries(a: Anchors, shared: Shared) -> tuple[np.ndarray, ...]:
    """Rows of WIDTH bytes for the anchors whose k-gram is shared: (rows, doc, place in the doc: of the anchor or window)."""
    code = _code(a.gram, shared.n)
    x = np.flatnonzero(shared.test(0, code))
    heavy = shared.test(1, code[x])
    begin = np.concatenate([[0], a.ends[:-1]])
    pad = np.concatenate([np.zeros(REACH, np.uint8), a.data, np.zeros(WINDOW, np.uint8)])
    out, docs, places = [], [], []
    n = x[~heavy]
    if len(n):
        rows = np.zeros((len(n), WIDTH), np.uint8)
        reach_right, reach_left = WINDOW - a.near[n], a.far[n]
        cols = np.arange(WINDOW)
        rows[:, 1 : 1 + WINDOW] = pad[a.at[n][:, None] + REACH + cols] * (cols < reach_right[:, None])
        cols = np.arange(REACH)
        rows[:, 1 + WINDOW : 1 + WINDOW + REACH] = pad[a.at[n][:, None] + REACH - 1 - cols] * (cols < reach_left[:, None])
        rows[:, -2], rows[:, -1] = a.near[n], a.far[n]
        out.append(rows), docs.append(a.doc[n]), places.append(a.at[n] - begin[a.doc[n]])
    n = x[heavy]
    if len(n):
        size = a.far[n] - a.near[n] + 1
        p = ragged(a.at[n] - a.far[n], size)
        rows = np.zeros((len(p), WIDTH), np.uint8)
        rows[:, 0] = 1
        rows[:, 1 : 1 + WINDOW] = pad[p[:, None] + REACH + np.arange(WINDOW)]
        doc = np.repeat(a.doc[n], size)
        out.append(rows), docs.append(doc), places.append(p - begin[doc])
    if not out:
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs), np.concatenate(places)


def _as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _reach(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far before an entry's place its windows start: (largest, smallest distance)."""
    whole = rows[:, 0] == 1
    return np.where(whole, 0, rows[:, -1]).astype(np.int64), np.where(whole, 0, rows[:, -2]).astype(np.int64)


def _deal_runs(n_slices: int, fp: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Byte runs to the slices of their texts: fingerprints, ids, numbers of runs, begins, sizes."""
    order = np.lexsort((ids, fp))  # by fingerprint, hence by slice
    fp, ids, begin, size = fp[order], ids[order], begin[order], size[order]
    bounds = np.searchsorted(slice_of(fp, n_slices), np.arange(n_slices + 1))
    for s in range(n_slices):
        i, j = bounds[s], bounds[s + 1]
        if j > i:
            first = np.flatnonzero(np.concatenate([[True], (fp[i + 1 : j] != fp[i : j - 1]) | (ids[i + 1 : j] != ids[i : j - 1])]))
            count = np.diff(np.append(first, j - i))
            yield s, pack(fp[i:j][first], ids[i:j][first], count.astype(np.uint32), begin[i:j].astype(np.uint32), size[i:j].astype(np.uint8))


def _send_runs(sent, splitters: np.ndarray, n_slices: int):
    """Front-coded sorted runs (6 arrays) to range slices; byte runs of repeats found here (5 arrays) to their texts' slices."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            rows, fp, ids, place = (np.concatenate(x) for x in zip(*held, strict=True))
            text = _as_strings(rows)
            order = np.argsort(text, kind="stable")
            text, rows, fp, ids, place = text[order], rows[order], fp[order], ids[order], place[order]
            first, size = runs(text)
            least = np.minimum.reduceat(ids, first)
            again = ids > np.repeat(least, size)
            if again.any():
                far, near = _reach(rows[again])
                yield from _deal_runs(n_slices, fp[again], ids[again], place[again] - far, far - near + WINDOW)
            rows, fp, ids, place, text = rows[~again], fp[~again], ids[~again], place[~again], text[~again]
            lcp = np.zeros(len(rows), np.uint8)
            if len(rows) > 1:
                differ = rows[1:] != rows[:-1]
                lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
            at = np.searchsorted(splitters, _as_strings(rows[:, : 1 + GRAM]), side="right")
            bounds = np.searchsorted(at, np.arange(n_slices + 1))
            for s in range(n_slices):
                i, j = bounds[s], bounds[s + 1]
                if j > i:
                    own = lcp[i:j].copy()
                    own[0] = 0
                    tail = rows[i:j][np.arange(WIDTH)[None, :] >= own[:, None]]
                    # documents by number: their fingerprint and id are sent once per run
                    _, first, number = np.unique(fp[i:j] ^ mix64(ids[i:j].view(U)), return_index=True, return_inverse=True)
                    small = np.uint16 if len(first) < 65536 else np.uint32
                    yield s, pack(own, tail, fp[i:j][first], ids[i:j][first], number.astype(small), place[i:j].astype(np.uint32))

        def rows_():
            held, total = [], 0
            for b in it:
                texts = to_bytes(b.column("text"))
                fps = _fingerprints(texts)
                ids = b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                _one_copy(texts, fps, ids)
                for i, j in chunks(texts):
                    e, doc, place = _entries(Anchors(texts[i:j]), sent.value)
                    if len(e):
                        held.append((e, fps[i:j][doc], ids[i:j][doc], place))
                        total += len(e)
                    if total * 4 >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if held:
                yield from out(held)

        yield from batches(rows_())

    return run


def _sample(sent, rate: float):
    """A part of the shared k-grams by hash, for even ranges only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = to_bytes(b.column("text"))
            fps = _fingerprints(texts)
            for i, j in chunks(texts):
                e, doc, place = _entries(Anchors(texts[i:j]), sent.value)
                pick = mix64(fps[i:j][doc] + place.astype(U)) >> U(32) < U(int(rate * 2**32))
                yield pa.record_batch([pa.array([x.tobytes() for x in e[pick][:, : 1 + GRAM]], pa.binary())], ["head"])

    return run


class Run:
    """A front-coded run that is read entry by entry."""

    def __init__(self, arrays: list[np.ndarray]):
        lcp, tail, fp, ids, number, place = arrays
        self.lcps, self.fp, self.ids, self.place = lcp.tolist(), fp[number], ids[number], place
        size = WIDTH - lcp.astype(np.int64)
        ends = np.cumsum(size)
        self.ends, self.tail = ends.tolist(), tail.tobytes()
        self.i, self.n = -1, len(lcp)
        self.text, self.lcp = b"", 0
        self.step()

    def step(self) -> None:
        self.i = i = self.i + 1
        if i < self.n:
            self.lcp = h = self.lcps[i]
            self.text = self.text[:h] + self.tail[self.ends[i] - WIDTH + h : self.ends[i]]


def merge(all_runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the entry before, run that holds the entry) in sorted order, by a loser tree with known prefixes.

    A loser keeps the length of its common prefix with the winner that passed it, which is the last one that was put out.
    """
    k = 1
    while k < len(all_runs):
        k *= 2
    loser: list[tuple[int, Run | None]] = [(0, None)] * k

    def play(x: Run | None, hx: int, y: Run | None, hy: int):
        """(winner, its prefix, loser, its prefix)"""
        if x is None or x.i >= x.n:
            return y, hy, x, 0
        if y is None or y.i >= y.n:
            return x, hx, y, 0
        if hx > hy:
            return x, hx, y, hy
        if hx < hy:
            return y, hy, x, hx
        a, b = x.text, y.text
        if a == b:
            return x, hx, y, WIDTH
        h = hx
        while a[h] == b[h]:
            h += 1
        return (x, hx, y, h) if a[h] < b[h] else (y, hy, x, h)

    level: list[tuple[Run | None, int]] = [(r, 0) for r in all_runs] + [(None, 0)] * (k - len(all_runs))
    base = k
    while len(level) > 1:
        up = []
        for i in range(0, len(level), 2):
            w, hw, x, hx = play(*level[i], *level[i + 1])
            loser[(base + i) // 2] = (hx, x)
            up.append((w, hw))
        base //= 2
        level = up
    where = {id(r): k + i for i, r in enumerate(all_runs)}
    winner, h = level[0]
    while winner is not None and winner.i < winner.n:
        yield h, winner
        node = where[id(winner)] // 2
        winner.step()
        x, h = winner, (winner.lcp if winner.i < winner.n else 0)
        while node >= 1:
            hy, y = loser[node]
            x, h, z, hz = play(x, h, y, hy)
            loser[node] = (hz, z)
            node //= 2
        winner = x


def _merge_runs(n_slices: int):
    """Byte runs of the repeats found by merging the entry runs of a range, and of those that senders found, by text slice."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        yield from batches((s, pack(*x)) for x in parts if len(x) == 5)
        yield from batches(_merged(n_slices, [Run(x) for x in parts if len(x) == 6]))

    return fn


def _merged(n_slices: int, all_runs: list[Run]) -> Iterator[tuple[int, bytes]]:
    texts: list[bytes] = []  # different entries, of k-grams with more than one
    least: list[int] = []
    kept: list[tuple[list, list]] = []
    found: tuple[list, list, list, list] = ([], [], [], [])  # fingerprints, ids, begins, sizes
    state: list = [b"", [], [], []]

    def take(f: int, i: int, begin: int, size: int) -> None:
        found[0].append(f), found[1].append(i), found[2].append(begin), found[3].append(size)

    def close() -> None:
        """The entries equal to state[0] are complete: all but those of the smallest id repeat it."""
        text, fps, ids, places = state
        if not ids:
            return
        m = min(ids)
        far, near = (0, 0) if text[0] == 1 else (text[-1], text[-2])
        own: tuple[list, list] = ([], [])
        same = {f for f, i in zip(fps, ids, strict=True) if i == m}
        for f, i, p in zip(fps, ids, places, strict=True):
            if i == m:
                own[0].append(f), own[1].append(p)
            elif f not in same:  # else a copy of a whole text
                take(f, i, p - far, far - near + WINDOW)
        if text[0] == 0:
            texts.append(text), least.append(m), kept.append(own)

    def windows() -> None:
        """Compare the windows of the different entries held, which are whole k-grams."""
        if len(texts) > 1:
            rows = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, WIDTH)
            near, far, ids = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64), np.array(least)
            line = np.concatenate([rows[:, WINDOW + REACH : WINDOW : -1], rows[:, 1 : 1 + WINDOW]], axis=1)
            size = far - near + 1
            row = np.repeat(np.arange(len(rows)), size)
            off = ragged(near, size)
            start = row * line.shape[1] + REACH - off
            h = RangeHash(np.ascontiguousarray(line).ravel())(start, start + WINDOW)
            order = np.argsort(h, kind="stable")
            first, count = runs(h[order])
            smallest = np.minimum.reduceat(ids[row[order]], first)
            again = order[ids[row[order]] > np.repeat(smallest, count)]
            high, low = np.full(len(rows), -1), np.full(len(rows), WINDOW)
            np.maximum.at(high, row[again], off[again])
            np.minimum.at(low, row[again], off[again])
            for r in np.flatnonzero(high >= 0).tolist():
                for f, p in zip(*kept[r], strict=True):
                    take(f, least[r], p - int(high[r]), int(high[r] - low[r]) + WINDOW)
        texts.clear(), least.clear(), kept.clear()

    def flush() -> Iterator[tuple[int, bytes]]:
        if found[0]:
            yield from _deal_runs(n_slices, np.array(found[0], U), np.array(found[1], np.int64), np.array(found[2]), np.array(found[3]))
            for x in found:
                x.clear()

    single = 0
    for h, r in merge(all_runs):
        if h < WIDTH:
            close()
            if h <= GRAM:  # another k-gram
                if len(texts) - single == 1:  # the last k-gram had one entry only
                    texts.pop(), least.pop(), kept.pop()
                single = len(texts)
                if single > 20_000:
                    windows()
                    single = 0
                if len(found[0]) > 1_000_000:
                    yield from flush()
            state = [r.text, [], [], []]
        state[1].append(int(r.fp[r.i])), state[2].append(int(r.ids[r.i])), state[3].append(int(r.place[r.i]))
    close()
    windows()
    yield from flush()


_MARKS = "fp long, id long, begin binary, size binary"


def _marks(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row per text: its smallest id that has repeats, and their byte runs, in order and apart."""
    parts = [unpack(b) for b in blobs]
    fp, ids = (np.concatenate([np.repeat(x[k], x[2]) for x in parts]) for k in (0, 1))
    begin, size = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (3, 4))
    order = np.lexsort((ids, fp))
    first, count = runs(fp[order])
    order = order[ids[order] == np.repeat(ids[order[first]], count)]
    order = order[np.lexsort((begin[order], fp[order]))]
    fp, ids, begin, end = fp[order], ids[order], begin[order], (begin + size)[order]
    first, count = runs(fp)
    base = np.repeat(np.arange(len(first)) << 33, count)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], base[1:] + begin[1:] > reach[:-1]])  # another text, or bytes between
    at = np.flatnonzero(new)
    begin, end = begin[at].astype(np.uint32), (reach - base)[np.append(at[1:], len(fp)) - 1].astype(np.uint32)
    fp, ids = fp[at], ids[at]
    first, count = runs(fp)
    step = 20_000
    for k in range(0, len(first), step):
        x, n = first[k : k + step].tolist(), count[k : k + step].tolist()
        cols = [pa.array([v[a : a + c].tobytes() for a, c in zip(x, n, strict=True)], pa.binary()) for v in (begin, end - begin)]
        yield pa.record_batch([pa.array(signed(fp[x])), pa.array(ids[x]), *cols], ["fp", "id", "begin", "size"])


_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, sha string"


def _cut_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of texts: a copy of a smaller document's text goes whole, others lose their byte runs."""
    for b in it:
        cols: list[list] = [[], [], [], [], []]
        columns = (b.column(c).to_pylist() for c in ("id", "least", "begin", "size"))
        for text, i, least, begin, size in zip(to_bytes(b.column("text")), *columns, strict=True):
            text = text or b""
            gone: list[tuple[int, int]] = []
            if (NO_ID if i is None else i) > least:
                gone = [(0, len(text))] if len(text) >= WINDOW else []
            elif begin is not None:
                start = np.frombuffer(begin, np.uint32).astype(np.int64)
                gone = list(zip(start.tolist(), (start + np.frombuffer(size, np.uint32)).tolist(), strict=True))
            edges = [0, *(x for pair in gone for x in pair), len(text)]
            kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if gone else None
            row = (len(text), sum(y - x for x, y in gone), len(gone), kept, hashlib.sha256(text).hexdigest())
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.record_batch([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "sha"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, sha) of every row. kept: the bytes that stay (null: nothing was removed, the
    text is whole); sha: SHA-256 of the text as it came. Ids are integers, or strings of integers; other ids are an error.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    seen = cut(source.mapInArrow(_scan, "id long, fp long, n_bytes long, sha string"))
    top = F.coalesce("id", F.lit(int(NO_ID)))
    smallest = seen.groupBy("fp").agg(F.min(top).alias("least"))
    total = int(seen.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    dealt = source.select("text").mapInArrow(_deal(n), SLICED)
    bits = 1 << max(13, min(MAX_BITS, total.bit_length()) - n.bit_length())
    shared = Shared(n, bits)
    for part, blob in gathered(dealt, n, _segments(n, bits, heavy), SLICED).collect():  # at most 2**MAX_BITS bits twice
        shared.maps[0, part], shared.maps[1, part] = unpack(blob)
    sent = spark.sparkContext.broadcast(shared)
    # about HEADS k-grams a slice, from a part of the documents by hash
    share = max(1, min(64, total // SAMPLE_BYTES))
    rate = min(1.0, HEADS * n * share * 14 / max(total, 1))
    some = source.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    heads = sorted(bytes(r[0]) for r in some.mapInArrow(_sample(sent, rate), "head binary").collect())
    step = max(1, len(heads) // n)
    splitters = np.array(sorted(set(heads[step::step]))[: n - 1], f"S{1 + GRAM}")
    found = gathered(source.mapInArrow(_send_runs(sent, splitters, n), SLICED), n, _merge_runs(n), SLICED)
    marks = cut(gathered(found, n, _marks, _MARKS))
    marks = marks.join(smallest, "fp").where(F.col("id") == F.col("least")).select("fp", "begin", "size")  # copies of a text are removed whole
    marked = np.zeros(1 << MARK_BITS, bool)
    for part, blob in marks.select("fp").coalesce(4).mapInArrow(_bitmap(MARK_BITS), SLICED).collect():
        marked[part << 16 : (part + 1) << 16] |= np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
    sent_marks = spark.sparkContext.broadcast(marked)
    # texts with marks are shuffled once and cut where they meet their marks; all others are told from their digests
    some = source.mapInArrow(_with_fingerprint(sent_marks, MARK_BITS), "fp long, id long, text string")
    done = some.join(smallest.join(marks, "fp", "left"), "fp").select("id", "text", "least", "begin", "size").mapInArrow(_cut_out, _RESULT)
    rest = seen.mapInArrow(_marked(sent_marks, MARK_BITS, False), "id long, fp long, n_bytes long, sha string").join(smallest, "fp")
    copy = (top > F.col("least")) & (F.col("n_bytes") >= WINDOW)
    rest = rest.select(
        "id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.lit(0)).cast("long").alias("n_removed"), copy.cast("long").alias("n_spans"),
        F.when(copy, F.lit(b"")).alias("kept"), "sha",
    )
    return done.unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, over (id, text) with distinct ids. For tests."""
    least: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - WINDOW + 1):
            least.setdefault(data[i][p : p + WINDOW], i)
    out = {}
    for i, t in data.items():
        gone = bytearray(len(t))
        for p in range(len(t) - WINDOW + 1):
            if least[t[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
