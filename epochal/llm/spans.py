"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed and joined globally.

A sentence is a run of words that ends after a word ending in . ! or ?, or before a line break. A run is the fewest sentences
from a given one on, or up to a given one, two at least, that hold MIN_WORDS words: so the first and the last sentence of a
repeated passage are in a run that lies within it. Beside these, a sentence of LONG_SENTENCE words is looked for on its own, so
that a long passage without stops goes whole. Words are ASCII-lowered; white space between them does not matter. A sentence that
any non-first occurrence of a run covers is removed, with the white space after it. First: the smallest (document, position).

Passages that do not meet sentence ends are found by pieces: of each PASSAGE words in a row the PIECE words of the smallest hash
(the first of equal ones), so that two occurrences of a passage of PASSAGE words or more share a piece at the same place of it.
Pieces that follow each other within a passage overlap or touch. The words of a non-first occurrence of a piece are cut out,
with the white space after them; up to PASSAGE - PIECE words at either end of a passage may stay.

Runs and pieces are dealt by 64-bit hash in packed slices, once. A sender keeps the first occurrence of each hash in a flush and
marks its other ones itself, so a passage in a third of all documents sends a few entries to the slice that finds the first of all.
Marks are gathered by document: one row for each that loses words, which meets its text in a join.

A document is an id and a text: rows that share both are one (repeated rows keep their text), and texts of one id, or of null ids,
are documents of their own. Documents are ordered by id (nulls last), then by hash of the text. Ids are integers (or strings of
integers); other ids are an error. Null and empty texts have no sentences and stay as they are. Repeats within a document count.
Extra columns pass through under any names, but ``n_sentences`` and ``n_removed`` are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from epochal.llm._packed import SLICED, batches, gathered, pack, runs, slice_of, slices_for, tidy, unpack
from epochal.llm._spark import cut, table
from epochal.llm._text import RangeHash, U, Words, chunks, mix64, signed, to_bytes

MIN_SENTENCES, MIN_WORDS, LONG_SENTENCE = 2, 20, 50
PASSAGE, PIECE = 51, 26
FLUSH, SLICES, SLICE_BYTES, NO_ID = 2_000_000, 24, 24_000_000, np.iinfo(np.int64).max
#: In place of a run's number of sentences (MIN_WORDS at most).
OF_PIECE = 255
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True


def _pieces(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the pieces, in order."""
    n = len(w.hash)
    if n < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - PIECE + 1)
    h = mix64(RangeHash(w.hash)(at, at + PIECE) ^ U(0x70696563))
    best, size, of = at, 1, PASSAGE - PIECE + 1
    while size < of:  # best: place of the first smallest hash of the next size ones
        step = min(size, of - size)
        a, b = best[:-step], best[step:]
        best, size = np.where(h[b] < h[a], b, a), size + step
    best = best[w.doc[: len(best)] == w.doc[PASSAGE - 1 :]]
    best = np.unique(best)
    return best, h[best]


class Sentences:
    """Sentences of some texts: at (first word), doc; of each text count, and first (its first sentence)."""

    def __init__(self, texts: list[bytes | None]):
        self.w = w = Words(texts)
        n = len(w.start)
        new = np.ones(n, bool)
        if n:
            lines = np.concatenate([[0], np.cumsum(w.data == 10)])
            new[1:] = (w.doc[1:] != w.doc[:-1]) | _STOPS[w.data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
        self.at = np.flatnonzero(new)
        self.doc = w.doc[self.at]
        self.word_first = np.cumsum(w.per_doc) - w.per_doc
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, doc, first sentence or word of the doc, number of sentences or OF_PIECE) of all runs and pieces."""
        w, at = self.w, self.at
        size = np.diff(np.append(at, len(w.start)))
        h = mix64(RangeHash(w.hash)(at, at + size)) if len(at) else np.zeros(0, U)
        m, total, at = len(at), np.cumsum(size), np.arange(len(at))
        last = np.maximum(np.searchsorted(total, total - size + MIN_WORDS), at + MIN_SENTENCES - 1)
        first = np.minimum(np.searchsorted(total - size, total - MIN_WORDS, side="right") - 1, at - MIN_SENTENCES + 1)
        alone = np.flatnonzero(size >= LONG_SENTENCE)
        i, j = np.concatenate([at, first, alone]), np.concatenate([last, at, alone])
        ok = (i >= 0) & (j < m)
        i, j = i[ok], j[ok]
        ok = self.doc[i] == self.doc[j]
        every = np.unique(i[ok] * m + j[ok])
        i, j = (every // m, every % m) if m else (every, every)
        doc = self.doc[i]
        piece, piece_hash = _pieces(w)
        piece_doc = w.doc[piece]
        run_hash = RangeHash(h)(i, j + 1) if m else np.zeros(0, U)
        return (
            np.concatenate([run_hash, piece_hash]), np.concatenate([doc, piece_doc]),
            np.concatenate([i - self.first[doc], piece - self.word_first[piece_doc]]),
            np.concatenate([j - i + 1, np.full(len(piece), OF_PIECE)]),
        )

    def kept(self, r: int, text: bytes, first: np.ndarray, size: np.ndarray) -> tuple[bytes, int]:
        """(text that stays of text r, number of its sentences that lost words)."""
        w, base, n = self.w, self.word_first[r], self.w.per_doc[r]
        at = np.append(self.at[self.first[r] : self.first[r] + self.count[r]] - base, n)
        piece = size == OF_PIECE
        turn = np.zeros(n + 1, np.int64)
        begin = np.concatenate([first[piece], at[first[~piece]]])
        end = np.concatenate([first[piece] + PIECE, at[(first + size)[~piece]]])
        np.add.at(turn, begin, 1)
        np.add.at(turn, end, -1)
        lost = np.cumsum(turn[:-1]) > 0
        start = w.ends[r - 1] if r else 0
        edges = [*(w.start[base : base + n] - start).tolist(), len(text)]
        turn = np.diff(np.concatenate([[0], (~lost).astype(np.int8), [0]]))
        spans = zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)
        out = text[: edges[0]] + b"".join(text[edges[i] : edges[j]] for i, j in spans)
        return out, int(np.logical_or.reduceat(lost, at[:-1]).sum())


def _pack_marks(n_slices: int, ids: np.ndarray, fp: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Marks to the slices of their documents: ids, fingerprints, numbers of marks, first ones, sizes."""
    order = np.lexsort((ids, fp))
    ids, fp, first, size = ids[order], fp[order], first[order].astype(np.uint32), size[order].astype(np.uint8)
    bounds = np.searchsorted(slice_of(fp, n_slices), np.arange(n_slices + 1))
    for s in range(n_slices):
        i, j = bounds[s], bounds[s + 1]
        if j > i:
            at = np.flatnonzero(np.concatenate([[True], (fp[i + 1 : j] != fp[i : j - 1]) | (ids[i + 1 : j] != ids[i : j - 1])]))
            yield s, pack(ids[i:j][at], fp[i:j][at], np.diff(np.append(at, j - i)).astype(np.uint32), first[i:j], size[i:j])


def _again(h: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows that are not the first of their hash, by place: its columns in order of weight."""
    order = np.argsort(h, kind="stable")
    first, count = runs(h[order])
    some = order[np.repeat(count > 1, count)]
    some = some[np.lexsort((*(p[some] for p in reversed(place)), h[some]))]
    x = h[some]
    new = np.ones(len(some), bool)
    new[1:] = x[1:] != x[:-1]
    start = some[np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(some))))]
    differ = np.any([p[some] != p[start] for p in place], axis=0) if len(some) else np.zeros(0, bool)
    return some[differ]  # equal places are one occurrence, in a repeated row


def _runs(n_slices: int):
    """First occurrences of a flush (6 arrays) to the slices of their hashes; marks of its other ones (5) to those of documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            ids, fp = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            base = np.cumsum([0, *(len(x[0]) for x in held)])[:-1]
            h, first, size = (np.concatenate([x[k] for x in held]) for k in (2, 4, 5))
            doc = np.concatenate([x[3] + b for x, b in zip(held, base, strict=True)])
            again = _again(h, ids[doc], fp[doc], first, size)
            yield from _pack_marks(n_slices, ids[doc[again]], fp[doc[again]], first[again], size[again])
            stay = np.ones(len(h), bool)
            stay[again] = False
            h, doc, first, size = h[stay], doc[stay], first[stay], size[stay]
            order = np.argsort(h)
            bounds = np.searchsorted(slice_of(h[order], n_slices), np.arange(n_slices + 1))
            for s in range(n_slices):
                x = order[bounds[s] : bounds[s + 1]]
                if len(x):
                    docs, number = np.unique(doc[x], return_inverse=True)
                    small = np.uint16 if len(docs) < 65536 else np.uint32
                    yield s, pack(h[x], number.astype(small), first[x].astype(np.uint32), size[x].astype(np.uint8), ids[docs], fp[docs])

        def rows():
            held, total = [], 0
            for b in it:
                texts = to_bytes(b.column(2))
                ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                fp = b.column(1).to_numpy(zero_copy_only=False).view(U)
                for i, j in chunks(texts):
                    held.append((ids[i:j], fp[i:j], *Sentences(texts[i:j]).marks()))
                    total += len(held[-1][2])
                    if total >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if held:
                yield from out(held)

        yield from batches(rows())

    return run


def _find(n_slices: int):
    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        yield from batches((s, pack(*x)) for x in parts if len(x) == 5)
        parts = [x for x in parts if len(x) == 6]
        if parts:
            h, first, size = (np.concatenate([x[k] for x in parts]) for k in (0, 2, 3))
            ids, fp = (np.concatenate([x[k][x[1]] for x in parts]) for k in (4, 5))
            again = _again(h, ids, fp, first, size)
            yield from batches(_pack_marks(n_slices, ids[again], fp[again], first[again], size[again]))

    return fn


_MARKS = "id long, fp long, first binary, size binary"


def _gather(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One row per document that has marks."""
    parts = [unpack(b) for b in blobs]
    ids, fp = (np.concatenate([np.repeat(x[k], x[2]) for x in parts]) for k in (0, 1))
    first, size = (np.concatenate([x[k] for x in parts]) for k in (3, 4))
    order = np.lexsort((size, first, ids, fp))
    ids, fp, first, size = ids[order], fp[order], first[order], size[order]
    new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (ids[1:] != ids[:-1])])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(fp))
    for k in range(0, len(at), 10_000):
        pair = list(zip(at[k : k + 10_000].tolist(), ends[k : k + 10_000].tolist(), strict=True))
        x = at[k : k + 10_000]
        cols = [pa.array([v[a:b].tobytes() for a, b in pair], pa.binary()) for v in (first, size)]
        yield pa.record_batch([pa.array(ids[x], mask=ids[x] == NO_ID), pa.array(signed(fp[x])), *cols], ["id", "fp", "first", "size"])


def _rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, first, size, rest) with the marked words taken out: (number of sentences, number that lost words, text, rest)."""
    for b in it:
        texts, first, size = to_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()
        out, n, gone = list(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j in chunks(texts):
            s = Sentences(texts[i:j])
            n[i:j] = s.count
            for r in range(i, j):
                if first[r]:
                    out[r], gone[r] = s.kept(r - i, texts[r], np.frombuffer(first[r], np.uint32).astype(np.int64), np.frombuffer(size[r], np.uint8).astype(np.int64))
        new = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(gone), new, b.column(3)], ["n", "gone", "text", "rest"])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with repeated sentences and pieces taken out of the text, and ``n_sentences`` and ``n_removed`` added (or replaced).

    n_removed: sentences that lost words, all of them or the words of a piece.
    """
    n = slices_for(docs, SLICE_BYTES, SLICES, text)
    rest = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed") and c != text]
    body = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("fp"),
        F.col(f"`{text}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"),
    )
    sent = body.select("id", "fp", "text").where(F.length("text") > 0).mapInArrow(tidy(_runs(n)), SLICED)
    marks = cut(gathered(gathered(sent, n, _find(n), SLICED), n, _gather, _MARKS))
    same = (body["fp"] == marks["fp"]) & body["id"].eqNullSafe(marks["id"])
    ready = body.join(marks, same, "left").select(body["text"], "first", "size", "rest")
    schema = [StructField("n", LongType()), StructField("gone", LongType()), StructField("text", StringType()), StructField("rest", ready.schema["rest"].dataType)]
    done = ready.mapInArrow(tidy(_rewrite), StructType(schema))
    kept = (F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c == text or c in rest)
    return done.select(*kept, F.col("n").alias("n_sentences"), F.col("gone").alias("n_removed"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("text", F.lit(""))
    return remove_repeated_spans(docs).select(
        "doc_id", "n_sentences", "n_removed", F.octet_length(kept).cast("long").alias("n_kept_bytes"), F.sha2(kept, 256).alias("kept_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated spans; a document of which nothing is left goes."""
    done = remove_repeated_spans(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """The same by plain Python over (id, text), ids distinct. For tests."""
    import re

    runs, cutting, pieces, words = {}, {}, {}, {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        parts, start = [], 0
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        for k, m in enumerate(found):
            if k + 1 == len(found) or m[0][-1] in ".!?" or "\n" in text[m.end() : found[k + 1].start()]:
                parts.append(found[start : k + 1])
                start = k + 1
        cutting[i] = parts
        found_runs = set()
        for k in range(len(parts)):
            if len(parts[k]) >= LONG_SENTENCE:
                found_runs.add((k, k))
            enough = lambda a, b: b - a + 1 >= MIN_SENTENCES and sum(map(len, parts[a : b + 1])) >= MIN_WORDS  # noqa: E731, B023
            found_runs |= {(k, b) for b in [next((b for b in range(k, len(parts)) if enough(k, b)), None)] if b is not None}
            found_runs |= {(a, k) for a in [next((a for a in range(k, -1, -1) if enough(a, k)), None)] if a is not None}
        for a, b in found_runs:
            key = tuple(tuple(m[0].translate(low) for m in p) for p in parts[a : b + 1])
            runs.setdefault(key, []).append((i, a, b))
        words[i] = [m[0].translate(low) for m in found]
        # the order of pieces is the operator's: by hash
        sums = RangeHash(Words([(text or "").encode()]).hash)
        rank = [int(mix64(sums(np.array([k]), np.array([k + PIECE])) ^ U(0x70696563))[0]) for k in range(len(found) - PIECE + 1)]
        for at in {min(range(k, k + PASSAGE - PIECE + 1), key=lambda p: (rank[p], p)) for k in range(len(found) - PASSAGE + 1)}:
            pieces.setdefault(tuple(words[i][at : at + PIECE]), []).append((i, at))
    gone = {(i, k) for v in runs.values() for i, a, b in sorted(v)[1:] for k in range(a, b + 1)}
    cut_out = {(i, k) for v in pieces.values() for i, at in sorted(v)[1:] for k in range(at, at + PIECE)}
    out = {}
    for i, text in rows:
        flat = [(k, m) for k, p in enumerate(cutting[i]) for m in p]
        edges = [m.start() for _, m in flat] + [len(text or "")]
        stays = [text[edges[x] : edges[x + 1]] for x, (k, _) in enumerate(flat) if (i, k) not in gone and (i, x) not in cut_out]
        out[i] = text[: edges[0]] + "".join(stays) if flat else text
    return out


hash_of = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
