"""Language-model scoring by a hierarchical Pitman-Yor model.

Restaurants: (language, class of the word before) -> (language) -> one root -> an open vocabulary. Context restaurants share
their parents: a table of a restaurant is a customer of its parent. A class is a hash of the word before (8,192 classes a language
with up to eight languages), so that a frequent word has a class nearly of its own and totals of all restaurants fit in
RESTAURANTS numbers whatever the corpus; dishes (class, word) grow with it. The root's base measure is spread over words never
seen: every known word has one table there and the new-table mass is the probability of an unknown word, so that known words and
"unknown" sum to one in every context.

Seating is sampled by Gibbs. In a round all customers of every dish of each restaurant, of contexts and of languages, leave
together and are seated again: the dish's number of tables is drawn from its exact distribution given all other dishes, by
generalised Stirling numbers (``_tables``), where the seatings with that number are summed out. Probabilities need no more than these
numbers. The law is that of the Chinese-restaurant rule, and the same for dishes of any size. Dishes of a parent of few dishes are drawn
together with the parent's number. Dishes of a slice are drawn in groups one after another, those of one parent in different ones
as far as they go. ``sweeps``, customer by customer, has the same law and is for tests only. Seating starts near the expected number of tables; after BURN_IN rounds it is kept SAMPLES times,
BETWEEN rounds apart, and a token's probability is the average of the kept seatings' predictive ones. Discounts come from counts of
counts at each level, strengths from totals by the expectations of the usual auxiliary variables.

Words are dealt by hash: all restaurants' seatings of a word are in one slice. Slices run at the same time with the totals of all
restaurants (summed in ranges; the driver sees the sums) to which each adds its own changes; during burn-in each takes its own
words for a fair part of all. Counts pre-aggregate in the sender. For scoring, texts are dealt as (document, word, context, count)
arrays and each slice answers with its part of every document's sums; no dictionary is broadcast, so the vocabulary may
grow with the corpus. The number of slices follows the size of the input.

Null and empty texts are one end token. A null language is a language of its own; beyond 4,096 languages they share numbers by hash.
Ids are integers (or strings of integers); other ids are an error. Null ids count as the empty text for the held-out rule. Repeated
rows are scored each. An empty table gives no rows. Extra columns are not read. Sums of parts vary in the last bits.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm._packed import SLICED, batches, gathered, grow, pack, ragged, runs, shrink, slice_of, slices_for, unpack
from epochal.llm._spark import cut, table
from epochal.llm._tables import Stirling, climb, draw_within
from epochal.llm._text import RangeHash, U, Words, chunks, mix64, signed, to_bytes

BURN_IN, SAMPLES, BETWEEN = 8, 3, 4
#: Context restaurants of all languages, and the most languages that are told apart.
RESTAURANTS, LANGUAGES = 1 << 16, 1 << 12
FLUSH, SLICES, SLICE_BYTES = 3_000_000, 24, 24_000_000
#: So many dishes of a slice and level, those with most customers away from the largest table, are swept one by one, the others together;
#: so many move customers one by one.
ALONE, FEW = 64, 32
#: Dishes of a slice and level are drawn in so many groups one after another; those of a parent of at most CLOSE dishes, together with its tables.
GROUPS, CLOSE = 32, 4
HELD_OUT = 10
END, START = mix64(np.array([0xE0D, 0xB0E], U))


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode() if i is not None else b"") % HELD_OUT == 0


class Languages:
    """Numbers of language codes, and bits of a class."""

    def __init__(self, codes: list[int]):
        self.codes = np.unique(np.array(codes, np.int64)) if len(codes) <= LANGUAGES else np.arange(LANGUAGES)
        self.n = max(1, len(self.codes))
        self.bits = RESTAURANTS.bit_length() - 1 - (self.n - 1).bit_length()
        self.size = self.n << self.bits

    def number(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, code % LANGUAGES if self.n == LANGUAGES else code)

    def of(self, context: np.ndarray) -> np.ndarray:
        return context.astype(np.int64) >> self.bits


def _tokens(texts: list[bytes | None], number: np.ndarray, langs: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, token hash, context) of all tokens, end tokens included, and a hash of each text."""
    w, n = Words(texts), len(texts)
    kind = lambda h: (mix64(h ^ U(0xC1A55)) >> U(64 - langs.bits)).astype(np.int64)
    of, start = kind(w.hash), int(kind(np.array([START]))[0])
    has = w.per_doc > 0
    before = np.empty_like(of)
    before[1:] = of[:-1]
    before[(np.cumsum(w.per_doc) - w.per_doc)[has]] = start
    last = np.full(n, start)
    last[has] = of[(np.cumsum(w.per_doc) - 1)[has]]
    text = RangeHash(w.data)(np.concatenate([[0], w.ends[:-1]]).astype(np.int64), w.ends - 1)
    doc = np.concatenate([w.doc, np.arange(n)])
    context = (number[doc] << langs.bits | np.concatenate([before, last])).astype(np.uint16)
    return doc, np.concatenate([w.hash, np.full(n, END)]), context, text


def _distinct(h: np.ndarray, *low: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(words, number of entries of each, lower columns, counts) of the distinct rows (word, *low), in order; low: (column, bits)."""
    words, key = np.unique(h, return_inverse=True)
    key = key.astype(U)
    for x, bits in low:
        key = key << U(bits) | x.astype(U)
    key = np.sort(key)
    first, count = runs(key)
    key = key[first]
    cols = []
    for _, bits in reversed(low):
        cols.append((key & U((1 << bits) - 1)).astype(np.int64))
        key = key >> U(bits)
    return words, np.bincount(key.astype(np.int64), minlength=len(words)), cols[::-1], count


def _by_slice(n_slices: int, words: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
    """(slice, its words, their entries): words are in order."""
    cuts = np.searchsorted(slice_of(words, n_slices), np.arange(n_slices + 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    for s in range(n_slices):
        if cuts[s + 1] > cuts[s]:
            yield s, slice(cuts[s], cuts[s + 1]), slice(ends[cuts[s]], ends[cuts[s + 1]])


def _read(b: pa.RecordBatch, langs: Languages) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    return b.column(0), langs.number(b.column(1).to_numpy(zero_copy_only=False)), to_bytes(b.column(2))


def _train(n_slices: int, langs: Languages):
    """To each word slice: words, numbers of contexts of each, contexts, counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            words, size, (context,), c = _distinct(np.concatenate([x[0] for x in held]), (np.concatenate([x[1] for x in held]), 16))
            for s, w, e in _by_slice(n_slices, words, size):
                yield s, pack(words[w], *shrink(size[w]), context[e].astype(np.uint16), *shrink(c[e]))

        def rows():
            held, total = [], 0
            for b in it:
                ids, number, texts = _read(b, langs)
                learn = np.array([not held_out(i) for i in ids.to_pylist()], bool)
                for i, j in chunks(texts):
                    doc, h, context, _ = _tokens(texts[i:j], number[i:j], langs)
                    ok = learn[i:j][doc]
                    held.append((h[ok], context[ok]))
                    total += int(ok.sum())
                    if total >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if total:
                yield from out(held)

        yield from batches(rows())

    return run


def views(**arrays: np.ndarray) -> SimpleNamespace:
    """The same memory for reads and writes of single numbers, which are several times faster than an array's."""
    return SimpleNamespace(**{k: memoryview(x) for k, x in arrays.items()})


class Seats:
    """Customers at the tables of many dishes: c customers and t tables of each dish, and at which table each customer is.

    A dish has ``room`` numbers from ``o`` on: for its customers' tables (``table``, in no order that tells of tables once shuffled)
    and for customers at a table (``at_table``; 0: no such table).

    Most customers of a dish are at one large table, ``home``, and most of those return to it when they are seated again, which changes
    nothing. A sweep draws how many do so in a row, until one does not, by the geometric law of as many single draws.
    """

    def __init__(self, c: np.ndarray, t: np.ndarray, size: np.ndarray, most: np.ndarray | None = None):
        """size: those of the tables of dishes of several tables, in a row; most: customers of each dish at any time, if more than c."""
        self.c, self.t = c.astype(np.int64), t.astype(np.int64)
        most = self.c if most is None else most
        self.room = most + most // 2 + 1  # a third is free, so that a random number soon is
        self.o = np.cumsum(self.room) - self.room
        self.table, self.at_table = np.zeros((2, int(self.room.sum())), np.int32)
        at, many = ragged(self.o, self.t), np.repeat(self.t > 1, self.t)
        every = np.repeat(self.c, self.t)
        every[many] = size
        self.at_table[at] = every
        self.table[ragged(self.o, self.c)] = np.repeat(at - np.repeat(self.o, self.t), every)
        self.home, self.list = self.table[self.o].copy(), np.zeros_like(self.table)
        self.view = views(home=self.home, c=self.c, t=self.t, room=self.room, o=self.o, table=self.table, at_table=self.at_table)

    @classmethod
    def start(cls, c: np.ndarray, a: np.ndarray, d: float, most: np.ndarray | None = None) -> Seats:
        """About as many tables as c customers open; a as in ``sit``. All but the first table have one customer."""
        t = np.clip(np.round(1 + a * np.log((a + c - d) / (a + 1 - d))), 1, c).astype(np.int64)
        some = t[t > 1]
        size = np.ones(int(some.sum()), np.int64)
        size[np.cumsum(some) - some] += (c - t)[t > 1]
        return cls(c, t, size, most)

    @property
    def several(self) -> np.ndarray:
        """Dishes of more than one table."""
        return np.flatnonzero(self.t > 1)

    @property
    def size(self) -> np.ndarray:
        """Sizes of the tables of ``several``, in a row."""
        x = self.at_table[ragged(self.o[self.several], self.room[self.several])]
        return x[x > 0].astype(np.int64)

    def shuffle(self, rng: np.random.Generator) -> None:
        """Customers of a dish in random order: tables do not tell who is next."""
        c = self.c[self.several]
        at = ragged(self.o[self.several], c)
        self.table[at] = self.table[at[np.argsort(np.repeat(np.arange(len(c)), c) + rng.random(len(at)))]]

    def leave(self, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """One random customer leaves each of the dishes ``at`` (distinct, with a customer or more). True: its table closes.

        The last customer takes its number, and ``sit`` gives the last number.
        """
        o, c = self.o[at], self.c[at]
        p = o + (rng.random(len(at)) * c).astype(np.int64)
        k = o + self.table[p]
        self.table[p] = self.table[o + c - 1]
        left = self.at_table[k] - 1
        self.at_table[k] = left
        closed = left == 0
        self.c[at] = c - 1
        self.t[at] -= closed
        return closed

    def sit(self, at: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
        """One customer comes to each of the dishes; a: (strength + d * tables) * the parent's probability. True: a table opens."""
        o, c, t = self.o[at], self.c[at], self.t[at]
        old = c - d * t
        r = rng.random(len(at)) * (a + old) - a
        opened = (r < 0) | (t == 0)
        table = np.zeros(len(at), np.int64)
        more = np.flatnonzero(~opened)
        first, many = o[more], c[more]
        r = r[more] * (many / old[more])
        while len(more):  # in proportion to size less d: of a random customer, kept with (size - d) / size
            who = np.minimum(r.astype(np.int64), many - 1)
            table[more] = k = self.table[first + who]
            size = self.at_table[first + k]
            again = np.flatnonzero(((r - who) * size >= size - d) & (t[more] > 1))
            more, first, many = more[again], first[again], many[again]
            r = rng.random(len(more)) * many
        more = np.flatnonzero(opened)
        k, room = c[more], self.room[at[more]]
        while len(more):  # a free number
            table[more] = k
            busy = self.at_table[o[more] + k] > 0
            more, room = more[busy], room[busy]
            k = (rng.random(len(more)) * room).astype(np.int64)
        self.at_table[o + table] += 1
        self.table[o + c] = table
        self.c[at] = c + 1
        self.t[at] = t + opened
        return opened

    def leave_one(self, i: int, draw: Callable[[], float]) -> bool:
        """``leave`` of one dish."""
        v = self.view
        o, c = v.o[i], v.c[i]
        p = o + int(draw() * c)
        k = o + v.table[p]
        v.table[p] = v.table[o + c - 1]
        left = v.at_table[k] - 1
        v.at_table[k] = left
        v.c[i] = c - 1
        v.t[i] -= not left
        return not left

    def sit_one(self, i: int, a: float, d: float, draw: Callable[[], float]) -> bool:
        """``sit`` of one dish."""
        v = self.view
        o, c, t = v.o[i], v.c[i], v.t[i]
        opened = not t or draw() * (a + c - d * t) < a
        if opened:
            k = c
            while v.at_table[o + k]:
                k = int(draw() * v.room[i])
        else:
            k = v.table[o + int(draw() * c)]
            while t > 1 and draw() * (size := v.at_table[o + k]) >= size - d:
                k = v.table[o + int(draw() * c)]
        v.at_table[o + k] += 1
        v.table[o + c] = k
        v.c[i] = c + 1
        v.t[i] = t + opened
        return opened

    def away(self, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A home for each of the dishes, the largest table or a large one; numbers of customers elsewhere, who are put in ``list``."""
        o, c = self.o[at], self.c[at]
        other = self.table[o + (rng.random(len(at)) * c).astype(np.int64)]
        home = np.where(self.at_table[o + other] > self.at_table[o + self.home[at]], other, self.home[at])
        self.home[at] = home
        n = c - self.at_table[o + home]
        some = np.flatnonzero(n)
        o, c, n = o[some], c[some], n[some]
        places = ragged(o, c)
        far = np.flatnonzero(self.table[places] != np.repeat(home[some], c))
        self.list[ragged(o, n)] = places[far] - np.repeat(o, n)
        out = np.zeros(len(at), np.int64)
        out[some] = n
        return out

    def largest(self, at: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Dishes and ``away`` of each, the ALONE with most in front."""
        far = self.away(at, rng)
        if len(at) > ALONE > 0:
            order = np.argpartition(-far, ALONE)
            at, far = at[order], far[order]
        return at, far

    def sweep(self, at: np.ndarray, far: np.ndarray, mass: Callable, less: Callable, moved: Callable, d: float, rng: np.random.Generator) -> None:
        """Every customer of each of the dishes leaves and is seated again, by the rule of ``sit``, in the order of their numbers.

        far: customers of each that are not at home, listed. mass, less: a of dishes as in ``sit``, and where a table has closed;
        moved: called with dishes and the changes of their numbers of tables. The next change of each dish is made at a time.
        """
        i, m0, m, e, p = at, far, far.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(i):
            o, c, t, home = self.o[i], self.c[i], self.t[i], self.home[i]
            a, n = mass(i), self.at_table[o + home]
            with np.errstate(divide="ignore"):
                back = (n - 1 - d) / (a + (c - 1) - d * t)  # the odds that one from home returns
                after = np.log1p(-rng.random(len(i))) / np.minimum(np.log(np.where(n > 1, back, 0.0)), -1e-17)
            far_next = np.where(e < m0, self.list[o + np.minimum(e, m0)], c)
            leaves = p + after < far_next  # one from home, before the next of the others
            go = np.flatnonzero(leaves | (far_next < c))
            i, m0, m, e, p, o, c, t, home, a, after, far_next, leaves = (x[go] for x in (i, m0, m, e, p, o, c, t, home, a, after, far_next, leaves))
            who = far_next
            who[leaves] = p[leaves] + after[leaves].astype(np.int64)
            e, p = e + ~leaves, who + 1
            k = self.table[o + who]
            left = self.at_table[o + k] - 1
            self.at_table[o + k] = left
            closed = left == 0
            if len(x := np.flatnonzero(closed)):
                a[x] = less(i[x])
            t = t - closed
            n = self.at_table[o + home]
            here = n > 0
            others = t - here  # tables
            at_home = np.where(here & ~leaves, n - d, 0)
            r = rng.random(len(i)) * (a + at_home + np.where(others > 0, (c - 1 - n) - d * others, 0)) - a
            opened = (r < 0) | (t == 0) | ((others == 0) & leaves)
            table = home.copy()
            more = np.flatnonzero(~opened & (r >= at_home) & (others > 0))
            while len(more):  # one of those listed, who may have come home, kept with (size - d) / size
                first, z = o[more], rng.random(len(more)) * m[more]
                x = z.astype(np.int64)
                one = self.list[first + x]
                table[more] = to = self.table[first + one]
                size = self.at_table[first + to]
                more = more[(to == home[more]) | (one == who[more]) | ((z - x) * size >= size - d)]
            more = np.flatnonzero(opened)
            free, room = np.where(closed[more], k[more], who[more]), self.room[i[more]]
            while len(more):
                table[more] = free
                busy = self.at_table[o[more] + free] > 0
                more, room = more[busy], room[busy]
                free = (rng.random(len(more)) * room).astype(np.int64)
            self.at_table[o + table] += 1
            self.table[o + who] = table
            self.t[i] = t + opened
            x = np.flatnonzero(leaves)
            self.list[o[x] + m[x]] = who[x]
            m = m + leaves
            if len(x := np.flatnonzero(opened != closed)):
                moved(i[x], np.where(opened[x], 1, -1))

    def sweep_one(self, i: int, far: int, mass: Callable[[bool], float], moved: Callable[[int], None], d: float, draw: Callable[[], float]) -> None:
        """``sweep`` of one dish; mass: with the customer's table closed or not."""
        v = self.view
        o, c, t, room, home = v.o[i], v.c[i], v.t[i], v.room[i], v.home[i]
        table, at_table, listed = v.table[o : o + c], v.at_table[o : o + room], self.list[o : o + far].tolist()
        a, e, p = mass(False), 0, 0
        while True:
            who = listed[e] if e < far else c
            leaves = False
            if p < who:
                n, after = at_table[home], 0
                if n > 1:
                    after = math.log(1 - draw()) / min(math.log((n - 1 - d) / (a + (c - 1) - d * t)), -1e-17)
                if leaves := p + after < who:
                    who = p + int(after)
            if who == c:
                return
            e, p = e + (not leaves), who + 1
            k = table[who]
            left = at_table[k] - 1
            at_table[k] = left
            new = a
            if not left:
                t -= 1
                new = mass(True)
            n = at_table[home]
            others = t - (n > 0)
            at_home = n - d if n and not leaves else 0.0
            r = draw() * (new + at_home + ((c - 1 - n) - d * others if others else 0.0)) - new
            if r < 0 or not t or (not others and leaves):
                t += 1
                while at_table[k]:
                    k = int(draw() * room)
                change = 1 if left else 0
            else:
                k, change = home, 0 if left else -1
                if r >= at_home and others:
                    while True:
                        one = listed[int(draw() * len(listed))]
                        k = table[one]
                        if k != home and one != who and draw() * (size := at_table[k]) < size - d:
                            break
            if change:
                v.t[i] = t
                moved(change)
                a = mass(False)
            at_table[k] += 1
            table[who] = k
            if leaves:
                listed.append(who)

    def take(self, at: np.ndarray) -> Seats:
        """Seats of some dishes (in order)."""
        x = self.at_table[ragged(self.o[some := at[self.t[at] > 1]], self.room[some])]
        return Seats(self.c[at], self.t[at], x[x > 0])

    def put(self, at: np.ndarray, other: Seats) -> None:
        """Those of ``take`` in their places again."""
        self.at_table[ragged(self.o[at], self.room[at])] = 0
        t, c = np.repeat(self.o[at] - other.o, other.room), ragged(other.o, other.c)
        self.at_table[np.arange(len(t)) + t] = other.at_table
        self.table[c + np.repeat(self.o[at] - other.o, other.c)] = other.table[c]
        self.c[at], self.t[at] = other.c, other.t


class Tables:
    """Customers and numbers of tables of many dishes."""

    def __init__(self, c: np.ndarray, t: np.ndarray):
        self.c, self.t = c.astype(np.int64), t.astype(np.int64)

    @classmethod
    def start(cls, c: np.ndarray, a: np.ndarray, d: float) -> Tables:
        """About as many tables as c customers open; a: (strength + d * tables) * the parent's probability."""
        return cls(c, np.clip(np.round(1 + a * np.log((a + c - d) / (a + 1 - d))), 1, c))

    @property
    def several(self) -> np.ndarray:
        """Dishes of more than one table."""
        return np.flatnonzero(self.t > 1)

    @property
    def size(self) -> np.ndarray:
        """Sizes of tables of ``several``, in a row, in one of the seatings with these numbers: all but the first have one customer."""
        t = self.t[self.several]
        out = np.ones(int(t.sum()), np.int64)
        out[np.cumsum(t) - t] += self.c[self.several] - t
        return out


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def strength(c: np.ndarray, t: np.ndarray, d: float) -> float:
    """Concentration of restaurants of c customers at t tables with discount d, under a Gamma(1, 1) prior."""
    c, t = c[c > 0].astype(float), t[c > 0].astype(float)
    s = 1.0
    for _ in range(30):
        tables = 1 + (s / d) * (_digamma(s / d + t) - _digamma(s / d + 1)).sum()
        s = float(tables / (1 + (_digamma(s + c) - _digamma(np.array([s + 1.0]))).sum()))
        s = min(max(s, 1e-3), 1e6)
    return s


class Totals:
    """Customers and tables of every restaurant of one seating, discounts and strengths by level.

    As a vector: contexts' customers; V, and dishes of one and of two customers; contexts' tables; languages' tables; dishes of one
    and two customers of languages and root.
    """

    def __init__(self, fixed: np.ndarray, seating: np.ndarray, langs: Languages):
        n = langs.size
        self.C2, (self.V, *a) = fixed[:n].astype(float), fixed[n:]
        self.T2, self.T1 = seating[:n].astype(float), seating[n : n + langs.n].astype(float)
        few = [a, seating[n + langs.n : n + langs.n + 2], seating[n + langs.n + 2 :]]
        self.d2, self.d1, self.d0 = (float(min(0.98, max(0.02, x / (x + 2 * y)))) if x else 0.5 for x, y in few)
        self.C1, self.C0, self.N = self.T2.reshape(langs.n, -1).sum(axis=1), float(self.T1.sum()), int(self.C2.sum())
        self.s2, self.s1 = strength(self.C2, self.T2, self.d2), strength(self.C1, self.T1, self.d1)
        self.s0 = strength(np.array([self.C0]), np.array([self.V]), self.d0)
        # the part of each restaurant that its parent serves; of the root: that goes to words never seen
        self.new2 = (self.s2 + self.d2 * self.T2) / (self.s2 + self.C2)
        self.new1 = (self.s1 + self.d1 * self.T1) / (self.s1 + self.C1)
        self.new0 = (self.s0 + self.d0 * self.V) / (self.s0 + self.C0)


class Dishes:
    """The words of a slice: w (in order); (word, language) with word1, lang1; (word, context) with word2, middle, context, c."""

    def __init__(self, w: np.ndarray, word2: np.ndarray, context: np.ndarray, c: np.ndarray, langs: Languages):
        self.w, self.word2, self.context, self.c, self.langs = w, word2, context.astype(np.int64), c.astype(np.int64), langs
        pair = word2 * langs.n + langs.of(self.context)
        first, _ = runs(pair)
        self.word1, self.lang1 = pair[first] // langs.n, pair[first] % langs.n
        self.middle = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        self.many = np.flatnonzero(self.c > 1)  # a dish of one customer has one table

    def packed(self) -> list[np.ndarray]:
        return [self.w, *shrink(np.bincount(self.word2, minlength=len(self.w))), self.context.astype(np.uint16), *shrink(self.c)]

    @classmethod
    def unpacked(cls, x: list[np.ndarray], langs: Languages) -> Dishes:
        return cls(x[0], np.repeat(np.arange(len(x[0])), grow(x[1], x[2])), x[3], grow(x[4], x[5]), langs)

    def t2(self, many: np.ndarray) -> np.ndarray:
        out = np.ones(len(self.c), np.int64)
        out[self.many] = many
        return out

    def c1(self, t2: np.ndarray) -> np.ndarray:
        return np.bincount(self.middle, t2, len(self.word1)).astype(np.int64)

    def c0(self, t1: np.ndarray) -> np.ndarray:
        return np.bincount(self.word1, t1, len(self.w)).astype(np.int64)

    def fixed(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.context, self.c, self.langs.size), [len(self.w), (self.c == 1).sum(), (self.c == 2).sum()]]).astype(np.int64)

    def seating(self, many: np.ndarray, t1: np.ndarray) -> np.ndarray:
        t2 = self.t2(many)
        c1, c0 = self.c1(t2), self.c0(t1)
        few = [(c1 == 1).sum(), (c1 == 2).sum(), (c0 == 1).sum(), (c0 == 2).sum()]
        return np.concatenate([np.bincount(self.context, t2, self.langs.size), np.bincount(self.lang1, t1, self.langs.n), few]).astype(np.int64)

    def seated(self, g: Totals) -> tuple[Tables, Tables]:
        """Tables to start from."""
        share = self.c1(self.c) / np.maximum(g.C2.reshape(self.langs.n, -1).sum(axis=1), 1)[self.lang1]  # of the word in the language
        low = Tables.start(self.c[self.many], (g.s2 + g.d2 * g.T2[self.context[self.many]]) * share[self.middle[self.many]], g.d2)
        return low, Tables.start(self.c1(self.t2(low.t)), (g.s1 + g.d1 * g.T1[self.lang1]) / max(g.V, 1.0), g.d1)


class Middle:
    """The middle level of a slice while it is seated: seats of (word, language) and what changes with them."""

    def __init__(self, x: Dishes, up: Seats, g: Totals, rng: np.random.Generator):
        self.x, self.up, self.g, self.rng, self.c0 = x, up, g, rng, x.c0(up.t)
        self.draw = random.Random(int(rng.integers(1 << 62))).random
        self.view = views(lang=x.lang1, word=x.word1, c0=self.c0, T1=g.T1, C1=g.C1)

    def p0(self, word: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
        """Of words, with ``less`` tables of them away."""
        return np.maximum(self.c0[word] - less - self.g.d0, 0) / (self.g.s0 + self.g.C0 - less)

    def mass(self, at: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
        """Odds of a new table of (word, language), with ``less`` of its tables away."""
        return (self.g.s1 + self.g.d1 * (self.g.T1[self.x.lang1[at]] - less)) * self.p0(self.x.word1[at], less)

    def probability(self, at: np.ndarray | slice, away: int = 0, less: np.ndarray | int = 0) -> np.ndarray:
        """Of (word, language), with ``away`` customers and ``less`` tables of it away."""
        g, c = self.g, self.up.c[at] - away
        own = np.maximum(c - g.d1 * (self.up.t[at] - less), 0)
        return (own + self.mass(at, less)) / (g.s1 + g.C1[self.x.lang1[at]] - away)

    def without_one(self, at: np.ndarray) -> np.ndarray:
        """``probability`` without a random customer, and its table if it is alone there."""
        o = self.up.o[at]
        who = (self.rng.random(len(at)) * self.up.c[at]).astype(np.int64)
        return self.probability(at, 1, self.up.at_table[o + self.up.table[o + who]] == 1)

    def mass_one(self, at: int, less: int = 0) -> float:
        """``mass`` of one."""
        g, v = self.g, self.view
        return (g.s1 + g.d1 * (v.T1[v.lang[at]] - less)) * max(v.c0[v.word[at]] - less - g.d0, 0.0) / (g.s0 + g.C0 - less)

    def one(self, at: int, away: bool) -> float:
        """``probability``, or ``without_one``, of one."""
        g, v, up = self.g, self.view, self.up.view
        c, o, less = up.c[at], up.o[at], 0
        if away:
            less = up.at_table[o + up.table[o + int(self.draw() * c)]] == 1
        return (max(c - away - g.d1 * (up.t[at] - less), 0.0) + self.mass_one(at, less)) / (g.s1 + v.C1[v.lang[at]] - away)

    def _count(self, at: np.ndarray, change: np.ndarray) -> None:
        """Tables of (word, language) have opened or closed: customers of the root."""
        np.add.at(self.g.T1, self.x.lang1[at], change)
        np.add.at(self.c0, self.x.word1[at], change)
        self.g.C0 += float(change.sum())

    def _count_one(self, at: int, change: int) -> None:
        v = self.view
        v.T1[v.lang[at]] += change
        v.c0[v.word[at]] += change
        self.g.C0 += change

    def follow(self, of: np.ndarray, change: np.ndarray) -> None:
        """Customers come and leave as tables below have opened and closed."""
        at, place = np.unique(of, return_inverse=True)
        net = np.bincount(place, change).astype(np.int64)
        while len(at := at[net != 0]):
            net = net[net != 0]
            if len(at) <= FEW:
                for i, change in zip(at.tolist(), net.tolist(), strict=True):
                    for _ in range(abs(change)):
                        self.follow_one(i, 1 if change > 0 else -1)
                return
            np.add.at(self.g.C1, self.x.lang1[at], np.sign(net))
            less, more = at[net < 0], at[net > 0]
            self._count(less, -self.up.leave(less, self.rng).astype(np.int64))
            self._count(more, self.up.sit(more, self.mass(more), self.g.d1, self.rng).astype(np.int64))
            net = net - np.sign(net)

    def follow_one(self, at: int, change: int) -> None:
        self.view.C1[self.view.lang[at]] += change
        if change < 0:
            if self.up.leave_one(at, self.draw):
                self._count_one(at, -1)
        elif self.up.sit_one(at, self.mass_one(at), self.g.d1, self.draw):
            self._count_one(at, 1)

    def reseat(self) -> None:
        """Every customer leaves and is seated again."""
        at, far = self.up.largest(np.flatnonzero(self.up.c > 1), self.rng)
        for i, n in zip(at[:ALONE].tolist(), far[:ALONE].tolist(), strict=True):
            self.up.sweep_one(i, n, partial(self.mass_one, i), partial(self._count_one, i), self.g.d1, self.draw)
        self.up.sweep(at[ALONE:], far[ALONE:], self.mass, partial(self.mass, less=1), self._count, self.g.d1, self.rng)


def sweeps(x: Dishes, low: Seats, up: Seats, g: Totals, n: int, rng: np.random.Generator) -> None:
    """``rounds``, customer by customer: slower by far, and kept to test them against."""
    low.shuffle(rng), up.shuffle(rng)
    context, middle = x.context[x.many], x.middle[x.many]
    level = Middle(x, up, g, rng)

    def mass(at: np.ndarray) -> np.ndarray:
        m = middle[at]
        p1 = level.probability(m) if len(m) < len(x.word1) else level.probability(slice(None))[m]
        return (g.s2 + g.d2 * g.T2[context[at]]) * p1

    def less(at: np.ndarray) -> np.ndarray:
        return (g.s2 + g.d2 * (g.T2[context[at]] - 1)) * level.without_one(middle[at])

    def moved(at: np.ndarray, change: np.ndarray) -> None:
        np.add.at(g.T2, context[at], change)
        level.follow(middle[at], change)

    def one(i: int, far: int) -> None:
        u, m, T2 = int(context[i]), int(middle[i]), memoryview(g.T2)

        def mass_one(closed: bool) -> float:
            return (g.s2 + g.d2 * (T2[u] - closed)) * level.one(m, closed)

        def moved_one(change: int) -> None:
            T2[u] += change
            level.follow_one(m, change)

        low.sweep_one(i, far, mass_one, moved_one, g.d2, level.draw)

    for _ in range(n):
        at, far = low.largest(np.arange(len(low.c)), rng)
        for i, k in zip(at[:ALONE].tolist(), far[:ALONE].tolist(), strict=True):
            one(i, k)
        low.sweep(at[ALONE:], far[ALONE:], mass, less, moved, g.d2, rng)
        level.reseat()


class Draws:
    """Numbers of tables of the dishes of a slice, each drawn at once given all others; seatings with the same numbers are summed out."""

    def __init__(self, x: Dishes, low: Tables, up: Tables, g: Totals, rng: np.random.Generator):
        self.x, self.low, self.up, self.g, self.rng = x, low, up, g, rng
        self.context, self.middle, self.c0 = x.context[x.many], x.middle[x.many], x.c0(up.t)
        self.s2 = Stirling(g.d2, int(low.c.max(initial=1)))
        self.s1 = Stirling(g.d1, int(x.c1(x.c).max(initial=1)))
        room = np.bincount(x.middle, x.c, len(x.word1))
        close = ((np.bincount(self.middle, minlength=len(x.word1)) <= CLOSE) & (room <= self.s1.rows))[self.middle]
        self.close, self.groups2 = self._groups(self.middle, close), self._groups(self.middle, ~close)
        self.groups1 = self._groups(x.word1, np.ones(len(x.word1), bool))
        # logs of S(c, t) of a dish are at values[start + t], for t from first to last
        self.values, self.start = self.s2.flat, np.minimum(low.c, self.s2.rows) * self.s2.width
        big = low.c > self.s2.rows
        self.first, self.last = np.where(big, 1, 0), np.where(big, 0, low.c)
        if len(big := np.flatnonzero(big)):
            self._extend(big, low.t[big] // 2 - 32, np.minimum(2 * low.t[big], low.t[big] + low.c[big] // 4) + 64)

    def _groups(self, of: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
        """GROUPS groups of some, those with the same parent (in a row) in different ones as far as they go."""
        some = np.flatnonzero(some)
        of = of[some]
        first, size = runs(of)
        order = np.argsort(np.repeat(np.arange(len(first)), size) + self.rng.random(len(of)))
        rank = np.empty(len(of), np.int64)
        rank[order] = np.arange(len(of)) - np.repeat(first, size)
        group = (rank + np.repeat(self.rng.integers(GROUPS, size=len(first)), size)) % GROUPS
        order, ends = np.argsort(group, kind="stable"), np.cumsum(np.bincount(group, minlength=GROUPS))
        return [i for i in np.split(some[order], ends[:-1]) if len(i)]

    def _extend(self, i: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Values of dishes of more customers than the table has."""
        first, last = np.maximum(first, 1), np.minimum(last, self.low.c[i])
        size = last - first + 1
        self.start[i], self.first[i], self.last[i] = len(self.values) + np.cumsum(size) - size - first, first, last
        self.values = np.concatenate([self.values, self.s2.along_t(self.low.c[i], first, last)])

    def _own(self, i: np.ndarray, low: np.ndarray, size: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Logs of S(c, k) of dishes i."""
        if len(j := np.flatnonzero((low < self.first[i]) | (low + size - 1 > self.last[i]))):
            self._extend(i[j], low[j] - size[j], low[j] + 2 * size[j])
        return self.values[np.repeat(self.start[i], size) + k]

    def _contexts(self, groups: list[np.ndarray], close: bool) -> None:
        """The tables of (word, context) of some groups; if close, with their parents'."""
        g, low, up = self.g, self.low, self.up
        for i in groups:
            m, u, t = self.middle[i], self.context[i], low.t[i]
            lang, t1 = self.x.lang1[m], up.t[m]
            tables, away, all_away = g.s2 / g.d2 + g.T2[u] - t, up.c[m] - t, g.s1 + g.C1[lang] - t

            def weight(which: np.ndarray, low: np.ndarray, size: np.ndarray, i=i, m=m, tables=tables, away=away, all_away=all_away, t1=t1) -> np.ndarray:
                k, r = ragged(low, size), np.repeat(which, size)
                before = k - 1
                more = g.d2 * (tables[r] + before) / (all_away[r] + before)
                if close:
                    return self._own(i[which], low, size, k) + climb(more, size) + self._served(m[r], away[r] + k)
                return self._own(i[which], low, size, k) + climb(more * self.s1.growth(away[r] + before, t1[r]), size)

            new = draw_within(np.maximum(1 if close else t1 - away, 1) + 0 * t, low.c[i], t, weight, self.rng)
            j = np.flatnonzero(new != t)
            change = (new - t)[j]
            low.t[i[j]] = new[j]
            np.add.at(up.c, m[j], change)
            np.add.at(g.T2, u[j], change)
            np.add.at(g.C1, lang[j], change)
            if close:
                self._languages(m)

    def _up(self, i: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Of pairs (word, language) i[r], the factor that table k brings, but for the first, which the root has of each word in any case."""
        g, t, word, lang = self.g, self.up.t[i], self.x.word1[i], self.x.lang1[i]
        tables, away, all_away = g.s1 / g.d1 + g.T1[lang] - t, self.c0[word] - t - g.d0, g.s0 + (g.C0 - t)
        return lambda r, k: g.d1 * (tables[r] + (k - 1)) * (away[r] + (k - 1)) / (all_away[r] + (k - 1))

    def _served(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log weights of all seatings of n customers of pairs i at any number of tables."""
        k, r = ragged(np.ones(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
        weight = self.s1(n[r], k) + climb(self._up(i)(r, k), n)
        first = np.cumsum(n) - n
        top = np.maximum.reduceat(weight, first)
        # ``climb`` is up to a constant of each row: that of its first, where S(n, 1) is the weight
        start = weight[first] - self.s1(n, np.ones(len(n), np.int64))
        return top - start + np.log(np.add.reduceat(np.exp(weight - top[r]), first))

    def _languages(self, i: np.ndarray) -> None:
        """The tables of pairs (word, language)."""
        g, up, x = self.g, self.up, self.x
        i = i[(up.c[i] > 1) | (up.t[i] > 1)]
        if not len(i):
            return
        more, c, t = self._up(i), up.c[i], up.t[i]

        def weight(which: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
            k, r = ragged(low, size), np.repeat(which, size)
            return self.s1(c[r], k) + climb(more(r, k), size)

        t = np.minimum(t, c)
        change = draw_within(np.ones(len(i), np.int64), c, t, weight, self.rng) - up.t[i]
        up.t[i] += change
        np.add.at(self.c0, x.word1[i], change)
        np.add.at(g.T1, x.lang1[i], change)
        g.C0 += float(change.sum())

    def rounds(self, n: int) -> None:
        """n times all customers of every dish at both levels leave together and are seated again. Totals take this slice's changes.

        Dishes that are drawn with their parent's tables cost little, and are drawn to and fro before and after the others.
        """
        to_and_fro = [*self.close, *self.close[::-1]]
        for _ in range(n):
            self._contexts(to_and_fro, True)
            self._contexts(self.groups2, False)
            for i in self.groups1:
                self._languages(i)
            self._contexts(to_and_fro, True)


def rounds(x: Dishes, low: Tables, up: Tables, g: Totals, n: int, rng: np.random.Generator) -> None:
    Draws(x, low, up, g, rng).rounds(n)


_STATE = "slice int, state binary, totals binary"


def _state_batch(s: int, state: list[np.ndarray], totals: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([s], pa.int32()), pa.array([pack(*state)], pa.binary()), pa.array([np.concatenate(totals).tobytes()], pa.binary())], ["slice", "state", "totals"])


def _dictionary(n_slices: int, langs: Languages, seed: int):
    """Counts of the words of a slice, seated and burnt in with the slice's own totals as an even part of all."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        size = [grow(p[1], p[2]) for p in parts]
        words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        key = np.repeat(of, np.concatenate(size)).astype(U) << U(16) | np.concatenate([p[3] for p in parts]).astype(U)
        c = np.concatenate([grow(p[4], p[5]) for p in parts])
        order = np.argsort(key)
        key, c = key[order], c[order]
        first, _ = runs(key)
        key, c = key[first], np.add.reduceat(c, first)
        x = Dishes(words, (key >> U(16)).astype(np.int64), key & U(0xFFFF), c, langs)
        g = Totals(x.fixed() * n_slices, x.seating(np.ones(len(x.many), np.int64), np.ones(len(x.word1), np.int64)) * n_slices, langs)
        low, up = x.seated(g)
        g = Totals(x.fixed() * n_slices, x.seating(low.t, up.t) * n_slices, langs)
        rounds(x, low, up, g, BURN_IN, np.random.default_rng([seed, s]))
        yield _state_batch(s, [*x.packed(), *shrink(low.t), *shrink(up.t)], [x.fixed(), x.seating(low.t, up.t)])

    return fn


def _sample(g: Totals, langs: Languages, seed: int):
    """SAMPLES seatings of each slice: numbers of tables only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s, blob in zip(b.column("slice").to_pylist(), b.column("state").to_pylist(), strict=True):
                own = _copy(g)
                arrays = unpack(blob)
                x = Dishes.unpacked(arrays[:6], langs)
                t2, t1 = (grow(*arrays[i : i + 2]) for i in (6, 8))
                low, up = Tables(x.c[x.many], t2), Tables(x.c1(x.t2(t2)), t1)
                level = Draws(x, low, up, own, np.random.default_rng([seed + 1, s]))
                kept, totals = [], [x.fixed()]
                for _ in range(SAMPLES):
                    level.rounds(BETWEEN)
                    kept += [*shrink(low.t), *shrink(up.t)]
                    totals.append(x.seating(low.t, up.t))
                yield _state_batch(s, [*x.packed(), *kept], totals)

    return run


def _copy(g: Totals) -> Totals:
    out = object.__new__(Totals)
    out.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in g.__dict__.items()})
    return out


RANGES = 16


def _sums(states: DataFrame) -> np.ndarray | None:
    """The slices' totals, added by ranges of the vector: a few numbers for each restaurant come to the driver."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield from batches((k, x.tobytes()) for t in b.column(0).to_pylist() for k, x in enumerate(np.array_split(np.frombuffer(t, np.int64), RANGES)))

    def add(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        yield from batches([(s, np.sum([np.frombuffer(x, np.int64) for x in blobs], axis=0).tobytes())])

    rows = sorted(gathered(states.select("totals").mapInArrow(split, SLICED), RANGES, add, SLICED).collect())
    return np.concatenate([np.frombuffer(bytes(r[1]), np.int64) for r in rows]) if rows else None


def _seatings(v: np.ndarray, langs: Languages) -> list[Totals]:
    n, m = langs.size + 3, langs.size + langs.n + 4
    return [Totals(v[:n], v[k : k + m], langs) for k in range(n, len(v), m)]


def _deal(n_slices: int, langs: Languages):
    """To each word slice: (batch, words, documents, contexts, counts); to the batch's slice: its ids and text hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            ids, null, text = (np.concatenate([x[k] for x in held]) for k in (0, 1, 2))
            base = np.cumsum([0, *(len(x[0]) for x in held)])[:-1]
            doc = np.concatenate([x[3] + b for x, b in zip(held, base, strict=True)])
            n_tokens = np.bincount(doc, minlength=len(ids))
            bits = max(16, int(len(ids)).bit_length())
            words, size, (context, doc), c = _distinct(np.concatenate([x[4] for x in held]), (np.concatenate([x[5] for x in held]), 16), (doc, bits))
            batch = mix64(np.array([len(ids)], U) + np.bitwise_xor.reduce(mix64(text ^ mix64(ids.view(U)))))
            yield int(slice_of(batch, n_slices)[0]), pack(batch, ids, null, signed(text), n_tokens)
            small = np.uint16 if bits == 16 else np.uint32
            for s, w, e in _by_slice(n_slices, words, size):
                more = np.flatnonzero(c[e] > 1)
                yield s, pack(batch, words[w], *shrink(size[w]), context[e].astype(np.uint16), doc[e].astype(small), more.astype(np.uint32), c[e][more].astype(np.uint32), np.array([len(ids)], np.uint32))

        def rows():
            held, total = [], 0
            for b in it:
                got, number, texts = _read(b, langs)
                null = np.array([x is None for x in got.to_pylist()], np.uint8)
                ids = got.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                for i, j in chunks(texts):
                    doc, h, context, text = _tokens(texts[i:j], number[i:j], langs)
                    held.append((ids[i:j], null[i:j], text, doc, h, context))
                    total += len(h)
                    if total >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if held:
                yield from out(held)

        yield from batches(rows())

    return run


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of wanted ones among sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Predictive probabilities of the words of a slice, averaged over its kept seatings."""

    def __init__(self, state: list[np.ndarray] | None, totals: list[Totals], langs: Languages):
        self.totals, self.langs = totals, langs
        none = np.zeros(0, np.int64)
        self.x = x = Dishes.unpacked(state[:6], langs) if state else Dishes(np.zeros(0, U), none, none, none, langs)
        self.count = np.bincount(x.word2, x.c, len(x.w)).astype(np.int64)
        self.key1, self.key2 = x.word1 * langs.n + x.lang1, x.word2 * langs.size + x.context
        self.own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, g in enumerate(totals):
            many, t1 = (grow(*state[i : i + 2]) for i in (6 + 4 * k, 8 + 4 * k)) if state else (none, none)
            t2 = x.t2(many)
            own2 = (x.c - g.d2 * t2) / (g.s2 + g.C2[x.context])
            own1 = (x.c1(t2) - g.d1 * t1) / (g.s1 + g.C1[x.lang1])
            self.own.append((own2, own1, (x.c0(t1) - g.d0) / (g.s0 + g.C0)))

    def probability(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """word: place in x.w, -1 for a word never seen."""
        has, lang, context = word >= 0, self.langs.of(context), context.astype(np.int64)
        a1, in1 = _lookup(self.key1, word * self.langs.n + lang)
        a2, in2 = _lookup(self.key2, word * self.langs.size + context)
        in1, in2 = in1 & has, in2 & has
        a1, a2, known = a1[in1], a2[in2], word[has]
        p = np.zeros(len(word))
        for g, (own2, own1, own0) in zip(self.totals, self.own, strict=True):
            one = np.full(len(word), g.new0)
            one[has] = own0[known]
            one *= g.new1[lang]
            one[in1] += own1[a1]
            one *= g.new2[context]
            one[in2] += own2[a2]
            p += one
        return p / len(self.totals)


def _score(n_slices: int, totals: list[Totals], langs: Languages):
    """Parts of the documents' sums by batch; heads of batches go on."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        state = next((unpack(b)[1:] for b in blobs if _is_state(b)), None)
        model = Model(state, totals, langs)
        g, freq = totals[-1], np.append(model.count, 0)

        def rows():
            while blobs:
                blob = blobs.pop()
                if _is_state(blob):
                    continue
                part = unpack(blob)
                if len(part) == 5:
                    yield s, blob
                    continue
                batch, words, s8, more8, context, doc, more, count, n_docs = part
                at, known = _lookup(model.x.w, words)
                word = np.repeat(np.where(known, at, -1), grow(s8, more8))
                c, n = np.ones(len(doc)), int(n_docs[0])
                c[more] = count
                f = freq[word]
                base = np.bincount(doc, c * np.log10((f + 0.1) / (g.N + 0.1 * (g.V + 1))), n)
                score = np.bincount(doc, c * np.log10(np.maximum(model.probability(word, context), 1e-300)), n)
                know = np.bincount(doc, c * (f > 0), n)
                there = np.flatnonzero(np.bincount(doc, minlength=n))
                small = doc.dtype
                yield int(slice_of(batch, n_slices)[0]), pack(batch, there.astype(small), base[there], score[there], know[there].astype(np.uint32))

        yield from batches(rows())

    return fn


def _is_state(blob: bytes) -> bool:
    """A state has an empty array in front, which tells it from a batch's part."""
    return int(np.frombuffer(blob, np.int64, 1, 16)[0]) == 0


_SCORES = "id long, text_hash long, n_tokens long, n_known long, base_score double, score double"


def _gather(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    heads: dict[int, list] = {}
    parts: dict[int, list] = {}
    for x in map(unpack, blobs):
        (heads if x[1].dtype == np.int64 else parts).setdefault(int(x[0][0]), []).append(x)
    for key, same in heads.items():  # copies of a whole batch share a key, and their parts add up
        _, ids, null, text, n_tokens = same[0]
        base, score, know = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for x in parts.pop(key, []):
            base[x[1]] += x[2] / len(same)
            score[x[1]] += x[3] / len(same)
            know[x[1]] += x[4]
        for _ in same:
            yield pa.record_batch(
                [pa.array(ids, mask=null.astype(bool)), pa.array(text), pa.array(n_tokens.astype(np.int64)), pa.array(know // len(same)), pa.array(base), pa.array(score)],
                ["id", "text_hash", "n_tokens", "n_known", "base_score", "score"],
            )


def _marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield from batches((s, pack(np.zeros(0, np.uint8), *unpack(x))) for s, x in zip(b.column("slice").to_pylist(), b.column("state").to_pylist(), strict=True))


def language_model(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang", seed: int = 7, slices: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    score: log10 of the text's probability; 10 ** (-score / n_tokens) is its perplexity.
    """
    lang = F.col(f"`{language}`").cast("string")
    code = F.crc32(F.encode(F.coalesce(F.concat(F.lit("="), lang), F.lit("null")), "UTF-8"))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), code.alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    n = slices or slices_for(source, SLICE_BYTES, SLICES)
    langs = Languages([r[0] for r in source.select("lang").distinct().limit(LANGUAGES + 1).collect()])
    states = cut(gathered(source.mapInArrow(_train(n, langs), SLICED), n, _dictionary(n, langs, seed), _STATE))
    totals = _sums(states)
    if totals is None:  # nothing to learn from: every token is unknown
        totals = np.zeros(2 * langs.size + langs.n + 7, np.int64)
    else:
        states = cut(states.mapInArrow(_sample(_seatings(totals, langs)[0], langs, seed), _STATE))
        totals = _sums(states)
    kept = _seatings(totals, langs)
    dealt = source.mapInArrow(_deal(n, langs), SLICED)
    sums = gathered(states.select("slice", "state").mapInArrow(_marked, SLICED).union(dealt), n, _score(n, kept, langs), SLICED)
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(HELD_OUT)) == 0
    scored = gathered(sums, n, _gather, _SCORES)
    return scored.select("id", held.alias("held_out"), "n_tokens", "n_known", F.lit(kept[-1].N).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language_model(docs).withColumnRenamed("id", "doc_id")
