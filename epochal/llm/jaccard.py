"""N-gram Jaccard join: exact links of word-shingle sets, filtered under several global token orders at once.

A set of n tokens can reach Jaccard similarity p/q only with sets that share one of its n - ceil(n p / q) + 1 first tokens,
under any global token order. So a pair is verified only if it shares a prefix token under every order (rarest first by exact
document frequency; two coarser frequency orders with other tie-breaks), which are intersected.

1. Shingle hashes and set fingerprints come from whole texts; equal sets are one vertex from here on.
2. Tokens are dealt by hash in packed slices and counted: their frequency among distinct sets. Tokens of one set only can't be
   shared, and stand first in every order: a set whose prefix consists of them has no link, and leaves here (most do). Of the
   others only shared tokens go on, with frequencies: an intersection consists of nothing else.
3. Under each order, sets that share a prefix token are chained to the token's smallest set. Components of these linear edges
   under the first order are families; no link leaves a family, and no pairs are emitted.
4. A family's sets meet in one task, largest frequencies first: a set is held against all later ones that pass the prefix
   filters of all orders and the length filter, by exact intersection, so that every link is found once. Links are counted at
   both sets and joined by union-find; only spanning links and numbers leave the task. A family of more than FAMILY_TOKENS
   tokens is cut into blocks, and every pair of blocks is a task of its own. With components_only a set is held against the
   sets of other components only, and links are not counted.

Tokens that may be in a large part of all sets (1/8 of some sender's sets) are dealt by token and set, so that none meets in
one task, and rank last. Sets and tokens are compared by hashes of 64 and at least 40 bits.

Null and empty texts have no tokens, size 0, and are linked with nothing. Fewer words than a shingle make one token. Equal
texts and repeated rows are linked (if they have words). A null id is carried; it counts as the largest in its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from epochal.llm._components import components
from epochal.llm._packed import SLICED, batches, cut_by, gathered, pack, ragged, runs, slice_of, tidy, unpack
from epochal.llm._spark import cut, free, parallelism, table
from epochal.llm._text import U, Words, chunks, mix64, shingles, signed, to_bytes

#: Tokens gathered before a sender cuts them into slices, and tokens of a family (block) in one task.
FLUSH, FAMILY_TOKENS = 2_000_000, 4_000_000
HOT_PART, HOT_LEAST, HOT_DF = 8, 64, 65_535


def _sets(texts: list[bytes | None], k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, set sizes, tokens by row, fingerprints) of chunks of texts."""
    for i, j in chunks(texts):
        doc, h = shingles(Words(texts[i:j]), k)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        if len(h):
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
            doc, h = doc[new], h[new]
        size = np.bincount(doc, minlength=j - i).astype(np.int64)
        sums = np.concatenate([[U(0)], np.cumsum(mix64(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
        ends = np.cumsum(size)
        yield i, j, size, h, mix64(sums[ends] - sums[ends - size] + size.astype(U))


def _scan(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = to_bytes(b.column(1))
            n, fp, hot = np.zeros(len(texts), np.int64), np.zeros(len(texts), U), []
            held: list[np.ndarray] = []
            sets = 0
            for i, j, size, h, f in _sets(texts, k):
                n[i:j], fp[i:j] = size, f
                held.append(h)
                sets += int((size > 0).sum())
                if sum(map(len, held)) >= FLUSH or j == len(texts):
                    first, count = runs(np.sort(np.concatenate(held)))
                    many = count >= max(HOT_LEAST, sets // HOT_PART)
                    hot.extend(np.sort(np.concatenate(held))[first[many]].view(np.int64).tolist())
                    held, sets = [], 0
            hots = [hot, *[[]] * (len(texts) - 1)] if texts else []
            yield pa.record_batch(
                [b.column(0), pa.array(n), pa.array(signed(fp)), pa.array(hots, pa.list_(pa.int64()))], ["id", "n", "fp", "hot"]
            )

    return run


def _deal(k: int, n_slices: int, p: int, q: int, hot: np.ndarray):
    """Blobs of a token slice: set fingerprints, token counts, token bits (40), and 1 for hot tokens."""

    def out(held) -> Iterator[tuple[int, bytes]]:
        fp, size = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        tok = np.concatenate([x[2] for x in held])
        row = np.repeat(np.arange(len(fp), dtype=np.int32), size)
        is_hot = np.isin(tok, hot) if len(hot) else np.zeros(len(tok), bool)
        where = np.where(is_hot, mix64(tok ^ fp[row]), tok) if len(hot) else tok
        order, bounds = cut_by(slice_of(where, n_slices), n_slices)
        for s in range(n_slices):
            x = order[bounds[s] : bounds[s + 1]]
            if len(x):
                first, count = runs(row[x])
                t = tok[x]
                yield s, pack(fp[row[x][first]], count.astype(np.uint32), t, is_hot[x].astype(np.uint8)) if is_hot[x].any() else pack(
                    fp[row[x][first]], count.astype(np.uint32), t.astype(np.uint32), (t >> U(32)).astype(np.uint8)
                )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held, total = [], 0
            for b in it:
                for _, _, size, h, f in _sets(to_bytes(b.column(0)), k):
                    has = size > 0
                    held.append((f[has], size[has], h))
                    total += len(h)
                    if total >= FLUSH:
                        yield from out(held)
                        held, total = [], 0
            if held:
                yield from out(held)

        yield from batches(rows())

    return run


def _count(n_slices: int):
    """Blobs of a set slice: fingerprints, numbers of single tokens, numbers of shared tokens, their tokens and frequencies."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        fps, toks, hots = [], [], []
        for b in blobs:
            fp, count, lo, hi = unpack(b)
            fps.append(np.repeat(fp, count))
            if lo.dtype == np.uint64:  # with hot tokens, which keep all bits
                toks.append(np.where(hi == 1, lo, (lo & U((1 << 40) - 1)) | (U(s) << U(40))))
                hots.append(hi == 1)
            else:
                toks.append(lo.astype(U) | (hi.astype(U) << U(32)) | (U(s) << U(40)))
                hots.append(np.zeros(len(lo), bool))
        fp, tok, hot = np.concatenate(fps), np.concatenate(toks), np.concatenate(hots)
        order = np.lexsort((fp, tok))
        fp, tok, hot = fp[order], tok[order], hot[order]
        new = np.concatenate([[True], (fp[1:] != fp[:-1]) | (tok[1:] != tok[:-1])])
        fp, tok, hot = fp[new], tok[new], hot[new]
        first, size = runs(tok)
        df = np.repeat(np.minimum(size, HOT_DF - 1), size).astype(np.uint16)
        df[hot] = HOT_DF
        order = np.argsort(fp, kind="stable")
        fp, tok, df = fp[order], tok[order], df[order]
        first, size = runs(fp)
        row = np.repeat(np.arange(len(first)), size)
        shared = df > 1
        n_shared = np.bincount(row[shared], minlength=len(first))
        v = fp[first]
        where, bounds = cut_by(slice_of(v, n_slices), n_slices)
        begin = np.cumsum(n_shared) - n_shared
        tok, df = tok[shared], df[shared]

        def rows():
            for t in range(n_slices):
                x = where[bounds[t] : bounds[t + 1]]
                if len(x):
                    at = ragged(begin[x], n_shared[x])
                    yield t, pack(v[x], (size[x] - n_shared[x]).astype(np.uint32), n_shared[x].astype(np.uint32), tok[at], df[at])

        yield from batches(rows())

    return fn


def _orders(tok: np.ndarray, df: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Sort keys (frequency, tie-break) of the token orders."""
    coarse = np.floor(np.log2(df)).astype(np.uint16)
    return (df, mix64(tok)), (coarse, mix64(tok ^ U(0x1234567))), (coarse >> 1, mix64(tok ^ U(0x89ABCDEF)))


N_ORDERS = 3


def _survivors(p: int, q: int):
    """Sets whose prefix reaches shared tokens: fp, n, prefix (number of its shared tokens), tokens, frequencies."""

    def fn(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(b) for b in blobs]
        fp = np.concatenate([x[0] for x in parts])
        single, shared = (np.concatenate([x[i] for x in parts]).astype(np.int64) for i in (1, 2))
        base = np.cumsum([0, *(len(x[3]) for x in parts)])[:-1]
        begin = np.concatenate([b + np.cumsum(x[2].astype(np.int64)) - x[2] for b, x in zip(base, parts, strict=True)])
        tok, df = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
        order = np.argsort(fp, kind="stable")
        first, size = runs(fp[order])
        n1, n2 = np.add.reduceat(single[order], first), np.add.reduceat(shared[order], first)
        n = n1 + n2
        prefix = n - (n * p + q - 1) // q + 1 - n1
        ids, toks, dfs, keep = fp[order][first], [], [], np.flatnonzero(prefix > 0)
        out: list[list] = [[], [], [], [], []]
        held = 0
        for i in keep:
            x = order[first[i] : first[i] + size[i]]
            at = ragged(begin[x], shared[x])
            t, d = tok[at], df[at]
            by = np.argsort(t)
            for col, val in zip(out, (int(ids[i].view(np.int64)), int(n[i]), int(prefix[i]), t[by].tobytes(), d[by].tobytes()), strict=True):
                col.append(val)
            held += 10 * len(t)
            if held > 8_000_000:
                yield _set_batch(out)
                out, held = [[], [], [], [], []], 0
        if out[0]:
            yield _set_batch(out)

    return fn


_SET = "fp long, n long, prefix int, tok binary, df binary"


def _set_batch(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["fp", "n", "prefix", "tok", "df"])


def _prefix(prefix: int, tok: np.ndarray, df: np.ndarray, order: int) -> np.ndarray:
    a, b = _orders(tok, df)[order]
    return np.lexsort((b, a))[:prefix]


def _postings(n_slices: int):
    """Prefix tokens of the first order, dealt by token: tokens, fingerprints."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            toks, fps, held = [], [], 0
            for b in it:
                for fp, pre, t, d in zip(*(b.column(c).to_pylist() for c in ("fp", "prefix", "tok", "df")), strict=True):
                    tok = np.frombuffer(t, U)
                    x = mix64(tok[_prefix(pre, tok, np.frombuffer(d, np.uint16), 0)])
                    toks.append(x), fps.append(np.full(len(x), fp, np.int64))
                    held += len(x)
                if held >= FLUSH:
                    yield from out(toks, fps)
                    toks, fps, held = [], [], 0
            if held:
                yield from out(toks, fps)

        yield from batches(rows())

    def out(toks, fps):
        tok, fp = np.concatenate(toks), np.concatenate(fps)
        # one token's sets in this sender need only an edge each: a hot token leaves as pairs of (smallest set, set) and one row
        order = np.lexsort((fp, tok))
        tok, fp = tok[order], fp[order]
        first, size = runs(tok)
        least = np.repeat(fp[first], size)
        far = least != fp
        yield -1, pack(*_pairs(least[far], fp[far]))
        tok, fp = tok[first], fp[first]
        order, bounds = cut_by(slice_of(tok, n_slices), n_slices)
        for s in range(n_slices):
            x = order[bounds[s] : bounds[s + 1]]
            if len(x):
                yield s, pack(tok[x], fp[x])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def _chain(s: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    parts = [unpack(b) for b in blobs]
    tok, fp = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    order = np.lexsort((fp, tok))
    tok, fp = tok[order], fp[order]
    first, size = runs(tok)
    least = np.repeat(fp[first], size)
    yield _edges(*_pairs(least[least != fp], fp[least != fp]))


def _own_chains(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for blob in b.column(1).to_pylist():
            yield _edges(*unpack(blob))


def _union(sets: list[tuple], p: int, q: int, side: np.ndarray | None, components_only: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning links of the sets of one family, and each set's number of links.

    side: block of each set; only sets of different blocks are compared (None: all).
    """
    m = len(sets)
    n = np.array([x[1] for x in sets])
    toks = [np.frombuffer(x[3], U) for x in sets]
    dfs = [np.frombuffer(x[4], np.uint16) for x in sets]
    size = np.array([len(t) for t in toks])
    begin = np.cumsum(size) - size
    flat = np.concatenate(toks)
    ids, code = np.unique(flat, return_inverse=True)
    lists = []  # per order: prefix codes of each set, and postings
    for o in range(N_ORDERS):
        pre = [code[b + _prefix(x[2], t, d, o)] for x, t, d, b in zip(sets, toks, dfs, begin, strict=True)]
        of = np.repeat(np.arange(m), [len(x) for x in pre])
        c = np.concatenate(pre)
        by = np.argsort(c, kind="stable")
        lists.append((pre, of[by], np.searchsorted(c[by], np.arange(len(ids) + 1))))
    root = np.arange(m)
    weight = np.array([d.astype(np.float64).sum() / max(k, 1) for d, k in zip(dfs, n, strict=True)])
    later = np.ones(m, bool)
    spanning, links = [], np.zeros(m, np.int64)
    for u in np.argsort(-weight, kind="stable"):
        later[u] = False
        may = (root != root[u] if components_only else later) & (100_000 * np.minimum(n, n[u]) * q >= 100_000 * p * np.maximum(n, n[u]))
        if side is not None:
            may &= side != side[u]
        for pre, of, bounds in lists:
            if not may.any():
                break
            c = pre[u]
            hit = np.zeros(m, bool)
            hit[of[ragged(bounds[c], bounds[c + 1] - bounds[c])]] = True
            may &= hit
        cand = np.flatnonzero(may)
        if not len(cand):
            continue
        mark = np.zeros(len(ids) + 1, np.int64)
        mark[code[begin[u] : begin[u] + size[u]]] = 1
        for x in np.array_split(cand, max(1, int(size[cand].sum() // 4_000_000))):
            inside = mark[code[ragged(begin[x], size[x])]]
            inter = np.add.reduceat(inside, np.cumsum(size[x]) - size[x]) if len(x) else np.zeros(0, np.int64)
            found = x[inter * q >= p * (n[x] + n[u] - inter)]
            links[found] += 1
            links[u] += len(found)
            for v in found[root[found] != root[u]]:
                if root[v] != root[u]:
                    root[root == root[v]] = root[u]
                    spanning.append((sets[u][0], sets[v][0]))
    return spanning, links


def _verify(p: int, q: int, components_only: bool):
    """Spanning links (a, b, 0), and numbers of links as (a, a, number)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def families():
            key, held = None, []
            for b in it:
                for row in zip(*(b.column(c).to_pylist() for c in ("fp", "n", "prefix", "tok", "df", "family", "i", "j", "block")), strict=True):
                    if row[5:8] != key:
                        if held:
                            yield key, held
                        key, held = row[5:8], []
                    held.append(row)
            if held:
                yield key, held

        for (_, i, j), rows in families():
            if len(rows) > 1:
                side = np.array([r[8] for r in rows]) if i != j else None
                spanning, links = _union(rows, p, q, side, components_only)
                if spanning or links.any():
                    has = [] if components_only else np.flatnonzero(links).tolist()
                    out = [(a, b, 0) for a, b in spanning] + [(rows[x][0], rows[x][0], int(links[x])) for x in has]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "n"])

    return run


def _linked(source: DataFrame, k: int, percent: int, components_only: bool) -> tuple[DataFrame, DataFrame]:
    """((id, n, fp) of every row of source (id, text), (fp, least, root, n_links) of every set that is not empty)."""
    spark, p, q = source.sparkSession, percent, 100
    n_slices = parallelism(spark)
    kind = source.schema["id"].dataType.simpleString()
    scanned = cut(source.mapInArrow(tidy(_scan(k)), f"id {kind}, n long, fp long, hot array<long>"))
    sets = scanned.select("id", "n", "fp")
    hot = np.array([r[0] for r in scanned.select(F.explode("hot").alias("h")).distinct().collect()], np.int64).view(U)
    dealt = source.select("text").mapInArrow(tidy(_deal(k, n_slices, p, q, hot)), SLICED)
    counted = gathered(dealt, n_slices, _count(n_slices), SLICED)
    alive = cut(gathered(counted, n_slices, _survivors(p, q), _SET))
    posted = cut(alive.select("fp", "prefix", "tok", "df").mapInArrow(tidy(_postings(n_slices)), SLICED))
    chains = gathered(posted.where("slice >= 0"), n_slices, _chain, "a long, b long").union(
        posted.where("slice < 0").mapInArrow(tidy(_own_chains), "a long, b long")
    )
    family = components(chains).withColumnRenamed("v", "fp").withColumnRenamed("root", "family")
    members = cut(alive.join(family, "fp"))
    blocks = members.groupBy("family").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("tok")) / (8 * FAMILY_TOKENS))).cast("int").alias("blocks")
    )
    blocked = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = blocked.withColumn("__other", other).withColumn("i", F.least("block", "__other")).withColumn("j", F.greatest("block", "__other"))
    tasks = paired.repartition(n_slices, "family", "i", "j").sortWithinPartitions("family", "i", "j", "fp")
    verified = tasks.select("fp", "n", "prefix", "tok", "df", "family", "i", "j", "block").mapInArrow(tidy(_verify(p, q, components_only)), "a long, b long, n long")
    links = cut(verified)
    roots = components(links.where("a <> b")).withColumnRenamed("v", "fp")
    numbers = links.where("a = b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_links"))
    least = sets.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    joined = least.join(roots, "fp", "left").join(numbers, "fp", "left")
    return sets, cut(joined.select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, components_only: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row: sets of distinct k-word shingles of the ASCII-lowered text, linked
    where 100 * intersection >= percent * union; component_id: the smallest id reachable by links; n_links: number of other sets
    that the row's set is linked to (rows of equal sets are one set). components_only: no n_links; links within a component that
    is known already are not verified.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sets, grouped = _linked(source, k, percent, components_only)
    top = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.join(top, "root").select("fp", "component_id", "n_links")
    out = sets.join(classes, "fp", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
    )
    return out.drop("n_links") if components_only else out


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the SQL; all links are verified."""
    return op6_jaccard_links(spark, sf_dir).drop("n_links")


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, k=3, percent=90).withColumnRenamed("id", "doc_id")


def _with_sets(k: int, text: int, names: list[str]):
    """Rows with the size and fingerprint of their set. A row without words gets a fingerprint of its own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for b in it:
            texts = to_bytes(b.column(text))
            n, fp = np.zeros(len(texts), np.int64), np.zeros(len(texts), U)
            for i, j, size, _, f in _sets(texts, k):
                n[i:j], fp[i:j] = size, f
            own = mix64(np.arange(seen, seen + len(texts), dtype=U) | U(part << 40))
            seen += len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(signed(np.where(n > 0, fp, own)))], [*b.schema.names, *names])

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row of the smallest id stays (null is the largest); all other rows stay.

    The survivor is chosen by (id, set), so a row that has no near duplicate stays whatever its id is.
    """
    _, grouped = _linked(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")), 5, 80, components_only=True)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("s"))
    n, fp, of, least = free(docs.columns, "__n", "__fp", "__set", "__id")
    keep = best.select(F.col("s.fp").alias(of), F.col("s.least").alias(least))
    schema = StructType([*docs.schema.fields, StructField(n, LongType()), StructField(fp, LongType())])
    rows = docs.mapInArrow(tidy(_with_sets(5, docs.columns.index("text"), [n, fp])), schema)
    held = rows.join(keep, F.col(fp) == F.col(of), "left")
    held = held.where((F.col(n) == 0) | (F.col(of).isNotNull() & F.col("doc_id").eqNullSafe(F.col(least))))
    return held.dropDuplicates([fp]).select(*(F.col(f"`{c}`") for c in docs.columns))


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, CAST(greatest(len(w), 3) - 1 AS BIGINT)), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
u AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS k, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT doc_id, unnest(k) AS t FROM u),
d AS (SELECT doc_id, t FROM t WHERE t IN (SELECT t FROM t GROUP BY t HAVING count(*) > 1)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN u x ON x.doc_id = a JOIN u y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN u ON u.k = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN m ON m.node = u.doc_id
"""
