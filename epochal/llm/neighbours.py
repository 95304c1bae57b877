"""Approximate nearest neighbours by cross-polytope hashing.

Vectors scaled to unit length and padded to a power of two are turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform); a table's bucket is the signed axis nearest to the turned vector. A query probes its nearest
axes in each of several tables, and the rows found there are ranked by exact Euclidean distance of the original vectors.

Equal vectors are indexed once: of their ids only the k + 1 smallest can be among the nearest, so a vector that a third of
all rows share costs one row. Index rows stay where they are dealt: each chunk of CHUNK vectors has tables of its own, which
loses nothing, and only a query's k nearest of a chunk leave it. Queries are a stated set; they come in blocks of at most
BLOCK, which bounds what is broadcast, and every block meets every chunk. Nothing is fitted on data: no sample is needed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as queries nor as
candidates; only vectors of one length are compared. Repeated rows are candidates each (ties by id). Fewer candidates than k:
what the probes find is completed from all others of the chunks, so that all are returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.llm._spark import cut, table

K, TABLES, PROBES, CHUNK, BLOCK = 10, 16, 6, 16_384, 4_096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in place over log2(width) rounds."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        x = np.stack([a, b], 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


@lru_cache(maxsize=8)
def _signs(width: int, tables: int, seed: int) -> np.ndarray:
    return np.where(np.random.default_rng(seed).random((tables, 3, width)) < 0.5, -1.0, 1.0)


def turned(v: np.ndarray, t: int, tables: int, seed: int = 5) -> np.ndarray:
    """The vectors as table t turns them."""
    width = 1 << max(0, int(v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), width))
    x[:, : v.shape[1]] = v / np.linalg.norm(v, axis=1, keepdims=True)
    for s in _signs(width, tables, seed)[t]:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of turned vectors, nearest first: axis, or axis + width for its negative."""
    both = np.concatenate([x, -x], axis=1)
    if probes == 1:
        return np.argmax(both, axis=1)[:, None]
    probes = min(probes, both.shape[1])
    return np.argpartition(-both, probes - 1, axis=1)[:, :probes]


def _search(vectors: np.ndarray, q: np.ndarray, k: int, tables: int, probes: int):
    """For each query (row, distances) of its nearest found rows of one chunk, at most k + 1."""
    parts = np.array_split(np.arange(len(q)), len(q) * len(vectors) // 64_000_000 + 1)
    index = []
    for t in range(tables):
        b = buckets(turned(vectors, t, tables), 1)[:, 0]
        order = np.argsort(b, kind="stable")
        index.append((order, np.searchsorted(b[order], np.arange(b.max(initial=0) + 2))))
    for part in parts:
        hit = np.zeros((len(part), len(vectors)), bool)
        for t in range(tables):
            order, bounds = index[t]
            for r, axes in enumerate(buckets(turned(q[part], t, tables), probes)):
                for a in axes[axes < len(bounds) - 1]:
                    hit[r, order[bounds[a] : bounds[a + 1]]] = True
        for r, i in enumerate(part):
            rows = np.flatnonzero(hit[r])
            if len(rows) <= k:
                rows = np.arange(len(vectors))
            d = np.sqrt(((vectors[rows] - q[i]) ** 2).sum(axis=1))
            if len(rows) > k + 1:
                near = np.sort(d)[k]
                rows, d = rows[d <= near], d[d <= near]
            yield int(i), rows, d


def nearest(data: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every query row, itself left out by id. Ids are integers."""

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())

    rows = sound(data)
    # equal vectors: one row with its k + 1 smallest ids, kept small by a first cut within salts
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    index = cut(ranked.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")))
    asked = cut(sound(queries))
    n = asked.count()
    out: DataFrame | None = None
    n_blocks = max(1, -(-n // BLOCK))
    block_of = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    for b in range(n_blocks):
        block = asked.where(block_of == b).collect()  # about BLOCK rows
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({len(r["v"]) for r in block}):
            own = [r for r in block if len(r["v"]) == width]
            by_width[width] = (np.array([r["id"] for r in own], np.int64), np.array([r["v"] for r in own]))
        sent = data.sparkSession.sparkContext.broadcast(by_width)
        found = index.mapInArrow(_scan(sent, k, tables, probes), "query_id long, id long, score double")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _scan(sent, k: int, tables: int, probes: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(width: int) -> Iterator[pa.RecordBatch]:
            ids, vectors = zip(*held.pop(width), strict=True)
            vectors = np.array(vectors)
            asked, q = sent.value[width]
            qs, cs, ds = [], [], []
            for i, rows, d in _search(vectors, q, k, tables, probes):
                pairs = sorted((float(x), c) for r, x in zip(rows.tolist(), d.tolist(), strict=True) for c in ids[r] if c != asked[i])[:k]
                qs += [int(asked[i])] * len(pairs)
                ds += [p[0] for p in pairs]
                cs += [p[1] for p in pairs]
            yield pa.record_batch([pa.array(qs, pa.int64()), pa.array(cs, pa.int64()), pa.array(ds, pa.float64())], ["query_id", "id", "score"])

        for b in it:
            for v, ids in zip(b.column("v").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if len(v) in sent.value:
                    held.setdefault(len(v), []).append((ids, v))
                    if len(held[len(v)]) >= CHUNK:
                        yield from flush(len(v))
        for width in list(held):
            yield from flush(width)

    return run


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(data, data.where("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")
