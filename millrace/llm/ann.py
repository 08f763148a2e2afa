"""Approximate nearest neighbours by learned partitions.

1. The number of parts grows with the table, a part for each PART_ROWS rows, up to MOST_PARTS. A bounded sample of the
   vectors (SAMPLE for each part, by a hash of their ids) gets its exact neighbour graph on the driver. The graph is cut
   into parts of nearly equal size: halves along principal directions, then moves of single vertices to the part of most
   of their neighbours, as long as no part grows over 1 + SLACK of the mean.
2. A small network learns from each vector of the sample how its neighbours are spread over the parts.
3. All rows are indexed: each goes to its most probable part, which is written in files of about ROWS rows. Queries go to as
   many of their most probable parts as held RECALL of the nearest neighbours of a tenth of the sample, which the network
   has not seen: few where the vectors have structure, most of them where they are noise.
4. A task takes a block of queries of one part and reads the part's files, one after another, keeping the k best rows so
   far. Rows are shuffled once, into their part; queries once for each part that they visit; a part or a set of queries
   with a third of all rows is just more files or blocks. Of a file's equal vectors only the smallest ids can be among
   the nearest. Cosines are of the original vectors, in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of another length than most of the sample are a part of their own for each length, as a cosine is between
equal lengths; a query whose vector takes no part has no rows, and repeated query ids are one query (the smallest
vector); a row that is repeated is a candidate each time, but rows with the query's own id never are; ties go to the
smaller id; with fewer than k candidates found all are given; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

SAMPLE, PART_ROWS, LEAST_PARTS, MOST_PARTS = 384, 16384, 16, 256
NEIGHBOURS, RECALL, SLACK = 16, 0.95, 0.1
ROWS, QUERIES = 16384, 4096
#: Numbers of the parts of other lengths begin here.
OTHER = 1 << 20


def parts_for(n: int) -> int:
    """A power of two."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, (n // PART_ROWS).bit_length() - 1)))


# ------------------------------------------------------------------------------------------------------------ learning


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): the nearest other rows, by cosine of unit vectors."""
    out, block = [], max(16, (1 << 23) // len(x))
    for a in range(0, len(x), block):
        near = x[a : a + block] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -2
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 15) -> np.ndarray:
    """The part of each row; parts is a power of two."""
    part = np.zeros(len(x), dtype=np.int64)
    for _ in range(parts.bit_length() - 1):
        new = np.empty_like(part)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            _, vectors = np.linalg.eigh(centred.T @ centred)
            order = np.argsort(centred @ vectors[:, -1], kind="stable")
            new[own[order]] = 2 * p + (np.arange(len(own)) >= len(own) / 2)
        part = new
    mean = len(x) / parts
    most, least = max(math.ceil(mean), math.floor(mean * (1 + slack) + 1e-9)), math.floor(mean * (1 - slack) + 1e-9)
    near = [[] for _ in range(len(x))]
    for a, row in enumerate(graph):
        for b in row:
            near[a].append(b)
            near[b].append(a)
    near = [np.array(b) for b in near]
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in range(len(x)):
            votes = np.bincount(part[near[v]], minlength=parts)
            own, best = part[v], int(votes.argmax())
            if votes[best] > votes[own] and sizes[best] < most and sizes[own] > least:
                part[v] = best
                sizes[own] -= 1
                sizes[best] += 1
                moved += 1
        if moved < len(x) / 200:
            break
    return part


@dataclass
class Router:
    """Unit vector -> log-probabilities of the parts, up to a constant."""

    size: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self(x), axis=1, kind="stable")[:, :n]


def probes_for(router: Router, vectors: np.ndarray, held: np.ndarray, k: int, recall: float) -> int:
    """The fewest probes with which the held rows find that share of their k nearest among vectors (held or not)."""
    x, parts = unit(vectors), router.w2.shape[1]
    if parts == 1 or len(x) <= k or not len(held):
        return parts
    near = x[held] @ x.T
    near[np.arange(len(held)), held] = -2
    near = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = router.probes(x[held], parts)
    place = np.argsort(order, axis=1)  # of each part, for each held row
    at = np.take_along_axis(place, router.probes(x, 1)[:, 0][near], axis=1)
    return int(np.searchsorted(np.cumsum(np.bincount(at.ravel(), minlength=parts)) / at.size, recall)) + 1


def learn(vectors: np.ndarray, parts: int = LEAST_PARTS, neighbours: int = NEIGHBOURS, hidden: int = 128, steps: int = 250, seed: int = 3) -> Router:
    """A router for distinct vectors."""
    x = unit(np.unique(vectors, axis=0))
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    parts = min(parts, 1 << max(0, len(x).bit_length() - 5))  # a few dozen vectors are one part
    net = [rng.normal(0, (2 / size) ** 0.5, (size, hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    if parts > 1:
        graph = neighbour_graph(x, min(neighbours, len(x) - 1))
        part = balanced_cut(x, graph, parts)
        goal = np.zeros((len(x), parts), dtype=np.float32)
        np.add.at(goal, (np.arange(len(x)), part), 0.5)
        np.add.at(goal, (np.arange(len(x))[:, None], part[graph]), 0.5 / graph.shape[1])
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
        for t in range(1, steps + 1):
            own = rng.integers(0, len(x), 1024)
            h = np.maximum(x[own] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - goal[own]) / len(own)
            dh = (dz @ net[2].T) * (h > 0)
            for w, g, (m, v) in zip(net, (x[own].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Router(size, *net)


# ----------------------------------------------------------------------------------------------------------- searching


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest rows to each query, ties to smaller ids, a query's own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, same = np.unique(np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_inverse=True)
    by_same = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(same[by_same]) > 0]))
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    # equal vectors tie: of those with other ids than the query's, the k smallest are enough; rows before one are not
    # counted if they may be the query's own, which are at most as many as one smaller id has
    new_id = np.flatnonzero(np.concatenate([[True], (np.diff(ids[by_same]) != 0) | (np.diff(same[by_same]) != 0)]))
    copies, group = np.diff(np.append(new_id, len(ids))), same[by_same][new_id].astype(np.int64) * (len(ids) + 1)
    most = np.maximum.accumulate(copies + group)  # with the group's offset: an earlier group's do not reach over
    before = np.maximum(np.concatenate([[0], most[:-1]]) - group, 0)
    keep = np.sort(by_same[rank - np.repeat(before, copies) < k])
    ids, vectors = ids[keep], vectors[keep]
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    out = []
    for a in range(0, len(queries), 512):
        q, q_ids = queries[a : a + 512], query_ids[a : a + 512]
        q_norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        near = (q / q_norms[:, None]) @ (vectors / norms[:, None]).T
        near[q_ids[:, None] == ids[None, :]] = -np.inf
        n = min(k, near.shape[1])
        least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
        row, column = np.nonzero((near >= least - 1e-9) & np.isfinite(near))
        exact = np.einsum("ij,ij->i", q[row], vectors[column]) / (q_norms[row] * norms[column])
        order = np.lexsort((ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < k
        out.append((q_ids[row[top]], ids[column[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query among what some searches have found."""
    query, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], ids[top], scores[top]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)


def _routed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """(part, id, vector) of the rows' most probable parts."""
    net = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            usual = np.flatnonzero(lengths == net.value.size)
            other = np.flatnonzero(lengths != net.value.size)
            at, parts = other, OTHER + lengths[other].astype(np.int64)
            if len(usual):
                found = net.value.probes(unit(_matrix(batch.column(1).take(pa.array(usual)), net.value.size)), probes)
                at, parts = np.concatenate([np.repeat(usual, found.shape[1]), at]), np.concatenate([found.ravel(), parts])
            own = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *own.columns], names=["part", "id", "vector"])

    return rows.mapInArrow(run, "part int, id long, vector array<double>")


def _in_blocks(df: DataFrame, most: int, folder: str) -> tuple[DataFrame, int]:
    """df with block: its rows of a part in blocks of about most; and the number of blocks."""
    df = common.stage(df, folder)
    found = [(r.part, math.ceil(r["count"] / most)) for r in df.groupBy("part").count().collect()]  # a row for each part
    plan = df.sparkSession.createDataFrame(found, "part int, blocks int")
    row = F.xxhash64("id", F.monotonically_increasing_id())  # rows that repeat one are dealt out too
    df = df.withColumn("row", row).join(F.broadcast(plan), "part").withColumn("block", F.pmod("row", F.col("blocks")).cast("int"))
    return df.select("part", "block", "id", "vector"), sum(n for _, n in found)


def _searcher(files, k: int, size: int, id_col: str):
    """Rows (part, block, id, vector) of queries, sorted by the first two: the nearest rows in the files of their part."""
    import pyarrow.parquet as pq

    def blocks(part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = part - OTHER if part >= OTHER else size
        for uri in files.value.get(part, ()):
            system, path = common.opened(uri)
            with system.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(ROWS, columns=["id", "vector"]):
                    if batch.num_rows:
                        yield batch.column(0).to_numpy(), _matrix(batch.column(1), width)

    def searched(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = np.concatenate([b.column(2).to_numpy() for b in held])
        queries = np.concatenate([_matrix(b.column(3), part - OTHER if part >= OTHER else size) for b in held])
        found = [tuple(np.array([], dtype=t) for t in (np.int64, np.int64, np.float64))]
        for other, vectors in blocks(part):
            found = [best([*found, nearest(ids, queries, other, vectors, k)], k)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], names=["query_id", id_col, "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            part, block = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if at != (part[a], block[a]):
                    if held:
                        yield searched(int(at[0]), held)
                    at, held = (part[a], block[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield searched(int(at[0]), held)

    return run


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, whatever their lengths."""
    vector = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("vector", lambda x: x != 0))


def search(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows found for each row where is_query, an expression of the
    column id, holds."""
    spark = table.sparkSession
    folder, tasks = common.work_dir(spark, "ann"), common.shuffle_partitions(spark)
    rows = common.stage(usable(table, id_col, vector_col), f"{folder}/rows")
    n = rows.count()
    parts = parts or parts_for(n)
    sample = SAMPLE * parts
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40))
    drawn = rows.filter(draw < min(1 << 40, (sample << 40) // max(n, 1))).limit(2 * sample).collect() or rows.limit(1).collect()
    if not drawn:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    size = int(np.bincount([len(r.vector) for r in drawn]).argmax())
    known = np.unique(np.array([r.vector for r in drawn if len(r.vector) == size]), axis=0)
    held = np.arange(0, len(known), 10)
    router = learn(np.delete(known, held, axis=0) if len(known) > 500 else known, parts)
    probes = probes_for(router, known, held, k, recall)

    index, blocks = _in_blocks(_routed(rows, router, 1), ROWS, f"{folder}/routed")
    index.repartition(blocks, "part", "block").drop("block").write.partitionBy("part").parquet(f"{folder}/index")
    files: dict[int, list[str]] = {}
    for uri in spark.read.parquet(f"{folder}/index").inputFiles():  # those of the committed write, about one a block
        files.setdefault(int(uri.rsplit("/part=", 1)[1].split("/")[0]), []).append(uri)
    queries = rows.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = common.stage(_routed(queries, router, probes), f"{folder}/asked")
    most = min(QUERIES, max(256, asked.count() // (4 * tasks)))  # a block for each core, if there are enough queries
    asked, blocks = _in_blocks(asked, most, f"{folder}/queries")
    asked = asked.repartition(max(tasks, blocks), "part", "block").sortWithinPartitions("part", "block")
    found = asked.mapInArrow(_searcher(spark.sparkContext.broadcast(files), k, size, id_col), f"query_id long, `{id_col}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def op4_learned_partitions(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, F.col("id") % 50 == 0)
