"""Near-duplicates by SimHash fingerprints, joined by walking binary tries, and their connected components.

1. Fingerprints: lower-case A-Z, words between ASCII white space, n-word shingles (repeats count; fewer words: the
   whole sequence; none: fingerprint 0), XXH64 of each, and a bit wherever over half of the hashes have it.
2. Only distinct fingerprints go on, each with its smallest document id: a group of copies is one row.
3. Two fingerprints of 64 bits within the radius r agree in at least b - r of b blocks of bits. For each choice of b - r blocks,
   the fingerprints are dealt out by those blocks; b grows with the number of fingerprints, so that what shares a
   bucket stays small. Every choice of b gives the same links. Wide fingerprints, for large radii, are dealt out by
   tables of sampled bits instead, as many as find RECALL of the pairs that differ in radius bits.
4. Within a bucket, the sorted fingerprints are a binary trie. Pairs of its nodes are walked together, bit by bit: the
   error of a pair grows where its nodes take different branches, and a pair beyond the radius is dropped with all
   below it. A pair of nodes whose leaves are all in one component already has nothing to add and is dropped too.
   What is left of a bucket's links is a spanning forest: never more edges than fingerprints.
   Buckets over SPLIT rows are cut into chunks; each pair of chunks is a task's work, so none is held whole by a task.
5. Components: alternating large-star and small-star steps over the edges, each written to the shared folder.

Defined cases: null text counts as empty (fingerprint 0, linked like any other); rows with the same id each give their
own row; null ids take part in linking but never name a component unless all ids in it are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

BITS = 64
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Rows of a bucket, from which it is cut into chunks.
SPLIT = 1 << 16
#: Pairs of nodes that are held at once.
FRONTIER = 1 << 20
#: Of the pairs that differ in as many bits as the radius, those that meet in a table of sampled bits.
RECALL = 0.98

# ------------------------------------------------------------------------------------------------------- fingerprints


def _derived(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of wide hashes; the first is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _token_blocks(text: bytes, overlap: int, size: int) -> Iterator[list[bytes]]:
    """The words of a text in blocks of about size bytes, each after the first with the overlap words before it."""
    at, kept = 0, []
    while at < len(text):
        stop = at + size
        found = WHITE.search(text, stop) if stop < len(text) else None
        stop = found.start() if found else len(text)
        tokens = kept + text[at:stop].lower().split()
        yield tokens
        at, kept = stop, tokens[-overlap:] if overlap else []


def fingerprint(text: bytes, words: int = 4, seed: int = 42, width: int = 1, block: int = 1 << 20) -> np.ndarray:
    """The fingerprint of a whole text, width words of 64 bits, in memory for about block bytes of it."""
    hashed, counts, n, tokens = xxhash.xxh64_intdigest, np.zeros((width, BITS), dtype=np.int64), 0, []

    def count(hashes: list[int]) -> None:
        nonlocal n
        n += len(hashes)
        own = np.array(hashes, dtype=np.uint64)
        for w in range(width):
            counts[w] += np.unpackbits(_derived(own, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for tokens in _token_blocks(text, words - 1, block):
        if len(tokens) >= words:
            joined = b" ".join(tokens)
            stops = list(accumulate(map(len, tokens), lambda a, b: a + b + 1))
            starts = chain([0], (x + 1 for x in stops))
            count([hashed(joined[a:b], seed) for a, b in zip(starts, stops[words - 1 :], strict=False)])
    if not n and tokens:  # fewer words than a shingle has: they are all in the last block
        count([hashed(b" ".join(tokens), seed)])
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64).ravel()


def columns_of(width: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, width))]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, width: int = 1) -> DataFrame:
    """id_col and the fingerprint's words as signed longs: fp, fp1, ..."""
    names = columns_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 512):
            found = np.array([fingerprint(x, words, seed, width) for x in common.utf8(batch.column(1))], dtype=np.uint64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k].view(np.int64)) for k in range(width))], names=[id_col, *names])

    rows = common.spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")))
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` long", *(f"{n} long" for n in names)]))


# ----------------------------------------------------------------------------------------------------- local trie join


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


class Forest:
    """Components of rows 0..n-1; label[i] is the smallest row of i's component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            keep = x != y
            if not keep.any():
                break
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            self.label = _roots(parent)[self.label]
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else self.label

    def one(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether the rows [a0, a1) and [b0, b1) are all in one component."""
        return (self.label[a0] == self.label[b0]) & (self.changes[a1 - 1] == self.changes[a0]) & (self.changes[b1 - 1] == self.changes[b0])


def trie_links(keys: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """label of each row: rows within radius of each other in a bucket get the same one, transitively.

    keys: (rows, words) distinct fingerprints, sorted within buckets; bucket: sorted.
    """
    n = len(keys)
    forest = Forest(n)
    if n < 2:
        return forest.label
    apart = lambda a, b: np.bitwise_count(keys[a] ^ keys[b]).sum(axis=1, dtype=np.int64)
    near = (bucket[1:] == bucket[:-1]) & (apart(slice(1, None), slice(None, -1)) <= radius)
    at = np.flatnonzero(near)
    forest.link(at, at + 1)  # neighbours in the order of the trie's leaves: most of a dense group is one component now
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    stop = np.append(first[1:], n)
    wide = stop - first > 1
    first, stop = first[wide], stop[wide]
    last = BITS * keys.shape[1] - 1

    @lru_cache(maxsize=8)
    def ones(bit: int) -> np.ndarray:
        """Before each row, the rows that have the bit; bits count down from the first word's highest."""
        return np.concatenate([[0], np.cumsum(keys[:, (last - bit) // BITS] >> np.uint64(bit % BITS) & np.uint64(1), dtype=np.int64)])

    work = [(last, first, stop, first, stop, np.zeros(len(first), dtype=np.int16))]
    while work:
        bit, a0, a1, b0, b1, error = work.pop()
        open_ = ~forest.one(a0, a1, b0, b1)
        a0, a1, b0, b1, error = a0[open_], a1[open_], b0[open_], b1[open_], error[open_]
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            work += [(bit, a0[half:], a1[half:], b0[half:], b1[half:], error[half:]), (bit, a0[:half], a1[:half], b0[:half], b1[:half], error[:half])]
            continue
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaves.any():
            a, b = a0[leaves], b0[leaves]
            close = apart(a, b) <= radius
            forest.link(a[close], b[close])
            a0, a1, b0, b1, error = a0[~leaves], a1[~leaves], b0[~leaves], b1[~leaves], error[~leaves]
        if not len(a0) or bit < 0:
            continue
        one = ones(bit)
        am, bm = a1 - (one[a1] - one[a0]), b1 - (one[b1] - one[b0])  # where the bit turns to 1
        same = (a0 == b0) & (a1 == b1)
        kids = []
        for x0, x1, y0, y1, more, which in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (error + more <= radius)
            if which is not None:
                ok &= which
            ok &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], (error[ok] + more).astype(np.int16)))
        work.append((bit - 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))
    return forest.label


# ------------------------------------------------------------------------------------------------------ the wide join


def choices(n: int, radius: int, wanted: int = 2048) -> list[list[tuple[int, int]]]:
    """For each choice of blocks that must agree, its (start, width)s: the fewest blocks that leave about wanted of n
    fingerprints in a bucket."""
    for blocks in range(radius + 1, radius + 5):
        keep = blocks - radius
        if n / 2 ** (BITS * keep / blocks) <= wanted or blocks == radius + 4:
            break
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    return [[(cuts[k], cuts[k + 1] - cuts[k]) for k in own] for own in combinations(range(blocks), keep)]


def _bucket_of(band: list[tuple[int, int]]):
    bits = F.lit(0).cast("long")
    for start, width in band:
        bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return bits


def tables(n: int, width: int, recall: float, radius: int, seed: int = 11) -> np.ndarray:
    """(tables, bits): the sampled bits of each table. Their number grows with the logarithm of n, so that buckets of
    unlike fingerprints stay small; that of the tables grows with it, so that the recall stays the same."""
    bits = min(32, max(14, math.ceil(math.log2(max(n, 1) / 4))))
    many = math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / (BITS * width)) ** bits))
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS * width)[:bits] for _ in range(many)])


def _sampled(chosen: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 8192):
            fps = np.stack([c.to_numpy() for c in batch.columns], axis=1).view(np.uint64)
            for band, own in enumerate(chosen):
                bucket = np.zeros(len(fps), dtype=np.uint64)
                for bit in own.tolist():
                    bucket = bucket << np.uint64(1) | fps[:, bit // BITS] >> np.uint64(bit % BITS) & np.uint64(1)
                columns = [*batch.columns, pa.array(np.full(len(fps), band, dtype=np.int32)), pa.array(bucket.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "band", "bucket"])

    return run


def _joiner(radius: int, width: int, at_once: int = 1 << 17):
    """Rows (band, bucket, pair, node, fp...), sorted by the first three: edges (u, v) of spanning forests."""

    def solved(columns: list[np.ndarray]) -> pa.RecordBatch | None:
        group = np.cumsum(np.any([np.diff(c, prepend=c[0]) != 0 for c in columns[:3]], axis=0))
        fp = np.stack([c.view(np.uint64) for c in columns[4:]], axis=1)
        order = np.lexsort((*fp.T[::-1], group))
        group, fp, node = group[order], fp[order], columns[3][order]
        label = trie_links(fp, group, radius)
        joined = np.flatnonzero(label != np.arange(len(label)))
        if not len(joined):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[label[joined]]), pa.array(node[joined])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < at_once:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            new = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)) + 1
            stop = int(new[-1]) if len(new) else 0  # the last group may go on
            if stop and (out := solved([c[:stop] for c in columns])):
                yield out
            held, size = [[c[stop:] for c in columns]], len(columns[0]) - stop
        if size and (out := solved([np.concatenate(c) for c in zip(*held, strict=True)])):
            yield out

    return run


def node_of(width: int):
    """What names a fingerprint in edges: itself, or a wide one's hash."""
    return F.col("fp") if width == 1 else F.xxhash64(*columns_of(width))


def links(prints: DataFrame, *, radius: int = 4, width: int = 1, n: int | None = None) -> DataFrame:
    """Edges (u, v) between nodes of the distinct fingerprints of prints, that connect just what pairs within radius
    connect (of wide fingerprints: of the pairs that meet in a table)."""
    spark = prints.sparkSession
    n = prints.count() if n is None else n
    names = columns_of(width)
    if width == 1:
        parts = [F.struct(F.lit(k).alias("band"), _bucket_of(band).alias("bucket")) for k, band in enumerate(choices(n, radius))]
        many = len(parts)
        rows = prints.select("fp", F.explode(F.array(*parts)).alias("x")).select("fp", "x.band", "x.bucket")
    else:
        schema = ", ".join([*(f"{x} long" for x in names), "band int, bucket long"])
        chosen = tables(n, width, RECALL, radius)
        rows, many = prints.select(*names).mapInArrow(_sampled(chosen, names), schema), len(chosen)
    buckets = rows.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    rows = common.meet(rows, buckets, ["band", "bucket"], names[0], n * many).withColumn("chunks", F.ceil(F.col("n") / SPLIT).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int"))
    # chunk i meets chunk j in the pair (min, max); a bucket of one chunk is the pair (0, 0)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.least("side", "other").cast("long") * F.lit(1 << 31) + F.greatest("side", "other").cast("long")
    rows = rows.select("band", "bucket", pair.alias("pair"), node_of(width).alias("node"), *names)
    tasks = common.shuffle_partitions(spark)
    rows = rows.repartition(tasks, "band", "bucket", "pair").sortWithinPartitions("band", "bucket", "pair")
    return rows.mapInArrow(_joiner(radius, width), "u long, v long").distinct()


def components(edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(node, root) of every node that an edge (u, v) has; root is one node of its component, the same for all of it.

    Large-star: every node's larger neighbours go to its smallest neighbour or itself. Small-star: every node's smaller
    neighbours and itself go to the smallest of them. The minima are aggregates with map-side sums, and a node of many
    neighbours meets its own in several tasks; no neighbourhood is ever collected. Ends when a round leaves the edges as
    they were.
    """

    def with_least(pairs: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        return common.meet(pairs, least, ["u"], "v", total), least

    edges = common.stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    state = (edges.count(),)
    for k in range(1, most + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, _ = with_least(both, 2 * state[0])
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met, smallest = with_least(large, state[0])
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.stage(edges, f"{folder}/edges-{k}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4, width: int = 1) -> DataFrame:
    """id_col, the fingerprint (fp, and fp1, ... of a wide one) and component_id, the smallest id in the component, for
    every row of docs."""
    folder, names = common.work_dir(docs.sparkSession, "simhash"), columns_of(width)
    prints = common.stage(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed, width=width), f"{folder}/prints")
    classes = common.stage(prints.groupBy(*names).agg(F.min(id_col).alias("least_id")).withColumn("node", node_of(width)), f"{folder}/classes")
    nodes = components(links(classes.select(*names), radius=radius, width=width), folder)
    rooted = common.stage(classes.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{folder}/rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    named = common.meet(rooted, least, ["root"], "node", rooted.count()).select(*names, "component_id")
    return prints.join(named, names).select(id_col, *names, "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
