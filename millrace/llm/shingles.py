"""Near-duplicates by the exact similarity of shingle sets, of candidates from SimHash tries and from min-wise hashes.

1. The set of a text: lower-case A-Z, words between ASCII white space, XXH64 of each n-word shingle (fewer words: the
   whole sequence). Texts with one set are one class, of which one row goes on.
2. A class has the SimHash fingerprint of its shingles, and BANDS keys, each of the ROWS smallest values of its set under as
   many hash functions. Two sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, whatever the size of
   the table: 0.9996 at 0.8.
3. Candidates are verified: the similarity |A and B| / |A or B| is counted from the sets. First come the links of the
   fingerprints' trie self-join (within RADIUS bits, millrace.llm.simhash), which join most copies; fingerprints alone
   would miss many pairs of similarity 0.8, and join some below. Then each class meets one hub of its buckets, and another
   that is not in its component yet. What is left of a bucket in two components is compared block by block: by sketches,
   the lowest bytes of the smallest values, then those of which the sketches agree in no less than SLACK below the
   similarity by their sets, each pair in the first bucket that it shares. A task gives a forest of links.

So what is linked is the closure of the pairs that share a key and have the similarity; large groups of copies need no more
pairs than members, and the pairs of a bucket are never rows.

Defined cases: null text counts as empty; the texts without a word are one class; rows that repeat an id and a text have one
name; null ids take part, and name a component only if all its ids are null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.simhash import _token_blocks, components, links

BANDS, ROWS, HUBS, RADIUS = 20, 5, 2, 4
#: Of a sketch: what chance may take from the share of equal bytes (four deviations at 0.8); members of a block, and bytes of
#: their sets.
SLACK, BLOCK, BLOCK_BYTES = 0.16, 2048, 16 << 20
#: Names of rows that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_rng = np.random.default_rng(23)
_XOR, _TIMES = (_rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)

# ---------------------------------------------------------------------------------------------------------- of a text


def shingles(text: bytes, words: int, seed: int = 42, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, at least one, in blocks."""
    hashed, none, tokens = xxhash.xxh64_intdigest, True, []
    for tokens in _token_blocks(text, words - 1, block):
        if len(tokens) >= words:
            joined, none = b" ".join(tokens), False
            stops = list(accumulate(map(len, tokens), lambda a, b: a + b + 1))
            starts = chain([0], (x + 1 for x in stops))
            yield np.array([hashed(joined[a:b], seed) for a, b in zip(starts, stops[words - 1 :], strict=False)], dtype=np.uint64)
    if none:
        yield np.array([hashed(b" ".join(tokens), seed)], dtype=np.uint64)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes."""
    return np.unique(np.concatenate([np.unique(x) for x in shingles(text, words)]))


def fingerprint(blocks: list[np.ndarray]) -> int:
    """A bit wherever over half of the hashes have it, as a signed number."""
    ones = sum(np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for x in blocks)
    return int(np.packbits(2 * ones > sum(map(len, blocks)), bitorder="little").view(np.int64)[0])


def keys_of(own: np.ndarray) -> tuple[list[int], bytes]:
    """The keys of a set, as signed 64-bit numbers, and its sketch."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(own), 2048):
        np.minimum(least, ((own[k : k + 2048, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    raw, size = least.tobytes(), 8 * ROWS
    found = [xxhash.xxh3_64_intdigest(raw[k * size : (k + 1) * size], k) for k in range(BANDS)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def similar(a: bytes, b: bytes, least: float) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


PRINTS = "id long, row string, name binary, keys array<long>, sketch binary, fp long"


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 512):
            found = []
            for text in common.utf8(batch.column(2)):
                blocks = list(shingles(text, words))
                own = np.unique(np.concatenate(blocks))
                found.append((xxhash.xxh3_128_digest(own.tobytes()), *keys_of(own), fingerprint(blocks)))
            name, keys, sketch, fp = (list(x) for x in zip(*found, strict=True))
            columns = [batch.column(0), batch.column(1), pa.array(name, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(fp, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "name", "keys", "sketch", "fp"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches, 256):
            found = [shingle_set(text, words).tobytes() for text in common.utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "own"])

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a.as_buffer(), b.as_buffer(), least) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _linked(least: float):
    """Rows (key, pair, side, node, root, sketch, keys, own), sorted by the first two: links of nodes in two components that
    join just what the similar pairs of a group join. A pair of two blocks meets only across."""
    need = int(np.ceil((least - SLACK) * BANDS * ROWS))

    def linked(key: int, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        side, node, root = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (2, 3, 4))
        sketch = np.frombuffer(b"".join(chain.from_iterable(b.column(5).to_pylist() for b in held)), dtype=np.uint8).reshape(len(node), -1)
        keys = np.concatenate([b.column(6).flatten().to_numpy() for b in held]).reshape(len(node), BANDS)
        sets = list(chain.from_iterable(b.column(7) for b in held))
        size = np.array([x.as_buffer().size for x in sets], dtype=np.int64)
        across, into, u, v = len(np.unique(side)) > 1, {}, [], []

        def find(x: int) -> int:
            while x in into:
                x = into[x]
            return x

        for a in range(0, len(node), 64):
            own = slice(a, a + 64)
            good = (sketch[own, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16) >= need
            good &= root[own, None] < root[None, :]
            good &= np.minimum(size[own, None], size[None, :]) >= least * np.maximum(size[own, None], size[None, :]) - 1e-6
            if across:
                good &= side[own, None] != side[None, :]
            i, j = np.nonzero(good)
            i += a
            same = keys[i] == keys[j]
            here = keys[i, same.argmax(axis=1)] == key  # the first bucket of the pair
            for x, y in zip(i[here].tolist(), j[here].tolist(), strict=True):
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q and similar(sets[x].as_buffer(), sets[y].as_buffer(), least):
                    into[max(p, q)] = min(p, q)
                    u.append(min(node[x], node[y]))
                    v.append(max(node[x], node[y]))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if u else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            key, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a < b:
                    if at != (key[a], pair[a]) and held:
                        if (out := linked(at[0], held)) is not None:
                            yield out
                        held = []
                    at = (key[a], pair[a])
                    held.append(batch.slice(a, b - a))
        if held and (out := linked(at[0], held)) is not None:
            yield out

    return run


# ---------------------------------------------------------------------------------------------------------- the tables


def row_name(id_: Column, text: Column) -> Column:
    """128 bits of id and text, in hex."""
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("\0"), F.coalesce(text.cast("string"), F.lit("\1"))))


def small(rows: DataFrame) -> DataFrame:
    """rows, a staged table, with a hint to broadcast it if it has few rows; otherwise joins with it are shuffles."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _trie_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): classes that one fingerprint or the trie self-join of the fingerprints connects."""
    named = classes.groupBy("fp").agg(F.min("node").alias("first"))
    edges = links(named.select("fp"), radius=RADIUS)
    ends = edges.join(named.toDF("u", "a"), "u").join(named.toDF("v", "b"), "v").select(F.col("a").alias("node"), F.col("b").alias("hub"))
    return classes.join(named, "fp").filter("node <> first").select("node", F.col("first").alias("hub")).unionByName(ends)


def _block_links(open_: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of the nodes of each key that are in two components."""
    sizes = sets.select("node", F.octet_length("own").alias("bytes"))
    most = F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    held = open_.join(sizes, "node").groupBy("key").agg(F.ceil(most).cast("int").alias("blocks"), F.count("*").alias("n"))
    rows = common.meet(open_, held, ["key"], "node", open_.count()).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("side", "other").cast("long") * F.lit(1 << 31) + F.greatest("side", "other").cast("long")
    rows = rows.join(classes.select("node", "sketch", "keys"), "node").join(sets, "node")
    rows = rows.select("key", pair.alias("pair"), "side", "node", "root", "sketch", "keys", "own")
    rows = rows.repartition(common.shuffle_partitions(open_.sparkSession), "key", "pair").sortWithinPartitions("key", "pair")
    return rows.mapInArrow(_linked(similarity), "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """id_col, row (the row's name, of id and text) and component_id, the smallest id in the component, for every row of
    docs, and component, which tells components apart also where ids are null."""
    folder = common.work_dir(docs.sparkSession, "shingles")
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = common.spread(docs.select(id_.alias("id"), row_name(id_, text).alias("row"), text.alias("text")))
    prints = common.stage(rows.mapInArrow(_keyed(words), PRINTS), f"{folder}/prints")
    classes = prints.groupBy("name").agg(F.min("row").alias("row"), F.min("id").alias("id"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = common.stage(classes.withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes")
    buckets = classes.select("node", F.explode("keys").alias("key"))
    held = buckets.groupBy("key").agg(F.count("*").alias("n"))
    members = common.meet(buckets, held, ["key"], "node", BANDS * classes.count()).filter("n > 1").select("key", "node")
    members = common.stage(members, f"{folder}/members")
    many = members.count()
    first = common.stage(_trie_pairs(classes), f"{folder}/trie")
    some = members.select("node").unionByName(first.select("node")).unionByName(first.select(F.col("hub").alias("node"))).distinct()
    some = common.stage(some.join(classes.select("node", "row"), "node"), f"{folder}/some")
    texts = rows.join(small(some), "row").select("node", "text").dropDuplicates(["node"])
    sets = common.stage(texts.mapInArrow(_sets(words), "node long, own binary"), f"{folder}/sets")

    nodes = seen = found = None
    for turn in range(HUBS + 2):
        if turn == 0:
            pairs = first
        else:
            named = members.join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
            held = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
            named = common.meet(named, held, ["key"], "node", many).filter("a <> b").select("key", "node", "root")
            named = common.stage(named, f"{folder}/open-{turn}")
        if turn in range(1, HUBS + 1):
            hub = named.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("hub"), F.col("root").alias("other"))).alias("x"), F.count("*").alias("n"))
            pairs = common.meet(named, hub, ["key"], "node", many).select("node", "root", "x.col1", "x.hub", "x.other").filter("root <> other")
            if turn == 1:  # one hub for each
                pairs = pairs.groupBy("node").agg(F.min(F.struct("col1", "hub")).alias("x")).select("node", "x.hub")
        if turn <= HUBS:
            pairs = pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
            if seen is not None:
                pairs = pairs.join(seen, ["u", "v"], "left_anti")
            pairs = common.stage(pairs, f"{folder}/pairs-{turn}")
            both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u")
            both = both.join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")
            new, seen = both.mapInArrow(_verified(similarity), "u long, v long"), pairs if seen is None else seen.unionByName(pairs)
        else:
            new = _block_links(named, classes, sets, similarity)
        new = common.stage(new, f"{folder}/links-{turn}")
        found = new if found is None else found.unionByName(new)
        if nodes is None or not new.isEmpty():
            nodes = components(found, f"{folder}/components-{turn}")
    rooted = classes.select("node", "name", "id").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = common.stage(rooted, f"{folder}/rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    named = common.meet(rooted, least, ["root"], "node", rooted.count()).select("name", F.col("root").alias("component"), "component_id")
    return prints.select("id", "row", "name").join(named, "name").select(F.col("id").alias(id_col), "row", "component", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each component, the one with the smallest id stays (one without an id
    only if none has one; of rows that repeat it, one). Rows that go are told by name: texts are not shuffled as long as
    the names are few."""
    folder = common.work_dir(docs.sparkSession, "one")
    found = common.stage(near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, similarity=similarity).withColumnRenamed(id_col, "id"), f"{folder}/found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    first = common.stage(first.select("component", F.col("first.row").alias("first")), f"{folder}/first")
    counts = common.stage(found.groupBy("component", "row").agg(F.count("*").alias("n")), f"{folder}/counts")
    rows = counts.join(first, "component")  # plain exchanges on both sides, as a component can hold a third of the rows
    rows = common.stage(rows.select("row", "n", (F.col("row") == F.col("first")).alias("stays")), f"{folder}/rows")
    gone = common.stage(rows.filter("NOT stays OR n > 1").select(F.col("row").alias("_row"), "stays"), f"{folder}/gone")
    given = docs.withColumn("_row", row_name(F.col(id_col), F.col(text_col)))
    gone = small(gone)
    again = given.join(gone.filter("stays").select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return given.join(gone.select("_row"), "_row", "left_anti").unionByName(again).select(*docs.columns)
