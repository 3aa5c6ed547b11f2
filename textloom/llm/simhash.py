"""Near-duplicates by SimHash: fingerprints, Hamming links through BK-trees, linked groups.

Two fingerprints within r bits of each other agree in at least b - r of any b
blocks their bits are cut into.  Every way to choose b - r blocks, with the
values found there, names a shard; fingerprints that link are together in at
least one shard.  b is the least that keeps a shard to about a thousand evenly
spread fingerprints, so trees stay bounded as the corpus grows.  Each shard's
fingerprints form a BK-tree (children keyed by their distance to the parent),
which all of them search along edges within the radius only.  A shard's tree
comes to the task that has its fingerprints, by shuffle: broadcasting the trees
of all shards to all tasks would grow with the corpus.  Links that join nothing
new are not followed: a branch whose fingerprints all share the group of the
one searched is skipped, and a shard gives fewer links than fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_WORD_BYTES, arrow_limits, discard, materialize, with_text

SEED = 42


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned 64 bits: each is 1 if set in over half the hashes of the word shingles, repeats included."""
    words = BLANK_WORD_BYTES.findall(text.encode().lower())
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, *more: Column) -> DataFrame:
    """(doc_id, fp, ...): fp has the fingerprint's bits as a signed long.  Null and empty texts have 0."""
    arrow_limits(docs.sparkSession)
    rows = with_text(docs, id_col, text_col, *more)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long{kept}")


def joined_groups(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each place's smallest fellow) after joining the groups of places a with those of places b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(shorter := label[label], label):
            label = shorter


class BKTrees:
    """A BK-tree for each shard, all of them in arrays and searched together; no fingerprint is twice in a shard.

    A node is a fingerprint's place.  Its children are keyed by their distance to it and stored together in the order
    of that key, so the edges within the radius of a distance are one stretch: first[node, d - r] to first[node, d + r + 1].
    """

    EDGES = 66

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard in ascending order, value as uint64."""
        n = len(value)
        self.value = value
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.empty(0, np.int64)
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        self.levels = [starts]
        left = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at = self.root[left]
        while len(left):
            d = np.bitwise_count(value[at] ^ value[left]).astype(np.int64)
            _, new, where = np.unique(at * self.EDGES + d, return_index=True, return_inverse=True)
            self.parent[left[new]], self.edge[left[new]] = at[new], d[new]
            self.levels.append(left[new])
            at, further = left[new][where], np.ones(len(left), bool)
            further[new] = False
            left, at = left[further], at[further]
        has = np.flatnonzero(self.parent >= 0)
        key = self.parent[has] * self.EDGES + self.edge[has]
        self.children = has[np.argsort(key, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n * self.EDGES))])

    def of_one_group(self, label: np.ndarray) -> np.ndarray:
        """Whether a node and all nodes below it are of one group."""
        out = np.ones(len(label), bool)
        for nodes in reversed(self.levels[1:]):
            above = self.parent[nodes]
            out[above[~out[nodes] | (label[nodes] != label[above])]] = False
        return out

    def search(self, asked: np.ndarray, radius: int, label: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked place, place within the radius) pairs; branches whose nodes are all of the asked one's own group are left out."""
        found, at, edges = [(asked[:0], asked[:0])], self.root[asked], self.EDGES
        while len(asked):
            open_ = ~(uniform[at] & (label[at] == label[asked]))
            asked, at = asked[open_], at[open_]
            d = np.bitwise_count(self.value[asked] ^ self.value[at]).astype(np.int64)
            near = d <= radius
            found.append((asked[near], at[near]))
            low = self.first[at * edges + np.maximum(d - radius, 0)]
            size = self.first[at * edges + np.minimum(d + radius, edges - 2) + 1] - low
            ends = np.cumsum(size)
            asked = np.repeat(asked, size)
            at = self.children[np.arange(len(asked)) + np.repeat(low - ends + size, size)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def groups(self, radius: int, step: int = 1024) -> np.ndarray:
        """For each place the first place of its group: all links within the radius, inside a shard, are followed."""
        n = len(self.value)
        own = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        label = joined_groups(np.arange(n), own, self.parent[own])
        for i in range(0, n, step):
            label = joined_groups(label, *self.search(np.arange(i, min(n, i + step)), radius, label, self.of_one_group(label)))
        return label


def block_count(n: int, radius: int, aim: int = 1024) -> int:
    """Blocks for n fingerprints: the fewest for which evenly spread ones lie about `aim` to a shard at most."""
    for blocks in range(radius + 1, radius + 5):
        if n >> (64 * (blocks - radius) // blocks) <= aim:
            return blocks
    return radius + 4


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """For each choice of blocks - radius blocks: a hash of the choice and of the bits in these blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def whole_shards(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches in order of their shards, in tables of about so many rows; no shard is in two of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            shard = table.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield table.slice(0, cut)
            held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


def hamming_links(distinct: DataFrame, radius: int = 4, shard_limit: int = 4096) -> DataFrame:
    """(a, b) links between different fingerprints (column fp) that make the same groups as all links within radius.

    Counts the fingerprints first.  A shard of more than shard_limit fingerprints is dealt into runs, and every pair
    of runs is a piece of work of its own, over which the larger shard is searched completely; other shards are one.
    """
    n = distinct.count()
    blocks = block_count(n, radius)
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > shard_limit).withColumn("runs", F.ceil(F.col("n") / (shard_limit // 2)).cast("int"))
    large, path = materialize(crowded.select("shard", "runs"), "shards")
    some = large.count()
    if some:
        # there are at most rows / shard_limit of these shards
        marked = keyed.join(F.broadcast(large) if some <= 100_000 else large, "shard", "left")
        run = F.pmod(F.xxhash64("fp", "shard"), F.col("runs")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda o: F.least(run, o) * F.col("runs") + F.greatest(run, o))
        work = marked.withColumn("piece", F.explode(F.when(F.col("runs").isNull(), F.array(F.lit(-1).cast("int"))).otherwise(pairs)))
        work = work.select("fp", F.when(F.col("piece") < 0, F.col("shard")).otherwise(F.xxhash64("shard", "piece")).alias("shard"))
    else:
        work = keyed
    dealt = work.repartition("shard").sortWithinPartitions("shard", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_shards(batches):
            fps = held.column("fp").to_numpy()
            label = BKTrees(held.column("shard").to_numpy(), fps.view(np.uint64)).groups(radius)
            own = np.flatnonzero(label != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[label[own]])], names=["a", "b"])

    return dealt.select("fp", "shard").mapInArrow(search, "a long, b long").distinct()


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the group; for the nodes that have a link.

    Large-star and small-star rounds: each hangs a node's neighbours on the smallest node around it.  Minimums are
    summed up before they are shuffled, joins on a crowded node are split by adaptive execution, and each round is
    written to the shared folder, so nothing of it grows in lineage, on the driver or in one task.  The rounds go on
    until one changes nothing, which every graph comes to.
    """
    spark = links.sparkSession
    edges, path = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    before = size(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges, new = materialize(star, "edges")
        after = size(edges)
        discard(spark, path)
        path = new
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, *more: Column) -> DataFrame:
    """(doc_id, fp, component_id, ...): component_id is the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one node throughout, so exact copies cost nothing beyond their row.  Writes the
    fingerprints and each round of the grouping to the shared folder.  Null and empty texts share fingerprint 0 and
    are linked like any other; equal rows come back each; null ids are the smallest only where a group has no other.
    Ids may be of any type with an order; an empty table gives no row.
    """
    return grouped_rows(docs, id_col, text_col, width, radius, *more).drop("root")


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, *more: Column) -> DataFrame:
    """near_duplicates with each row's group, root: two groups can have the same component_id, where ids are repeated or null."""
    rows, _ = materialize(fingerprints(docs, id_col, text_col, width, *more), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = linked_groups(hamming_links(nodes.select("fp"), radius))
    # each join is of tables as they are read, with no aggregate below it: adaptive execution can split a large group
    rooted, _ = materialize(nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest, _ = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named, _ = materialize(rooted.join(smallest, "root").select("fp", "component_id", "root"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *rows.columns[2:], "root")
