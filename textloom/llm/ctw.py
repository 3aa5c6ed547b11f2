"""Language-model scoring by context-tree weighting.

Bytes are predicted bit by bit (eight binary decisions each, one context tree
for each node of the byte's binary tree).  A node of such a tree is a context:
the last d bytes, d from 0 to DEPTH, each as one of 32 classes.  Its counts
give a Krichevsky-Trofimov block probability; a node mixes its own estimate
half and half with the product of its children's, and so over all depths.

Counts are gathered over all training documents and add up in any order.
Every context that occurs is a node of its own, so the model grows with the
corpus.  Its counts stay in a table in the shared folder: the branches below
each context of TOP classes are mixed where their counts are, and only the
sums of these, whose number is fixed, meet on the driver.  After training the
mixture is fixed; a cell (context and byte) then has one log-probability.  The
frequent cells' are broadcast, those of all others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_WORD_BYTES, arrow_limits, arrow_rows, discard, materialize, with_text

DEPTH, CLASSES, CLASS_BITS = 5, 32, 5
#: The contexts of so many classes, CLASSES**TOP at most, are mixed on the driver.
TOP = 2


def byte_classes() -> np.ndarray:
    """Class of each byte: letters of either case 1 to 26, blank 0, other blanks and controls 27, digits 28, other ASCII 29, UTF-8 lead 30 and further bytes 31."""
    c = np.full(256, 29, np.int64)
    c[:32], c[127], c[32] = 27, 27, 0
    c[ord("0") : ord("9") + 1] = 28
    for i in range(26):
        c[ord("a") + i] = c[ord("A") + i] = i + 1
    c[0xC0:], c[0x80:0xC0] = 30, 31
    return c


CLASS = byte_classes()


def newest_first(kinds: np.ndarray, depth: int) -> np.ndarray:
    """For each place the classes of the depth bytes before it as one number, the newest in the highest bits."""
    at = np.zeros(len(kinds), np.int64)
    for d in range(1, depth + 1):
        at <<= CLASS_BITS
        at[d:] |= kinds[:-d]
    return at


def encoded(text: str) -> np.ndarray:
    """UTF-8 bytes of the text, and byte 0 for its end."""
    return np.frombuffer(text.encode("utf-8", "replace") + b"\0", np.uint8)


def cells(text: str) -> np.ndarray:
    """For each byte of the text and its end: context and byte as one number."""
    raw = encoded(text)
    return newest_first(CLASS[raw], DEPTH) << 8 | raw


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) - np.log(shift)


def block_probability(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    n = zeros + ones
    out = np.zeros(n.shape)
    some = n > 0
    a, b = zeros[some].astype(float), ones[some].astype(float)
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)
    return out


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, 255) zeros and ones of the binary tree's nodes, level by level, from (contexts, 256) byte counts."""
    zeros, ones = [], []
    for level in range(8):
        halves = counts.reshape(len(counts), 2 << level, 128 >> level).sum(2)
        zeros.append(halves[:, 0::2])
        ones.append(halves[:, 1::2])
    return np.hstack(zeros), np.hstack(ones)


class ContextTree:
    """Nodes by depth and context; the byte table of each node's leaf for all other children."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels: for each depth, the nodes' contexts in ascending order, every parent among them, and (nodes, 256) counts."""
        n = [len(contexts) for contexts, _ in levels]
        first = np.concatenate([[0], np.cumsum(n)])
        self.kids = np.full((first[-1] + 1, CLASSES), -1, np.int32)
        parents = []
        for d in range(1, len(levels)):
            contexts, above = levels[d][0], levels[d - 1][0]
            parents.append(np.searchsorted(above, contexts >> CLASS_BITS))
            self.kids[first[d - 1] + parents[-1], contexts & (CLASSES - 1)] = first[d] + np.arange(n[d])
        own = [block_probability(*bit_counts(c)) for _, c in levels]
        # from the deepest up: weighted probability, and odds of a node's own estimate against its children's
        weighted, odds, others = own[-1], [np.full_like(own[-1], np.inf)], [levels[-1][1]]
        for d in range(len(levels) - 2, -1, -1):
            in_kids = np.zeros_like(levels[d][1])
            below = np.zeros_like(own[d])
            if n[d + 1]:
                np.add.at(in_kids, parents[d], levels[d + 1][1])
                np.add.at(below, parents[d], weighted)
            other = levels[d][1] - in_kids
            below += block_probability(*bit_counts(other))
            others.insert(0, other)
            odds.insert(0, own[d] - below)
            weighted = np.logaddexp(own[d], below) - np.log(2)
        # from the root down: what the nodes so far add to a leaf's estimate, and the share that is left to it
        tables = []
        added, left = np.zeros((1, 255)), np.ones((1, 255))
        for d, (_, counts) in enumerate(levels):
            share = 1 / (1 + np.exp(-np.clip(odds[d], -700, 700)))
            if d:
                added, left = added[parents[d - 1]], left[parents[d - 1]]
            added = added + left * share * estimate(counts)
            left = left * (1 - share)
            tables.append(byte_table(added + left * estimate(others[d])))
        self.table = np.concatenate(tables) if tables else np.empty((0, 256), np.float32)
        self.first_levels()

    def first_levels(self, depth: int = 3) -> None:
        """For each context of `depth` classes: the node it leads to, and whether that is so deep."""
        codes = np.arange(CLASSES**depth)
        self.start, alive = np.zeros(len(codes), np.int32), np.ones(len(codes), bool)
        for d in range(depth):
            kid = self.kids[self.start, codes >> CLASS_BITS * (depth - 1 - d) & (CLASSES - 1)]
            alive &= kid >= 0
            self.start = np.where(alive, kid, self.start)
        self.whole, self.depth = alive, depth

    def log10(self, text: str) -> float:
        """The text's log10-probability, its end included."""
        raw = encoded(text)
        kinds = CLASS[raw]
        code = newest_first(kinds, self.depth)
        node = self.start[code]
        alive = np.flatnonzero(self.whole[code])
        for d in range(self.depth, DEPTH):
            kid = self.kids[node[alive], np.where(alive > d, kinds[np.maximum(alive - d - 1, 0)], 0)]
            alive, kid = alive[kid >= 0], kid[kid >= 0]
            node[alive] = kid
        return float(self.table[node, raw].sum(dtype=np.float64))


def estimate(counts: np.ndarray) -> np.ndarray:
    zeros, ones = bit_counts(counts)
    return (ones + 0.5) / (zeros + ones + 1)


def byte_table(p: np.ndarray) -> np.ndarray:
    """(nodes, 256) log10-probabilities of bytes from (nodes, 255) probabilities of a one, as float32."""
    log = np.zeros((len(p), 1))
    for level in range(8):
        one = p[:, (1 << level) - 1 : (2 << level) - 1]
        log = np.stack([log + np.log10(1 - one), log + np.log10(one)], 2).reshape(len(p), 2 << level)
    return log.astype(np.float32)


def grow_tree(cell_counts: DataFrame, max_nodes: int) -> ContextTree:
    """Tree from (cell, n), on the driver: a small model to test score_documents by, which has no bound on its nodes.

    Nodes are all contexts that occur at least as often as the least power of two for which they are max_nodes or
    fewer; a context's parent occurs as often as itself at least, so every node's parent is a node.
    """
    at = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    context = F.expr(f"cell >> (8 + {CLASS_BITS} * ({DEPTH} - depth))")
    byte = F.expr("cell & 255")
    each = cell_counts.select("cell", "n", at).select("depth", context.alias("context"), byte.alias("byte"), "n")
    sums, path = materialize(each.groupBy("depth", "context", "byte").agg(F.sum("n").alias("n")), "contexts")
    totals = sums.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    steps = [1 << i for i in range(50)]
    sizes = totals.agg(*[F.count(F.when(F.col("total") >= s, 1)).alias(str(s)) for s in steps]).first()
    least = next((s for s in steps if sizes[str(s)] <= max_nodes), steps[-1])
    nodes = sums.join(totals.where(F.col("total") >= least), ["depth", "context"]).select("depth", "context", "byte", "n").toArrow()
    discard(cell_counts.sparkSession, path)
    depth, contexts, bytes_, n = (nodes.column(c).to_numpy() for c in ("depth", "context", "byte", "n"))
    levels = []
    for d in range(DEPTH + 1):
        here = depth == d
        own, row = np.unique(contexts[here], return_inverse=True)
        if not d and not len(own):
            own = np.zeros(1, np.int64)
        counts = np.zeros((len(own), 256), np.int64)
        counts[row, bytes_[here]] = n[here]
        levels.append((own, counts))
    return ContextTree(levels)


def starts_of(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of an ascending array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the share of the nodes' own estimates."""
    own = block_probability(zeros, ones)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(-np.clip(own - below, -700, 700)))


class Branches:
    """The trees below contexts of TOP classes, from their cells and counts; every context is a node.

    A cell may be given more than once, and with count 0 if it is only asked for: a node without counts has weighted
    probability 1 and passes on half of what it is given, so it changes nothing for the others.
    """

    def __init__(self, cell: np.ndarray, n: np.ndarray):
        self.cell, at = np.unique(cell, return_inverse=True)
        contexts, self.node = np.unique(self.cell >> 8, return_inverse=True)
        counts = np.zeros((len(contexts), 256), np.int64)
        counts[self.node, self.cell & 255] = np.bincount(at, n).astype(np.int64)
        zeros, ones = bit_counts(counts)
        self.leaf = (ones + 0.5) / (zeros + ones + 1)
        weighted = block_probability(zeros, ones)
        self.levels = []  # from the deepest but one up: number of children, share of the own estimate, own estimate
        for _ in range(DEPTH - 1, TOP, -1):
            contexts, first, size = self.parents(contexts)
            zeros, ones, below = (np.add.reduceat(x, first) for x in (zeros, ones, weighted))
            weighted, share = mixed(zeros, ones, below)
            self.levels.append((size, share, (ones + 0.5) / (zeros + ones + 1)))
        self.roots, first, self.in_root = self.parents(contexts)
        self.sums = tuple(np.add.reduceat(x, first) for x in (zeros, ones, weighted))

    @staticmethod
    def parents(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        above = contexts >> CLASS_BITS
        first = starts_of(above)
        return above[first], first, np.diff(np.append(first, len(above)))

    def log10(self, added: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Log10-probability of each cell, given what the driver's contexts have added and left."""
        added, left = (np.repeat(x[self.roots], self.in_root, 0) for x in (added, left))
        for size, share, own in reversed(self.levels):
            added, left = np.repeat(added + left * share * own, size, 0), np.repeat(left * (1 - share), size, 0)
        one = added + left * self.leaf
        out = np.zeros(len(self.cell))
        byte = self.cell & 255
        for level in range(8):
            p = one[self.node, (1 << level) - 1 + (byte >> 8 - level)]
            out += np.log10(np.where(byte >> 7 - level & 1, p, 1 - p))
        return out


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches in order of cells, in chunks of about so many rows; no context of TOP + 1 classes is in two of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            chunk = pa.Table.from_batches(held)
            key = chunk.column("cell").to_numpy() >> 8 + CLASS_BITS * (DEPTH - TOP - 1)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield chunk.slice(0, cut)
            held, size = chunk.slice(cut).to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


def by_branch(cells: DataFrame) -> DataFrame:
    """Dealt by the contexts of TOP + 1 classes, so that no frequent context of TOP classes is one task's; their sums add up."""
    return cells.repartition(F.expr(f"cell >> {8 + CLASS_BITS * (DEPTH - TOP - 1)}")).sortWithinPartitions("cell")


def mix_top(cell_counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(CLASSES**TOP, 255) each: what the contexts of up to TOP classes add to their branches' estimates, and the share left."""

    def added(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """One row a root, of which there are CLASSES**TOP at most."""
        total: dict[int, np.ndarray] = {}
        for roots, parts in rows:
            for root, part in zip(roots.tolist(), parts, strict=True):
                total[root] = total[root] + part if root in total else part
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([TaskContext.get().partitionId()] * len(total), pa.int64()), pa.array([p.tobytes() for p in total.values()], pa.binary())], names=["root", "part", "sums"])

    def of_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (Branches(chunk.column("cell").to_numpy(), chunk.column("n").to_numpy()) for chunk in in_chunks(batches))
        yield added((b.roots, np.stack([x.astype(float) for x in b.sums], 1)) for b in each)

    def of_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield added((b.column(0).to_numpy(), [np.frombuffer(x).reshape(3, 255) for x in b.column(2).to_pylist()]) for b in batches)

    schema = "root long, part long, sums binary"
    parts = by_branch(cell_counts).mapInArrow(of_branches, schema)
    total = np.zeros((CLASSES**TOP, 3, 255))
    for r in parts.repartition("root").sortWithinPartitions("root", "part").mapInArrow(of_roots, schema).collect():  # 6 MB
        total[r.root] = np.frombuffer(r.sums).reshape(3, 255)
    zeros, ones, below = total[:, 0], total[:, 1], total[:, 2]
    levels = []
    for _ in range(TOP + 1):
        weighted, share = mixed(zeros, ones, below)
        levels.append((share, (ones + 0.5) / (zeros + ones + 1)))
        if len(zeros) > 1:
            zeros, ones, below = (x.reshape(-1, CLASSES, 255).sum(1) for x in (zeros, ones, weighted))
    added, left = np.zeros((1, 255)), np.ones((1, 255))
    for share, own in reversed(levels):
        added, left = (np.repeat(x, len(own) // len(x), 0) for x in (added, left))
        added, left = added + left * share * own, left * (1 - share)
    return added, left


def cell_logs(cell_counts: DataFrame, asked: DataFrame, top: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(cell, log): the log10-probability of each different asked cell, whether it has been counted or not."""
    sent = cell_counts.sparkSession.sparkContext.broadcast(top)  # 4 MB

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in in_chunks(batches):
            cell, n, wanted = (chunk.column(c).to_numpy() for c in ("cell", "n", "wanted"))
            some = Branches(cell, n)
            hit = np.isin(some.cell, cell[wanted])
            yield pa.RecordBatch.from_arrays([pa.array(some.cell[hit], pa.int64()), pa.array(some.log10(*sent.value)[hit], pa.float64())], names=["cell", "log"])

    both = cell_counts.select("cell", "n", F.lit(False).alias("wanted")).unionByName(asked.select("cell", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted")))
    return by_branch(both).mapInArrow(logs, "cell long, log double")


class CellTable:
    """Log-probabilities by cell, in a hash table at most half full."""

    def __init__(self, cells_: np.ndarray, logs: np.ndarray):
        self.bits = max(4, (2 * len(cells_)).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        left, at = np.arange(len(cells_)), self.home(cells_)
        while len(left):
            here = at[left]
            free = self.keys[here] < 0
            self.keys[here[free]] = cells_[left[free]]
            won = self.keys[here] == cells_[left]
            self.logs[here[won]] = logs[left[won]]
            left = left[~won]
            at[left] = at[left] + 1 & len(self.keys) - 1

    def home(self, cells_: np.ndarray) -> np.ndarray:
        return (cells_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, cells_: np.ndarray) -> np.ndarray:
        """The log of each cell; nan for those not held."""
        at = self.home(cells_)
        key = self.keys[at]
        out = np.where(key == cells_, self.logs[at], np.nan)
        left = np.flatnonzero((key != cells_) & (key >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.keys) - 1
            key = self.keys[at[left]]
            hit = key == cells_[left]
            out[left[hit]] = self.logs[at[left[hit]]]
            left = left[~hit & (key >= 0)]
        return out


def gather_counts(rows: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, cell, n): how often each word (lower-cased A-Z) and each tree cell occurs in the texts; one pass, one shuffle.

    The end of each text is one empty word.  Tasks add up before they shuffle, holding at most about `flush` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def word_rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "cell", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for text in texts:
                words.update(BLANK_WORD_BYTES.findall(text.encode("utf-8", "replace").lower()))
            words[b""] += len(texts)
            if texts:
                held.append(np.unique(np.concatenate([cells(t) for t in texts]), return_counts=True))
            if sum(len(at) for at, _ in held) > 3_000_000:
                held = [added_up(held)]
                if len(held[0][0]) > 1_500_000:
                    yield from cell_rows(held.pop())
            if len(words) > flush:
                yield word_rows()
                words.clear()
        yield word_rows()
        if held:
            yield from cell_rows(added_up(held))

    def added_up(held: list) -> tuple[np.ndarray, np.ndarray]:
        at, where = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
        return at, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    def cell_rows(sums: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(sums[0]), 100_000):
            at, n = (x[i : i + 100_000] for x in sums)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["word", "cell", "n"])

    return rows.select("text").mapInArrow(count, "word binary, cell long, n long").groupBy("word", "cell").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = 200_000, head_cells: int = 1_000_000) -> DataFrame:
    """For every document: tokens, known tokens, the base (add-one unigram) and the tree's log10-probability.

    Learns from the rows where `train` holds.  Counts of words and tree cells over all training texts are written to
    the shared folder; a pass over all texts scores the frequent words and cells, of which at most head_words and
    head_cells are broadcast; joins of the remaining words' and cells' occurrences with the remaining counts are
    exact whatever the corpus, and are added up by document.  Null text is the empty one: one end token.  An empty
    training set gives N = V = 0.  Equal rows come back each.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    counts, _ = materialize(gather_counts(with_text(docs.where(train), id_col, text_col)), "counts")
    words, tree = counts.where(F.col("word").isNotNull()).select("word", "n"), counts.where(F.col("cell").isNotNull()).select("cell", "n")
    steps = [1 << i for i in range(1, 50)]

    def sizes(of: DataFrame, most: int) -> tuple:
        """Sum, number, and the least power of two that at most so many counts reach."""
        r = of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), *[F.count(F.when(F.col("n") >= s, 1)).alias(f"s{s}") for s in steps]).first()
        return r["n"], r["v"], next((s for s in steps if r[f"s{s}"] <= most), steps[-1])

    n_words, vocabulary, frequent = sizes(words, head_words)
    head = words.where(F.col("n") >= frequent).toArrow()
    known = dict(zip(head.column("word").to_pylist(), np.log10(head.column("n").to_numpy() + 1.0).tolist(), strict=True))
    with arrow_rows(spark, 20_000):  # of cells
        top = mix_top(tree)
        frequent_cells = cell_logs(tree, tree.where(F.col("n") >= sizes(tree, head_cells)[2]), top).toArrow()
    sent = spark.sparkContext.broadcast((known, CellTable(*(frequent_cells.column(c).to_numpy() for c in ("cell", "log")))))
    rows = with_text(docs, id_col, text_col, F.coalesce(train, F.lit(False)).alias("trained"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = sent.value
        row = TaskContext.get().partitionId() << 40
        names = ["doc_id", "trained", "row", "n_tokens", "head_known", "head_log", "head_score", "n_bytes", "rest", "rest_cells"]
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                found = BLANK_WORD_BYTES.findall(text.encode("utf-8", "replace").lower())
                found.append(b"")
                logs = [known[w] for w in found if w in known]
                at = cells(text)
                tree_logs = table.find(at)
                values = (len(found), len(logs), sum(logs), float(np.nansum(tree_logs)), len(at) - 1, [w for w in found if w not in known], at[np.isnan(tree_logs)])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            number = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), number, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    scored, _ = materialize(rows.mapInArrow(score, f"doc_id {kind}, trained boolean, row long, n_tokens long, head_known long, head_log double, head_score double, n_bytes long, rest array<binary>, rest_cells array<long>"), "scored")
    rare = words.where(F.col("n") < frequent)
    asked = scored.select("row", F.explode("rest").alias("word"))
    rest = asked.join(rare, "word").groupBy("row").agg(F.count("*").alias("rest_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rest_log"))
    asked_cells = scored.select("row", F.explode("rest_cells").alias("cell")).groupBy("row", "cell").agg(F.count("*").alias("times"))
    with arrow_rows(spark, 20_000):
        rare_cells, _ = materialize(cell_logs(tree, asked_cells.select("cell").distinct(), top), "cells")
    rest_cells = asked_cells.join(rare_cells, "cell").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("rest_score"))
    of_all = float(np.log10(n_words + vocabulary + 1))
    whole = scored.join(rest, "row", "left").join(rest_cells, "row", "left").withColumn("score", F.col("head_score") + F.coalesce("rest_score", F.lit(0.0)))
    return whole.select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(n_words).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("rest_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(of_all)).alias("base_score"),
        "score",
        (F.col("score") * F.lit(-1 / np.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
