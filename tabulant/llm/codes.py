"""Vector codes by product quantisation, fitted by a dual-tree Lloyd iteration over integers.

A vector's components become integers and the vector is cut into equal parts.  Every part position has a
codebook.  A round of Lloyd's algorithm assigns each part to its nearest entry and moves the entries
to the means of their parts.

Within a task, each block of parts is held in a tree of boxes, and so are the entries.  Both trees are descended
together: a pair of nodes is dropped when the boxes are further apart than some entry can be from any part
of the node, or when another entry is nearer at every corner of its box.  A node of parts with one entry left is
assigned whole, and its cached sum and count are added to that entry.  The leaves that stay uncertain compare
their parts with their remaining entries by integer distances.  Everything is exact, so the codes equal
those of a plain search, ties included.

A round is one job: each task adds up sums and counts of its blocks, Spark adds up those of the tasks, and the
driver gets one row per codebook component.  Nothing is kept between tasks.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.joins import join_totals
from tabulant.sources.scratch import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
LEAF = 32
LARGEST = 1 << 28  # of an integer component; distances and sums stay within 64 bits


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    cells = np.floor(vectors.astype(np.float64) * SCALE)
    if len(cells) and np.abs(cells).max() >= LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in size cannot be coded")
    return cells.astype(np.int64)


@dataclass
class Tree:
    """A balanced tree of boxes over rows, as a heap: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``.

    ``order`` lists the rows so that a node's rows are ``order[start:end]``.  ``low`` and ``high`` bound a node,
    ``total`` sums its rows.
    """

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    first_leaf: int


def build(rows: np.ndarray, leaf: int) -> Tree:
    """Split at the median of the widest dimension until nodes have at most ``leaf`` rows."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(rows)) / leaf))))
    order, start, end = np.arange(len(rows)), [0], [len(rows)]
    for node in range((1 << depth) - 1):
        a, b = start[node], end[node]
        middle = (a + b) // 2
        own = rows[order[a:b]]
        if a < middle:
            widest = np.ptp(own, axis=0).argmax()
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle - a)]
        start += [a, middle]
        end += [middle, b]
    first_leaf = (1 << depth) - 1
    nodes, width = 2 * first_leaf + 1, rows.shape[1]
    low, high, total = (np.zeros((nodes, width), np.int64) for _ in range(3))
    sorted_rows, cuts = rows[order], np.array(start[first_leaf:])
    low[first_leaf:] = np.minimum.reduceat(sorted_rows, cuts)
    high[first_leaf:] = np.maximum.reduceat(sorted_rows, cuts)
    total[first_leaf:] = np.add.reduceat(sorted_rows, cuts)
    for level in range(depth - 1, -1, -1):
        own = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
        low[own] = np.minimum(low[2 * own + 1], low[2 * own + 2])
        high[own] = np.maximum(high[2 * own + 1], high[2 * own + 2])
        total[own] = total[2 * own + 1] + total[2 * own + 2]
    return Tree(order, np.array(start), np.array(end), low, high, total, first_leaf)


def _pruned(tree: Tree, book: Tree, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which pairs of a node of parts and a node of entries may hold a nearest entry."""
    low, high = tree.low[nodes], tree.high[nodes]
    gap = np.maximum(np.maximum(book.low[others] - high, low - book.high[others]), 0)
    span = np.maximum(book.high[others] - low, high - book.low[others])
    nearest = np.einsum("ij,ij->i", gap, gap)
    farthest = np.einsum("ij,ij->i", span, span)
    bound = np.full(len(tree.start), np.iinfo(np.int64).max)
    np.minimum.at(bound, nodes, farthest)
    keep = nearest <= bound[nodes]
    if (others < book.first_leaf).any():
        return keep
    # single entries: one with the least bound stands against each other one at the corners of the box
    best = np.full(len(tree.start), -1)
    ranked = np.lexsort((others, farthest))[::-1]
    best[nodes[ranked]] = others[ranked]
    rival = book.low[best[nodes]]
    entry = book.low[others]
    towards = entry - rival
    reach = np.maximum(low * towards, high * towards).sum(1)
    return keep & (2 * reach >= (entry**2).sum(1) - (rival**2).sum(1))


def _halves(nodes: np.ndarray) -> np.ndarray:
    return np.stack([2 * nodes + 1, 2 * nodes + 2], 1)


def candidates(tree: Tree, book: Tree):
    """Nodes of parts that belong to one entry, and ``(leaf, entry)`` pairs that stay uncertain.

    Entries are given as leaves of ``book``, which hold one each.
    """
    nodes, others = np.zeros(1, np.int64), np.zeros(1, np.int64)
    sure = []
    while len(nodes):
        keep = _pruned(tree, book, nodes, others)
        nodes, others = nodes[keep], others[keep]
        if others[0] < book.first_leaf:  # all entries of a round are on one level
            split = _halves(others)
            others, nodes = split.ravel(), np.repeat(nodes, 2)
        else:
            alone = np.bincount(nodes, minlength=len(tree.start))[nodes] == 1
            sure.append(np.stack([nodes[alone], others[alone]], 1))
            nodes, others = nodes[~alone], others[~alone]
            if not len(nodes) or nodes[0] >= tree.first_leaf:
                break
            nodes, others = _halves(nodes).ravel(), np.repeat(others, 2)
            filled = tree.start[nodes] < tree.end[nodes]
            nodes, others = nodes[filled], others[filled]
            continue
        if len(nodes) and nodes[0] < tree.first_leaf:
            nodes, others = _halves(nodes).ravel(), np.repeat(others, 2)
        filled = (tree.start[nodes] < tree.end[nodes]) & (book.start[others] < book.end[others])
        nodes, others = nodes[filled], others[filled]
    return np.concatenate(sure) if sure else np.zeros((0, 2), np.int64), np.stack([nodes, others], 1)


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in doubles while every number is an integer that they hold."""
    largest = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0))
    if rows.shape[1] * int(largest) ** 2 < 1 << 50:
        products = (rows.astype(np.float64) @ entries.T.astype(np.float64)).astype(np.int64)
    else:
        products = rows @ entries.T
    return (rows**2).sum(1)[:, None] - 2 * products + (entries**2).sum(1)[None, :]


def assign(rows: np.ndarray, entries: np.ndarray, leaf: int = LEAF):
    """The nearest entry of each row (ties to the lower), and sums and counts per entry."""
    tree, book = build(rows, leaf), build(entries, 1)
    entry_of = np.zeros(len(book.start), np.int64)
    entry_of[book.first_leaf :][book.start[book.first_leaf :] < book.end[book.first_leaf :]] = book.order
    sure, open_pairs = candidates(tree, book)
    chosen = np.zeros(len(rows), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    for node, entry in zip(sure[:, 0].tolist(), entry_of[sure[:, 1]].tolist()):
        chosen[tree.order[tree.start[node] : tree.end[node]]] = entry
        sums[entry] += tree.total[node]
        counts[entry] += tree.end[node] - tree.start[node]
    ranked = np.lexsort((entry_of[open_pairs[:, 1]], open_pairs[:, 0]))
    leaves, entry = open_pairs[ranked, 0], entry_of[open_pairs[ranked, 1]]
    cuts = np.flatnonzero(np.diff(leaves, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(leaves)]):
        own = tree.order[tree.start[leaves[a]] : tree.end[leaves[a]]]
        chosen[own] = entry[a:b][distances(rows[own], entries[entry[a:b]]).argmin(1)]
    if len(leaves):
        own = np.concatenate([tree.order[tree.start[x] : tree.end[x]] for x in leaves[cuts].tolist()])
        np.add.at(sums, chosen[own], rows[own])
        counts += np.bincount(chosen[own], minlength=len(entries))
    return chosen, sums, counts


def _blocks(batches, columns: int = 0):
    """Blocks of at most ``BLOCK`` rows as ``(integers, other columns)``; the vectors are the last column."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            some = batch.slice(low, BLOCK)
            cells = some.column(columns)
            flat = cells.flatten().to_numpy(zero_copy_only=False)
            yield integers(flat.reshape(len(cells), -1)), [some.column(i) for i in range(columns)]


@dataclass
class Codebooks:
    """``entries[part, entry, component]``, all integers."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after one assignment of all vectors."""
    parts, size, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # parts x entries x components numbers

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for cells, _ in _blocks(batches):
            for p in range(parts):
                _, s, n = assign(np.ascontiguousarray(cells[:, p * width : (p + 1) * width]), shared.value[p])
                sums[p] += s
                counts[p] += n
        p, e = np.nonzero(counts)
        cell = ((p * size + e)[:, None] * width + np.arange(width)).ravel()
        rows = [pa.array(cell), pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], width))]
        yield pa.RecordBatch.from_arrays(rows, names=["cell", "total", "n"])

    found = vectors.mapInArrow(run, "cell bigint, total bigint, n bigint").groupBy("cell")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")]
    moved = books.copy().ravel()
    for r in found.agg(*wide).collect():  # at most one row per component of the codebooks
        moved[r["cell"]] = int(r["total"]) // int(r["n"])
    return moved.reshape(books.shape)


def fit_codebooks(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codebooks | None:
    """Codebooks that start as the parts of the vectors with the least keys; None without usable vectors.

    All usable vectors must have the same length, a multiple of ``parts``; others are an error.
    """
    known = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    first = known.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    least, most = known.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least != most or least == 0 or least % parts:
        raise ValueError(f"vectors of {least} to {most} components cannot be cut into {parts} equal parts")
    start = integers(np.array([r["vector"] for r in first], np.float64))
    books = start.reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _round(known.select("vector"), np.ascontiguousarray(books))
    return Codebooks(np.ascontiguousarray(books))


CODED = "key bigint, label string, codes binary, error bigint"


def encode(
    vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``(key, label, codes, error)`` per row with a usable vector; one byte per part, the label as text."""
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    parts, _, width = books.entries.shape

    def run(batches):
        for cells, (keys, labels) in _blocks(batches, 2):
            codes, error = np.zeros((len(cells), parts), np.uint8), np.zeros(len(cells), np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(cells[:, p * width : (p + 1) * width])
                chosen, _, _ = assign(own, shared.value[p])
                codes[:, p] = chosen
                error += ((own - shared.value[p][chosen]) ** 2).sum(1)
            names = ["key", "label", "codes", "error"]
            spelled = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, labels, spelled, pa.array(error)], names=names)

    rows = vectors.select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")
    ).where(usable(F.col("vector")))
    return rows.mapInArrow(run, CODED)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options
) -> DataFrame:
    """``(key, code, error, label_error, codebooks_sha256)`` per row of ``vectors`` with a usable vector.

    Rows whose vector is null or holds null or non-finite components are dropped.  The codebooks start from the
    least keys, null keys last, equal keys by vector; fewer vectors than entries make smaller codebooks.  Rows with a
    null key or label and repeated rows are coded like any other; null labels are one label.  Other columns are not
    read.  An empty table gives an empty result.
    """
    books = fit_codebooks(vectors, key, vector, **options)
    if books is None:
        empty = "key bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty).withColumnRenamed("key", key)
    coded, _ = materialize(encode(vectors, books, key, vector, label), "coded")
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    per_label, _ = materialize(per_label, "label-errors")
    return join_totals(coded, per_label, ["label"], "rows").select(
        F.col("key").alias(key),
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )
