"""Hard negatives by ball trees, branch and bound.

For an anchor, the positives are the best other rows of its label, and the hard
negatives of a positive the best rows of other labels whose score lies in a
window below the positive's. Scores are inner products of whole numbers, so they
are exact; the better score comes first, of equal ones the smaller id.

Each task builds ball trees over its own rows. A ball's centre and radius bound
the inner products of an anchor with all rows inside, above and below: a node is
left out where its bounds miss the score window, where it lies strictly beneath
the anchor's k-th best so far, or where its labels are of no use. What a task has
found is the first k of its own rows, and the k-th of one tree prunes the next;
a grouped ranking over tasks gives the first k of all. Every row is in some tree, so
nothing is missed and no pair of rows is made beyond anchors against rows.

Anchors go to the tasks in blocks of a fixed number of bytes, and a block's
pass goes over the stored rows.

Rows with a null id or label, a null vector, or a null or non-finite component
take no part. Shorter vectors are filled with zeros, an empty vector is all zeros.
Rows that share an id are one row, the least of them by label and vector.
Anchors without positives, and positives without rows in the window, have no
result. Vectors whose squared length reaches 2^53 are an error, as their scores
would not be exact. An empty table gives an empty table. Columns beyond id,
label and vector are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class HardNegatives:
    """``low`` and ``high`` are the window in percent of the positive's score. ``tree`` rows make a tree, ``leaf`` rows a leaf, ``block`` is the bytes of anchors sent together."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    tree: int = 1 << 14
    leaf: int = 64
    block: int = 32 << 20


class BallTree:
    """Rows in the order of the leaves; nodes in preorder, each with its rows, ball, labels and children."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int):
        order = np.lexsort((ids,))
        self.nodes: list[tuple] = []
        self.build(order, rows, labels, leaf, 0, len(order))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]

    def build(self, order, rows, labels, leaf: int, lo: int, hi: int) -> int:
        here = rows[order[lo:hi]]
        centre = here.mean(axis=0)
        apart = np.sqrt(((here - centre) ** 2).sum(axis=1))
        own = labels[order[lo:hi]]
        at = len(self.nodes)
        self.nodes.append(())
        children = ()
        if hi - lo > leaf and apart.max() > 0:
            # Between the row furthest from the centre and the one furthest from it, halved by rank: rows that are alike stay together.
            far = here[apart.argmax()]
            other = here[((here - far) ** 2).sum(axis=1).argmax()]
            rank = np.argsort(here @ (other - far), kind="stable")
            order[lo:hi] = order[lo:hi][rank]
            middle = (lo + hi) // 2
            children = (self.build(order, rows, labels, leaf, lo, middle), self.build(order, rows, labels, leaf, middle, hi))
        self.nodes[at] = (lo, hi, centre, float(apart.max()) * (1 + 1e-9) + 1e-9, own.min(), own.max(), children)
        return at


class Search:
    """The best k rows of each query so far. A query is an anchor with a window of scores; ``same`` asks for rows of its label, else of others."""

    def __init__(self, vectors: np.ndarray, anchor: np.ndarray, ids: np.ndarray, labels: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool):
        self.vectors, self.anchor, self.ids, self.labels, self.lo, self.hi, self.same = vectors, anchor, ids, labels, lo, hi, same
        self.length = np.sqrt((vectors**2).sum(axis=1))
        self.best = np.full((len(anchor), k), -np.inf)
        self.found = np.full((len(anchor), k), NONE)

    def products(self, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Inner products; queries of one anchor, which stand together, are computed once."""
        at = self.anchor[queries]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        return (self.vectors[at[new]] @ others)[np.cumsum(new) - 1]

    def visit(self, tree: BallTree, node: int, queries: np.ndarray) -> None:
        lo, hi, centre, radius, least, most, children = tree.nodes[node]
        label = self.labels[queries]
        queries = queries[(least <= label) & (label <= most) if self.same else (least != most) | (label != least)]
        if not len(queries):
            return
        middle = self.products(queries, centre)
        reach = self.length[self.anchor[queries]] * radius
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        above = middle + reach + slack
        queries = queries[(above >= self.lo[queries]) & (middle - reach - slack <= self.hi[queries]) & (above >= self.best[queries, -1])]
        if not len(queries):
            return
        if children:
            better = [self.products(queries[:1], tree.nodes[c][2])[0] for c in children]
            for c in children if better[0] >= better[1] else children[::-1]:
                self.visit(tree, c, queries)
        else:
            self.score(tree, slice(lo, hi), queries)

    def score(self, tree: BallTree, part: slice, queries: np.ndarray) -> None:
        scores = self.products(queries, tree.rows[part].T)
        same = tree.labels[part] == self.labels[queries, None]
        fits = (scores >= self.lo[queries, None]) & (scores <= self.hi[queries, None]) & (scores >= self.best[queries, -1:])
        fits &= (same & (tree.ids[part] != self.ids[queries, None])) if self.same else ~same
        some = fits.any(axis=1)
        queries, k = queries[some], self.best.shape[1]
        scores = np.concatenate([self.best[queries], np.where(fits[some], scores[some], -np.inf)], axis=1)
        ids = np.concatenate([self.found[queries], np.where(fits[some], tree.ids[part], NONE)], axis=1)
        first = np.lexsort((ids, -scores), axis=-1)[:, :k]
        self.best[queries], self.found[queries] = np.take_along_axis(scores, first, 1), np.take_along_axis(ids, first, 1)


def whole_vectors(vectors: DataFrame, label: Column, anchor: Column, scale: int, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id, label, anchor (whether it is one) and the vector of whole numbers of each row that takes part; and the dimension."""
    v = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("_r")).select("id", "_r.label", "_r.anchor", F.transform("_r.vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    rows = stored(rows)
    size = rows.agg(F.max(F.size("vec")).alias("dim"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).first()
    if (size["most"] or 0) >= 2.0**53:
        raise ValueError("vectors too long: scores would not be exact")
    dim = max(size["dim"] or 0, 1)
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec")))), dim


def _columns(table: pa.Table | pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vec = table.column("vec")
    vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return table.column("id").to_numpy(), table.column("label").to_numpy(), vec.flatten().to_numpy().reshape(-1, dim)


def _first(rows: DataFrame, queries, k: int, same: bool, dim: int, options: HardNegatives) -> DataFrame:
    """query (its number), id, score: the first ``k`` rows of each task, from trees over the task's rows."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        found = Search(*held.value, k, same)
        waiting, count = [], 0

        def grow():
            ids, labels, vectors = (np.concatenate(x) for x in zip(*waiting))
            for begin in range(0, len(ids), options.tree):
                part = slice(begin, begin + options.tree)
                tree = BallTree(ids[part], labels[part], vectors[part], options.leaf)
                found.visit(tree, 0, np.arange(len(found.anchor)))

        for batch in batches:
            if batch.num_rows:
                waiting.append(_columns(batch, dim))
                count += batch.num_rows
            if count >= options.tree:
                grow()
                waiting, count = [], 0
        if waiting:
            grow()
        query, place = np.nonzero(found.found != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found.found[query, place]), pa.array(found.best[query, place].astype(np.int64))], ["query", "id", "score"])

    return rows.select("id", "label", "vec").mapInArrow(search, "query long, id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query over all tasks, with their rank."""
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, label: Column, options: HardNegatives = HardNegatives(), id_col="vec_id", vec_col="embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors, ``label`` is the label to take. Anchors
    are searched for in blocks that fit ``options.block`` bytes; a block's anchors and positives are all that is ever on the driver.
    """
    rows, dim = whole_vectors(vectors, label, anchor, options.scale, id_col, vec_col)
    anchors = rows.where("anchor")
    blocks = -(-anchors.count() // max(options.block // (8 * dim + 64 * options.positives), 1))
    session = vectors.sparkSession
    out = []
    for b in range(blocks):
        ids, labels, matrix = _columns(anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow(), dim)
        if not len(ids):
            continue
        wide = np.full(len(ids), np.inf)
        found = _ranked(_first(rows, (matrix, np.arange(len(ids)), ids, labels, -wide, wide), options.positives, True, dim, options), options.positives)
        positives = found.orderBy("query", "rank").toArrow()
        at, positive, score = (positives[c].to_numpy() for c in ("query", "id", "score"))
        lo, hi = -(-(options.low * score) // 100), options.high * score // 100
        able = lo <= hi
        at, positive, score, lo, hi = at[able], positive[able], score[able], lo[able], hi[able]
        queries = (matrix, at, ids[at], labels[at], lo.astype(float), hi.astype(float))
        best = _ranked(_first(rows, queries, options.negatives, False, dim, options), options.negatives)
        asked = pa.table({"query": pa.array(np.arange(len(at))), "anchor_id": ids[at], "positive_id": positive, "positive_score": score})
        known = best.join(session.createDataFrame(asked, "query long, anchor_id long, positive_id long, positive_score long"), "query")
        out.append(stored(known.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not out:
        return session.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out)
