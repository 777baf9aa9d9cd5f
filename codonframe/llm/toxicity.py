"""Toxicity by class-conditional Kneser-Ney models over characters.

Two models of words as character sequences, one of toxic and one of ordinary
text, have their own counts at the top order and share everything below it:
the backoff distribution is a Kneser-Ney model of continuation counts over all
documents, so an expression seldom seen in either class weighs the same in
both. A document's length-normalised log-likelihoods are compared, for the whole
text and for its most telling words; a logistic curve, fitted on labelled rows
that no count has used, turns the comparison into a probability.

The class counts use at most ``max_labels`` labelled rows, chosen by a hash of
the id; the shared counts cover every document. Both are aggregated by Spark.
What the scorer looks up is one number for each gram and context of the labelled
rows, by its whole 64-bit key: it grows with their vocabulary, which
``max_labels`` bounds, and no two expressions share an entry.

Null and empty texts have no likelihood to compare and get the score of a
neutral text; texts of any length are scored whole. Null labels are not learnt
from; repeated label rows count as often as they occur, and of equal ids at the
bound the smaller label is taken first. Rows that share an id are scored each
for itself. Without labels of both classes every score is 0.5. An empty table
gives an empty table. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import SPACE, chunks, letters
from .shared import stored

FEATURES = ("mean_llr", "best_word", "second_word", "telling_share")


@dataclass(frozen=True)
class KneserNey:
    """``order`` characters with the one foretold; the shared orders are 4 and 2.

    ``max_labels`` labelled rows are learnt from at most, of which ``calibrate``
    in ``of_labels`` fit the curve.
    """

    order: int = 7
    discount: float = 0.75
    max_labels: int = 200_000
    max_calibration: int = 20_000
    calibrate: int = 1
    of_labels: int = 5


MULTIPLIER = 0x9E3779B97F4A7C15
SHARED = (4, 2)


def _keys(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """keys[k][i]: hash of the k code points that end at i (those before the first count as zeros)."""
    c = codes.astype(np.uint64) + np.uint64(1)
    keys, total = [np.zeros(len(c), np.uint64)], np.zeros(len(c), np.uint64)
    for k in range(longest):
        total = total.copy()
        total[k:] += c[: max(len(c) - k, 0)] * np.uint64(pow(MULTIPLIER, k, 1 << 64))
        keys.append(total)
    return keys


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits, so that any of them part the keys evenly."""
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def _chosen(keys: list[np.ndarray], size: np.ndarray, at: np.ndarray, less: int = 0) -> np.ndarray:
    """The key of ``size`` code points that end ``less`` places before each of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in np.unique(size):
        some = size == k
        out[some] = keys[k - less][at[some] - less]
    return _mixed(out)


def _positions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each foretold place, and how many code points reach back to its word's first space, both included."""
    space = codes == SPACE
    last = np.maximum.accumulate(np.where(space, np.arange(len(codes)), 0))
    at = np.arange(1, len(codes))
    return at, at - last[:-1] + 1


def _rows(codes: np.ndarray, kind: int, order: int) -> tuple[np.ndarray, ...]:
    """kind, gram, context, low, low_context, lowest, lowest_context, free, n of the distinct grams."""
    at, back = _positions(codes)
    keys = _keys(codes, order)
    size = np.minimum(back, order).astype(np.int64)
    gram, where, n = np.unique(_chosen(keys, size, at), return_index=True, return_counts=True)
    at, back, size = at[where], back[where], size[where]
    low, lowest = (np.minimum(back, k).astype(np.int64) for k in SHARED)
    parts = [gram, _chosen(keys, size, at, 1), _chosen(keys, low, at), _chosen(keys, low, at, 1), _chosen(keys, lowest, at), _chosen(keys, lowest, at, 1)]
    free = back > SHARED[0]  # a letter stands before the low gram: it counts its kinds, not its times
    if kind == ALL:  # what one kind of count does not need is 0, and costs nothing
        parts[1] = np.zeros_like(gram)
    else:
        parts[3:], free = [np.zeros_like(gram)] * 3, np.zeros(len(at), bool)
    return (np.full(len(at), kind, np.int8), *[p.view(np.int64) for p in parts], free, n.astype(np.int64))


NAMES = ("kind", "gram", "context", "low", "low_context", "lowest", "lowest_context", "free", "n")
SCHEMA = "kind byte, gram long, context long, low long, low_context long, lowest long, lowest_context long, free boolean, n long"
#: Rows that a task gathers before it combines them, and twice as many combined ones before it hands them on, ``SENT_ROWS`` at a time.
HELD_ROWS, SENT_ROWS = 500_000, 50_000
#: kind: class 0 or 1, or the shared counts.
ALL = 2


def _combined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row for each gram of a kind; a column at a time, as each takes memory of its own."""
    gram, first, where = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
    n = np.bincount(where, np.concatenate([p[8] for p in parts])).astype(np.int64)
    return (parts[0][0][:1].repeat(len(gram)), gram, *[np.concatenate([p[i] for p in parts])[first] for i in range(2, 8)], n)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """Counts of grams by class, and of the shared orders' grams over all rows of (label, text).

    A task combines rows as they come, however many of them a batch of texts gives.
    """

    def count(batches):
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def combine() -> int:
            for kind, parts in held.items():
                held[kind] = [_combined(parts)]
            return sum(len(parts[0][0]) for parts in held.values())

        def flush():
            for (columns,) in held.values():
                for begin in range(0, len(columns[0]), SENT_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[begin : begin + SENT_ROWS]) for x in columns], list(NAMES))
            held.clear()

        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for kind, k in ((0, order), (1, order), (ALL, SHARED[0] + 1)):
                own = [t for l, t in zip(labels, texts) if t and (kind == ALL or l == kind)]
                for a, b in chunks(own):
                    codes = letters(own[a:b])[0]
                    if len(codes) > 1:
                        held.setdefault(kind, []).append(_rows(codes, kind, k))
                        size += len(held[kind][-1][0])
                    if size > HELD_ROWS:
                        size = 0
                        if combine() > 2 * HELD_ROWS:
                            yield from flush()
        combine()
        yield from flush()

    return docs.mapInArrow(count, SCHEMA)


class Ratios:
    """Values by 64-bit key: sorted keys, and where those with the same first bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(int(len(keys)).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.begin = np.append(self.begin, len(keys))
        self.most = int(np.diff(self.begin).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, nan where it has none; a part of the keys at a time, as the way there takes several times their memory."""
        found = np.full(len(keys), np.nan, np.float32)
        for begin in range(0, len(keys) if len(self.keys) else 0, 1 << 17):
            self._fill(keys[begin : begin + (1 << 17)], found[begin : begin + (1 << 17)])
        return found

    def _fill(self, keys: np.ndarray, found: np.ndarray) -> None:
        part = (keys >> self.shift).astype(np.int64)
        at, end = self.begin[part], self.begin[part + 1]
        open_ = np.flatnonzero(at < end)
        for k in range(self.most):
            place = at[open_] + k
            hit = self.keys[place] == keys[open_]
            found[open_[hit]] = self.values[place[hit]]
            open_ = open_[~hit & (place + 1 < end[open_])]
            if not len(open_):
                break


def ratio_table(counts: DataFrame, options: KneserNey = KneserNey()) -> tuple[Ratios, Ratios]:
    """Log-likelihood ratios of grams seen in a class, and of unseen letters after a context seen in one.

    Interpolated Kneser-Ney: above, p(w|h) = max(c(hw) - D, 0) / c(h) + D kinds(h) / c(h) p_low(w|h'), with c of the
    class; below, the same with continuation counts of all documents, down to a uniform distribution.
    """
    d = options.discount
    kinds = counts.where(F.col("kind") == ALL).groupBy("gram", "low", "low_context", "lowest", "lowest_context", "free").agg(F.sum("n").alias("n"))
    low = kinds.groupBy("low", "low_context", "lowest", "lowest_context").agg(F.sum(F.when(F.col("free"), 1).otherwise(F.col("n"))).alias("n"))
    low = stored(low)
    lowest = low.groupBy("lowest", "lowest_context").agg(F.count("*").alias("n"))
    of_lowest = lowest.groupBy("lowest_context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    lowest = lowest.join(of_lowest, "lowest_context").select("lowest", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") / 256).alias("p_lowest"))
    of_low = low.groupBy("low_context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    shared = low.join(of_low, "low_context").join(lowest, "lowest").select("low", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("p_lowest")).alias("p_low"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    top = stored(counts.where(F.col("kind") != ALL).groupBy("gram", "context", "low").agg(of(0).alias("n0"), of(1).alias("n1")))
    seen = lambda k: F.sum(F.when(F.col(f"n{k}") > 0, 1).otherwise(0))
    contexts = top.groupBy("context").agg(*[F.sum(f"n{k}").alias(f"all{k}") for k in (0, 1)], *[seen(k).alias(f"kinds{k}") for k in (0, 1)])
    left = lambda k: F.when(F.col(f"all{k}") > 0, d * F.col(f"kinds{k}") / F.col(f"all{k}")).otherwise(1.0)
    p = lambda k: F.when(F.col(f"all{k}") > 0, F.greatest(F.col(f"n{k}") - d, F.lit(0.0)) / F.col(f"all{k}")).otherwise(0.0) + left(k) * F.col("p_low")
    grams = top.join(contexts, "context").join(shared, "low").select(F.col("gram").alias("key"), F.ln(p(1) / p(0)).cast("float").alias("llr"))
    after = contexts.select(F.col("context").alias("key"), F.ln(left(1) / left(0)).cast("float").alias("llr"))
    found = [rows.toArrow() for rows in (grams, after)]  # of the labelled rows, which max_labels bounds
    return tuple(Ratios(x["key"].to_numpy().view(np.uint64), x["llr"].to_numpy()) for x in found)


def _word_sums(codes: np.ndarray, rows: np.ndarray, n_rows: int, tables: tuple[Ratios, Ratios], order: int) -> list[tuple[float, ...]]:
    """The features of each row; all 0 where it has no letter."""
    out = [(0.0,) * len(FEATURES)] * n_rows
    if len(codes) < 3:
        return out
    at, back = _positions(codes)
    keys = _keys(codes, order)
    size = np.minimum(back, order).astype(np.int64)
    llr = tables[0].find(_chosen(keys, size, at))
    unseen = np.isnan(llr)
    llr[unseen] = tables[1].find(_chosen(keys, size[unseen], at[unseen], 1))
    llr = np.nan_to_num(llr)
    ends = np.flatnonzero(codes[1:] == SPACE)  # places in ``at`` where a word ends
    begins = np.concatenate([[0], ends[:-1] + 1])
    words, owner = np.add.reduceat(llr, begins), rows[1:][ends]
    sizes = ends - begins + 1
    order_ = np.lexsort((-words, owner))
    firsts = np.searchsorted(owner, np.arange(n_rows + 1))
    for i in range(n_rows):
        a, b = firsts[i], firsts[i + 1]
        if a < b:
            best = words[order_[a : min(b, a + 2)]]
            telling = (words[a:b] > 2.0).mean()
            out[i] = (float(words[a:b].sum() / sizes[a:b].sum()), float(best[0]), float(best[1]) if len(best) > 1 else 0.0, float(telling))
    return out


def features(docs: DataFrame, tables: tuple[Ratios, Ratios], order: int, id_col: str, text_col: str) -> DataFrame:
    key = docs.select(id_col).schema[0].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(tables)

    def score(batches):
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in chunks(texts):
                codes, rows = letters(texts[a:b])
                out += _word_sums(codes, rows, b - a, model.value, order)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([x[i] for x in out], pa.float64()) for i in range(len(FEATURES))], ["doc_id", *FEATURES])

    return docs.select(id_col, text_col).mapInArrow(score, f"doc_id {key}, " + ", ".join(f"{f} double" for f in FEATURES))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve(x: Column) -> Column:
    """Negative ratios speak of ordinary text; beyond a few units more adds little."""
    return F.ln(1 + F.greatest(x, F.lit(0.0)))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, options: KneserNey = KneserNey(), id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    """doc_id, score and the features of every document; labels of the rows where ``learn`` holds are used."""
    known = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = stored(known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(options.max_labels))  # bounded, so it may be broadcast
    held = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(options.of_labels)) < options.calibrate
    counted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known.where(~held)), "_id", "left")
    counts = stored(gram_counts(counted.select("_label", "_text"), options.order))
    rows = stored(features(docs, ratio_table(counts, options), options.order, id_col, text_col))
    inputs = [F.col("mean_llr") * 10, _curve(F.col("best_word")), _curve(F.col("second_word")), F.sqrt("telling_share") * 10]
    some = rows.join(F.broadcast(known.where(held)), F.col("doc_id") == F.col("_id")).select("_id", "_label", *[c.alias(f"x{i}") for i, c in enumerate(inputs)])
    fit = some.orderBy(F.xxhash64("_id"), "_id").limit(options.max_calibration).toPandas()
    if fit["_label"].nunique() < 2:
        return rows.withColumn("score", F.lit(0.5))
    w = logistic(fit[[f"x{i}" for i in range(len(inputs))]].to_numpy(), fit["_label"].to_numpy())
    margin = sum((c * F.lit(float(v)) for c, v in zip(inputs, w)), F.lit(float(w[-1])))
    return rows.withColumn("score", 1 / (1 + F.exp(-margin)))
