"""Document quality by a generalised additive model with pairwise interactions.

Every document becomes a row of shape features: shares of letter cases, digits
and signs, word and line lengths, repetition. Boosting goes round and round the
features; at each one a shallow tree over the feature's bins is added to that
feature's lookup table. Then the feature pairs that explain most of what is left
get two-way tables the same way. A score is the sum of one table entry for each
feature and pair, through the logistic function: vectorised bin additions.

The model is fitted on at most ``max_labels`` labelled rows, chosen by a hash of
the id; the texts are read once, for all documents, and the features are written
to the shared folder. Null and empty texts have all features 0 and are scored
like any other row; texts of any length are measured whole. Null labels are not
learnt from; repeated label rows count as often as they occur, and of equal ids
at the bound the smaller label is taken first. Rows that share an id are scored
each for itself. Without labels every score is 0.5. An empty table gives an empty
table. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digits", "marks", "symbols", "space", "other_bytes",
    "distinct_words", "top_word", "repeat_next", "repeat_pairs", "dup_lines", "line_length", "ended_lines", "lines_per_word", "caps_words", "sign_words", "short_words", "entropy",
)


@dataclass(frozen=True)
class Additive:
    """``rounds`` cycles over the features, ``pair_rounds`` over the ``pairs`` best pairs."""

    max_labels: int = 20_000
    bins: int = 48
    pair_bins: int = 12
    rounds: int = 120
    pairs: int = 10
    pair_rounds: int = 40
    rate: float = 0.15
    ridge: float = 4.0
    leaves: int = 4
    min_rows: int = 10


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256)
    table[[*chars.encode()]] = 1
    return table


_CLASSES = np.array([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"),
    _class(".,;:!?'\"()-"), _class("#*$%&|<>{}[]=_/\\@+~^"), _class(" \t\r\n"), np.arange(256) >= 128,
]).T


def shape(text: str | None) -> tuple[float, ...]:
    """The features of one text, whole."""
    if not text:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = counts.sum()
    shares = counts @ _CLASSES / n
    p = counts[counts > 0] / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, m = max(len(words), 1), max(len(lines), 1)
    times = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    inner = sum(len(x) for x in words)
    return (
        float(np.log1p(len(text))), float(np.log1p(len(words))), inner / w, *map(float, shares),
        len(times) / w, max(times.values(), default=0) / w,
        sum(c for (a, b), c in pairs.items() if a == b) / w, sum(c for c in pairs.values() if c > 1) / w,
        1 - len(set(lines)) / m, float(np.log1p(sum(map(len, lines)) / m)),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, len(lines) / w,
        sum(c for x, c in times.items() if len(x) > 1 and x.isupper()) / w,
        sum(c for x, c in times.items() if not x[-1:].isalnum() and x[-1:] not in ".,") / w,
        sum(c for x, c in times.items() if len(x) < 3) / w,
        float(-(p * np.log2(p)).sum()),
    )


def features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and one float column for each of ``FEATURES``."""
    key = docs.select(id_col).schema[0].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            rows = np.array([shape(t.as_py()) for t in batch.column(1)], dtype=np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])

    return docs.select(id_col, text_col).mapInArrow(measure, f"doc_id {key}, " + ", ".join(f"{f} float" for f in FEATURES))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, ridge: float, min_rows: int) -> np.ndarray:
    """Leaf value of each bin of a shallow tree: the best cut again and again, ``leaves`` leaves at most."""
    parts, value = [(0, len(g))], np.zeros(len(g))
    cut_of = {}

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - cg[-1] ** 2 / (ch[-1] + ridge)
        gain[(cn[:-1] < min_rows) | (cn[-1] - cn[:-1] < min_rows)] = 0
        i = int(np.argmax(gain))
        return float(gain[i]), a + i + 1

    cut_of[0, len(g)] = best(0, len(g))
    while len(parts) < leaves:
        part = max(parts, key=lambda x: cut_of[x][0])
        gain, cut = cut_of[part]
        if gain <= 1e-9:
            break
        parts.remove(part)
        for new in ((part[0], cut), (cut, part[1])):
            parts.append(new)
            cut_of[new] = best(*new)
    for a, b in parts:
        value[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return value


def _corner(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut of a two-way table into four quarters: what it gains, and the quarters' values by bin."""
    full = lambda x: np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0)))
    cg, ch = full(g), full(h)

    def quarters(c):
        a, rows, cols, everything = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, rows - a, cols - a, everything - rows - cols + a

    qg, qh = quarters(cg), quarters(ch)
    gain = sum(a**2 / (b + ridge) for a, b in zip(qg, qh)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(qg, qh)]
    value = np.empty_like(g)
    value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), value


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        margin = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            margin += t[b]
        for i, j, t in self.pairs:
            margin += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, options: Additive = Additive()) -> Model:
    """Cyclic boosting on (rows, features); x and y are bounded by ``max_labels``."""
    up = y.sum()
    model = Model(float(np.log((up + 1) / (len(y) - up + 1))), _edges(x, options.bins), [], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = _edges(x, options.pair_bins)
    if not 0 < up < len(y):
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    margin = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(options.rounds):
        for b, t, n in zip(bins, model.tables, counts):
            g, h = slopes()
            step = options.rate * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), n, options.leaves, options.ridge, options.min_rows)
            t += step
            margin += step[b]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def two_way(i, j, g, h):
        at = coarse[i] * sizes[j] + coarse[j]
        return (np.bincount(at, v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (g, h))

    g, h = slopes()
    able = [(i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
    ranked = sorted(able, key=lambda p: -_corner(*two_way(*p, g, h), options.ridge)[0])[: options.pairs]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked]
    for _ in range(options.pair_rounds):
        for i, j, t in model.pairs:
            step = options.rate * _corner(*two_way(i, j, *slopes()), options.ridge)[1]
            t += step
            margin += step[coarse[i], coarse[j]]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, options: Additive = Additive(), id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """doc_id and score of every document; labels of the rows where ``learn`` holds are used."""
    known = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
    known = stored(known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(options.max_labels))  # bounded, so it may be broadcast
    rows = stored(features(docs, id_col, text_col))
    some = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(options.max_labels)
    sample = some.select("_label", *FEATURES).toPandas()
    model = docs.sparkSession.sparkContext.broadcast(fit(sample[list(FEATURES)].to_numpy(np.float64), sample["_label"].to_numpy(np.float64), options) if len(sample) else Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], []))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.column_stack([c.to_numpy(np.float64) for c in columns])))

    return rows.select("doc_id", score(*FEATURES).alias("score"))
