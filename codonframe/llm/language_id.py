"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams
(one to three letters, word ends marked). A document is ranked the same way; the
out-of-place distance to a profile adds, for each of the document's n-grams, how
far apart the two ranks are, or the profile's length where it is missing. The
nearest language wins; ties go to the name that sorts first.

A language is known by the profile's grams and ranks alone, held by gram, so the
profiles of many languages take little. Where there are more than ``block``
languages, one block after the other is compared, each document taking along the
best so far; so there may be any number of names.

Null texts and texts without a letter are ``und`` with score 0, as is everything
when nothing could be learnt. Null languages are not learnt from. Texts of any
length are ranked whole; n-grams of equal frequency are ranked by their code
points. Repeated rows count as often as they occur, and each gets its own answer.
An empty table gives an empty table. Columns beyond id, text and language are
not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chars import SPACE, chunks, letter_table, letters
from .shared import stored

BITS = 21
UNKNOWN = "und"


@dataclass(frozen=True)
class Ranks:
    """A profile's length, and how many languages are compared at a time."""

    top: int = 300
    block: int = 2000


def gram_keys(codes: np.ndarray) -> np.ndarray:
    """One integer for each n-gram of one to three characters; a space stands only at an end."""
    c = codes.astype(np.int64)
    two = (c[:-1] << BITS) | c[1:]
    three = (two[:-1] << BITS) | c[2:]
    return np.concatenate([c[c != SPACE], two, three[c[1:-1] != SPACE]])


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True) if len(keys) else (keys, keys)


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram, n over all rows with a language."""

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush():
            for lang, parts in held.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        size = 0
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for a, b in chunks(own):
                    held.setdefault(lang, []).append(_counted(gram_keys(letters(own[a:b])[0])))
                    size += len(held[lang][-1][0])
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, options: Ranks = Ranks()) -> DataFrame:
    """lang, gram, rank (from 0) of each language's top n-grams.

    The best of 16 parts of each language are ranked first, so that no task sorts a language's whole list.
    """
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    best = counts.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= options.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return stored(best.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < options.top))


@dataclass
class Profiles:
    """The profiles of some languages by gram: grams ascend, and each has the languages and ranks from begin[i] to begin[i + 1]."""

    names: list[str]
    grams: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    top: int

    @classmethod
    def of(cls, names: list[str], rows: pa.Table, top: int) -> Profiles:
        number = {n: i for i, n in enumerate(names)}
        lang = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
        gram, rank = rows["gram"].to_numpy().astype(np.int64), rows["rank"].to_numpy().astype(np.int64)
        order = np.argsort(gram, kind="stable")
        grams, begin = np.unique(gram[order], return_index=True)
        return cls(names, grams, np.append(begin, len(gram)), lang[order], rank[order], top)

    def nearest(self, codes: np.ndarray) -> tuple[str, int, int] | None:
        """Name and distance of the nearest language, and how many n-grams were ranked; None if there is none."""
        keys, n = _counted(gram_keys(codes))
        if not len(keys) or not self.names:
            return None
        top = self.top
        if len(keys) > top:  # all that tie with the last place, then rank exactly
            some = n >= np.partition(n, len(n) - top)[len(n) - top]
            keys, n = keys[some], n[some]
        keys = keys[np.lexsort((keys, -n))[:top]]
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == keys)
        begin, size = self.begin[at[known]], self.begin[at[known] + 1] - self.begin[at[known]]
        entry = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        # A missing gram costs ``top``; one that is there as much less as the ranks are near.
        saved = np.bincount(self.lang[entry], top - np.abs(self.rank[entry] - np.repeat(known, size)), len(self.names))
        i = int(np.argmax(saved))
        return self.names[i], top * len(keys) - int(saved[i]), len(keys)


def identify(docs: DataFrame, learn: Column, options: Ranks = Ranks(), id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, lang_pred and score of every document; profiles come from the rows where ``learn`` holds.

    The score is 1 less the winner's distance over the largest possible.
    """
    spark = docs.sparkSession
    learnt = profiles(gram_counts(docs.where(learn), lang_col, text_col), options)
    names = [r["lang"] for r in learnt.select("lang").distinct().orderBy("lang").toLocalIterator()]
    key = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {key}, lang_pred string, score double"
    blocks = [names[i : i + options.block] for i in range(0, len(names), options.block)] or [[]]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(-1.0).alias("score"), F.col(text_col).alias("text"))

    def compared(rows: DataFrame, own: list[str], last: bool) -> DataFrame:
        held = learnt.where(F.col("lang").between(own[0], own[-1])) if own else learnt.limit(0)
        model = spark.sparkContext.broadcast(Profiles.of(own, held.toArrow(), options.top))  # at most block profiles

        def predict(batches):
            alpha = letter_table()
            for batch in batches:
                texts, found = batch.column(3).to_pylist(), []
                before = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                for a, b in chunks(texts):
                    codes, rows_ = letters(texts[a:b])
                    ends = np.searchsorted(rows_, np.arange(b - a), side="right")
                    for i in range(b - a):
                        begin = ends[i - 1] - 1 if i else 0  # the space before the text
                        part = codes[begin : ends[i]]
                        name, score = next(before)
                        best = model.value.nearest(part) if alpha[part].any() else None
                        if best and 1.0 - best[1] / (options.top * best[2]) > score:
                            name, score = best[0], 1.0 - best[1] / (options.top * best[2])
                        found.append((name, max(score, 0.0) if last else score))
                columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns + ([] if last else [batch.column(3)]), ["doc_id", "lang_pred", "score", "text"][: 3 if last else 4])

        return rows.mapInArrow(predict, schema + ("" if last else ", text string"))

    for i, own in enumerate(blocks):
        rows = compared(rows, own, i == len(blocks) - 1)
    return rows
