"""Packing into optimal length buckets.

The histogram of document lengths over the whole corpus is small whatever the
corpus: lengths of 512 tokens and more are rounded up to 9 significant bits, so
there are at most 256 lengths an octave, which differ by 0.4 % at most. Dynamic
programming over it places the bucket boundaries that minimise padding. A
bucket's length is the longest document in it. Inside each bucket, batches take
as many documents as the token budget holds at the bucket's length; a document
longer than the budget forms a batch alone.

Places inside a bucket come from exact counts, not from one sorted task: every
length is dealt into chunks by hash, about the square root of its count, so both
the chunks and what is in them stay small at any count. Rows of equal id and
length, such as all those with a null id, are counted first, placed as one run
and dealt out again in pieces.

Null and empty texts have no tokens: they share the shortest bucket. Repeated
and null ids get places of their own. Texts of any length are counted whole. An
empty table gives an empty table. Columns beyond id and text are not read,
whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
EXACT_BITS = 9


@dataclass(frozen=True)
class Packing:
    """``piece`` rows of one id and length are dealt out together."""

    buckets: int = 16
    token_budget: int = 16_384
    piece: int = 100_000


def word_tokens(text: Column) -> Column:
    """Whitespace-separated tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rounded(n: Column) -> Column:
    """``n`` rounded up to ``EXACT_BITS`` significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(n)) - EXACT_BITS, F.lit(0))).cast("long")
    return F.ceil(n / step).cast("long") * step


def boundaries(lengths, counts, totals, k: int) -> list[int]:
    """At most ``k`` bucket lengths, ascending, that minimise the padding.

    ``lengths`` ascend; ``counts`` documents of each hold ``totals`` tokens. A
    bucket that ends at length j and begins after i pads (count between) times
    length j, less the tokens between.
    """
    lengths = np.asarray(lengths, dtype=float)
    if not len(lengths):
        return []
    docs, tokens = np.concatenate([[0], np.cumsum(np.asarray(counts, float))]), np.concatenate([[0], np.cumsum(np.asarray(totals, float))])
    n, k = len(lengths), min(k, len(lengths))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cut = np.zeros((k + 1, n + 1), dtype=np.int64)
    for b in range(1, k + 1):
        now = np.full(n + 1, np.inf)
        for j in range(b, n + 1):
            cost = best[:j] + lengths[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            cut[b, j] = i = int(np.argmin(cost))
            now[j] = cost[i]
        best = now
    ends, j = [], n
    for b in range(k, 0, -1):
        ends.append(int(lengths[j - 1]))
        j = int(cut[b, j])
    return ends[::-1]


def pack(docs: DataFrame, options: Packing = Packing(), id_col="doc_id", text_col="text", length: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, bucket_length, batch, slot.

    ``length`` replaces the token count, for instance by the count of a BPE encoder.
    """
    spark = docs.sparkSession
    n = length if length is not None else word_tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("_k"))
    rows = stored(rows.withColumn("_bin", rounded(F.col("n_tokens"))))
    bins = sorted(rows.groupBy("_bin").agg(F.sum("_k").alias("n"), F.sum(F.col("n_tokens") * F.col("_k")).alias("t"), F.max("n_tokens").alias("longest")).collect())  # at most 256 an octave
    ends = boundaries([r[0] for r in bins], [r[1] for r in bins], [r[2] for r in bins], options.buckets)
    bucket_of = [int(np.searchsorted(ends, r[0])) for r in bins]
    longest = {b: max(r[3] for r, x in zip(bins, bucket_of) if x == b) for b in set(bucket_of)}
    plan, before = [], {}
    for (size, count, *_), bucket in zip(bins, bucket_of):
        plan.append((size, bucket, longest[bucket], math.isqrt(count) + 1, before.get(bucket, 0)))
        before[bucket] = before.get(bucket, 0) + count
    plan = spark.createDataFrame(plan, "_bin long, bucket int, bucket_length long, _chunks int, _before long")
    rows = rows.join(plan, "_bin").withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("_chunks")))
    of_bin, of_chunk = Window.partitionBy("_bin").orderBy("_chunk"), Window.partitionBy("_bin", "_chunk").orderBy("doc_id", "n_tokens")
    chunks = rows.groupBy("_bin", "_chunk").agg(F.sum("_k").alias("_n"))
    chunks = chunks.select("_bin", "_chunk", (F.sum("_n").over(of_bin) - F.col("_n")).alias("_skip"))
    runs = rows.withColumn("_row", F.sum("_k").over(of_chunk) - F.col("_k")).join(chunks, ["_bin", "_chunk"])
    runs = runs.withColumn("_first", F.col("_before") + F.col("_skip") + F.col("_row")).withColumn("_last", F.col("_first") + F.col("_k") - 1)
    # One row for each document again; pieces of long runs are dealt to other tasks before they are spread out.
    columns = ["doc_id", "n_tokens", "bucket", "bucket_length"]
    short = runs.where(F.col("_k") <= options.piece).select(*columns, "_first", "_last")
    long_ = runs.where(F.col("_k") > options.piece).select(*columns, "_last", F.explode(F.sequence("_first", "_last", F.lit(options.piece).cast("long"))).alias("_first"))
    long_ = long_.select(*columns, "_first", F.least("_last", F.col("_first") + options.piece - 1).alias("_last")).repartition("bucket", "_first")
    placed = short.unionByName(long_).select(*columns, F.explode(F.sequence("_first", "_last")).alias("_place"))
    per_batch = F.greatest(F.floor(F.lit(options.token_budget) / F.greatest(F.col("bucket_length"), F.lit(1))), F.lit(1))
    return placed.select(
        *columns, F.floor(F.col("_place") / per_batch).cast("long").alias("batch"), F.pmod(F.col("_place"), per_batch).cast("int").alias("slot"),
    )
