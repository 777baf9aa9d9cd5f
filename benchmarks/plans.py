"""Times the analyses' plans against plainer plans of the same results, on generated alignments; prints one JSON line a workload.

Median of ``RUNS`` warm runs, the making of the rows included. The plain plan
compares sequences with each other; ours counts first.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codonframe.genetics.code import with_differences
from codonframe.operators import alleles, between, bootstrap, codons, windows, within
from codonframe.plans.views import base, codon_of

RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def aligned(spark, groups, n, places):
    """group, product, codon_num, seq, codon of ``n`` sequences a group; a tenth of the codons differ from their place's usual one."""
    rows = spark.range(groups * n * places, numPartitions=16)
    place, seq = F.col("id") % places, F.floor(F.col("id") / places)
    roll = F.pmod(F.xxhash64("id"), F.lit(100))
    codon = codon_of((place * 7 + F.when(roll < 10, roll + 1).otherwise(0)) % 64)
    return rows.select((seq % groups).cast("string").alias("group"), F.lit("P").alias("product"), (place + 1).cast("int").alias("codon_num"), seq.alias("seq"), codon.alias("codon"))


def by_sequences(rows, pairs):
    """Mean differences of each place over pairs of sequences."""
    one = rows.select("product", "codon_num", F.col("group").alias("g"), F.col("seq").alias("s"), F.col("codon").alias("codon_a"))
    two = rows.select("product", "codon_num", F.col("group").alias("h"), F.col("seq").alias("t"), F.col("codon").alias("codon_b"))
    joined = with_differences(one.join(two, ["product", "codon_num"]).where(pairs), "codon_a", "codon_b")
    return joined.groupBy("product", "codon_num", "g", "h").agg(F.avg("n_diff").alias("N_diffs"), F.avg("s_diff").alias("S_diffs"))


def site_pairs(reads):
    one, two = reads.select("site", F.col("seq").alias("s"), F.col("nt").alias("x")), reads.select("site", F.col("seq").alias("t"), F.col("nt").alias("y"))
    return one.join(two, "site").where("s < t").groupBy("site").agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("pi"))


def range_joined(rows, size):
    starts = rows.select(F.col("product").alias("p"), F.col("codon_num").alias("first"))
    inside = starts.join(rows, (F.col("p") == F.col("product")) & F.col("codon_num").between(F.col("first"), F.col("first") + size - 1))
    return inside.groupBy("p", "first").agg(*[F.sum(m).alias(m) for m in within.MEASURES])


def one_by_one(rows, reps):
    found = []
    for rep in range(1, reps + 1):
        found.append(bootstrap.replicates(rows, 1, rep).collect())
    return found


def run(df):
    df.write.format("noop").mode("overwrite").save() if hasattr(df, "write") else df()


def seconds(make):
    times = []
    for _ in range(RUNS + 1):
        began = time.perf_counter()
        run(make())
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 2)


def main():
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    one, two = aligned(spark, 1, 300, 300), aligned(spark, 2, 150, 300)
    reads = aligned(spark, 1, 300, 900).select("seq", F.col("codon_num").alias("site"), base(F.pmod(F.xxhash64("seq", "codon_num"), F.lit(4))).alias("nt"))
    long_ = spark.range(20_000).select(F.concat(F.lit("P"), (F.col("id") % 4).cast("string")).alias("product"), (F.floor(F.col("id") / 4) + 1).cast("int").alias("codon_num"), *[F.rand(1).alias(m) for m in within.MEASURES])
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    within.within_codon(codons.codon_counts(one)).write.parquet(f"{folder}/codons")
    held = spark.read.parquet(f"{folder}/codons")
    work = {
        "P1": (lambda: by_sequences(one, F.col("s") < F.col("t")), lambda: within.within_codon(codons.codon_counts(one))),
        "P2": (lambda: by_sequences(two, F.col("g") < F.col("h")), lambda: between.between_codon(codons.codon_counts(two))),
        "P3": (lambda: site_pairs(reads), lambda: alleles.site_diversity(alleles.base_counts(reads, "site"))),
        "P4": (lambda: range_joined(long_, 40), lambda: windows.sliding_windows(long_, 40)),
        "P5": (lambda: lambda: one_by_one(held, 50), lambda: bootstrap.replicates(held, 1000, 1)),
    }
    for name, (plain, ours) in work.items():
        print(json.dumps({"id": name, "plain": seconds(plain), "ours": seconds(ours)}), flush=True)
    for n in (100, 1000, 10_000):
        rows = aligned(spark, 1, n, 1000)
        print(json.dumps({"id": "P6", "n": n, "ours": seconds(lambda: within.within_codon(codons.codon_counts(rows)))}), flush=True)  # noqa: B023
    spark.stop()


if __name__ == "__main__":
    main()
