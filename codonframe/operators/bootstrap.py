"""Bootstrap over codons: replicates are rows, so they run side by side.

Draws come from a hash of key, replicate, draw and seed, so a task that is run
again draws the same. ``arithmetic`` draws follow a linear congruence that other
engines can repeat; they are meant for tests only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonframe.functions.stats import jukes_cantor as corrected
from codonframe.functions.stats import ratio, ratio_p, stars, two_sided_p, z_score

from .between import with_jukes_cantor
from .windows import in_order, row_windows
from .within import MEASURES, rates


#: Replicates that are drawn in one row of work.
BLOCK = 500


def _index(rep: Column, draw: Column, n: Column, keys: list[str], seed: int, arithmetic: bool, legacy_index0: bool) -> Column:
    """The place, from 1, that a draw takes; 0 takes none."""
    if arithmetic:
        return ((rep * 7919 + draw * 104729 + F.lit(seed) * 31) % 1000003) % n + 1
    return F.pmod(F.xxhash64(*keys, rep, draw, F.lit(seed)), n + 1 if legacy_index0 else n) + (0 if legacy_index0 else 1)


def replicates(codons: DataFrame, reps: int, seed: int, by: tuple[str, ...] = ("product",), arithmetic: bool = False, legacy_index0: bool = False, keep: Column | None = None) -> DataFrame:
    """by, rep and the four sums of as many drawn codons as the product has.

    Codons where ``keep`` is false are drawn and add nothing. ``legacy_index0`` draws a place before the first, too, which adds nothing.
    A product's measures are one array, as long as the product; a replicate draws from it and adds up in its own row.
    Products are dealt over all tasks by a stated number, which adaptive execution does not lower for small arrays, and where there are more
    replicates than ``BLOCK``, so are blocks of replicates, each with the array once: one product uses all tasks. What is drawn does not depend on it.
    """
    keys = list(by)
    held = codons if keep is None else codons.withColumns({m: F.when(keep, F.col(m)).otherwise(0.0) for m in MEASURES})
    tasks = int(codons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = held.select(*keys, "codon_num", *MEASURES).repartition(tasks, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("codon_num", *MEASURES))).alias("_a"))
    first = F.explode(F.sequence(F.lit(1), F.lit(reps), F.lit(BLOCK))).alias("_first")
    rows = rows.select(*keys, "_a", first)
    if reps > BLOCK:
        rows = rows.repartition(tasks, *keys, "_first")
    rows = rows.select(*keys, "_a", F.explode(F.sequence("_first", F.least(F.col("_first") + BLOCK - 1, F.lit(reps)))).alias("rep"))
    size = F.size("_a")
    take = lambda draw: F.get("_a", (_index(F.col("rep"), draw, size, keys, seed, arithmetic, legacy_index0) - 1).cast("int"))
    drawn = rows.select(*keys, "rep", F.transform(F.sequence(F.lit(1), size), take).alias("_d"))
    total = lambda m: F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.coalesce(x[m].cast("double"), F.lit(0.0)))
    return drawn.select(*keys, "rep", *[total(m).alias(m) for m in MEASURES])


def window_codons(codons: DataFrame, windows: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """The codons of each window: by, window, codon_num and the measures; ready for ``replicates`` by (*by, window)."""
    keys = list(by)
    inside = windows.select(*keys, "window", F.explode(F.sequence("first_codon", "last_codon")).alias("codon_num"))
    found = inside.join(codons.select(*keys, "codon_num", *MEASURES), [*keys, "codon_num"], "left")
    return found.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in MEASURES})


def standard_errors(reps: DataFrame, by: tuple[str, ...] = ("product",), undefined_as_zero: bool = False, jukes_cantor: bool = False) -> DataFrame:
    """SE_dN, SE_dS, SE_dN_minus_dS, SE_dN_over_dS over the replicates, corrected ones too if asked for."""
    rated = rates(reps, undefined_as_zero)
    names = ["dN", "dS", "dN_minus_dS", "dN_over_dS"]
    if jukes_cantor:
        rated, names = with_jukes_cantor(rated), [*names, "JC_dN", "JC_dS", "JC_dN_minus_dS", "JC_dNdS"]
    return rated.groupBy(*by).agg(*[F.stddev_samp(c).alias(f"SE_{c}") for c in names])


def with_z_test(results: DataFrame, errors: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """``results`` with the errors, Z_value and significance of dN - dS; JC_Z_value and JC_significance where both tables hold corrected rates."""
    joined = results.join(errors, list(by), "left")
    for prefix in ("", "JC_") if {"JC_dN_minus_dS", "SE_JC_dN_minus_dS"} <= set(joined.columns) else ("",):
        joined = joined.withColumn(f"{prefix}Z_value", z_score(F.col(f"{prefix}dN_minus_dS"), F.col(f"SE_{prefix}dN_minus_dS")))
        joined = joined.withColumn(f"{prefix}significance", F.coalesce(stars(F.col(f"{prefix}Z_value")), F.lit("NA")))
    return joined


def window_tests(codons: DataFrame, windows: DataFrame, reps: int, seed: int, by: tuple[str, ...] = ("product",), arithmetic: bool = False, keep: Column | None = None) -> DataFrame:
    """``windows`` of codon numbers with standard errors, Z test and achieved significance levels of their own bootstrap.

    A window's codons are drawn anew for each replicate; those where ``keep`` is false are drawn and add nothing.
    """
    of_window = (*by, "window")
    held = codons if keep is None else codons.withColumns({m: F.when(keep, F.col(m)).otherwise(0.0) for m in MEASURES})
    drawn = replicates(window_codons(held, windows, by), reps, seed, of_window, arithmetic)
    found = with_z_test(windows, standard_errors(drawn, of_window), of_window)
    return found.join(achieved_significance(drawn, of_window), list(of_window), "left")


def with_p_values(results: DataFrame, ratio_null: float = 0.0) -> DataFrame:
    """``results`` (with standard errors) with normal P values of the difference and of the ratio against ``ratio_null``."""
    return results.withColumns({
        "dN_minus_dS_P": two_sided_p(z_score(F.col("dN_minus_dS"), F.col("SE_dN_minus_dS"))),
        "dN_over_dS_P": ratio_p(F.col("dN_over_dS"), F.col("SE_dN_over_dS"), ratio_null),
    })


def achieved_significance(reps: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Replicates with dN above, at and below dS, the shares that speak against either, and the two-sided level.

    The two-sided level is at least one in the number of replicates, and 1 where no replicate is defined.
    """
    diff = ratio(F.col("N_diffs"), F.col("N_sites")) - ratio(F.col("S_diffs"), F.col("S_sites"))
    count = lambda c: F.count_if(c)
    found = reps.withColumn("_d", diff).groupBy(*by).agg(
        count(F.col("_d") > 0).alias("dN_gt_dS_count"), count(F.col("_d") == 0).alias("dN_eq_dS_count"), count(F.col("_d") < 0).alias("dN_lt_dS_count"), F.count("*").alias("_reps")
    )
    total = F.col("dN_gt_dS_count") + F.col("dN_eq_dS_count") + F.col("dN_lt_dS_count")
    found = found.withColumns({"ASL_dN_gt_dS_P": F.try_divide(F.col("dN_lt_dS_count"), total), "ASL_dN_lt_dS_P": F.try_divide(F.col("dN_gt_dS_count"), total)})
    two = 2 * F.least("ASL_dN_gt_dS_P", "ASL_dN_lt_dS_P")
    return found.withColumn("ASL_dNdS_P", F.when(two.isNull(), 1.0).when(two == 0, 1 / F.col("_reps")).otherwise(two)).drop("_reps")


def row_window_tests(
    codons: DataFrame, size: int, reps: int, seed: int, step: int = 1, min_defined: int = 2, numerator: str = "N", denominator: str = "S",
    jukes_cantor: bool = False, ratio_null: float = 0.0, by: tuple[str, ...] = ("product",), arithmetic: bool = False,
) -> DataFrame:
    """``row_windows`` with their bootstrap: sw_boot_ standard errors, P values and counts, and sw_ASL_ levels.

    One resampling of a window's rows serves all statistics. With ``jukes_cantor``
    the corrected rates take the place of dN and dS.
    """
    keys = list(by)
    found = row_windows(codons, size, step, min_defined, numerator, denominator, by)
    chosen = {"N_diffs": f"{numerator}_diffs", "N_sites": f"{numerator}_sites", "S_diffs": f"{denominator}_diffs", "S_sites": f"{denominator}_sites"}
    rows = in_order(codons.where(F.col("num_defined_seqs") >= min_defined), keys)
    rows = rows.select(*keys, "codon_num", F.col("_row").cast("int").alias("_row"), *[F.col(c).alias(m) for m, c in chosen.items()])
    # A row belongs to the windows that begin at most size - 1 rows before it.
    starts = F.explode(F.sequence(F.greatest(F.col("_row") - size + 1, F.lit(1)), F.col("_row"))).alias("_start")
    inside = rows.select(*keys, "codon_num", *MEASURES, starts).where((F.col("_start") - 1) % step == 0)
    first = rows.select(*keys, F.col("_row").alias("_start"), F.col("codon_num").alias("sw_start"))
    inside = inside.join(first, [*keys, "_start"]).drop("_start")
    drawn = rates(replicates(inside, reps, seed, (*by, "sw_start"), arithmetic))
    if jukes_cantor:
        both = {"sw_dN": corrected(F.col("sw_dN")), "sw_dS": corrected(F.col("sw_dS"))}
        found = found.withColumns(both).withColumns({"sw_dNdS": ratio(F.col("sw_dN"), F.col("sw_dS")), "sw_dN_m_dS": F.col("sw_dN") - F.col("sw_dS")})
        drawn = drawn.withColumns({"dN": corrected(F.col("dN")), "dS": corrected(F.col("dS"))})
        drawn = drawn.withColumns({"dN_minus_dS": F.col("dN") - F.col("dS"), "dN_over_dS": ratio(F.col("dN"), F.col("dS"))})
    diff = F.col("dN_minus_dS")
    tests = drawn.groupBy(*keys, "sw_start").agg(
        F.count("*").alias("sw_num_replicates"), F.stddev_samp("dN").alias("sw_boot_dN_SE"), F.stddev_samp("dS").alias("sw_boot_dS_SE"),
        F.stddev_samp("dN_over_dS").alias("sw_boot_dN_over_dS_SE"), F.stddev_samp(diff).alias("sw_boot_dN_m_dS_SE"),
        F.count_if(diff > 0).alias("sw_boot_dN_gt_dS_count"), F.count_if(diff == 0).alias("sw_boot_dN_eq_dS_count"), F.count_if(diff < 0).alias("sw_boot_dN_lt_dS_count"),
    )
    total = F.col("sw_boot_dN_gt_dS_count") + F.col("sw_boot_dN_eq_dS_count") + F.col("sw_boot_dN_lt_dS_count")
    tests = tests.withColumns({"sw_ASL_dN_gt_dS_P": F.try_divide(F.col("sw_boot_dN_lt_dS_count"), total), "sw_ASL_dN_lt_dS_P": F.try_divide(F.col("sw_boot_dN_gt_dS_count"), total)})
    two = 2 * F.least("sw_ASL_dN_gt_dS_P", "sw_ASL_dN_lt_dS_P")
    tests = tests.withColumn("sw_ASL_dNdS_P", F.when(two.isNull(), 1.0).when(two == 0, 1 / F.col("sw_num_replicates")).otherwise(two))
    return found.join(tests, [*keys, "sw_start"], "left").withColumns({
        "sw_boot_dN_over_dS_P": ratio_p(F.col("sw_dNdS"), F.col("sw_boot_dN_over_dS_SE"), ratio_null),
        "sw_boot_dN_m_dS_P": two_sided_p(z_score(F.col("sw_dN_m_dS"), F.col("sw_boot_dN_m_dS_SE"))),
    })
