"""Sliding windows over the codons of a product.

A product is not one task: its codons are dealt into blocks, each with the codons
of the next that its windows reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonframe.functions.stats import ratio

from .between import enough_taxa
from .within import MEASURES, rates


#: Codon numbers, or rows, of a block.
BLOCK = 4096


def required(df: DataFrame, *columns: str) -> DataFrame:
    """``df``; a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError("the table has no column " + ", ".join(missing))
    return df


def table_guards(codons: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """by, guard, codon_num, rows: what keeps a codon table from being read as one row for each codon.

    ``repeated`` codon numbers of a product, and rows with ``no number``. One grouped count finds both.
    """
    keys = list(by)
    times = codons.groupBy(*keys, "codon_num").agg(F.count("*").alias("rows"))
    guard = F.when(F.col("codon_num").isNull(), "no number").when(F.col("rows") > 1, "repeated")
    return times.select(*keys, guard.alias("guard"), "codon_num", "rows").where(F.col("guard").isNotNull())


def several_products(codons: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """by, guard (``several products``), rows: of tables that hold more than one product, where only one was meant."""
    keys = list(by)
    found = codons.groupBy(*keys).agg(F.count("*").alias("rows"))
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("_n")))).where(F.col("_n") > 1).select(*keys, F.lit("several products").alias("guard"), "rows")  # with one row


def window_log(codons: DataFrame, size: int, by: tuple[str, ...] = ("product",), min_defined: float | None = None) -> DataFrame:
    """by, codons, message of products that have no window, as they have fewer codons than one.

    With ``min_defined`` only codons with so many sequences count, as in ``row_windows``.
    """
    rows = codons if min_defined is None else codons.withColumn("codon_num", F.when(F.col("num_defined_seqs") >= min_defined, F.col("codon_num")))
    found = rows.groupBy(*by).agg(F.count("codon_num").alias("codons"))
    return found.where(F.col("codons") < size).withColumn("message", F.concat(F.lit(f"no window of {size} codons: it has "), F.col("codons").cast("string")))


def _once(codons: DataFrame, by: list[str]) -> DataFrame:
    """``codons``; an error when they are read if a product has a codon number twice, or a row none."""
    before = F.lag("codon_num").over(Window.partitionBy(*by).orderBy("codon_num"))
    wrong = F.raise_error(F.concat(F.lit("codon number twice, or none, in a product: "), F.coalesce(F.col("codon_num").cast("string"), F.lit("null")))).cast(codons.schema["codon_num"].dataType)
    return codons.withColumn("codon_num", F.when(F.col("codon_num").isNull() | (before == F.col("codon_num")), wrong).otherwise(F.col("codon_num")))


def dense(codons: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A row for every codon number between a product's first and last; missing ones have null measures. A codon number that a product has twice is an error."""
    rows = _once(codons, by)
    span = rows.groupBy(*by).agg(F.min("codon_num").alias("_lo"), F.max("codon_num").alias("_hi"), F.count("*").alias("_codons"))
    grid = span.select(*by, "_lo", "_codons", F.explode(F.sequence("_lo", "_hi")).alias("codon_num"))
    return grid.join(rows.select(*by, "codon_num", *columns), [*by, "codon_num"], "left")


def with_halo(rows: DataFrame, place: Column, size: int) -> DataFrame:
    """``rows`` with _block and _own: each in the block of its ``place`` (from 0), and again (not _own) in those before whose windows of ``size`` reach it."""
    block = lambda x: F.floor(x / BLOCK).cast("long")
    reached = F.sequence(block(F.greatest(place - (size - 1), F.lit(0))), block(place))
    return rows.withColumn("_at", block(place)).withColumn("_block", F.explode(reached)).withColumn("_own", F.col("_block") == F.col("_at")).drop("_at")


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with _row, their place from 1 in order of codon number, counted by blocks of codon numbers."""
    rows = rows.withColumn("_part", F.floor(F.col("codon_num") / BLOCK))
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_part") == F.col("_of")]
    found = rows.join(parts, same).drop(*[f"_{c}" for c in by], "_of")
    return found.withColumn("_row", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy("codon_num"))).drop("_part", "_before")


def sliding_windows(codons: DataFrame, size: int = 9, step: int = 1, by: tuple[str, ...] = ("product",), keep: Column | None = None) -> DataFrame:
    """Windows of ``size`` codon numbers: first_codon, last_codon, sums and rates.

    Missing codons add nothing; neither do those where ``keep`` is false.
    Products with fewer codons than a window have none; ``window_log`` names them.
    A codon number that a product has twice is an error when the windows are read; ``table_guards`` names all of them.
    """
    keys = list(by)
    held = codons if keep is None else codons.withColumns({m: F.when(keep, F.col(m)) for m in MEASURES})
    rows = with_halo(dense(held, keys, list(MEASURES)), F.col("codon_num") - F.col("_lo"), size)
    frame = Window.partitionBy(*keys, "_block").orderBy("codon_num").rangeBetween(0, size - 1)
    sums = rows.select(*keys, "_own", "_lo", "_codons", F.col("codon_num").alias("first_codon"), (F.col("codon_num") + size - 1).alias("last_codon"), *[F.coalesce(F.sum(m).over(frame), F.lit(0.0)).alias(m) for m in MEASURES])
    offset = F.col("first_codon") - F.col("_lo")
    found = sums.where(F.col("_own") & (offset % step == 0) & (offset <= F.col("_codons") - size)).withColumn("window", (offset / step + 1).cast("int"))
    return rates(found.drop("_own", "_lo", "_codons"))


def between_windows(codons: DataFrame, size: int = 9, step: int = 1, min_total: int = 0, min_group: int = 0, min_cap: float | None = None) -> DataFrame:
    """Windows between groups over codons with enough taxa, and how many codons were defined in them.

    The mean of both groups' sums, and the least of either group's codons; ``min_cap`` bounds the least.
    """
    keys = ["product", "group_1", "group_2"]
    keep = enough_taxa(min_total, min_group)
    sums = sliding_windows(codons, size, step, tuple(keys), keep)
    taxa = ["num_defined_codons_g1", "num_defined_codons_g2"]
    rows = with_halo(dense(codons.withColumns({t: F.when(keep, F.col(t)) for t in taxa}), keys, taxa), F.col("codon_num") - F.col("_lo"), size)
    frame = Window.partitionBy(*keys, "_block").orderBy("codon_num").rangeBetween(0, size - 1)
    least = F.min(F.least(*taxa)).over(frame)
    stats = rows.select(
        *keys, "_own", F.col("codon_num").alias("first_codon"), *[F.coalesce(F.sum(t).over(frame), F.lit(0)).alias(t) for t in taxa],
        (least if min_cap is None else F.least(least, F.lit(min_cap))).alias("min_num_defined_codons"),
    )
    stats = stats.where("_own").drop("_own").withColumn("mean_num_defined_codons", (F.col(taxa[0]) + F.col(taxa[1])) / 2)
    return sums.join(stats, [*keys, "first_codon"], "left")


def row_windows(codons: DataFrame, size: int, step: int = 1, min_defined: int = 2, numerator: str = "N", denominator: str = "S", by: tuple[str, ...] = ("product",), keep_columns: bool = False) -> DataFrame:
    """Windows of ``size`` rows, in order of codon number, over codons with at least ``min_defined`` sequences.

    numerator ``N`` or ``T`` and denominator ``S`` or ``N`` choose the columns.
    A codon number that a product has twice, or a row without one, is an error when the windows are read.
    Each window stands on its first codon's row: sw_start, sw_center, sw_end and sw_ columns. ``keep_columns``
    returns every row of ``codons`` with all its columns; those on which no window begins have null sw_ columns.
    """
    keys = list(by)
    chosen = {f"{x}_{m}" for x in (numerator, denominator) for m in ("diffs", "sites")}
    required(codons, *keys, "codon_num", "num_defined_seqs", *sorted(chosen))
    rows = in_order(_once(codons, keys).where(F.col("num_defined_seqs") >= min_defined).select(*keys, "codon_num", *sorted(chosen)), keys)
    rows = with_halo(rows, F.col("_row") - 1, size)
    frame = Window.partitionBy(*keys, "_block").orderBy("codon_num").rowsBetween(0, size - 1)
    top, bottom = {"N": (f"{numerator}_diffs", f"{numerator}_sites"), "S": (f"{denominator}_diffs", f"{denominator}_sites")}.values()
    found = rows.select(
        *keys, "codon_num", "_own", "_row", F.count("*").over(frame).alias("_n"),
        F.lit(f"d{numerator}d{denominator}").alias("sw_ratio"), F.first("codon_num").over(frame).alias("sw_start"), F.avg("codon_num").over(frame).alias("sw_center"), F.last("codon_num").over(frame).alias("sw_end"),
        F.sum(top[0]).over(frame).alias("sw_N_diffs"), F.sum(bottom[0]).over(frame).alias("sw_S_diffs"), F.sum(top[1]).over(frame).alias("sw_N_sites"), F.sum(bottom[1]).over(frame).alias("sw_S_sites"),
    )
    found = found.where(F.col("_own") & (F.col("_n") == size) & ((F.col("_row") - 1) % step == 0)).drop("_own", "_row", "_n")
    found = found.withColumns({"sw_dN": ratio(F.col("sw_N_diffs"), F.col("sw_N_sites")), "sw_dS": ratio(F.col("sw_S_diffs"), F.col("sw_S_sites"))})
    found = found.withColumns({"sw_dNdS": ratio(F.col("sw_dN"), F.col("sw_dS")), "sw_dN_m_dS": F.col("sw_dN") - F.col("sw_dS")})
    return on_rows(codons, found, by) if keep_columns else found


def on_rows(codons: DataFrame, found: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """Every row of a codon table with its columns and, where a window begins, the window's; missing key values are equal to each other."""
    other = found.select(*[F.col(c).alias(f"_{c}") for c in (*by, "codon_num")], *[c for c in found.columns if c not in codons.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "codon_num")]
    return codons.join(other, same, "left").drop(*[f"_{c}" for c in (*by, "codon_num")])


def with_excess_flag(windows: DataFrame, products: DataFrame, by: tuple[str, ...] = ("product",)) -> DataFrame:
    """``windows`` with dN_gt_total_dS: ``*`` where a window's dN exceeds the whole product's dS."""
    whole = products.select(*by, F.col("dS").alias("_total"))
    return windows.join(whole, list(by), "left").withColumn("dN_gt_total_dS", F.when(F.col("dN") > F.col("_total"), "*").otherwise("")).drop("_total")
