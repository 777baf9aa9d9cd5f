"""Long sequences as pieces: no row holds a chromosome, and time is linear in its length.

A piece is ``PIECE`` bases of a sequence and the two that follow, so that every
codon of neighbouring bases lies in the piece in which it begins. Annotations
become runs: for each coding segment and piece the codons that begin in it, known
by their first place and number, not listed. Runs meet pieces by the number of
the piece. Codons that a splice cuts are asked for base by base; there are at
most two of them for each splice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonframe.functions.sequence import cleaned, codons

#: Bases of a piece, and bytes of runs up to which they are sent to all tasks.
PIECE, BROADCAST_BYTES = 1 << 14, 64 << 20


def cut(seqs: DataFrame, *keep: str, piece: int | None = None) -> DataFrame:
    """``keep``, length, piece (from 0) and bases of the sequences in ``seq``. Bytes are cut, as places in them need no counting."""
    size = piece or PIECE
    raw = F.col("seq").cast("binary")
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / size).cast("int"))
    parts = F.transform(numbers, lambda i: F.struct(i.alias("piece"), F.substring(raw, i * size + 1, F.lit(size + 2)).cast("string").alias("bases")))
    return seqs.where(F.length("seq") > 0).select(*keep, F.length("seq").cast("long").alias("length"), F.explode(parts).alias("_p")).select(*keep, "length", "_p.piece", "_p.bases")


def own_bases(bases: Column, piece: int | None = None) -> Column:
    """A piece's bases without the two of the next."""
    return F.substring(bases, 1, piece or PIECE)


def pieces_of_lines(lines: DataFrame, piece: int | None = None) -> DataFrame:
    """group, sequence, header, length, piece, bases from the lines of FASTA files: group, part, line (which order a file's lines), value.

    A line belongs to the last line before it that begins with ``>``, and its place
    is the number of bases between them. Both are running sums: over the lines of a
    part, which is what one task has read of a file, and over the sums of the parts. A sequence is never gathered.
    Lines before a file's first header are left out; headers without bases have no pieces.
    """
    size = piece or PIECE
    text = cleaned(F.col("value"))
    header = F.col("value").startswith(">")
    rows = lines.select("group", "part", "line", header.alias("_h"), F.when(header, F.trim(F.substring(F.regexp_replace("value", "[\\r\\n]", ""), 2, 1 << 30))).alias("_name"), F.when(header, "").otherwise(text).alias("_bases"))
    rows = rows.withColumn("_n", F.length("_bases"))  # before they are dealt out, so that what needs no bases moves none
    before = Window.partitionBy("group", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_records": F.count_if("_h").over(before), "_sum": F.sum("_n").over(before) - F.col("_n")})
    # A part's share: its headers, its bases, and the bases after its last header.
    last = F.max(F.when(F.col("_h"), F.struct("line", "_sum")))
    parts = rows.groupBy("group", "part").agg(F.count_if("_h").alias("_heads"), F.sum("_n").alias("_total"), last.alias("_last"))
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    begun = F.max(F.when(F.col("_last").isNotNull(), F.struct("part", (F.col("_base") + F.col("_last._sum")).alias("at")))).over(earlier)
    parts = parts.select("group", "part", F.coalesce(F.sum("_heads").over(earlier), F.lit(0)).alias("_before"), "_base", begun["at"].alias("_open"))
    placed = rows.join(parts, ["group", "part"])
    own = F.max(F.when(F.col("_h"), F.struct("line", "_sum"))).over(before)["_sum"]
    placed = placed.withColumns({"sequence": F.col("_before") + F.col("_records"), "_at": F.col("_base") + F.col("_sum") - F.coalesce(F.col("_base") + own, "_open")}).where(F.col("sequence") > 0)
    # Each line goes to the pieces it reaches, the two bases before a piece's begin included.
    first = F.floor(F.greatest(F.col("_at") - 2, F.lit(0)) / size).cast("int")
    shares = placed.where(F.col("_n") > 0).select("group", "sequence", "_at", "_n", "_bases", F.explode(F.sequence(first, F.floor((F.col("_at") + F.col("_n") - 1) / size).cast("int"))).alias("piece"))
    skip = F.greatest(F.col("piece").cast("long") * size - F.col("_at"), F.lit(0))
    until = F.least((F.col("piece").cast("long") + 1) * size + 2 - F.col("_at"), F.col("_n"))
    shares = shares.select("group", "sequence", "piece", "_at", F.substring(F.col("_bases").cast("binary"), (skip + 1).cast("int"), (until - skip).cast("int")).cast("string").alias("_b")).where(F.length("_b") > 0)
    whole = shares.groupBy("group", "sequence", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_b"))), lambda x: x["_b"]), "").alias("bases"))
    about = placed.groupBy("group", "sequence").agg(F.max("_name").alias("header"), F.sum("_n").alias("length")).where(F.col("length") > 0)
    # A row for each piece, so that a long sequence's pieces stay where they are, dealt out by their numbers.
    about = about.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))))
    return whole.join(about, ["group", "sequence", "piece"]).select("group", "sequence", "header", "length", "piece", "bases")


def read_fasta_pieces(spark, path: str | list[str], extensions: str | None = None) -> DataFrame:
    """``pieces_of_lines`` of FASTA files or of a folder's; a file of one sequence is read by many tasks."""
    from codonframe.sources.fasta import EXTENSIONS

    raw = spark.read.option("pathGlobFilter", extensions or EXTENSIONS).text(path)
    return pieces_of_lines(raw.select(F.col("_metadata.file_name").alias("group"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), "value"))


def _segments(products: DataFrame) -> DataFrame:
    """product, start, stop, c (coding bases before the segment) of each segment, and the same of the two that follow it (one, two)."""
    rows = products.select("product", F.xxhash64("product", "segments").alias("_of"), F.explode("segments").alias("_s")).select("product", "_of", "_s.start", "_s.stop")
    line = Window.partitionBy("product", "_of").orderBy("start", "stop")
    size = F.col("stop") - F.col("start") + 1
    rows = rows.withColumn("c", (F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("long"))
    return rows.select("product", "start", "stop", "c", *[F.lead(F.struct("start", "c"), i).over(line).alias(n) for i, n in ((1, "one"), (2, "two"))])


def runs(products: DataFrame, piece: int | None = None) -> DataFrame:
    """piece, product, site (of the first codon that begins in the piece), codon_num (its number), n (codons that follow each other there)."""
    size = piece or PIECE
    rows = _segments(products).select("product", "start", "stop", F.ceil(F.col("c") / 3).alias("_k"), F.pmod(-F.col("c"), F.lit(3)).alias("_shift"))
    rows = rows.withColumn("_first", F.col("start") + F.col("_shift")).withColumn("_n", F.floor((F.col("stop") - F.col("_first") + 1) / 3)).where(F.col("_n") > 0)
    last = F.col("_first") + 3 * (F.col("_n") - 1)
    rows = rows.withColumn("piece", F.explode(F.sequence(F.floor((F.col("_first") - 1) / size).cast("int"), F.floor((last - 1) / size).cast("int"))))
    skipped = F.greatest(F.ceil((F.col("piece").cast("long") * size + 1 - F.col("_first")) / 3), F.lit(0))
    within = F.least(F.floor(((F.col("piece").cast("long") + 1) * size - F.col("_first")) / 3) + 1, F.col("_n"))
    found = rows.select("piece", "product", (F.col("_first") + 3 * skipped).alias("site"), (F.col("_k") + skipped + 1).cast("int").alias("codon_num"), (within - skipped).cast("int").alias("n"))
    return found.where(F.col("n") > 0)


def spliced_codons(products: DataFrame) -> DataFrame:
    """product, codon_num, sites (three) of the codons that a splice cuts."""
    ends = F.col("c") + F.col("stop") - F.col("start") + 1
    first = F.floor((ends - 1) / 3) * 3
    rows = _segments(products).withColumns({"_ends": ends, "_first": first}).where((F.col("_ends") % 3 != 0) & (F.col("_first") >= F.col("c")) & F.col("one").isNotNull())

    def site(i):
        at = F.col("_first") + i
        later = F.when(F.col("two").isNotNull() & (at >= F.col("two.c")), F.col("two.start") + at - F.col("two.c")).otherwise(F.col("one.start") + at - F.col("one.c"))
        return F.when(at < F.col("_ends"), F.col("start") + at - F.col("c")).otherwise(later).cast("long")

    return rows.select("product", (F.col("_first") / 3 + 1).cast("int").alias("codon_num"), F.array(*[site(i) for i in range(3)]).alias("sites"))


def sent(df: DataFrame, bytes_a_row: Column) -> DataFrame:
    """``df``, broadcast where its own measure allows it."""
    return F.broadcast(df) if (df.agg(F.sum(bytes_a_row)).first()[0] or 0) <= BROADCAST_BYTES else df


def unbroken_codons(pieces: DataFrame, products: DataFrame, by: tuple[str, ...], piece: int | None = None) -> DataFrame:
    """``by``, product, codon_num, codon of the codons that no splice cuts. A product that reaches beyond its sequence is an error when they are read."""
    size = piece or PIECE
    stop = F.array_max(F.transform("segments", lambda s: s["stop"]))
    reach = products.select(F.max(stop).alias("stop"), F.max_by("product", stop).alias("name")).first()
    beyond = F.raise_error(F.lit(f"product beyond the end of a sequence: {reach['name']}")).cast("string")
    checked = pieces.withColumn("bases", F.when(F.col("length") >= (reach["stop"] or 0), F.col("bases")).otherwise(beyond))
    met = checked.join(sent(runs(products, size), F.coalesce(F.length("product"), F.lit(0)) + 48), "piece")
    offset = (F.col("site") - F.col("piece").cast("long") * size).cast("int")
    # A run is cut from its piece once. It has a codon at least, so that outer explosion adds no row; an inner one would make the codons twice.
    run = F.substring(F.col("bases").cast("binary"), offset, 3 * F.col("n")).cast("string")
    found = met.select(*by, "product", F.col("codon_num").alias("_first"), run.alias("_run")).select(*by, "product", "_first", F.posexplode_outer(codons("_run")).alias("_i", "codon"))
    return found.select(*by, "product", (F.col("_first") + F.col("_i")).alias("codon_num"), "codon")


def codon_rows(pieces: DataFrame, products: DataFrame, by: tuple[str, ...] = ("group", "sequence"), piece: int | None = None) -> DataFrame:
    """``by``, product, codon_num, codon: a row for each codon of each sequence, which ``by`` names, and product.

    Codons that a splice cuts are put together from the pieces that their bases lie in.
    """
    size, keys = piece or PIECE, list(by)
    whole = unbroken_codons(pieces, products, by, size)
    asked = spliced_codons(products).select("product", "codon_num", F.posexplode("sites").alias("_i", "site")).withColumn("piece", F.floor((F.col("site") - 1) / size).cast("int"))
    asked = sent(asked, F.coalesce(F.length("product"), F.lit(0)) + 48)
    letters = pieces.join(asked, "piece").select(*keys, "product", "codon_num", "_i", F.substring(F.col("bases"), (F.col("site") - F.col("piece").cast("long") * size).cast("int"), F.lit(1)).alias("nt"))
    base = lambda i: F.max(F.when(F.col("_i") == i, F.col("nt")))
    return whole.unionByName(letters.groupBy(*keys, "product", "codon_num").agg(F.concat(base(0), base(1), base(2)).alias("codon")))


def site_rows(pieces: DataFrame, by: tuple[str, ...] = ("group", "sequence"), piece: int | None = None) -> DataFrame:
    """``by``, site (from 1), nt of every base."""
    letters = pieces.select(*by, "piece", F.posexplode(F.split(own_bases(F.col("bases"), piece), "")).alias("_at", "nt")).where(F.col("nt") != "")
    return letters.select(*by, (F.col("piece").cast("long") * (piece or PIECE) + F.col("_at") + 1).alias("site"), "nt")
