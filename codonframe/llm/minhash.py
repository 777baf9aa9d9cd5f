"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles, each weighing 1 and the
logarithm of how often it occurs, so that a line repeated hundreds of times does
not stand for the whole text; a text of fewer words is one shingle. Every shingle sends arrivals
of a Poisson process, its weight the rate, to random registers; a register keeps
the shingle that came first. Shingles stop once their next arrival is later than
every register's first. Two registers agree with the probability that is the
probability Jaccard similarity of the two sets, which is the Jaccard similarity
where no shingle repeats.

Texts of equal words are one class from the start. Classes that agree in a band
of registers are candidates. In each band the class that meets most others is
held against all the rest, and links are exact: the similarity is computed from
both texts. Components are then found, and only bands that still hold several go
on. What two rounds leave is compared pair by pair. After the first round, bounds
rule pairs out without comparing texts: the shingles that no other open text has,
and the distances to a common class (one less the similarity is a metric). So a
large group costs a few comparisons for each member, and no link between
candidates is lost. A pair of similarity 0.8 is no candidate once in 20,000 times.

Null texts and texts without a word never link. Rows with a null id form no
group: their component is null and they are kept. Rows that share an id are one
document, which has the links of all its texts. Ids are whole numbers; of
several equal texts, and of several in a band that meet equally many, the one with
the least id stands for the others. Texts of any length are compared whole. An
empty table gives an empty table. Columns beyond id and text are not read,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored, whole_ids
from .suffix_dedup import mixed

SHINGLE = 5


@dataclass(frozen=True)
class ProbMinHash:
    bands: int = 25
    rows: int = 5
    similarity: float = 0.8
    star_rounds: int = 2


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash for each word of a text's bytes."""
    global _powers
    inside = ~_space[data]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(begins):
        return np.empty(0, np.uint64)
    data, inside, begins = data[begins[0] :], inside[begins[0] :], begins - begins[0]
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    if len(_powers) <= int(place.max()):
        steps = np.full(max(2 * int(place.max()), 1 << 12), ODD[0], np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return mixed(np.add.reduceat(np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * _powers[place], np.uint64(0)), begins))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a sequence of word hashes, and their weights: 1 and the logarithm of how often each occurs."""
    n = len(words) - SHINGLE + 1
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0)
    if n < 1:
        n, total = 1, np.array([np.bitwise_xor.reduce(mixed(words * ODD[1] + np.arange(1, len(words) + 1, dtype=np.uint64)))])
    else:
        total = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            total = mixed(total * ODD[2] + words[j : j + n])
    keys, times = np.unique(total, return_counts=True)
    return keys, 1 + np.log(times)


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """The element each of ``m`` registers keeps."""
    first, kept = np.full(m, np.inf), np.zeros(m, np.uint64)
    time, active, step = np.zeros(len(elements)), np.arange(len(elements)), 0
    while len(active):
        # As many arrivals as will probably reach the last register's first, or fill the registers.
        last = first.max()
        wanted = ((last - time[active]) * weights[active]).max() + 2 if np.isfinite(last) else 3 * m / len(active)
        block = max(int(min(wanted, 60_000 / len(active))), 1)
        draw = mixed(elements[active][:, None] + np.arange(step + 1, step + block + 1, dtype=np.uint64) * ODD[0])
        wait = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[active][:, None]
        at = time[active][:, None] + np.cumsum(wait, axis=1)
        register = (mixed(draw ^ ODD[3]) % np.uint64(m)).astype(np.int64)
        row, column = np.nonzero(at < first[register])
        t, r = at[row, column], register[row, column]
        order = np.argsort(-t, kind="stable")
        best = np.full(m, -1)
        best[r[order]] = order  # the earliest is written last
        hit = np.flatnonzero(best >= 0)
        first[hit], kept[hit] = t[best[hit]], elements[active[row[best[hit]]]]
        time[active] = at[:, -1]
        active, step = active[at[:, -1] < first.max()], step + block
    return kept


def probability_jaccard(x: dict, y: dict) -> float:
    """Probability Jaccard similarity of two weighted sets."""
    both = list(x.keys() | y.keys())
    if not both:
        return 0.0
    a = np.array([x.get(k, 0) for k in both], float)
    b = np.array([y.get(k, 0) for k in both], float)
    ratio = np.divide(a, b, out=np.full(len(a), np.inf), where=b > 0)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    at = np.searchsorted(ratio, ratio, side="left")
    above = np.concatenate([np.cumsum(a[::-1])[::-1], [0]])[at]
    below = np.concatenate([[0], np.cumsum(b)])[at]
    shared = (a > 0) & (b > 0)
    return float((1 / (above[shared] / a[shared] + below[shared] / b[shared])).sum())


def _words(text: str | None) -> np.ndarray:
    return word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))


def signatures(docs: DataFrame, options: ProbMinHash, id_col: str, text_col: str) -> DataFrame:
    """doc_id, one and two (the text's words as two hashes), bands, n, heavy; of texts with words.

    n distinct shingles; heavy is the share of their weight that lies on those which occur more than once.
    """
    m = options.bands * options.rows

    def sign(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1)):
                words = _words(text.as_py())
                if not len(words):
                    continue
                place = np.arange(1, len(words) + 1, dtype=np.uint64)
                one, two = (np.bitwise_xor.reduce(mixed(words * ODD[k] + place * ODD[k - 1])) for k in (2, 4))
                keys, weights = shingles(words)
                kept = signature(keys, weights, m).reshape(options.bands, options.rows)
                band = np.arange(1, options.bands + 1, dtype=np.uint64)
                for j in range(options.rows):
                    band = mixed(band * ODD[1] + kept[:, j])
                out.append((i, one.view(np.int64), two.view(np.int64), band.view(np.int64), len(keys), float(weights[weights > 1].sum() / weights.sum())))
            if out:
                flat = pa.array(np.concatenate([x[3] for x in out]))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * options.bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out])), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), bands, pa.array([x[4] for x in out], pa.int64()), pa.array([x[5] for x in out], pa.float64())], ["doc_id", "one", "two", "bands", "n", "heavy"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(sign, "doc_id long, one long, two long, bands array<long>, n long, heavy double")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and their exact similarity, from (class_id, text)."""
    side = lambda key, name: texts.select(F.col("class_id").alias(key), F.col("text").alias(name))
    rows = pairs.hint("merge").join(side("a", "_one"), "a").hint("merge").join(side("b", "_two"), "b").select("a", "b", "_one", "_two")

    def compare(batches):
        def weighted(text):
            return dict(zip(*(x.tolist() for x in shingles(_words(text)))))

        held = (None, None)
        for batch in batches:
            found = []
            for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held[0] != one:
                    held = (one, weighted(one))
                found.append(probability_jaccard(held[1], weighted(two)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return rows.mapInArrow(compare, "a long, b long, similarity double")


def lone_shingles(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """class_id, lone: how many of a text's shingles are in no other of the texts with these ids; none left out that has one."""

    def cut(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = [shingles(_words(t))[0] for t in batch.column(1)[begin : begin + 500].to_pylist()]
                owner = batch.column(0)[begin : begin + 500].to_numpy(zero_copy_only=False).repeat([len(k) for k in part])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(part).view(np.int64))], ["class_id", "shingle"])

    rows = texts.join(ids.hint("merge"), "class_id").select("class_id", "text").mapInArrow(cut, "class_id long, shingle long")
    return rows.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("class_id").alias("class_id")).where(F.col("_n") == 1).groupBy("class_id").agg(F.count("*").alias("lone"))


def _pairs(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _able(x, y, least: float):
    """False where the counts of two texts rule out a similarity of ``least``.

    Of n + n' distinct shingles o are shared at most, so single ones add o / (n + n' - o) at most, and repeated ones their share of the weight.
    """
    most = F.least(x[0] - x[1], y[0] - y[1])
    return most / (x[0] + y[0] - most) + x[2] + y[2] >= least


def near_duplicates(docs: DataFrame, options: ProbMinHash = ProbMinHash(), id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, class_id, component_id and kept of every row; kept is the smallest id of each component.

    class_id is the smallest id with the same words, component_id the smallest that links reach.
    """
    whole_ids(docs, id_col)
    signed = stored(signatures(docs, options, id_col, text_col))
    classes = stored(signed.groupBy("one", "two").agg(F.min("doc_id").alias("class_id"), *[F.first(c).alias(c) for c in ("bands", "n", "heavy")]))
    bands = stored(classes.select("class_id", F.explode("bands").alias("band")))
    shared = stored(bands.groupBy("band").agg(F.count("*").alias("_n")).where(F.col("_n") > 1))
    bands = stored(bands.join(shared, "band"))
    score = stored(bands.groupBy("class_id").agg(F.sum("_n").alias("met")))
    open_ = bands.select("band", "class_id").join(score, "class_id").withColumn("component", F.col("class_id")).withColumn("used", F.lit(False)).withColumn("far", F.lit(None).cast("double"))
    # The texts of all classes that share a band, fetched once.
    wanted = score.select("class_id").hint("merge")
    texts = stored(docs.select(F.col(id_col).cast("long").alias("class_id"), F.col(text_col).alias("text")).join(wanted, "class_id", "left_semi"))
    tested = links = labels = None
    least = options.similarity - 1e-9
    for round_ in range(options.star_rounds + 1):
        open_ = stored(open_)
        spans = open_.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max(F.when(~F.col("used"), F.struct("met", F.negate("class_id").alias("no"), "component"))).alias("_hub"))
        spans = stored(spans.where((F.col("_lo") < F.col("_hi")) & F.col("_hub").isNotNull()).select("band", (-F.col("_hub.no")).alias("hub"), F.col("_hub.component").alias("hub_component")))
        if spans.isEmpty():
            break
        open_ = stored(open_.join(spans, "band"))
        if round_ == 1 or round_ == options.star_rounds == 0:
            # Shingles that no other open text has cannot be shared. A text of which they leave too little links with
            # nothing, and is not open any more; so once again.
            for _ in range(2):
                lone = stored(lone_shingles(open_.select("class_id").distinct(), texts))
                counts = classes.select("class_id", "n", "heavy").join(lone, "class_id", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
                counts = stored(counts.where((F.col("n") - F.col("lone")) / F.col("n") + F.col("heavy") >= least))
                open_ = stored(open_.drop("n", "lone", "heavy").join(counts, "class_id"))
        if round_ < options.star_rounds:
            candidates = open_.where(F.col("component") != F.col("hub_component"))
            if round_:
                hubs = counts.select(F.col("class_id").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("n", "lone", "heavy")])
                candidates = candidates.join(hubs, "hub").where(_able(*[[F.col(k + c) for c in ("n", "lone", "heavy")] for k in ("", "hub_")], least))
            pairs = candidates.select(*_pairs("class_id", "hub")).distinct()
        else:
            held = open_.join(classes.select("class_id", "bands"), "class_id")
            x, y = (held.select("band", *[F.col(c).alias(f"{k}_{c}") for c in ("class_id", "component", "far", "n", "lone", "heavy", "bands")]) for k in "xy")
            once = F.col("band") == F.array_min(F.array_intersect("x_bands", "y_bands"))  # of several bands that a pair shares
            apart = F.coalesce(F.abs(F.col("x_far") - F.col("y_far")) > 1 - least, F.lit(False))
            able = _able(*[[F.col(f"{k}_{c}") for c in ("n", "lone", "heavy")] for k in "xy"], least)
            pairs = x.join(y.withColumnRenamed("band", "y_band"), F.col("band") == F.col("y_band")).where((F.col("x_class_id") < F.col("y_class_id")) & (F.col("x_component") != F.col("y_component")) & ~apart & able & once).select(*_pairs("x_class_id", "y_class_id")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = stored(verified(stored(pairs), texts))
        tested = found if tested is None else stored(tested.unionByName(found))
        more = found.where(F.col("similarity") >= options.similarity).select("a", "b")
        links = more if links is None else links.unionByName(more)
        labels = stored(components(links))
        if round_ == 0:  # distances to the first hub of each band
            far = found.select("a", "b", (1 - F.col("similarity")).alias("_d"))
            keyed = open_.withColumns({"a": F.least("class_id", "hub"), "b": F.greatest("class_id", "hub")})
            open_ = keyed.join(far, ["a", "b"], "left").withColumn("far", F.when(F.col("class_id") == F.col("hub"), 0.0).otherwise(F.col("_d")))
        rest = ["n", "lone", "heavy"] if round_ else []
        open_ = open_.select("band", "class_id", "met", (F.col("used") | (F.col("class_id") == F.col("hub"))).alias("used"), "far", *rest)
        open_ = open_.join(labels, F.col("class_id") == F.col("node"), "left").select("band", "class_id", "met", "used", "far", *rest, F.coalesce("component", "class_id").alias("component"))
    member = signed.select("doc_id", "one", "two").join(classes.select("one", "two", "class_id"), ["one", "two"]).select("doc_id", "class_id")
    if labels is None:
        member = member.withColumn("component_id", F.col("class_id"))
    else:
        member = member.join(labels, F.col("class_id") == F.col("node"), "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    member = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    rows = docs.select(F.col(id_col).alias("doc_id")).join(member, "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
