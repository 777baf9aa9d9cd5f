"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is turned by several random rotations; the signs are its code, and
for each rotation a correction factor is stored: the inner product of the vector
and its quantised form. The quantised form's product with another vector,
divided by the factor, estimates the two vectors' product without bias, and the
factor bounds the error. Pairs whose upper confidence bound stays below what a
link needs are dropped; all others are computed again in double precision, so no
link rests on an estimate. The first 128 signs already speak while candidates
meet: the angle of two vectors is the share in which they differ, and pairs in
which more differ than the bound allows never leave the join.

Candidates agree in a band of code bits; band width follows the logarithm of the
number of vectors and the number of bands is such that a pair at the threshold
is missed at most once in ``1 / miss``.

Tight groups are never compared pair by pair. Vectors within half the linking
angle of a bucket's hub form its ball: all of them link. Two balls link as a whole, or not at
all, where the angle of their hubs and their radii say so, and so do a vector and a
ball; only what these bounds leave open is computed for each pair.

Vectors that are null, zero, or hold null or non-finite components link with
nothing and are kept. Shorter vectors are filled with zeros. Rows with a null id
link with nothing, either; rows that share an id are one vector, the least of them.
Of several vectors in a bucket, and of several hubs a vector could join, the
least id is taken. Vectors of any length are taken whole. An empty table gives
an empty table. Columns beyond id and vector are not read, whatever their names.

With n vectors the bands, and so the rows of a vector, grow as n to the power
0.22, which is what codes of signs cost at a cosine of 0.9.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored


@dataclass(frozen=True)
class BinaryCodes:
    """``sigmas`` is the width of the confidence bound; ``ball_bands`` bands look for hubs."""

    cosine: float = 0.9
    miss: float = 0.01
    sigmas: float = 5.0
    ball_bands: int = 8
    seed: int = 7


EPS = 1e-7
#: Signs of a sketch, as two whole numbers.
SKETCH = 128


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """(dim, n * dim): ``n`` random orthogonal matrices side by side."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        found.append(q * np.sign(np.diag(r)))
    return np.hstack(found)


def shape_of(n: int, options: BinaryCodes) -> tuple[int, int]:
    """Bits in a band, and bands."""
    bits = min(max(math.ceil(math.log2(max(n, 2))), 8), 62)
    agree = (1 - math.acos(options.cosine) / math.pi) ** bits
    return bits, max(math.ceil(math.log(options.miss) / math.log1p(-agree)), options.ball_bands)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, and each rotation's correction factor."""
    turned = x @ turn
    signs = turned > 0
    dim = x.shape[1]
    factors = np.abs(turned).reshape(len(x), -1, dim).sum(axis=2) / math.sqrt(dim)
    return signs, factors


def estimate(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded vectors with rotated ones, and their standard error."""
    n, rounds = factors.shape
    dim = signs.shape[1] // rounds
    product = np.where(signs, turned, -turned).reshape(n, rounds, dim).sum(axis=2) / math.sqrt(dim)
    error = np.sqrt(np.maximum(1 / factors**2 - 1, 0) / max(dim - 1, 1))
    return (product / factors).mean(axis=1), np.sqrt((error**2).sum(axis=1)) / rounds


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """vec_id and the unit vector of each row that can link; and the dimension."""
    v = F.col("vec")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    top = F.array_max(F.transform(v, F.abs))  # scaled first: squares neither overflow nor vanish
    rows = rows.where(top > 0).select("vec_id", F.transform(v, lambda x: x / top).alias("vec"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(rows.select("vec_id", F.transform(v, lambda x: x / norm).alias("vec")))
    dim = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    if dim:
        rows = rows.select("vec_id", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))).alias("vec"))
    return rows, dim


def coded(rows: DataFrame, dim: int, bits: int, bands: int, seed: int) -> DataFrame:
    """vec_id, vec, signs (packed), factors, keys (one for each band), sketch (the first signs, in two numbers)."""
    count = -(-bits * bands // dim)

    def code(batches):
        turn = rotations(dim, count, seed)
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs, factors = encode(_matrix(batch.column(1), dim), turn)
            keys = signs[:, : bits * bands].reshape(len(signs), bands, bits) @ weight
            rows = len(signs)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            packed = np.packbits(signs, axis=1)
            first = np.zeros((rows, SKETCH), bool)
            first[:, : min(SKETCH, signs.shape[1])] = signs[:, :SKETCH]
            sketch = np.packbits(first, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), lists(factors), lists(keys), lists(sketch)], ["vec_id", "vec", "signs", "factors", "keys", "sketch"])

    key = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(code, f"vec_id {key}, vec array<double>, signs binary, factors array<double>, keys array<long>, sketch array<long>")


def cosines(pairs: DataFrame, dim: int) -> DataFrame:
    """``pairs`` with cosine in place of the unit vectors u and v, in double precision."""
    names = [c for c in pairs.columns if c not in ("u", "v")]

    def compute(batches):
        for batch in batches:
            u, v = (_matrix(batch.column(c), dim) for c in ("u", "v"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.einsum("ij,ij->i", u, v))], [*names, "cosine"])

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)
    return pairs.select(*names, "u", "v").mapInArrow(compute, schema + ", cosine double")


def likely(pairs: DataFrame, dim: int, rounds: int, options: BinaryCodes) -> DataFrame:
    """Rows of (a, b, reach, signs, factors, v) whose estimate, and its bound, allow a cosine of at least ``reach``."""

    def test(batches):
        turn = rotations(dim, rounds, options.seed)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                packed = np.frombuffer(b"".join(part.column("signs").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                signs = np.unpackbits(packed, axis=1)[:, : rounds * dim].astype(bool)
                found, error = estimate(signs, _matrix(part.column("factors"), rounds), _matrix(part.column("v"), dim) @ turn)
                keep = pa.array(found + options.sigmas * error >= part.column("reach").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    key = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "reach", "signs", "factors", "v").mapInArrow(test, f"a {key}, b {key}")


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))


def near_duplicates(vectors: DataFrame, options: BinaryCodes = BinaryCodes(), id_col="vec_id", vec_col="embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    plain, dim = unit_vectors(vectors, id_col, vec_col)
    everything = vectors.select(F.col(id_col).alias("vec_id"))
    if not dim:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    limit = math.acos(options.cosine)
    bits, bands = shape_of(plain.count(), options)
    rounds = -(-bits * bands // dim)
    rows = stored(coded(plain, dim, bits, bands, options.seed))
    unit = rows.select("vec_id", "vec")
    entries = stored(rows.select("vec_id", F.posexplode("keys").alias("band", "key")))

    # Balls: each vector joins the least hub within half the linking angle that it meets in one of the first bands.
    early = entries.where(F.col("band") < options.ball_bands)
    hubs = stored(early.groupBy("band", "key").agg(F.min("vec_id").alias("hub"), F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n"))
    stars = early.join(hubs, ["band", "key"]).where(F.col("vec_id") != F.col("hub")).select("vec_id", "hub").distinct()
    stars = stars.join(unit.withColumnRenamed("vec", "u"), "vec_id").join(unit.select(F.col("vec_id").alias("hub"), F.col("vec").alias("v")), "hub")
    inside = cosines(stars, dim).select("vec_id", "hub", _angle(F.col("cosine")).alias("angle")).where(F.col("angle") <= limit / 2 - EPS)
    nearest = stored(inside.groupBy("vec_id").agg(F.min(F.struct("hub", "angle")).alias("_at")))
    # A hub stays the centre of its own ball, so that it belongs where its members are.
    centres = stored(nearest.select(F.col("_at.hub").alias("hub")).distinct())
    member = unit.select("vec_id").join(nearest, "vec_id", "left").join(centres, F.col("vec_id") == F.col("hub"), "left")
    own = F.col("hub").isNotNull() | F.col("_at").isNull()
    member = stored(member.select("vec_id", F.when(own, F.col("vec_id")).otherwise(F.col("_at.hub")).alias("ball"), F.when(own, 0.0).otherwise(F.col("_at.angle")).alias("angle")))
    balls = stored(member.groupBy("ball").agg(F.count("*").alias("size"), F.max("angle").alias("radius")))

    # Pairs of balls that share a bucket, each once; those that the codes allow; then the hubs' exact angle.
    boxes = stored(entries.join(member.select("vec_id", "ball"), "vec_id").select("band", "key", "ball").distinct())
    shared = stored(boxes.groupBy("band", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n"))
    centre = rows.select(F.col("vec_id").alias("ball"), *[F.col("sketch")[i].alias(f"sketch{i}") for i in (0, 1)])
    boxes = stored(boxes.join(shared, ["band", "key"]).join(stored(balls.join(centre, "ball")), "ball"))
    side = lambda k: boxes.select("band", "key", F.col("ball").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("size", "radius", "sketch0", "sketch1")])
    furthest = F.least(F.lit(limit + EPS) + F.col("radius_a") + F.col("radius_b"), F.lit(math.pi))
    differ = F.bit_count(F.col("sketch0_a").bitwiseXOR(F.col("sketch0_b"))) + F.bit_count(F.col("sketch1_a").bitwiseXOR(F.col("sketch1_b")))
    used, share = min(SKETCH, rounds * dim), furthest / math.pi
    able = differ <= used * share + options.sigmas * F.sqrt(used * share * (1 - share)) + 1
    met = side("a").join(side("b"), ["band", "key"]).where((F.col("a") < F.col("b")) & able)
    met = stored(met.select("a", "b", "size_a", "radius_a", "size_b", "radius_b").distinct())
    reach = F.cos(furthest)
    known = met.withColumn("reach", reach).join(rows.select(F.col("vec_id").alias("a"), "signs", "factors"), "a").join(unit.select(F.col("vec_id").alias("b"), F.col("vec").alias("v")), "b")
    close = stored(likely(known, dim, rounds, options)).join(met, ["a", "b"])
    close = close.join(unit.select(F.col("vec_id").alias("a"), F.col("vec").alias("u")), "a").join(unit.select(F.col("vec_id").alias("b"), F.col("vec").alias("v")), "b")
    close = stored(cosines(close, dim).withColumn("apart", _angle(F.col("cosine"))).where(F.col("apart") <= limit + EPS + F.col("radius_a") + F.col("radius_b")))
    sure = F.col("apart") + F.col("radius_a") + F.col("radius_b") <= limit - EPS
    whole = close.where(sure)

    # A vector against a ball, then pairs.
    single = close.where(~sure).join(member.select(F.col("ball").alias("a"), F.col("vec_id").alias("x")), "a")
    single = single.select("a", "b", "size_b", "radius_b", "x").join(unit.select(F.col("vec_id").alias("x"), F.col("vec").alias("u")), "x").join(unit.select(F.col("vec_id").alias("b"), F.col("vec").alias("v")), "b")
    single = stored(cosines(single, dim).withColumn("apart", _angle(F.col("cosine"))))
    one_sure = F.col("apart") + F.col("radius_b") <= limit - EPS
    one_whole = single.where(one_sure)
    pair = single.where(~one_sure & (F.col("apart") - F.col("radius_b") <= limit + EPS)).select("a", "b", "x")
    pair = pair.join(member.select(F.col("ball").alias("b"), F.col("vec_id").alias("y")), "b")
    pair = pair.join(unit.select(F.col("vec_id").alias("x"), F.col("vec").alias("u")), "x").join(unit.select(F.col("vec_id").alias("y"), F.col("vec").alias("v")), "y")
    pair = stored(cosines(pair, dim).where(F.col("cosine") >= options.cosine))

    add = lambda df, key, n: df.select(F.col(key).alias("k"), n.cast("long").alias("n"))
    to_ball = [add(balls, "ball", F.col("size") - 1), add(whole, "a", F.col("size_b")), add(whole, "b", F.col("size_a")), add(one_whole, "b", F.lit(1))]
    to_vector = [add(one_whole, "x", F.col("size_b")), add(pair, "x", F.lit(1)), add(pair, "y", F.lit(1))]
    total = lambda parts, name, key: stored(reduce(DataFrame.unionByName, parts).groupBy(F.col("k").alias(key)).agg(F.sum("n").alias(name)))
    links = reduce(DataFrame.unionByName, [x.select("a", "b") for x in (whole, one_whole, pair)])
    labels = stored(components(stored(links)))
    found = member.join(total(to_ball, "_of_ball", "ball"), "ball", "left").join(total(to_vector, "_own", "vec_id"), "vec_id", "left").join(labels, F.col("ball") == F.col("node"), "left")
    found = stored(found.select("vec_id", (F.coalesce("_of_ball", F.lit(0)) + F.coalesce("_own", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "ball").alias("_component")))
    least = stored(found.groupBy("_component").agg(F.min("vec_id").alias("component_id")))
    found = found.join(least, "_component").select("vec_id", "n_links", "component_id")
    out = everything.join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
