"""Small tables with every awkward case."""

import random

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ironwood juniper katsura larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices(WORDS, k=2)) for _ in range(n))


def awkward(spark, rows, extra=True):
    """documents of (doc_id, text, lang) with columns whose names clash with those the operators use."""
    data = [(i, t, lang, "src0", None if t is None else len(t), "x", 1.5, 7) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        return spark.createDataFrame(data, schema + ", score string, n double, bucket int")
    return spark.createDataFrame([r[:5] for r in data], schema)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
