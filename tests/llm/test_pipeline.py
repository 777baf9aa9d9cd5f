"""The pipeline on a small folder: each stage's decisions, and the whole against plain Python."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codonframe.llm import registry
from codonframe.llm.registry import THRESHOLD
from codonframe.llm.shared import in_fold, stored
from codonframe.llm.quality_model import score_quality
from codonframe.llm.toxicity import score_toxicity

from .fixtures import awkward, labels, prose
from .test_minhash import expected as groups
from .test_suffix_dedup import expected as passages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    shared = prose(77, 14)
    good = [(i, f"{prose(i, 60).capitalize()}. {shared if i % 9 == 0 else ''} {prose(500 + i, 20)}.", "en") for i in range(240)]
    bad = [(1000 + i, "BUY NOW!! " * 40 + prose(i, 5).upper(), "en") for i in range(120)]
    toxic = [(2000 + i, f"{prose(i + 3000, 40)} vexling {prose(i + 4000, 20)} zzgrub vexling.", "en") for i in range(120)]
    copies = [(3000 + i, good[i][1], "en") for i in range(20)]
    awkward(spark, good + bad + toxic + copies + [(None, None, None), (4000, "", None), (4001, None, "en")]).write.parquet(f"{d}/documents.parquet")
    labels(spark, [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(i, 1, 1) for i, *_ in toxic]).write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, folder))
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "quality":
            low = {r.doc_id for r in score_quality(docs, marks, ~in_fold("doc_id", 4, 2)).collect() if r.doc_id is not None and r.score < THRESHOLD}
            assert set(after) == set(before) - low and {1000 + i for i in range(120)} <= low and not low & set(range(240))
        if name == "toxicity":
            high = {r.doc_id for r in score_toxicity(docs, marks, ~in_fold("doc_id", 3, 1)).collect() if r.doc_id is not None and r.score >= THRESHOLD}
            assert set(after) == set(before) - high and {2000 + i for i in range(120)} <= high and not high & set(range(240))
        if name == "near_dedup":
            want = groups([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i in before if i is None or want[i] == i} and not set(after) & set(range(3000, 3020))
        if name == "suffix_dedup":
            want = passages([(i, r.text) for i, r in before.items()])
            assert set(after) == set(before)
            for i, r in after.items():
                if i is not None and want[i][1]:
                    assert len(r.text.encode()) == want[i][0] - want[i][1] and r.n_chars == len(r.text)
        docs = out
    packed = corpus_pipeline.packing(spark, docs, folder).collect()
    assert sorted(r.doc_id or -1 for r in packed) == sorted(r.doc_id or -1 for r in docs.collect())
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "suffix_dedup", "packing"]
    names = set(entry.queries())
    assert "pipeline" in names and set(registry.queries()) <= names
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}
