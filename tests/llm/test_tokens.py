"""BPE against the library, packing against brute force, quality rules against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonframe.llm import bpe, packing, quality_rules
from codonframe.llm.registry import word_bpe_path

from .fixtures import awkward, prose

TEXTS = [None, "", " \n\t", "Hello, World's 42 it'll'S", "ΑΣ ΣΑΣ İstanbul ß ﬁ ｆｕｌｌ 日本語 😀👍🏽", "a<|endoftext|>b <|startoftext|><|endoftext|> <|EndOfText|>", "aaaaaaaa" * 50, "th" * 3000, "é \x85\xa0　x\x1cy\x00z​", prose(1, 3000)]


def test_bpe_matches_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    docs = awkward(spark, [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "x", None), (3, TEXTS[3], None)])
    found = bpe.encode_documents(docs, word_bpe_path(), with_ids=True).collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        text = (TEXTS[r.doc_id] or "") if r.doc_id is not None else "x"
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (list(r.ids), r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_every_character_is_encoded_as_by_the_library():
    """Code points between letters, before marks that may join, and doubled after a mark; several to a text, apart by a space."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    with open(word_bpe_path(), encoding="utf-8") as f:
        e = bpe.BacktrackingEncoder(f.read())
    # Two planes whole; of the others, whose characters are alike, every 61st and those around the ends of their blocks.
    ends = {e + k for e in (0x2A6E0, 0x2B740, 0x2B820, 0x2CEB0, 0x2EBF0, 0x2F800, 0x2FA20, 0x31350, 0x323B0, 0x3347A, 0xE0000, 0xE0200) for k in range(-3, 3)}
    every = [chr(c) for c in sorted({*range(0x20000), *range(0x20000, 0x110000, 61), *ends}) if not 0xD800 <= c < 0xE000]
    for form in ("a%sb1", "a%s\u0301\u0316x", "e\u0316%s\u0327%s"):
        for begin in range(0, len(every), 64):
            text = " ".join(form.replace("%s", c) for c in every[begin : begin + 64])
            assert e.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(every[begin]))


def test_backtracking_equals_merging():
    with open(word_bpe_path(), encoding="utf-8") as f:
        e = bpe.BacktrackingEncoder(f.read())
    rnd = random.Random(5)
    for _ in range(400):
        word = "".join(rnd.choices("thaneringos", k=rnd.randrange(1, 30)))
        marked = word[:-1] + chr(ord(word[-1]) + bpe.LAST)
        assert [e.text[i] for i in e.encode_word(word)] == e.merged(marked)


def test_bpe_no_documents(spark):
    assert bpe.encode_documents(awkward(spark, []), word_bpe_path()).count() == 0


def test_boundaries_are_optimal():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = sorted(rnd.sample(range(0, 60), rnd.randrange(1, 9)))
        counts, k = [rnd.randrange(1, 9) for _ in sizes], rnd.randrange(1, 5)
        cost = lambda ends: sum(c * (min(e for e in ends if e >= s) - s) for s, c in zip(sizes, counts))
        best = min(cost([*cut, sizes[-1]]) for r in range(k) for cut in itertools.combinations(sizes[:-1], min(r, len(sizes) - 1)))
        found = packing.boundaries(sizes, counts, [s * c for s, c in zip(sizes, counts)], k)
        assert cost(found) == best and len(found) <= k and found == sorted(found)


def test_packing_places_every_document_once(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([0, 3, 3, 3, 17, 40, 300, 1000]), None) for i in range(400)] + [(500, None, None), (None, "a b", None), (7, "a b", None)]
    rows += [(None, "a b", None)] * 9 + [(8, None, None)] * 7
    options = packing.Packing(buckets=4, token_budget=600, piece=3)
    found = packing.pack(awkward(spark, rows), options).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    batches = {}
    for r in found:
        assert r.n_tokens <= r.bucket_length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert len({r.bucket for r in found}) <= 4
    # The whole result has the least padding that four buckets allow, and places are the same on every run.
    sizes = Counter(r.n_tokens for r in found)
    cost = lambda ends: sum(c * (min(e for e in ends if e >= s) - s) for s, c in sizes.items())
    best = min(cost([*cut, max(sizes)]) for cut in itertools.combinations(sorted(sizes)[:-1], 3))
    assert sum(r.bucket_length - r.n_tokens for r in found) == best and {r.bucket_length for r in found} <= set(sizes)
    again = packing.pack(awkward(spark, rows).repartition(7), options).collect()
    assert Counter(again) == Counter(found)
    for held in batches.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert len(held) == 1 or len(held) * held[0].bucket_length <= 600
    for bucket in {b for b, _ in batches}:
        full = sorted(n for b, n in batches if b == bucket)
        assert full == list(range(len(full)))
        sizes = [len(batches[bucket, n]) for n in full]
        assert len(set(sizes[:-1])) <= 1  # only a bucket's last batch is not full
    assert packing.pack(awkward(spark, [])).count() == 0


def test_lengths_are_rounded_up_by_little(spark):
    rows = spark.range(1, 100_000, 7).select("id", packing.rounded(F.col("id")).alias("b")).collect()
    assert all(r.id <= r.b <= r.id * 1.004 + 1e-9 for r in rows) and all(r.b == r.id for r in rows if r.id < 512)


def rules(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text or ""), (text or "").split("\n")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), base


def test_rules_match_plain_python(spark):
    texts = [None, "", "a b c", "same line\nsame line\n \n \nother", "x y z " * 40, "#* $5 | <b>\n" * 30, prose(1, 60), prose(2, 60) + "\n" + prose(2, 60), "\xa0é 日本\x0bfoo\x85bar " * 3, prose(3, 9000), "a b " * 3 + prose(4, 80)]
    docs = awkward(spark, [(i, t, None if i % 2 else "en") for i, t in enumerate(texts)] + [(None, "q", "fr")])
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(found) == len(texts) + 1
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(t)
        assert not (r.base_failed and r.kept)


def test_rules_reject_what_is_far_from_its_language(spark):
    rows = [(i, prose(i, 120), "en") for i in range(60)] + [(100, prose(1, 120).upper() + " 1234567" * 90, "en")]
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(awkward(spark, rows)).collect()}
    assert not found.pop(100) and all(found.values())
    assert quality_rules.quality_rules(awkward(spark, [])).count() == 0


def mixed(seed, n, share):
    """Invented words, of which a share are common English ones."""
    rnd = random.Random(seed)
    common = quality_rules.COMMON["en"].split()
    return " ".join(rnd.choice(common) if rnd.random() < share else w for w in prose(seed, n).split())


def test_rules_reject_long_texts_without_common_words(spark):
    rows = [(i, mixed(i, 90 + i, 0.25), "en") for i in range(300)] + [(1000 + i, prose(i, 100 + 20 * i), "en") for i in range(20)]
    # Two fifths and more of a language may be copies of one text: its prose is still kept.
    rows += [(2000 + i, mixed(7, 300, 0.25), "fr") for i in range(120)] + [(3000 + i, mixed(i, 200, 0.25), "fr") for i in range(60)] + [(4000, prose(5, 400), "fr")]
    # Too few for a spread.
    rows += [(5000 + i, mixed(i, 200, 0.25), "xx") for i in range(3)] + [(5100, prose(1, 60), "en")]
    found = {r.doc_id: r for r in quality_rules.quality_rules(awkward(spark, rows)).collect()}
    assert len(found) == len(rows) and found[5100].kept and found[5100].word_distance is None
    bare = {*range(1000, 1020), 4000}
    assert {i for i, r in found.items() if not r.kept} == bare
    assert all(found[i].word_distance < 0.55 and not found[i].base_failed for i in bare)


def test_rules_are_native(spark):
    plan = quality_rules.quality_rules(awkward(spark, [(1, "a", "en")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
