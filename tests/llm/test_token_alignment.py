"""Alignment of tokens against plain union-find over every pair of tokens, and counts by hand."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from codonframe.llm import token_alignment as al
from codonframe.llm.registry import tokenizer_path

from .fixtures import awkward, prose

TEXTS = [None, "", " ", "a", "Hello, World's 42", " two  spaces", "tab\tand\nlines\r\n", "日本語 😀👍🏽 İstanbul ﬁ", "a<|endoftext|>b <s> </s> <unk> <0x41>", "▁ and ▁", "nul\x00 bell\x07", "é é \xa0 　", "x" * 500, prose(3, 4000), "Hello, World's 42"]


def plain(text):
    """A and B ids, groups by union-find over every overlapping pair, links."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    if not text:
        return [], [], [], []
    whole = " " + text
    encoded = a.encode(whole, add_special_tokens=False)
    table = dict(zip(al.byte_alphabet(), range(256)))
    pieces_a = [bytes(table[c] for c in t) for t in encoded.tokens]
    ids_b = b.encode(text)
    pieces_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(pieces_a) == b"".join(pieces_b) == whole.encode():
        return [], [], [], []

    def ranges(pieces):
        at = 0
        for p in pieces:
            yield at, at + len(p)
            at += len(p)

    ra, rb = list(ranges(pieces_a)), list(ranges(pieces_b))
    parent = list(range(len(ra) + len(rb)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, low = [], 0
    for i, (s, e) in enumerate(ra):
        while rb[low][1] <= s:
            low += 1
        j = low
        while j < len(rb) and rb[j][0] < e:
            links.append((i, j))
            parent[find(len(ra) + j)] = find(i)
            j += 1
    groups = defaultdict(lambda: ([], []))
    for i in range(len(ra)):
        groups[find(i)][0].append(i)
    for j in range(len(rb)):
        groups[find(len(ra) + j)][1].append(j)
    return encoded.ids, ids_b, sorted(groups.values()), links


def expected(rows):
    made = [plain(t) for _, t, _ in rows]
    count = Counter(p for a, b, _, links in made for p in {(a[i], b[j]) for i, j in links})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _, _), (a, b, groups, links) in zip(rows, made):
        pairs = [(a[i], b[j]) for i, j in links]
        said = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [al.SHARD, 300])
def test_alignment_is_that_of_plain_union_find(spark, shard, monkeypatch):
    monkeypatch.setattr(al, "PIECE", 2000)
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(None, "null id", None), (3, "same id", None)]
    found = al.align_documents(awkward(spark, rows), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), shard=shard).collect()
    assert sorted(map(tuple, found), key=repr) == expected(rows)
    assert any(r.n_a for r in found) and sum(r.n_groups == 0 for r in found) >= 3


def test_no_documents_and_no_tokens(spark):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert al.align_documents(awkward(spark, []), *paths).collect() == []
    assert [tuple(r) for r in al.align_documents(awkward(spark, [(1, None, None)]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.fixture(scope="module")
def vocab():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        return al.Vocabularies(f.read(), g.read())


def test_ids_by_ranks_are_those_of_the_library(vocab):
    def library(texts):
        return [e.ids for e in vocab.a.encode_batch(texts, add_special_tokens=False)]

    tokens = [t for b in vocab.a_bytes if (t := b.decode(errors="ignore")) and t.encode() == b]
    draw = random.Random(5)
    alphabets = ["a=- \n中é\u0301\U0001f600 \t\x1c\x85", "abcdefghijklmnopqrstuvwxyz '", "=-_*#.", "  \n\t\r", "0123456789٣Ⅷ ,.", "éèàüñçаеиотн ", "中国的一是不"]
    runs = ["".join(draw.choice(draw.choice(alphabets)) * draw.choice([1, 1, 2, 3, 40]) for _ in range(draw.randrange(1, 60))) for _ in range(3000)]
    points = [f"{x}{chr(c)}{x}" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000 for x in ("a", "1", " ")]
    long = [" " * 300_000 + "x", "a" + "\n" * 300_000, "ab" * 100_000]
    texts = [*tokens, *runs, *points, *long, *(t for t in TEXTS if t)]
    assert vocab.ranks is not None and [vocab.encode_a(t) for t in texts] == library(texts)


def test_other_vocabularies_are_encoded_by_their_own_library(vocab):
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}, {"model": {**spec["model"], "ignore_merges": True}}):
        assert al.by_ranks(json.dumps({**spec, **change})) is None


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_components_of_arrays(links):
    u, v = (np.array([x[i] for x in links], dtype=np.int64) for i in (0, 1))
    root = list(range(31))
    for _ in range(31):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert al.components(31, u, v).tolist() == root
