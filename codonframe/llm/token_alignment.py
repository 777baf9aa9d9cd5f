"""Alignment of two tokenizers' tokens, and how often their tokens meet.

Both tokenizers cut the same bytes, a space and the text. Tokens that share bytes
are linked; a text's tokens and links are a bipartite graph, and its connected
components, found by union-find, are exactly the smallest groups of tokens that
both tokenizers cut alike. Links never leave a component, so each component's
members are all that its links are made of.

A pair of ids counts once for each document that links it. Pairs leave a
document once with the number of their links, the counts are one grouped sum,
and they come back to the documents in shards of a fixed number of pairs: the
number of shards follows the pairs, of which there are at most as many as the
two vocabularies make, and each shard is one pass over the stored links.

Null and empty texts have no tokens and zeros; neither have texts that one of the
tokenizers does not give back byte for byte (white space that it folds, signs
that it replaces). Texts of any length are encoded whole. Rows that share an id,
or have a null one, are documents of their own. Of several ids linked equally
often with an id all are its best. An empty table gives an empty table. Columns
beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .shared import stored

#: Pairs that are sent to the tasks together, and bytes of text that are aligned together.
SHARD, PIECE = 2_000_000, 1 << 21
#: White space that the encoder by ranks is not given.
LONG_SPACE = 4096
_long_space = re.compile(r"\s{%d}" % LONG_SPACE)

# Fixed value: the pattern by which byte-level vocabularies cut texts before merging.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_ranks(byte_bpe: str):
    """An encoder that merges by rank, or None unless the vocabulary is byte-level and its ids are the 256 bytes and then the merges in order."""
    import tiktoken

    spec = json.loads(byte_bpe)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    code, vocab = {c: i for i, c in enumerate(byte_alphabet())}, model["vocab"]
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if any(vocab.get(c, 256) >= 256 for c in code) or any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    ranks = {bytes(code[c] for c in t): vocab[t] for t in (*code, *merged)}
    return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Vocabularies:
    """Both tokenizers, each token's bytes, and each id as text with the sign that may follow it."""

    def __init__(self, byte_bpe: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.ranks = by_ranks(byte_bpe)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        code = {c: i for i, c in enumerate(byte_alphabet())}
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(code[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.b_at, self.b_blob = np.cumsum(self.b_size) - self.b_size, np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.n = max(len(self.a_bytes), len(self.b_bytes))
        self.text = [b"%d%b" % (i, end) for end in (b",", b"|", b";") for i in range(self.n)]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> list[int]:
        if self.ranks is None or _long_space.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both; none where a tokenizer does not give the bytes back.

        The first has a symbol for each byte, no normal form and a pattern that takes every character, so it
        loses nothing that the length would not show; the second's bytes are compared.
        """
        some = [t for t in texts if t]
        first = [self.encode_a(" " + t) for t in some]
        second = self.b.encode(some, num_threads=1) if some else []
        pairs = zip(first, second)
        none = np.zeros(0, np.int64)
        out = []
        for t in texts:
            a, b = (np.array(x, dtype=np.int64) for x in next(pairs)) if t else (none, none)
            whole = (" " + t).encode() if t else b""
            same = self.a_size[a].sum() == self.b_size[b].sum() == len(whole) and self.b_text(b) == whole
            out.append((a, b) if same else (none, none))
        return out

    def b_text(self, ids: np.ndarray) -> bytes:
        """The bytes of the second tokenizer's ids, cut from one table by offsets."""
        size = self.b_size[ids]
        return self.b_blob[np.repeat(self.b_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find on arrays: for each of ``n`` nodes the least node that links reach.

    A round hangs each root below the least root it has a link with, then every
    node is sent to its root by halving its way; links inside a component drop out.
    """
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens (place of A, place of B) that share bytes, from where tokens of the same bytes end."""
    begins = np.concatenate([[0], a_ends[:-1]]) if len(a_ends) else a_ends
    first, last = np.searchsorted(b_ends, begins, "right"), np.searchsorted(b_ends, a_ends, "left")
    times = np.maximum(last - first + 1, 0)
    u = np.repeat(np.arange(len(a_ends)), times)
    return u, np.arange(len(u)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)


def _aligned(vocab: Vocabularies, texts: list[str]) -> list[tuple]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256, its pairs (id of A times the vocabulary of B, plus id of B) and their links."""
    ids = vocab.encode(texts)
    sizes_a, sizes_b = (np.array([len(x[i]) for x in ids], dtype=np.int64) for i in (0, 1))
    a, b = (np.concatenate([x[i] for x in ids]) for i in (0, 1))
    u, v = overlaps(np.cumsum(vocab.a_size[a]), np.cumsum(vocab.b_size[b]))
    root = components(len(a) + len(b), u, v + len(a))
    # A component's least node is its first token of A, and components follow each other as their bytes do.
    heads = root[: len(a)] == np.arange(len(a))
    group_a = np.cumsum(heads) - 1
    group_b = group_a[root[len(a) :]]
    n_groups = int(heads.sum())
    to_a, to_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
    line = np.empty(len(a) + len(b), dtype=np.int64)
    before_b = np.concatenate([[0], to_b[:-1]]) if n_groups else to_b
    ends_a, ends_b = np.arange(len(a)) + 1 == to_a[group_a], np.arange(len(b)) + 1 == to_b[group_b]
    line[np.arange(len(a)) + before_b[group_a]] = a + vocab.n * ends_a
    line[np.arange(len(b)) + to_a[group_b]] = b + 2 * vocab.n * ends_b

    document = np.repeat(np.arange(len(ids)), sizes_a)
    groups, links = np.bincount(document, heads, len(ids)).astype(np.int64), np.bincount(document[u], minlength=len(ids))
    span = len(vocab.a_bytes) * len(vocab.b_bytes)
    keys, times = np.unique(document[u] * span + a[u] * len(vocab.b_bytes) + b[v], return_counts=True)
    edges = np.searchsorted(keys, np.arange(len(ids) + 1) * span)
    at = np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])
    out = []
    for i in range(len(ids)):
        said = b"".join(map(vocab.text.__getitem__, line[at[i] : at[i + 1]].tolist()))[:-1]
        part = slice(edges[i], edges[i + 1])
        out.append((int(sizes_a[i]), int(sizes_b[i]), int(groups[i]), int(links[i]), hashlib.sha256(said).hexdigest() if said else "", keys[part] - i * span, times[part].astype(np.int32)))
    return out


_known: dict[int, Vocabularies] = {}


def linked(docs: DataFrame, byte_bpe_path: str, piece_path: str, id_col="doc_id", text_col="text") -> tuple[DataFrame, int]:
    """row (its own for each document), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times; and the size of B's vocabulary.

    The vocabulary files (a few MB, whatever the corpus) go to the tasks as broadcasts.
    """
    context = docs.sparkSession.sparkContext
    with open(byte_bpe_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        held = context.broadcast((f.read(), g.read()))
    key = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    schema = f"row long, doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"

    def align(batches):
        if hash(held.value) not in _known:
            _known[hash(held.value)] = Vocabularies(*held.value)
        vocab, row = _known[hash(held.value)], TaskContext.get().partitionId() << 40

        def batch_of(ids, rows):
            nonlocal row
            numbers = np.arange(row, row + len(rows))
            row += len(rows)
            plain = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            edges = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([r[i] for r in rows]))) for i in (5, 6)]
            return pa.RecordBatch.from_arrays([pa.array(numbers), ids, *plain, pa.array([r[4] for r in rows]), *lists], names)

        for batch in batches:
            begin, size, texts = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= PIECE or i + 1 == batch.num_rows:
                    yield batch_of(batch.column(0).slice(begin, len(texts)), _aligned(vocab, texts))
                    begin, size, texts = i + 1, 0, []

    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_proto=held.value[1]).get_piece_size()
    return docs.select(id_col, text_col).mapInArrow(align, schema), pieces


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """pair, docs (documents that link it), best (no other pair of its id of A is in more)."""
    counts = stored(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")).withColumn("a", F.floor(F.col("pair") / pieces)))
    top = counts.groupBy("a").agg(F.max("docs").alias("_most"))
    return counts.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def _looked_up(links: DataFrame, shard: pa.Table) -> DataFrame:
    """row, n_best and count_sum of the links whose pairs are in ``shard``."""
    shard = shard.sort_by("pair")
    held = links.sparkSession.sparkContext.broadcast(tuple(shard[c].to_numpy() for c in ("pair", "docs", "best")))

    def look(batches):
        known, docs, best = held.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            times[known[at] != pairs] = 0
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(x)])[edges] for x in (times * best[at], times * docs[at])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(np.diff(s)) for s in sums]], ["row", "n_best", "count_sum"])

    return links.select("row", "pairs", "times").mapInArrow(look, "row long, n_best long, count_sum long")


def align_documents(docs: DataFrame, byte_bpe_path: str, piece_path: str, id_col="doc_id", text_col="text", shard: int = SHARD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    found, pieces = linked(docs, byte_bpe_path, piece_path, id_col, text_col)
    links = stored(found)
    counts = stored(pair_counts(links, pieces))
    shards = -(-counts.count() // shard)
    part = F.pmod(F.xxhash64("pair"), F.lit(max(shards, 1)))
    parts = [_looked_up(links, counts.where(part == i).toArrow()) for i in range(shards)]
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if not parts:
        return links.select(*own[1:6], F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    total = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.select(*own).join(total, "row").select(*own[1:6], "n_best", "count_sum", "groups_sha256")
