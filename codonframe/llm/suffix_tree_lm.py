"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words, and one end for each text. The root holds the frequency of
every word, with one added to each count and one unseen word more. A deeper state
is a context of up to ``depth`` words, with the distribution of the symbol that
follows: its own for the strings of context and symbol that occur ``least`` times
in the training texts, less a discount, and its suffix's, scaled to the rest, for
all others, so it adds up to one. By default every string that occurs counts; none
is dropped for being rare or because there are many. A context is retained if its
distribution diverges (Kullback and Leibler) from its suffix's by at least
``divergence`` nats a symbol and ``evidence`` nats over all its places. A text's
probability is the product over its tokens of their probability in the longest
state that is a suffix of what stands before them.

Counting. Texts are dealt into chunks, whose words are numbered by a dictionary
of the chunk's own, and stored so. A chunk asks for its distinct strings, once
each, and gets their counts in all chunks. Strings are dealt into shards by their
key, whose number grows with the texts; a shard sums up what all
chunks say of its strings, and answers each in the order of its question, so that
answers hold no keys. It also says whether another chunk asked: a string of which a part is
in one chunk only is itself in that chunk only, and its count needs no asking.
States are summed in the same way, each string by the first chunk that has it.
The tree grows with the corpus; no task and not the driver holds more of
it than a chunk's own strings or a shard. Words are known by 64 bits of hash,
strings by a mix of these.

Null and empty texts are the end alone. Rows with a null id are learnt from, as
they are in no fold; rows that share an id, or have a null one, are texts of their
own. Texts of any length are taken whole: a chunk is as long as its longest
text. Without any training text all words are unseen. An empty table gives an
empty table. Columns beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only_kept, shuffles_dropped, stored

#: The end of a text: no word holds a line break.
END = b"\n"


@dataclass(frozen=True)
class SuffixTree:
    depth: int = 2
    #: Strings that occur more rarely are left to the suffix: in ``share`` of the training tokens, or ``least`` times.
    share: float = 0.0
    least: int = 1
    discount: float = 0.5
    divergence: float = 0.02
    evidence: float = 10.0
    #: Tokens of a chunk, bytes of text that a task has at least, and bytes of text for each shard of strings.
    chunk: int = 3_000_000
    task: int = 20 << 20
    shard: int = 12 << 20


def keys_of(*words: np.ndarray) -> np.ndarray:
    """64 bits for each string of words, from the words' own."""
    key = np.full(words[0].shape, len(words), np.uint64)
    for w in words:
        key = (key ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64)


def chunks(docs: DataFrame, trains: Column, size: int, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids, trains, lengths (in tokens), tokens (numbers in the dictionary, compressed), words (the dictionary's keys)."""
    key = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["chunk", "ids", "trains", "lengths", "tokens", "words"]

    def number(batches):
        chunk = TaskContext.get().partitionId() << 32
        held: list = []

        def begin():
            numbers = count()
            words: dict[bytes, int] = {}
            held[:] = [words, numbers, [], [], [], [], 0]

        def done():
            words, _, ids, training, lengths, parts, _ = held
            tokens = np.concatenate(parts)
            keys = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)
            often = np.argsort(-np.bincount(tokens), kind="stable")  # frequent words get small numbers, which take less room
            rank = np.empty(len(often), np.int32)
            rank[often], keys = np.arange(len(often)), keys[often]
            planes = np.ascontiguousarray(rank[tokens].view(np.uint8).reshape(-1, 4).T)
            packed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
            as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([chunk]), as_list(pa.concat_arrays(ids)), as_list(pa.array(training, pa.bool_())), as_list(pa.array(lengths, pa.int32())), pa.array([packed], pa.binary()), as_list(pa.array(keys))]
            return pa.RecordBatch.from_arrays(columns, names)

        begin()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                known, numbers, ids, training, lengths, parts, total = held
                text = (texts[i].as_py() or b"").lower().split()
                text.append(END)
                for w in set(text).difference(known):
                    known[w] = next(numbers)
                parts.append(np.fromiter(map(known.__getitem__, text), np.int32, len(text)))
                ids.append(batch.column(0).slice(i, 1))
                training.append(bool(batch.column(2)[i].as_py()))
                lengths.append(len(text))
                held[6] = total + len(text)
                if held[6] >= size:
                    yield done()
                    chunk += 1
                    begin()
        if held[6]:
            yield done()

    schema = f"chunk long, ids array<{key}>, trains array<boolean>, lengths array<int>, tokens binary, words array<long>"
    return docs.select(id_col, text_col, F.coalesce(trains, F.lit(False))).mapInArrow(number, schema)


def _tokens(row: dict) -> np.ndarray:
    n = int(np.sum(row["lengths"]))
    planes = np.frombuffer(pa.decompress(row["tokens"], n * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _rows(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(batch.column(n).type) else batch.column(n)[i].as_py() for n in batch.schema.names}


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 8 bytes a value, compressed; bytes of the same rank stand together."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, kinds: str) -> list[np.ndarray]:
    """The columns again: ``u``, ``i`` and ``f`` are unsigned, signed and floating."""
    planes = np.frombuffer(pa.decompress(data, rows * 8 * len(kinds), codec="zstd", asbytes=True), np.uint8).reshape(len(kinds), 8, rows)
    return [np.ascontiguousarray(p.T).view(f"{kind}8").ravel() for p, kind in zip(planes, kinds)]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the places of all in order of key and place, and where in these each key begins.

    Keys are sorted by their first bits with their places as the last ones, which is faster than sorting places by
    keys; where the bits are too few to tell keys apart, places are sorted again.
    """
    bits = np.uint64(len(keys).bit_length())
    order = (np.sort(keys >> bits << bits | np.arange(len(keys), dtype=np.uint64)) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = order[np.argsort(ordered, kind="stable")]
        ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(keys)])
    return ordered[first], order, first


def scales(of: np.ndarray, strings: list[np.ndarray], seen: np.ndarray, symbols: int, options: SuffixTree) -> np.ndarray:
    """Log-scales of the suffixes of contexts that are ``seen`` so often, nan where a context isn't retained.

    Each string has its context's number, its count, and what gives its probability in the context's suffix: a count and
    that of the state, 0 for the root.
    """
    n, below, state = strings
    weight = n - options.discount
    below = np.log(np.where(state > 0, below - options.discount, below + 1) / np.where(state > 0, state, symbols))
    sums = lambda x: np.bincount(of, x, len(seen))
    seen, weights = np.maximum(seen, 1), sums(weight)
    left = 1 - weights / seen
    scale = np.log(left) - np.log(np.maximum(1 - sums(np.exp(below)), 1e-12))
    apart = (sums(weight * (np.log(weight) - below)) - weights * np.log(seen)) / seen + left * scale
    return np.where((weights > 0) & (apart >= options.divergence) & (apart * seen >= options.evidence), scale, np.nan)


@dataclass
class Level:
    """A chunk's distinct strings of one size, sorted by key."""

    keys: np.ndarray
    at: np.ndarray  # for each token, the number of the string that ends there, -1 where the text begins later
    some: np.ndarray  # a place where the string ends
    asked: np.ndarray  # whether it may be in other chunks
    n: np.ndarray  # training count: the chunk's own, then the corpus's
    owned: np.ndarray  # whether this chunk adds it to its state
    shared: np.ndarray  # whether other chunks have it


class Chunk:
    """The texts of a chunk, and what the answers so far say of their strings and states."""

    def __init__(self, row: dict, answers: dict[str, np.ndarray], longest: int, options: SuffixTree, least: int = 1, symbols: int = 1):
        """``symbols``: training tokens, words and one."""
        self.options, self.least, self.symbols = options, least, symbols
        self.tokens, self.lengths, self.words = _tokens(row), np.array(row["lengths"]), np.array(row["words"], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.begins, self.lengths).astype(np.int32)
        self.own = np.repeat(np.array(row["trains"], bool), self.lengths)
        self.levels: dict[int, Level] = {}
        for size in range(1, longest + 1):
            self.levels[size] = self.level(size, answers.get(f"n{size}"))
        self.root = np.log((self.levels[1].n + 1) / symbols)
        self.scale: dict[int, np.ndarray] = {}
        for size in range(1, longest):
            if (answer := answers.get(f"s{size}")) is not None:
                asked = self.contexts(size)
                self.scale[size] = scales(*self.strings(size, ~asked), self.levels[size].n, symbols, options)
                self.scale[size][asked] = answer

    def level(self, size: int, answer: np.ndarray | None) -> Level:
        ends = np.flatnonzero(self.place >= size - 1)
        if size == 1:
            keys, order, first = numbered(self.words.view(np.uint64))
            number = np.empty(len(order), np.int32)
            number[order] = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(first, append=len(order)))
            at = number[self.tokens]
            n = np.bincount(at[self.own], minlength=len(keys))
            some = np.empty(len(keys), np.int64)
            some[at] = ends
        else:
            keys, order, first = numbered(keys_of(*[self.words[self.tokens[ends - i]] for i in range(size - 1, -1, -1)]).view(np.uint64))
            order = ends[order]
            at = np.full(len(self.tokens), -1, np.int32)
            at[order] = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(first, append=len(order)))
            n = np.add.reduceat(self.own[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
            some = order[first]
        asked = np.ones(len(keys), bool)
        if size > 2:
            part = self.levels[size - 1]
            asked = part.shared[part.at[some]] & part.shared[part.at[some - 1]]
        owned, shared = np.ones(len(keys), bool), np.zeros(len(keys), bool)
        if answer is not None:
            n[asked], owned[asked], shared[asked] = answer >> 2, answer & 1, answer >> 1 & 1
        return Level(keys, at, some, asked, n, owned, shared)

    def contexts(self, size: int) -> np.ndarray:
        """Whether a string of ``size`` tokens is a context whose state other chunks may add to."""
        here = self.levels[size]
        followed = np.zeros(len(here.keys), bool)
        followed[here.at[np.flatnonzero(self.place >= size) - 1]] = True
        return followed & here.shared & (here.n >= self.least)

    def strings(self, size: int, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The strings that this chunk adds to the states of ``wanted`` contexts, in their order, as ``scales`` reads them."""
        here, longer = self.levels[size], self.levels[size + 1]
        chosen = np.flatnonzero(longer.owned & (longer.n >= self.least))
        of = here.at[longer.some[chosen] - 1]
        chosen, of = chosen[wanted[of]], of[wanted[of]]
        order = np.sort(of.astype(np.int64) << 32 | np.arange(len(of))) & 0xFFFFFFFF
        chosen, of = chosen[order], of[order]
        ends = longer.some[chosen]
        below, state = self.levels[1].n[self.levels[1].at[ends]], np.zeros(len(ends), np.int64)
        for shorter in range(1, size):
            context = self.levels[shorter].at[ends - 1]
            kept = np.flatnonzero(~np.isnan(self.scale[shorter][context]))
            below[kept] = self.levels[shorter + 1].n[self.levels[shorter + 1].at[ends[kept]]]
            state[kept] = self.levels[shorter].n[context[kept]]
        return of, [longer.n[chosen], below, state]

    def asked_states(self, size: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Keys of contexts whose states other chunks may add to, how many strings each has here and its count, and the strings."""
        asked = self.contexts(size)
        of, strings = self.strings(size, asked)
        here = self.levels[size]
        return here.keys[asked], [np.bincount(of, minlength=len(asked))[asked], here.n[asked]], strings

    def log_probability(self, ends: np.ndarray, depth: int) -> np.ndarray:
        """Natural log-probability of tokens in the longest state of at most ``depth`` words before them."""
        out = self.root[self.levels[1].at[ends]]
        for size in range(1, depth + 1):
            inside = np.flatnonzero(self.place[ends] >= size)
            of = self.levels[size].at[ends[inside] - 1]
            scale = self.scale[size][of]
            kept = ~np.isnan(scale)
            inside, of, scale = inside[kept], of[kept], scale[kept]
            n = self.levels[size + 1].n[self.levels[size + 1].at[ends[inside]]]
            own = np.log((np.maximum(n, self.least) - self.options.discount) / self.levels[size].n[of])
            out[inside] = np.where(n >= self.least, own, scale + out[inside])
        return out


QUESTION = "shard int, chunk long, what string, rows int, data binary, strings binary"
ANSWER = "chunk long, what string, shard int, rows long, data binary"


def questions(chunk: int, what: str, bits: int, keys: np.ndarray, columns: list[np.ndarray], strings: list[np.ndarray] | None = None) -> pa.RecordBatch:
    """A row for each shard that has some of the sorted keys; shards are the first bits of keys. Each key has as many of the strings as its first column says."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    last = np.append(first[1:], len(keys))
    data = [packed([np.diff(keys[a:b], prepend=np.uint64(0)), *[c[a:b] for c in columns]]) for a, b in zip(first, last)]
    more = [None] * len(first)
    if strings is not None:
        until = np.append(0, np.cumsum(columns[0]))
        more = [packed([c[until[a] : until[b]] for c in strings]) for a, b in zip(first, last)]
    arrays = [pa.array(shard[first], pa.int32()), pa.array([chunk] * len(first), pa.int64()), pa.array([what] * len(first), pa.string()), pa.array(last - first, pa.int32()), pa.array(data, pa.binary()), pa.array(more, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["shard", "chunk", "what", "rows", "data", "strings"])


def answered(asked: DataFrame, options: SuffixTree, symbols: int = 1) -> DataFrame:
    """Counts of strings (times four, and one for the first chunk that asks, two if several do) and scales of contexts, for each chunk in the order of its keys.

    Besides, with no chunk, the training tokens and the words among them in each shard.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("what", "ascending"), ("chunk", "ascending")]).to_pylist()
        out = []
        for what in sorted({r["what"] for r in rows}):
            mine = [r for r in rows if r["what"] == what]
            sizes = [r["rows"] for r in mine]
            parts = [unpacked(r["data"], r["rows"], "ui" if what[0] == "n" else "uii") for r in mine]
            keys, order, first = numbered(np.concatenate([np.cumsum(p[0]) for p in parts]))
            times = np.diff(first, append=len(order))
            number = np.empty(len(order), np.int64)
            number[order] = np.repeat(np.arange(len(keys)), times)
            columns = [np.concatenate(c) for c in list(zip(*parts))[1:]]
            if what[0] == "n":
                n = np.add.reduceat(columns[0][order], first)
                found = (4 * n + 2 * (times > 1))[number]
                found[order[first]] += 1
                if what == "n1":
                    out += [(None, "total", 0, int(n.sum()), None), (None, "distinct", 0, int((n > 0).sum()), None)]
            else:
                strings = [unpacked(r["strings"], int(p[1].sum()), "iii") for r, p in zip(mine, parts)]
                found = scales(np.repeat(number, columns[0]), [np.concatenate(c) for c in zip(*strings)], columns[1][order[first]], symbols, options)[number]
            ends = np.cumsum(sizes)
            out += [(r["chunk"], what, r["shard"], r["rows"], packed([found[e - r["rows"] : e]])) for r, e in zip(mine, ends)]
        kinds = [("chunk", pa.int64()), ("what", pa.string()), ("shard", pa.int32()), ("rows", pa.int64()), ("data", pa.binary())]
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), kinds)], schema=pa.schema(kinds))

    return asked.groupBy("shard").applyInArrow(answer, ANSWER)


def _told(table: pa.Table, depth: int) -> dict[str, np.ndarray]:
    """Answers to a chunk by what they are of. States that nothing was asked of have an empty one."""
    out: dict[str, list] = {}
    for r in table.sort_by([("what", "ascending"), ("shard", "ascending")]).to_pylist():
        out.setdefault(r["what"], []).append(*unpacked(r["data"], r["rows"], "i" if r["what"][0] == "n" else "f"))
    none = {f"n{i}": np.zeros(0, np.int64) for i in range(1, depth + 2)} | {f"s{i}": np.zeros(0) for i in range(1, depth + 1)}
    return none | {k: np.concatenate(v) for k, v in out.items()}


def score_texts(docs: DataFrame, trains: Column, options: SuffixTree = SuffixTree(), id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text; the tree learns from rows where ``trains`` is true."""
    with only_kept(docs.sparkSession) as here, shuffles_dropped(docs.sparkSession):
        return here.keep(_scored(docs, trains, options, id_col, text_col))


def _scored(docs: DataFrame, trains: Column, options: SuffixTree, id_col: str, text_col: str) -> DataFrame:
    # Small partitions are read together: the fewer tokens in a chunk, the more chunks have the same strings.
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    docs = docs.coalesce(max(size // options.task, docs.sparkSession.sparkContext.defaultParallelism))
    bits = int(np.ceil(np.log2(max(size / options.shard, 2))))
    depth = options.depth
    # Dealt once by chunk, and met by the answers there.
    texts = chunks(docs, trains, options.chunk, id_col, text_col).repartition(4 * max(size // options.task, 3), "chunk").persist(StorageLevel.DISK_ONLY)
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    try:

        def begin(batches):
            for batch in batches:
                for row in _rows(batch):
                    chunk = Chunk(row, {}, 2, options)
                    for size in (1, 2):
                        level = chunk.levels[size]
                        yield questions(row["chunk"], f"n{size}", bits, level.keys, [level.n])

        answers = stored(answered(texts.select("chunk", "trains", "lengths", "tokens", "words").mapInArrow(begin, QUESTION), options))
        known = {r["what"]: r["n"] for r in answers.where("chunk is null").groupBy("what").agg(F.sum("rows").alias("n")).collect()}
        total, symbols = known.get("total", 0), known.get("total", 0) + known.get("distinct", 0) + 1
        least = max(options.least, int(np.ceil(options.share * total)), 1)

        def met(of: DataFrame, function, schema: str) -> DataFrame:
            return of.groupBy("chunk").cogroup(answers.where("chunk is not null").groupBy("chunk")).applyInArrow(function, schema)

        def further(states: int):
            """Asks for the states of a size, and the strings of two tokens more."""

            def ask(left: pa.Table, right: pa.Table) -> pa.Table:
                (row,) = _rows(left.combine_chunks().to_batches()[0])
                told = {k: v for k, v in _told(right, depth).items() if int(k[1:]) < states + (k[0] == "n") * 2}
                chunk = Chunk(row, told, min(states + 2, depth + 1), options, least, symbols)
                out = [questions(row["chunk"], f"s{states}", bits, *chunk.asked_states(states))]
                if states < depth:
                    level = chunk.levels[states + 2]
                    out.append(questions(row["chunk"], f"n{states + 2}", bits, level.keys[level.asked], [level.n[level.asked]]))
                return pa.Table.from_batches(out)

            return ask

        for states in range(1, depth + 1):
            asked = met(texts.select("chunk", "trains", "lengths", "tokens", "words"), further(states), QUESTION)
            answers = answers.unionByName(stored(answered(asked, options, symbols)))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            (row,) = _rows(left.drop_columns("ids").combine_chunks().to_batches()[0])
            chunk = Chunk(row, _told(right, depth), depth + 1, options, least, symbols)
            each = chunk.levels[1].at
            whole = chunk.log_probability(np.arange(len(each)), depth)
            n_known, base, whole = (np.add.reduceat(x, chunk.begins) for x in ((chunk.levels[1].n > 0)[each].astype(np.int64), chunk.root[each], whole))
            ids = left["ids"].combine_chunks().flatten()
            return pa.table([ids, chunk.lengths.astype(np.int64), n_known, np.full(len(ids), total), base / np.log(10), whole / np.log(10)], names)

        key = docs.select(id_col).schema[0].dataType.simpleString()
        return stored(met(texts, score, f"doc_id {key}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    finally:
        texts.unpersist()
