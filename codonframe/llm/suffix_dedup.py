"""Removal of repeated passages by maximal repeats of an enhanced suffix array.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier:
in a document with a smaller id, or before in the same document. The strings
compared are those of the input.

Every string of ``LENGTH`` bytes has an anchor, the least hash among its
``GRAM``-byte grams, so equal strings meet at equal anchors. The neighbouring
strings with one anchor form a context of at most 2 ``LENGTH`` bytes. Anchors
that occur once need nothing more. Where all contexts of an anchor are equal, all
but the first are repeats as a whole; anchor and content together are 128 bits of
hash. Only where they differ, at the edges of repeated passages, are texts
fetched, for the first context of each content. Their suffixes are sorted by
text, the common-prefix intervals are walked with a stack, and those whose left
neighbours differ are the maximal repeats, with all their occurrences.

The contexts are sorted over all tasks, first by anchor and what stands left of
it, read backwards, then by anchor and what follows it. A context shares most
with a neighbour in each order, so what its neighbours do not share is cut off,
and hardly more than the repeated part is left. Blocks of neighbours, cut by
their bytes alone, are walked. Where a block ends inside an anchor, the strings
that come first in it meet those of the other blocks byte by byte. Every anchor
takes this way, and each context gives a few rows, however many there are.

No task holds a group that grows with the corpus: counts are combined before they
are shuffled, joins on hot anchors can be split by Spark, sorts are by range of
whole contents, blocks are bounded.

Null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing. Texts of
any length are taken whole; a document's first occurrence of a string stays.
Rows with a null id are not compared and stay whole. Rows with equal id and text
are one document; rows that share an id but not the text are documents of their
own, in an order of the texts' hashes. Ids are whole numbers. An empty table
gives an empty table. Columns beyond id and text are not read, or, in
``without_repeats``, go through as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, whole_ids

LENGTH, GRAM = 100, 16
SPAN = LENGTH - GRAM + 1
#: Bytes of contexts walked together.
SORTED_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) <= n:
        for i, x in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, 1 << 16), x, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    ahead, _ = powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[:-1])])


def hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from begin to end, for arrays of both."""
    _, back = powers(len(sums) - 1)
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """first and last start of each run of strings with one anchor; the anchor's and the context's hash."""
    sums = prefix_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    value, place, width = hashes(sums, at, at + GRAM), at, 1
    grams = value
    while 2 * width <= SPAN:  # least of 2, 4, 8 ... grams; the leftmost where several are least
        less = value[width:] < value[:-width]
        value, place, width = np.where(less, value[width:], value[:-width]), np.where(less, place[width:], place[:-width]), 2 * width
    rest = SPAN - width
    n = len(data) - LENGTH + 1
    place = np.where(value[rest : rest + n] < value[:n], place[rest : rest + n], place[:n])
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([begin[1:], [n]]) - 1
    return begin, last, grams[place[begin]], hashes(sums, begin, last + LENGTH)


def unused(columns: list[str]) -> str:
    """A beginning that no column's name has, in whatever letters."""
    start = "__"
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns of unused names, and these: the id, and the text's hash where rows with unlike texts share the id, else 0; null for a null id."""
    whole_ids(docs, id_col)
    start = unused(docs.columns)
    doc, sub, same, several = (start + x for x in ("doc", "sub", "id", "several"))
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.col(id_col).cast("long").alias(same), mark.alias("_m")).groupBy(same).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi"))
    found = stored(found.where("_lo <> _hi").select(same, F.lit(True).alias(several)))
    joined = docs.withColumn(doc, F.col(id_col).cast("long")).join(found, F.col(doc) == F.col(same), "left")
    return joined.withColumn(sub, F.when(F.col(several), mark).otherwise(F.lit(0).cast("long"))).select(*[docs[c] for c in docs.columns], doc, sub), doc, sub


PLACE = ["doc", "sub", "first"]


def scan(rows: DataFrame) -> DataFrame:
    """From (doc, sub, text): doc, sub, first, last, anchor, context of each context that comes first in its batch; the others as repeats without an anchor."""
    names = [*PLACE, "last", "anchor", "context"]

    def find(batches):
        for batch in batches:
            ids, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = []
            for i in np.lexsort((subs, ids)):
                text = batch.column(2)[int(i)].as_py()
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) >= LENGTH:
                    begin, last, anchor, context = anchors(data)
                    parts.append((np.full(len(begin), ids[i]), np.full(len(begin), subs[i]), begin.astype(np.int32), last.astype(np.int32), anchor.view(np.int64), context.view(np.int64)))
            if not parts:
                continue
            doc, sub, begin, last, anchor, context = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((context, anchor))  # stable: by document and place within equal contexts
            earlier, later = order[:-1], order[1:]
            again = np.zeros(len(order), dtype=bool)
            again[later] = (anchor[later] == anchor[earlier]) & (context[later] == context[earlier])
            # The same place of the same document is no repeat.
            same = np.zeros(len(order), dtype=bool)
            same[later] = again[later] & (doc[later] == doc[earlier]) & (sub[later] == sub[earlier]) & (begin[later] == begin[earlier])
            new = np.flatnonzero(~again)
            yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (doc, sub, begin, last, anchor, context)], names)
            old = np.flatnonzero(again & ~same)
            if len(old):  # neighbouring runs become one
                change = (doc[old][1:] != doc[old][:-1]) | (sub[old][1:] != sub[old][:-1]) | (begin[old][1:] != last[old][:-1] + 1)
                cut = np.flatnonzero(np.concatenate([[True], change]))
                ends = np.concatenate([cut[1:], [len(old)]]) - 1
                none = pa.nulls(len(cut), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(x[old][cut]) for x in (doc, sub, begin)], pa.array(last[old][ends]), none, none], names)

    return rows.where(F.col("doc").isNotNull()).mapInArrow(find, "doc long, sub long, first int, last int, anchor long, context long")


def suffixes(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of the contexts' suffixes of ``LENGTH`` bytes and more.

    owner and offset of each suffix in the order of the texts, the common prefix
    with the suffix before (0 where it is shorter than ``LENGTH``), and the byte
    to the left (-1 at a context's start). Suffixes that share no prefix of that
    length with another are left out.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    at = starts[owner] + offset
    key = hashes(prefix_sums(data), at, at + LENGTH)
    order = np.argsort(key, kind="stable")
    shared = key[order][1:] == key[order][:-1]
    some = order[np.concatenate([[False], shared]) | np.concatenate([shared, [False]])]
    if not len(some):
        none = np.empty(0, np.int64)
        return none, none, none, none
    owner, offset, at, key = owner[some], offset[some], at[some], key[some]
    # By text: the heads of ``LENGTH`` bytes are ranked once for each content, then the rest; UTF-8 leaves room for an end mark of 0.
    heads = np.ascontiguousarray(data[at[:, None] + np.arange(LENGTH)])
    _, one, group = np.unique(key, return_index=True, return_inverse=True)
    if (heads[one][group] != heads).any():  # equal hashes of unlike heads
        _, one, group = np.unique(heads.view(f"S{LENGTH}").ravel(), return_index=True, return_inverse=True)
    rank = np.empty(len(one), np.int64)
    rank[np.argsort(heads[one].view(f"S{LENGTH}").ravel(), kind="stable")] = np.arange(len(one))
    head = rank[group]
    left = (starts[owner + 1] - at - LENGTH).astype(np.int64)
    width = max(int(left.max()), 1)
    padded = np.concatenate([data, np.zeros(2 * LENGTH + width, np.uint8)])
    columns = np.arange(width)
    tails = np.where(columns < left[:, None], padded[(at + LENGTH)[:, None] + columns].astype(np.uint8) + np.uint8(1), np.uint8(0)).astype(np.uint8)
    order = np.lexsort((np.ascontiguousarray(tails).view(f"S{width}").ravel(), head))
    owner, offset, at, head, tails = owner[order], offset[order], at[order], head[order], tails[order]
    equal = (tails[1:] == tails[:-1]) & (tails[1:] > 0)
    prefix = np.concatenate([[0], np.where(head[1:] == head[:-1], LENGTH + np.cumprod(equal, axis=1, dtype=np.uint8).sum(axis=1), 0)])
    before = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    return owner, offset, prefix.astype(np.int64), before


def maximal_repeats(prefix: np.ndarray, before: np.ndarray):
    """(length, from, to) of each maximal repeat: suffixes from ``from`` to before ``to`` are its occurrences.

    One walk over the common prefixes with a stack of open intervals. An interval
    keeps the byte left of all its suffixes, or -1 once they differ or one has none.
    """
    stack: list[list[int]] = []  # length, from, left byte
    lengths, lefts = prefix.tolist(), before.tolist()
    n = len(lengths)
    for i in range(1, n + 1):
        now = lengths[i] if i < n else 0
        begin, byte = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > now:
            length, begin, held = stack.pop()
            byte = byte if byte == held else -1
            if byte == -1:
                yield length, begin, i
        if stack and stack[-1][0] == now:
            if stack[-1][2] != byte:
                stack[-1][2] = -1
        elif now:
            stack.append([now, begin, byte])


def repeated_runs(contexts: list[bytes], places: list[tuple[int, int, int]]) -> list[list[list[int]]]:
    """For each context, at its (doc, sub, first): runs of offsets (from, to) of the strings that start earlier in another one."""
    owner, offset, prefix, before = suffixes(contexts)
    runs: list[list[list[int]]] = [[] for _ in contexts]
    if not len(owner):
        return runs
    doc, sub, first = (np.array([p[i] for p in places], np.int64) for i in range(3))
    order = np.lexsort((first[owner] + offset, sub[owner], doc[owner]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own, off = owner.tolist(), offset.tolist()
    covered: dict[int, list[tuple[int, int]]] = {}
    for length, a, b in maximal_repeats(prefix, before):
        earliest = a + int(np.argmin(place[a:b])) if b - a > 2 else (a if place[a] < place[a + 1] else a + 1)
        for i in range(a, b):
            if i != earliest:
                covered.setdefault(own[i], []).append((off[i], off[i] + length - LENGTH))
    for i, spans in covered.items():
        held = runs[i]
        for a, b in sorted(spans):
            if held and a <= held[-1][1] + 1:
                held[-1][1] = max(held[-1][1], b)
            else:
                held.append([a, b])
    return runs


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


# --- contexts cut at the anchor -----------------------------------------------------------------------------------

SIDES = ["anchor", "left", "right", "doc", "sub", "at", "lo", "hi"]
SIDE_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
SIDE_SCHEMA = "anchor long, left binary, right binary, doc long, sub long, at int, lo int, hi int"


def anchor_places(contexts: list[bytes], first: list[int], anchor: list[int]) -> list[int]:
    """Where each context has its anchor: the leftmost such gram from ``first`` on, which all its strings hold."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashes(prefix_sums(data), at, at + GRAM).view(np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes)[: len(at)]
    here = np.flatnonzero((grams == np.array(anchor, np.int64)[owner]) & (at >= starts[owner] + np.array(first)[owner]) & (at + GRAM <= starts[owner + 1]))
    _, leftmost = np.unique(owner[here], return_index=True)
    return (here[leftmost] - starts[:-1]).tolist()


def sides(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contexts (doc, sub, first, last, anchor) with their bytes from the texts: ``left`` runs backwards from the anchor, ``right`` begins with it.

    A string is named by the bytes it has left of the anchor, which is at ``at`` of its text; lo to hi of them are a context's strings.
    """
    per_doc = wanted.groupBy("doc", "sub").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            out = []
            for doc, sub, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode("utf-8", "surrogatepass")
                texts = [data[w["first"] : w["last"] + LENGTH] for w in wanted]
                places = anchor_places(texts, [w["last"] - w["first"] for w in wanted], [w["anchor"] for w in wanted])
                for w, t, p in zip(wanted, texts, places, strict=True):
                    out.append((w["anchor"], t[:p][::-1], t[p:], doc, sub, w["first"] + p, p - (w["last"] - w["first"]), p))
            yield _batch(out, SIDES, SIDE_KINDS)

    return rows.join(per_doc, ["doc", "sub"]).mapInArrow(fetch, SIDE_SCHEMA)


def _common(one: bytes, two: bytes) -> int:
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n
    differ = int.from_bytes(one[:n], "big") ^ int.from_bytes(two[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _neighbours(batches, side: int):
    """(row, most): how many bytes of that side a row shares with a neighbour of the same anchor, over rows sorted by it.

    The first and the last row of a task may have a neighbour elsewhere: they share all they have.
    Equal rows, of one document that a table holds twice, are one.
    """
    held = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None:
                if row == held[0]:
                    continue
                both = _common(held[0][side], row[side]) if held[0][0] == row[0] else 0
                yield held[0], max(held[1], both)
                held = (row, both)
            else:
                held = (row, len(row[side]))
    if held is not None:
        yield held[0], len(held[0][side])


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartitionByRange(*by).sortWithinPartitions(*by, "doc", "sub", "at")


def trimmed(rows: DataFrame) -> DataFrame:
    """``sides`` rows less the strings, and the bytes, that reach further left than any other context does."""

    def trim(batches):
        out = []
        for row, most in _neighbours(batches, 1):
            hi = min(row[7], most)
            if hi >= row[6]:
                out.append((row[0], row[1][:hi], *row[2:7], hi))
            if len(out) >= 5000:
                yield _batch(out, SIDES, SIDE_KINDS)
                out = []
        yield _batch(out, SIDES, SIDE_KINDS)

    return _sorted(rows, "anchor", "left", "right").mapInArrow(trim, SIDE_SCHEMA)


def walked(rows: DataFrame) -> DataFrame:
    """Repeats among ``trimmed`` rows as doc, sub, first, last, and the strings that blocks have to compare with each other.

    Sorted by what follows the anchor, strings that need more of it than any other context shares go, and blocks of
    neighbours are walked. Strings that come first in a block have their bytes in ``string`` where other blocks may hold contexts of the same anchor.
    """
    names, kinds = [*PLACE, "last", "string"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def walk(held, shared):
        # Bytes from hi left of the anchor to what the string with lo of them needs to the right.
        texts = [left[:hi][::-1] + right[: LENGTH - lo] for _, left, right, *_, lo, hi in held]
        begins = [r[5] - r[7] for r in held]
        runs = repeated_runs(texts, [(r[3], r[4], b) for r, b in zip(held, begins)])
        out = []
        for row, text, begin, own in zip(held, texts, begins, runs):
            out += [(row[3], row[4], begin + a, begin + b, None) for a, b in own]
            if row[0] in shared:
                free = np.ones(len(text) - LENGTH + 1, bool)
                for a, b in own:
                    free[a : b + 1] = False
                out += [(row[3], row[4], begin + s, begin + s, text[s : s + LENGTH]) for s in np.flatnonzero(free).tolist()]
        return _batch(out, names, kinds)

    def find(batches):
        held, size, begun = [], 0, None  # begun: the anchor of which there may be contexts before the block
        for row, most in _neighbours(batches, 2):
            begun = row[0] if begun is None else begun
            if size >= SORTED_BYTES:
                yield walk(held, {begun, row[0]})
                held, size, begun = [], 0, held[-1][0]
            lo = max(row[6], LENGTH - most)
            if lo <= row[7]:
                held.append((*row[:6], lo, row[7]))
                size += LENGTH - lo + row[7]
        if held:
            yield walk(held, {begun, held[-1][0]})

    return _sorted(rows, "anchor", "right", "left").mapInArrow(find, "doc long, sub long, first int, last int, string binary")


def repeats(rows: DataFrame) -> DataFrame:
    """From (doc, sub, text): doc, sub, first, last, runs of starts of strings that also start earlier."""
    found = stored(scan(rows))
    held = found.where(F.col("anchor").isNotNull())
    shared = held.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("context").alias("_a"), F.max("context").alias("_b")).where(F.col("_n") > 1)
    again = stored(held.join(stored(shared.select("anchor", (F.col("_a") != F.col("_b")).alias("differ"))), "anchor"))
    firsts = stored(again.groupBy("anchor", "context").agg(F.min(F.struct(*PLACE, "last")).alias("_at"), F.first("differ").alias("differ")))
    runs = [*PLACE, "last"]
    not_at = (F.col("doc") != F.col("_at.doc")) | (F.col("sub") != F.col("_at.sub")) | (F.col("first") != F.col("_at.first"))
    later = again.join(firsts.select("anchor", "context", "_at"), ["anchor", "context"]).where(not_at).select(*runs)
    near = stored(walked(stored(trimmed(stored(sides(rows, firsts.where("differ").select("anchor", "_at.*")))))))
    strings = near.where(F.col("string").isNotNull())
    several = stored(strings.groupBy("string").agg(F.count("*").alias("_n"), F.min(F.struct(*PLACE)).alias("_at")).where(F.col("_n") > 1).drop("_n"))
    parts = [found.where(F.col("anchor").isNull()), later, near.where(F.col("string").isNull()), strings.join(several, "string").where(not_at)]
    return reduce(DataFrame.unionByName, [p.select(*runs) for p in parts])


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What stays, how many bytes go, and in how many maximal runs; ``spans`` are first and last starts."""
    out, removed, runs, at = [], 0, 0, 0
    begin = end = -1
    for first, last in [*sorted(spans), (len(data) + 1, 0)]:
        if first > end or first > len(data):
            if end > begin:
                out.append(data[at:begin])
                removed, runs, at = removed + end - begin, runs + 1, end
            begin, end = first, min(last + LENGTH, len(data))
        else:
            end = max(end, min(last + LENGTH, len(data)))
    out.append(data[at:])
    return b"".join(out), removed, runs


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` and, as a last column, the runs of starts to remove; null where there are none."""
    known, doc, sub = keyed(docs, id_col, text_col)
    spans = repeats(known.select(F.col(doc).alias("doc"), F.col(sub).alias("sub"), F.col(text_col).alias("text")))
    runs = unused(docs.columns) + "spans"
    spans = spans.groupBy(F.col("doc").alias(doc), F.col("sub").alias(sub)).agg(F.collect_list(F.struct("first", "last")).alias(runs))
    return known.join(spans, [doc, sub], "left").select(*docs.columns, runs)


def _cut(text: str | None, spans) -> tuple[bytes, bytes, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data, *kept_bytes(data, [(s["first"], s["last"]) for s in spans or ()])


def dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    key = docs.select(id_col).schema[0].dataType.simpleString()
    rows = _with_spans(docs.select(id_col, text_col), id_col, text_col)

    def measure(batches):
        for batch in batches:
            cut = [_cut(*x) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            counts = [pa.array(x, pa.int64()) for x in ([len(c[0]) for c in cut], [c[2] for c in cut], [c[3] for c in cut])]
            columns = [*counts, pa.array([hashlib.sha256(c[1]).hexdigest() for c in cut], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(measure, f"doc_id {key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with its columns, each text less its repeated bytes.

    A character of which only some bytes are left is dropped. Texts that lose
    nothing stay as they are, null ones too.
    """
    at = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            texts = [t if not s else _cut(t, s)[1].decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return _with_spans(docs, id_col, text_col).mapInArrow(cut, docs.schema)
