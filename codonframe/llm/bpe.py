"""BPE encoding with backtracking, and decoding through an offset table.

A word's tokens come from an Aho-Corasick automaton over the vocabulary: all
matches of the word in one pass, grouped by start. The encoder takes the longest
match at each position if the pair of it and the token before is compatible,
that is, if merging the two texts together gives these two tokens again. A
position from which nothing compatible goes on is marked dead and never tried
again, so each position is left at most once and the time is linear. Pairs that
have been tested stay in the compatibility table.

The normaliser and the splitting into words are those the vocabulary file
names: NFC, white space to one space, lower case; contractions, runs of letters,
single digits, runs of other signs; byte alphabet; a mark on a word's last
symbol. Special tokens in a text stand for themselves.

The library's tables are of three Unicode versions: normal forms of version 9,
letter and number classes of version 16, lower case of version 17. Texts whose
characters are the same in all of them and in this Python's tables take the
short way; the others are split, normalised and lower-cased by those versions.

Null texts are empty: no tokens, and the empty text on decoding. Texts of any
length are encoded whole, one at a time. Rows that share an id, or have a null
one, are encoded each for itself. An empty table gives an empty table. Columns
beyond id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The white space that the vocabulary's normaliser folds, and its word pattern.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: Words whose tokens a worker remembers, twice (recent and older), and pairs in its compatibility table.
MAX_WORDS, MAX_PAIRS = 250_000, 1_000_000
LAST = 0x1000

# What Unicode has changed between the versions that the library's tables and Python's are of.
#: Letters, and numbers, that version 16.0 added to 15.1.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Combining marks added after version 9.0, and the second half of a composition added after it: starters to the library.
MARKS_10 = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Capitals that versions 16.0 and 17.0 added, and their small letters.
LOWER_17 = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


class Characters:
    """Normalising and splitting by the library's Unicode versions, for texts in which the versions matter."""

    def __init__(self):
        kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
        #: True for characters on which Python's tables and the library's may differ.
        self.special = np.array([k == "Cn" for k in kinds])
        for a, b in MARKS_10:
            self.special[a : b + 1] = True

        def ranges(initial, more):
            at = np.array([k[0] == initial for k in kinds])
            for a, b in more:
                at[a : b + 1] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], at.view(np.int8), [0]])))
            return "".join(f"\\U{a:08X}-\\U{b - 1:08X}" for a, b in zip(edges[::2], edges[1::2]))

        letters, numbers = ranges("L", LETTERS_16), ranges("N", NUMBERS_16)
        self.find_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[" + letters + "]+|[" + numbers + "]|[^" + SPACE + letters + numbers + "]+").findall
        self.split = re.compile("([" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in MARKS_10) + "])").split

    def matter(self, text: str) -> bool:
        return bool(self.special[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any())

    def words(self, text: str) -> list[str]:
        composed = "".join([unicodedata.normalize("NFC", part) for part in self.split(text)])
        return self.find_words(composed.translate(LOWER_17).replace("Σ", "σ").lower())


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = dict(zip(plain, map(chr, plain))) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _marked(token: str, suffix: str) -> str:
    """A token with its last symbol moved out of the alphabet where it ends a word."""
    if not token.endswith(suffix):
        return token
    body = token[: -len(suffix)]
    return body[:-1] + chr(ord(body[-1]) + LAST)


class BacktrackingEncoder:
    def __init__(self, definition: str):
        import ahocorasick
        import regex

        spec = json.loads(definition)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {_marked(t, suffix): i for t, i in vocab.items() if t not in special}
        self.text = {i: t for t, i in self.ids.items()}
        self.rank = {(_marked(a, suffix), _marked(b, suffix)): n for n, (a, b) in enumerate(spec["model"]["merges"])}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find_words = regex.compile(WORDS).findall
        self.characters: Characters | None = None
        self.bytes = byte_alphabet()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names, default=-1) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the pair of lowest rank again and again."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank.get(pair, len(self.rank)), i) for i, pair in enumerate(zip(parts, parts[1:]))]
            best, i = min(ranked)
            if best == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return known

    def encode_word(self, word: str) -> list[int]:
        symbols = "".join([self.bytes[b] for b in word.encode()])
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + LAST)
        n = len(symbols)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(symbols):
            at[end + 1 - match[0]].append(match)
        out, tries, dead = [], [], bytearray(n + 1)
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            while k >= 0:
                size, token = at[pos][k]
                if not dead[pos + size] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tries.append(k)
                pos += size
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                pos -= len(self.text[out.pop()])
                k = tries.pop() - 1
        return out

    def remembered(self, word: str) -> list[int]:
        known = self.words.get(word) or self.older.get(word) or self.encode_word(word)
        if len(word) < 64:
            if len(self.words) >= MAX_WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = known
        return known

    def split_words(self, part: str) -> list[str]:
        """The words, normalised. Lower case letter by letter: a final sigma takes no form of its own. No word holds white space, so folding it changes nothing."""
        if not part.isascii():
            self.characters = self.characters or Characters()
            if self.characters.matter(part):
                return self.characters.words(part)
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return self.find_words(part.lower())

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if i % 2:
                ids.append(self.special[part])
                continue
            words = self.split_words(part)
            known = list(map(self.words.get, words))
            if None in known:
                known = [self.remembered(w) if k is None else k for w, k in zip(words, known)]
            ids.extend(chain.from_iterable(known))
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' texts with a space between, cut from one table by offsets."""
        if not len(ids):
            return b""
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.blob[shift + np.arange(len(shift))].tobytes()[:-1]


_encoders: dict[int, BacktrackingEncoder] = {}


def encoder(definition: str) -> BacktrackingEncoder:
    """One encoder for each worker and vocabulary."""
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = BacktrackingEncoder(definition)
    return _encoders[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; ``with_ids`` adds ids and decoded text.

    The vocabulary file (a few MB, whatever the corpus) goes to the workers as a broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    key = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def encode(batches):
        e = encoder(definition.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = np.array(e.encode(text.as_py() or ""), dtype="<u4")
                decoded = e.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()) + ((ids.astype(np.int32), decoded.decode()) if with_ids else ()))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds[: 5 if with_ids else 3])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4])

    return docs.select(id_col, text_col).mapInArrow(encode, schema)
