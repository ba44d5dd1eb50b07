"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one token with which the BPE encoding of that prefix ends. An
Aho-Corasick automaton over the vocabulary lists, at each position, the tokens that are suffixes of the prefix; the
one that is compatible with the last token of what precedes it is stored as back-pointer. Following the back-pointers
from the end gives the ids that greedy pair merging gives, in time linear in the text even for a pre-token of a
million bytes.

Cases: null text encodes as the empty text (no ids, empty decoded text); special strings inside a text become their
own id, as the tokenizers library does by default; repeated rows give repeated results; null ids of documents pass
through; columns of the input beside the named ones pass through, whatever their names, and if one has the name of an
output column, the output column replaces it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_text
from .pieces import MARKS, Pieces, binaries, by_bytes, column_bytes, cut_nowhere, cut_pretokens, gathered

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Transitions and token pairs a worker remembers.
CACHE_STEPS, CACHE_PAIRS = 500_000, 600_000

_INF = 1 << 60
_START = 1 << 41


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Aho-Corasick automaton over byte strings: for each state, the strings that are suffixes of what was read.

    Built as a trie with fail links; transitions off the trie are worked out when first needed and then kept.
    """

    def __init__(self, words):
        self.steps: dict[int, int] = {}  # state << 8 | byte: next state
        ends: list[tuple[int, int, int] | None] = [None]
        for word, i in words:
            s = 0
            for b in word:
                n = self.steps.get(s << 8 | b)
                if n is None:
                    n = self.steps[s << 8 | b] = len(ends)
                    ends.append(None)
                s = n
            ends[s] = (len(word), i, i << 20)
        self.fail = [0] * len(ends)
        self.outputs: list[tuple[tuple[int, int, int], ...]] = [()] * len(ends)  # longest first: length, id, id << 20
        # a state's number exceeds its parent's, but fail links need whole levels
        level = [(0, b, n) for b in range(256) if (n := self.steps.get(b))]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, n in self.steps.items():
            children.setdefault(key >> 8, []).append((key & 255, n))
        while level:
            following = []
            for parent, b, n in level:
                if parent:
                    f = self.fail[parent]
                    while f and (f << 8 | b) not in self.steps:
                        f = self.fail[f]
                    self.fail[n] = self.steps.get(f << 8 | b, 0)
                self.outputs[n] = ((ends[n],) if ends[n] else ()) + self.outputs[self.fail[n]]
                following += [(n, c, m) for c, m in children.get(n, ())]
            level = following

    def step(self, key: int) -> int:
        """A transition off the trie."""
        f, b = key >> 8, key & 255
        while f and (f << 8 | b) not in self.steps:
            f = self.fail[f]
        out = self.steps.get(f << 8 | b, 0)
        if len(self.steps) < CACHE_STEPS:
            self.steps[key] = out
        return out


class TokenBytes:
    """What the ids of a vocabulary file stand for: all that decoding needs."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in word)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._learn(spec["model"], alphabet, size)

    def _learn(self, model: dict, alphabet: dict[str, int], size: int) -> None:
        """What else is kept of the file."""

    def decode(self, ids: bytes) -> str:
        """Text of ids; byte sequences that are no UTF-8 become U+FFFD."""
        return self.decode_column(pa.array([ids], pa.binary()))[0].as_py()

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The text of each value of a binary column of packed ids without nulls."""
        raw, offsets = column_bytes(ids)
        numbers = raw.view("<u4")
        sizes = self.sizes[numbers]
        data = gathered(self.flat, self.starts[numbers], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets // 4]
        begins = ends[:-1][ends[:-1] < ends[1:]]
        try:
            data.tobytes().decode()
            whole = not ((data[begins] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


class PrefixBpe(TokenBytes):
    """Encoder and decoder for one vocabulary file."""

    def _learn(self, model: dict, alphabet: dict[str, int], size: int) -> None:
        vocab = model["vocab"]
        # merges: rank of a pair, and of each token the rank at which it is formed and its two parts
        self.rank: dict[int, int] = {}
        formed, parts = [-1] * size, [None] * size
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(left << 32 | right, r)
            if parts[whole] is None:
                formed[whole], parts[whole] = r, (left, right)
                if max(formed[left], formed[right]) >= r:
                    raise ValueError(f"merge {r} uses a part that is formed later")
        # from the outermost byte inwards, what a token's edge is made of: (symbol, rank of the merge that takes it in)
        self.left_edge, self.right_edge = ([self._edge(i, s, formed, parts) for i in range(size)] for s in (0, 1))
        if {alphabet[c] for c in alphabet if c in vocab} != set(range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        reachable = [i for i in vocab.values() if parts[i] is not None or len(self.bytes_of[i]) == 1]
        self.automaton = SuffixAutomaton((self.bytes_of[i], i) for i in reachable)
        self.good: set[int] = {_START + i for i in range(size)}
        self.bad: set[int] = set()
        self.pretoken = regex.compile(PRETOKEN)
        self.splitter = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        breaks = any(regex.search(rf"\s|[A-Za-z][{MARKS.decode()}]|^[{MARKS.decode()}]", word) for word in self.special)
        self.pieces = Pieces(cut_nowhere if breaks else cut_pretokens, self._fill)

    @staticmethod
    def _edge(i: int, side: int, formed: list[int], parts: list) -> tuple[tuple[int, int], ...]:
        chain, taken = [(i, _INF)], formed[i]
        while parts[i] is not None:
            i = parts[i][side]
            chain.append((i, taken))
            taken = formed[i]
        return tuple(reversed(chain))

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a followed by b as these two tokens: no merge across their border comes first.

        At any time of the merging, what touches the border is one symbol of a's right edge and one of b's left edge.
        Both edges are climbed in order of rank; a merge of the two touching symbols wins over b's own at equal rank,
        since it lies further left, and loses to a's.
        """
        left, right, rank = self.right_edge[a], self.left_edge[b], self.rank
        i = j = 0
        while True:
            (x, xr), (y, yr) = left[i], right[j]
            r = rank.get(x << 32 | y)
            if r is not None and r < xr and r <= yr:
                return False
            if xr == yr == _INF:
                return True
            if xr <= yr:
                i += 1
            else:
                j += 1

    def _test(self, p: int) -> bool:
        """Remembers whether the pair p (first token << 20 | second token) is compatible."""
        if len(self.good) + len(self.bad) > CACHE_PAIRS:
            self.bad.clear()
            self.good.clear()
            self.good.update(_START + i for i in range(len(self.bytes_of)))
        ok = self.compatible(p >> 20, p & 0xFFFFF)
        (self.good if ok else self.bad).add(p)
        return ok

    def words_ids(self, words: list[bytes]) -> Iterator[bytes]:
        """Packed ids of pre-tokens, which are in sorted order: a word keeps the table of the prefix that it shares
        with the word before it."""
        steps, outputs, step = self.automaton.steps, self.automaton.outputs, self.automaton.step
        good, bad, test = self.good, self.bad, self._test
        room = 1 + max(map(len, words), default=0)
        # by prefix length: its last token << 20, that token's length, where the automaton is
        last, size, state = [_START] * room, [0] * room, [0] * room
        before = b""
        for word in words:
            i = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                i += 1
            s = state[i]
            for b in word[i:]:
                i += 1
                key = s << 8 | b
                s = steps[key] if key in steps else step(key)
                for k, t, shifted in outputs[s]:
                    p = last[i - k] + t
                    if p in good or (p not in bad and test(p)):
                        break
                else:
                    raise ValueError("no token fits a prefix")
                last[i] = shifted
                size[i] = k
                state[i] = s
            before, ids = word, []
            while i:
                ids.append(last[i] >> 20)
                i -= size[i]
            ids.reverse()
            yield array("I", ids).tobytes()

    def pretokens(self, piece: str) -> list[str | int]:
        """The pre-tokens of a piece; special strings stand as their ids."""
        if self.splitter is None:
            return self.pretoken.findall(piece)
        out: list[str | int] = []
        at = 0
        for m in self.splitter.finditer(piece):
            out += self.pretoken.findall(piece[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.pretoken.findall(piece[at:])

    def _fill(self, missing: list[str]) -> list[bytes]:
        """Packed ids of pieces."""
        cut = [None if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else [w if isinstance(w, int) else w.encode() for w in self.pretokens(p)] for p in missing]
        words = {p.encode() for p, ws in zip(missing, cut, strict=True) if ws is None}
        for ws in filter(None, cut):
            words.update([w for w in ws if isinstance(w, bytes)])
        ordered = sorted(words)
        ids = dict(zip(ordered, self.words_ids(ordered), strict=True))
        return [ids[p.encode()] if ws is None else b"".join([w.to_bytes(4, "little") if isinstance(w, int) else ids[w] for w in ws]) for p, ws in zip(missing, cut, strict=True)]

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """Ids of each of a column of whole texts, without nulls, as little-endian unsigned 32-bit integers."""
        return binaries(*self.pieces.ids(texts))

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]))[0].as_py()


_LOADED: dict[tuple[str, type], TokenBytes] = {}


def loaded(path: str, kind: type = PrefixBpe) -> TokenBytes:
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = kind(path)
    return _LOADED[path, kind]


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """keep (all others by default) and ids_col: the ids of text_col as packed little-endian unsigned 32-bit binary."""
    src, fields, at = with_text(df, [c for c in (df.columns if keep is None else keep) if c not in (text_col, ids_col)], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for whole in batches:
            for b in by_bytes(whole, at):
                yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], model.encode_column(b.column(at).fill_null(""))], [*[f.name for f in fields], ids_col])

    return src.mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.BinaryType())]))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The columns of df with text_col, the text that the ids stand for (special tokens included; null: empty)."""
    fields = [f for f in df.schema.fields if f.name != text_col]
    at = [f.name for f in fields].index(ids_col)
    src = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path, TokenBytes)
        for whole in batches:
            for b in by_bytes(whole, at):
                yield pa.RecordBatch.from_arrays([*b.columns, model.decode_column(b.column(at).fill_null(b""))], [*[f.name for f in fields], text_col])

    return src.mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))


def digest(df: DataFrame, path: str) -> DataFrame:
    """op1: doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, through encoding and decoding."""
    coded = bpe_decode(bpe_encode(df, path, keep=["doc_id"]), path)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
