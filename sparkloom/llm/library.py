"""Whole texts through a tokenizer library, cut at safe places so that repeated pieces are encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np

from .pieces import CACHE_CHARS, MARKS, Pieces, cut_nowhere, cut_pretokens, cut_spaces, cut_words, plain

#: Short pieces, and bytes of longer ones, handed to the library at once.
BATCH_PIECES, BATCH_BYTES = 8192, 1 << 20

Encoder = Callable[[list[str]], list[bytes]]


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def batches(pieces: list[str]) -> Iterator[list[int]]:
    """Numbers of pieces: so many short ones at once, long ones (UTF-8 takes four bytes a character at most) by bytes."""
    short = [i for i, p in enumerate(pieces) if len(p) <= CACHE_CHARS]
    for k in range(0, len(short), BATCH_PIECES):
        yield short[k : k + BATCH_PIECES]
    batch, held = [], 0
    for i in [i for i, p in enumerate(pieces) if len(p) > CACHE_CHARS] if len(short) < len(pieces) else ():
        if batch and held + 4 * len(pieces[i]) > BATCH_BYTES:
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += 4 * len(pieces[i])
    if batch:
        yield batch


def _batched(encode: Callable[[list[str]], list[list[int]]]) -> Encoder:
    def run(pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        for batch in batches(pieces):
            for i, ids in zip(batch, encode([pieces[i] for i in batch]), strict=True):
                out[i] = packed(ids)
        return out

    return run


def _word_ends(model: Any, spec: dict, encode: Encoder) -> Encoder:
    """For a vocabulary that marks the ends of words: plain words are encoded as one text and told apart by the ids that
    end a word. Plain is what the normalizer leaves as it is and the pattern keeps whole; all else goes through encode."""
    from tokenizers import Tokenizer, pre_tokenizers

    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    ends = np.zeros(1 + max(vocab.values()), bool)
    ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
    bare = Tokenizer(model.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def lowered(w: str) -> bool:
        if w.isascii():
            return w.islower()
        return w == w.lower() and "\u03a3" not in w and unicodedata.is_normalized("NFC", w)

    def run(pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        words = [i for i, w in enumerate(pieces) if w.isalpha() and len(w) <= CACHE_CHARS and lowered(w)]
        for k in range(0, len(words), BATCH_PIECES):
            part = words[k : k + BATCH_PIECES]
            ids = np.array(bare.encode_batch_fast([" ".join([pieces[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ends[ids]) + 1
            if len(at) != len(part):
                raise ValueError("a word doesn't end in one marked id")
            raw, last = ids.tobytes(), 0
            for i, end in zip(part, (4 * at).tolist(), strict=True):
                out[i] = raw[last:end]
                last = end
        rest = sorted(set(range(len(pieces))).difference(words))
        for i, x in zip(rest, encode([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return run


def _json_pieces(path: str) -> Pieces:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    spec = json.load(open(path, encoding="utf-8"))
    encode = _batched(lambda batch: [e.ids for e in model.encode_batch_fast(batch, add_special_tokens=False)])
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = before.get("pretokenizers", [before])
    breaks = re.compile(rf"\s|[A-Za-z][{re.escape(MARKS.decode())}]|^[^<]*$")
    if any(breaks.search(a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
        return Pieces(cut_nowhere, encode)
    if not norm and steps[0].get("type") == "ByteLevel" and steps[0].get("use_regex") and not steps[0].get("add_prefix_space"):
        return Pieces(cut_pretokens, encode)
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
    lowers = [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if drops and lowers:
        return Pieces(cut_spaces, _word_ends(model, spec, encode) if spec["model"].get("end_of_word_suffix") else encode, plain)
    return Pieces(cut_nowhere, encode)


def _model_pieces(path: str) -> Pieces:
    """A sentencepiece file. A space between words is a safe place if no piece of the vocabulary has one past its start
    and what stands after it encodes alone as it does in a text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crosses = re.compile("[^\u2581]\u2581")
    alone = not any(crosses.search(model.id_to_piece(i)) for i in range(model.vocab_size()))
    alone = alone and all(model.encode(f"a1 {x}") == model.encode("a1") + model.encode(f" {x}") for x in ("b", "2", "Word", "1 x"))
    return Pieces(cut_words if alone else cut_nowhere, _batched(lambda batch: model.encode(batch, num_threads=1)))


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = _model_pieces(path) if path.endswith(".model") else _json_pieces(path)
    return _LOADED[path]
