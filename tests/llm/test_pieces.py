"""Texts cut into pieces give the libraries' ids, whatever they hold."""

import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkloom.llm import bpe, library, pieces

#: Words, marks, all kinds of white space, combining marks, special strings whole, in parts and in other cases.
ATOMS = [
    "a", "B", "foo", "Bar's", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "\x85", "\u00a0", "\u1680", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "\ufeff",
    ".", ",", "...", ";", "!", "?", "'s", "'T", "1", "23", "\u00e9", "e\u0301", "\u0301", "J\u030c", "\u01f0", "\u0391\u03a3", "\u03a3", "\u0130", "\u0345", "\u017f", "\u00df", "\u1e9e", "\u65e5\u672c", "\U0001f600",
    "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "<s>", "</s>", "<unk>", "\u2581", "-", "_", "(", '"',
]


def fuzzed(seed, n=6000):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ATOMS) for _ in range(rnd.randrange(0, 16))) for _ in range(n)] + ["", "Ab. " * 3000 + "<|endoftext|>", "x" * 70_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_fuzzed_texts(name, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PIECES", 500)
    model, t = library.loaded(P.path(name)), Tokenizer.from_file(P.path(name))
    for seed in (1, 2):
        texts = fuzzed(seed)
        want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        flat, n = model.ids(pa.array(texts))
        assert n.tolist() == list(map(len, want)) == model.counts(pa.array(texts)).tolist()
        assert flat.tolist() == [i for ids in want for i in ids]


def test_bpe_and_decoding_of_fuzzed_texts():
    model, t = bpe.loaded(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = fuzzed(3)
    want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    ids = model.encode_column(pa.array(texts))
    assert ids.to_pylist() == [struct.pack(f"<{len(x)}I", *x) for x in want]
    assert model.decode_column(ids).to_pylist() == [t.decode(x, skip_special_tokens=False) for x in want]


def test_sentencepiece_counts_of_fuzzed_texts():
    path = P.path("piece_bpe_32k.model")
    m, texts = sentencepiece.SentencePieceProcessor(model_file=path), fuzzed(4, 2000)
    assert library.loaded(path).counts(pa.array(texts)).tolist() == [len(m.encode(t)) for t in texts]


def test_slices_of_columns():
    texts = pa.array(["aa", "", "b" * 10, "c", "dd", ""])
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    assert [b.column(0).to_pylist() for b in pieces.by_bytes(batch.slice(1), 0, 3)] == [[""], ["b" * 10], ["c", "dd", ""]]
    assert list(pieces.by_bytes(batch.slice(0, 0), 0, 3)) == []
    data, offsets = pieces.column_bytes(texts.slice(3, 2))
    assert data.tobytes() == b"cdd" and offsets.tolist() == [0, 1, 3]
    assert pieces.gathered(np.arange(10), np.array([3, 0, 7]), np.array([2, 0, 3])).tolist() == [3, 4, 7, 8, 9]
