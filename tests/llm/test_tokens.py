"""Packing and SentencePiece against the libraries' own results."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from functools import cache

import helpers
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, sentencepieces, tokens

TEXTS = st.text(alphabet=st.sampled_from(list(" \n\tabcdezé.,'<>|/s▁ß日本😀\x00 　\x1c0123")), max_size=60)


@cache
def plain_library():
    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def library():
    return plain_library()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_are_those_of_the_whole_text(texts):
    encoder = tokens.encoder(tokens.default_path())
    ours = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert ours == [plain_library().encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("text", [" a b ", "  a b", " ", "  ", "a\nb c.\nd", "it's 'em, a.b. \n", "a \x1c b", "x\u3000 y",
    "<|endoftext|> a", "a b <|endoftext|> c", "x<|endoftext|><|endoftext|> y", "<|endoftext| > a", "z" * 200 + " " + "z" * 200])
def test_cuts(text):
    ours = np.frombuffer(tokens.encoder(tokens.default_path()).encode([text])[0], "<u4").tolist()
    assert ours == plain_library().encode(text, add_special_tokens=False).ids


def check_packed(rows, docs, library, size=packing.SIZE):
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(r["length"] for r in rows)


def test_packing(spark, sf_dir, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    padding, total = check_packed(packing.op2_packing(spark, sf_dir).collect(), docs, library)
    assert padding < 0.01 * total
    many = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(40)
    padding, total = check_packed(packing.pack(many).collect(), docs, library)
    assert padding < 0.02 * total


def test_packing_awkward(spark, library):
    docs = [(i, t) for i, t in dict(helpers.AWKWARD).items() if i is not None]
    check_packed(packing.pack(helpers.documents(spark, docs, extra=True)).collect(), docs, library)
    assert packing.pack(helpers.empty(spark)).collect() == []
    repeated = packing.pack(helpers.documents(spark, [(5, "a"), (5, "a"), (None, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in repeated) == [(0, 2), (5, 2), (5, 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 6))
def test_windows(lengths, limit):
    """Any lengths: all ids come out once, in sequences that aren't overfull."""
    size, out = 32, packing.Emitter(0)
    windows = packing.Windows(out, size, limit, 4)
    pieces = [(i, 0, bytes(4 * n), n) for i, n in enumerate(lengths)]
    for piece in pieces:
        windows.add(piece)
    assert len(windows.fills) <= limit
    left = [p for _, name in windows.fills for p in windows.held[name]]
    packing.merge_leftovers(left, out, size, 4)
    seen, fills = {}, {}
    for doc, start, length, _, total, sequence, offset in out.rows:
        assert fills.get(sequence, 0) == offset
        fills[sequence] = offset + length
        seen.setdefault(doc, []).append((start, length, total))
    assert all(f <= size and (f > size - 4 or f & (f - 1) == 0) for f in fills.values())
    for i, n in enumerate(lengths):
        at = 0
        for start, length, total in sorted(seen[i]):
            assert start == at and total == n
            at += length
        assert at == n


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_sentencepiece_round(text):
    path = sentencepieces.default_path()
    model = sentencepieces.pieces(path)
    library = test_sentencepiece_round.__dict__.setdefault("t", sentencepiece.SentencePieceProcessor(model_file=path))
    ids = np.frombuffer(model.encode([text])[0], "<u4").tolist()
    assert ids == library.encode(text) and model.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31_999), max_size=12))
def test_decoding_any_ids(ids):
    path = sentencepieces.default_path()
    library = test_sentencepiece_round.__dict__.setdefault("t", sentencepiece.SentencePieceProcessor(model_file=path))
    assert sentencepieces.pieces(path).decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 20_000, "日本" * 4000, "-" * 9999 + "x", " " * 501 + "b"])
def test_words_without_end(text):
    model = sentencepieces.Pieces(sentencepieces.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode(text)


def test_long_words_merge_in_several_places():
    """Random and periodic words of a few letters, by the rounds of long words and by those of short ones."""
    rng = random.Random(6)
    model = sentencepieces.pieces(sentencepieces.default_path())
    for _ in range(300):
        letters = rng.sample("abcdefghinorstuéß日-.", rng.choice([2, 3, 5, 12]))
        word = "".join(rng.choices(letters, k=rng.randrange(2, 700)))
        word = word[: rng.randrange(1, 14)] * rng.randrange(2, 60) if rng.random() < 0.4 else word
        assert model.merge_long(word).tolist() == model.merge([word])[0].tolist()


@pytest.mark.parametrize("kind", ["random", "the", "aab", "a"])
def test_long_words_take_time_in_proportion(kind):
    model = sentencepieces.pieces(sentencepieces.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=80_000))
    text = text if kind == "random" else kind * (80_000 // len(kind))
    model.encode(["warm" * 80])
    began = time.process_time()
    ours = model.encode([text])[0]
    assert time.process_time() - began < 3
    assert np.frombuffer(ours, "<u4").tolist() == library.encode(text)


def test_sentencepiece_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in sentencepieces.op10_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        text = library.decode(ids)
        raw = np.array(ids, "<u4").tobytes()
        expected = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected


def test_sentencepiece_awkward(spark):
    found = sentencepieces.encoded(helpers.awkward(spark)).collect()
    assert len(found) == len(helpers.AWKWARD)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    texts = dict(helpers.AWKWARD)
    for r in found:
        if r["doc_id"] is not None:
            ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["decoded"] == library.decode(ids)
    assert sentencepieces.encoded(helpers.empty(spark)).collect() == []


def test_random_words_merge_alike():
    rng = random.Random(3)
    model = sentencepieces.pieces(sentencepieces.default_path())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_path())
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 14))) for _ in range(20)) for _ in range(100)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == library.encode(texts)
