"""Piece encoding against the library, on the small table, random strings, and edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rankloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def ids_of(own, text):
    return np.frombuffer(own.encode([text])[0], np.uint32).tolist()


def said(own, ids):
    return own.decode(np.array(ids, np.int32), np.array([0, len(ids)]))[0].as_py()


def test_query_equals_library(spark, library):
    got = {r.doc_id: r for r in queries.load()[0]["op11_pieces"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "")
        said = library.decode(ids)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == want


PARTS = [*" ▁\n\tab<>'/x=", "the", " the", "<s>", "<unk>", "<0x0A>", "  ", "    ", "\x00", "�", "😀", "é", "⁇", "한", "ing", "==", "--", "的"]


def test_random_texts(own, library):
    rnd, known = random.Random(7), [t.replace("▁", " ") for t in own.ids]
    for parts, most in ((PARTS, 40), (known, 8)):
        for _ in range(5000):
            text = "".join(rnd.choices(parts, k=rnd.randrange(most)))
            ids = library.encode(text)
            assert ids_of(own, text) == ids, text
            assert said(own, ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 5000, "ab" * 20_000, "한" * 3000, "x" * 40 + " " * 77 + "the", "", " ", "▁", "\n"])
def test_long_words_and_runs(own, library, text):
    assert ids_of(own, text) == library.encode(text)


def test_decode_of_any_ids(own, library):
    rnd = random.Random(8)
    for _ in range(5000):
        ids = [rnd.choice([rnd.randrange(own.size), rnd.randrange(260), own.ids["▁"]]) for _ in range(rnd.randrange(9))]
        assert said(own, ids) == library.decode(ids), ids


def test_decode_of_many_texts(own, library):
    rnd = random.Random(10)
    rows = [[rnd.choice([rnd.randrange(own.size), 1, 2, own.ids["▁"]]) for _ in range(rnd.randrange(5))] for _ in range(2000)]
    starts = np.r_[0, np.cumsum([len(r) for r in rows])]
    assert own.decode(np.array(sum(rows, []), np.int32), starts).to_pylist() == library.decode(rows)
    with pytest.raises(ValueError, match="pieces"):
        said(own, [own.size])


def test_full_memories_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    texts = ["one two three four five one two", "six seven eight one", "one two three"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(texts * 3)] == library.encode(texts * 3)


def test_pairs_are_judged_as_by_merging(own):
    rnd, ids = random.Random(9), list(own.halves)
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        left, right = own.texts[a], own.texts[b]
        assert own.apart(a, b) == (own._merged(left + right)[0] == [left, right])


def test_edges(spark, library):
    rows = [(1, "one two", "x", "y", 5), (2, None, "x", None, 5), (3, "", "x", "y", 5), (1, "one two", "x", "y", 5), (None, " ünï <s> ", "x", "y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string, Decoded string, n_chars int")
    got = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.ids, r.n_tokens, r.decoded, r.n_chars) for r in got) == sorted(
        (i or 0, library.encode(t or ""), len(library.encode(t or "")), library.decode(library.encode(t or "")), 5) for i, t, *_ in rows
    )
    assert pieces.decode(pieces.encode(df.where("false"), PATH), PATH).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([1, None, 2],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd, PATH).collect()] == ["", "", ""]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1]))
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Pieces(str(path))
