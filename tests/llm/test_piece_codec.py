import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from markhive.llm import piece_codec
from markhive.llm.queries import model_path

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def own():
    return piece_codec.PieceCodec(model_path())


def strange(n: int) -> list[str]:
    rnd = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "▁", "é", "你", "😀", "\t", "the ", "ing", "\0", "\u00a0", "xxxxx", " " * 17, "0", "12", "\ufffd", "İ"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_equals_the_library(own, library):
    texts = ["", " ", "▁", "a" * 1000, "ab" * 700, " " * 300, "你好世界" * 200, "Hello  world ", *strange(1500)]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [own.decode(x) for x in ids] == library.decode([x.tolist() for x in ids])


def test_decodes_any_ids(own, library):
    rnd = random.Random(4)
    for _ in range(1500):
        ids = [rnd.choice([0, 1, 2, 259, 29871, *range(3, 259), 5000]) for _ in range(rnd.randrange(1, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED_BYTES", 4000)
    own = piece_codec.PieceCodec(model_path())
    for text in strange(50):
        assert own.encode([text])[0].tolist() == library.encode(text)


def test_heap_and_rounds_agree(own):
    words = ["▁" + "abcdefgh"[i % 7 :] * (1 + i % 5) for i in range(60)]
    sym, sizes = own._merge_rounds(words)
    for w, s in zip(words, np.split(sym, np.cumsum(sizes)[:-1]), strict=True):
        assert own._merge_long(w).tolist() == s.tolist()


def test_digests_of_odd_rows(odd, empty, library):
    rows = piece_codec.digests(odd, model_path()).collect()
    assert len(rows) == len(ODD)
    expected = sorted((str(i), len(ids := library.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert piece_codec.digests(empty, model_path()).count() == 0


def test_round_trip_keeps_other_columns(odd):
    clash = odd.withColumn("__text", F.lit("kept"))
    back = piece_codec.decode(piece_codec.encode(clash, model_path()), model_path())
    assert set(back.columns) == set(clash.columns)
    got = {(r["doc_id"], r["__text"], r["text"]) for r in back.collect()}
    assert got == {(i, "kept", (t or "").replace("▁", " ")) for i, t, *_ in ODD}
    both = piece_codec.there_and_back(clash, model_path())
    assert set(both.columns) == {*clash.columns, "ids"}
    want = {(r["doc_id"], tuple(r["ids"])) for r in piece_codec.encode(clash, model_path()).collect()}
    assert {(r["doc_id"], tuple(r["ids"])) for r in both.collect()} == want
    assert {(r["doc_id"], r["__text"], r["text"]) for r in both.collect()} == got
    with pytest.raises(ValueError):
        piece_codec.encode(odd.withColumn("ids", F.lit(1)), model_path())
