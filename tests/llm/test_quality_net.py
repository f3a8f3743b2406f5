"""The byte network: chunks, gradients, held-out accuracy, odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from markhive.llm import quality_net as net
from markhive.llm import queries

from .conftest import frame

SF01 = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 511, 512, 513, 960, 961, 5000)]
    numbers, place, owner = net.cut(texts)
    for k, text in enumerate(texts):
        own = place[owner == k]
        first = own[0]
        covered = np.zeros(max(len(text), net.CHUNK), bool)
        for p in own:
            chunk = numbers[p : p + net.CHUNK]
            raw = text[p - first : p - first + net.CHUNK]
            assert bytes(chunk[: len(raw)].astype(np.uint8)) == raw and (chunk[len(raw) :] == net.FILL).all()
            covered[p - first : p - first + net.CHUNK] = True
        assert covered.all()
        assert all(b - a <= net.CHUNK - net.OVERLAP for a, b in zip(own, own[1:], strict=False))


def _loss(own, chunks, owner, good):
    response, _ = own.strongest(chunks)
    features = own.over_chunks(response)
    starts = np.searchsorted(owner, np.arange(len(good)))
    pooled = np.concatenate([np.maximum.reduceat(features, starts), np.add.reduceat(features, starts) / np.bincount(owner)[:, None]], axis=1)
    z = pooled.astype(float) @ own.out + own.base
    return float(np.mean(good * np.log1p(np.exp(-z)) + (1 - good) * np.log1p(np.exp(z))))


def test_gradients_are_differences():
    rng = np.random.default_rng(3)
    own = net.Network.fresh(rng)
    chunks = rng.integers(0, 256, size=(7, net.CHUNK)).astype(np.int16)
    owner, good = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1, 0, 1, 0], np.float32)
    for values, gradient in zip(own.parameters, own.gradients(chunks, owner, good), strict=True):
        assert values.shape == gradient.shape
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        kept = values[at]
        values[at] = kept + 3e-3
        above = _loss(own, chunks, owner, good)
        values[at] = kept - 3e-3
        below = _loss(own, chunks, owner, good)
        values[at] = kept
        assert (above - below) / 6e-3 == pytest.approx(gradient[at], rel=2e-2)


def test_a_score_is_of_the_whole_text():
    rng = np.random.default_rng(5)
    own = net.Network.fresh(rng)
    text = bytes(rng.integers(97, 123, 40_000, dtype=np.uint8))
    changed = text[:-300] + bytes(rng.integers(33, 48, 300, dtype=np.uint8))
    alone, other, empty = own.probability([text]), own.probability([changed]), own.probability([b""])
    assert alone != other and 0 <= empty[0] <= 1
    assert np.allclose(own.probability([b"", text, changed]), [empty[0], alone[0], other[0]])


def test_held_out_accuracy(spark):
    got = queries.op12_quality_classifier(spark, SF01).toPandas()
    documents = spark.read.parquet(f"{SF01}/documents.parquet")
    assert len(got) == documents.count() and list(got.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.95


def test_held_out_labels_are_not_used(spark, monkeypatch):
    monkeypatch.setattr(net, "trained", lambda texts, good: pytest.fail("held-out labels reached the fit") if len(texts) != 1 else net.Network.fresh(np.random.default_rng(0)))
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = frame(spark, {i: f"text {i}" for i in range(60)})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in held], LABELS)
    assert net.learn(docs, labels).share == 0.5


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (10, 1, 1), (10, 0, 1), (None, 1, 0), (7, None, 0), (99, 1, 0), (8, 1, 0)], LABELS)
    monkey = net.learn(odd, labels)
    got = net.judged(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    same = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1  # null and empty texts
    none = labels.where("false")
    assert {r.score for r in net.judged(odd, none).collect()} == {0.5}
    assert {r.score for r in net.judged(odd, labels.where("quality = 1 and doc_id in (1, 4, 8)")).collect()} == {1.0}
    assert net.judged(empty, labels).collect() == []
    clashing = odd.withColumns({"good": F.lit(1), "__text": F.lit(2), "quality": F.lit(3)})
    out = net.score(clashing, monkey)
    assert out.columns == [*clashing.columns, "quality_score"] and out.count() == odd.count()
    with pytest.raises(ValueError):
        net.score(odd, monkey, name="LANG")


def test_a_score_does_not_depend_on_the_texts_beside_it():
    rng = np.random.default_rng(3)
    own = net.Network.fresh(rng)
    own.offset = rng.normal(size=own.offset.shape).astype(np.float32)
    texts = [b"", *(rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in rng.integers(0, 2000, 40).tolist())]
    alone = [own.probability([t])[0] for t in texts]
    for n in range(1, len(texts) + 1):
        assert own.probability(texts[:n]).tolist() == alone[:n]
    assert len(set(own.probability([b""] * 9).tolist())) == 1
