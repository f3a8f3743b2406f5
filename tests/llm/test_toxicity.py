import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from markhive.llm import toxicity

from .conftest import ODD, frame

BAD = ["idiot", "moron", "trash", "worthless"]


def corpus(n: int, seed: int = 1) -> tuple[dict[int, str], dict[int, int]]:
    rnd = random.Random(seed)
    plain = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "ou"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    texts, toxic = {}, {}
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 80))]
        toxic[i] = int(rnd.random() < 0.3)
        if toxic[i]:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        texts[i] = " ".join(words)
    return texts, toxic


@pytest.fixture(scope="module")
def scorer(spark):
    texts, toxic = corpus(1200)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    return toxicity.learn(frame(spark, texts), labels)


DISGUISED = {
    "1d10t": "idiot", "id1ot": "idiot", "idiooot": "idiot", "i.d.i.o.t": "idiot", "i-d-i-o-t": "idiot", "m0r0n": "moron", "mor***on": "moron", "tr@sh": "trash", "tra$h": "trash", "w0rthl3ss": "worthless",
}


def test_disguised_words_are_restored(scorer):
    assert {w: scorer.chars.restore(w) for w in DISGUISED} == DISGUISED
    assert "idiot" in scorer.chars.words("such an i d i o t here")
    assert "idiot" in scorer.chars.words("IDIOT### ...")
    assert scorer.chars.words("plain words stay good") == {"plain", "words", "stay", "good"}


EDGES = {
    "$tupid": "stupid", "stup!d!": "stupid", "a$$": "ass", "@$$": "ass", "(a$$)": "ass", "@sshole": "asshole", "1d10t$": "idiot", "idiot!": "idiot", "1d10t!!": "idiot", "fµck": "fuck",
    "i d ! o t": "idiot", "s h ! t": "shit", "s. h. ! t.": "shit", "i! d! i! o! t!": "idiot", "i d , i o t": "idiot", "a $ $": "ass",
}


def test_symbols_at_edges_and_in_spaced_words_reach_the_features(spark):
    texts = dict(enumerate([*corpus(300)[0].values(), *["stupid ass asshole idiot shit fuck"] * 300]))
    known = toxicity._Known(toxicity.char_model(frame(spark, texts)))
    for written, word in EDGES.items():
        held = next(known.features([f"such {written} one"]))
        wanted = toxicity.word_features([word])[1]
        assert np.isin(wanted, held).all(), written
    # numbers and plain words stay what they are
    assert known.model.restored("2024") == set() and known.model.restored("such") == {"such"}
    assert known.model.restored("such,") == {"such"} and "such" in known.model.restored("such!")


def best_by_trying_all(model: toxicity.CharModel, word: str) -> str:
    """The lattice's best path by listing all of them."""
    paths = [("", 0.0)]
    for i, c in enumerate(word):
        moves = ([(c, 0.0)] if c.isalpha() else []) + [(x, toxicity.COSTS["stands"]) for x in toxicity.STANDS_FOR.get(c, "")]
        skip = toxicity.COSTS["lost" if c.isalpha() else "digit" if c.isalnum() else "noise"]
        if i and c == word[i - 1]:
            skip = min(skip, toxicity.COSTS["repeat" if c * 3 in word else "pair"])
        moves = [*(moves or [(c, toxicity.COSTS["lost"])]), ("", skip)]
        paths = [(p + x, s - cost) for p, s in paths for x, cost in moves]

    def total(p, s):
        k = [0, 0, *map(model.code, p), 0]
        return s + sum(float(model.logs[k[j], k[j + 1], k[j + 2]]) for j in range(len(k) - 2))

    return max(total(*p) for p in paths)


def test_viterbi_takes_the_best_path(scorer):
    model = scorer.chars
    for w in ["1d10t", "tr@sh", "a1!b", "th33", "0", "x*y", "ooo"]:
        found = model.restore(w)
        # the cost of the path found is not kept: find it among all paths that spell the same
        paths = best_by_trying_all(model, w)
        assert paths >= max(-1e9, best_spelled(model, w, found) - 1e-3) and best_spelled(model, w, found) >= paths - 1e-3


def best_spelled(model, word, spelled):
    """The best score among the lattice's paths that spell ``spelled``."""
    best = {0: 0.0}
    for i, c in enumerate(word):
        moves = ([(c, 0.0)] if c.isalpha() else []) + [(x, toxicity.COSTS["stands"]) for x in toxicity.STANDS_FOR.get(c, "")]
        skip = toxicity.COSTS["lost" if c.isalpha() else "digit" if c.isalnum() else "noise"]
        if i and c == word[i - 1]:
            skip = min(skip, toxicity.COSTS["repeat" if c * 3 in word else "pair"])
        moves = [*(moves or [(c, toxicity.COSTS["lost"])]), ("", skip)]
        after = {}
        for at, s in best.items():
            for x, cost in moves:
                if spelled.startswith(x, at):
                    to = at + len(x)
                    after[to] = max(after.get(to, -1e18), s - cost)
        best = after
    k = [0, 0, *map(model.code, spelled), 0]
    return best[len(spelled)] + sum(float(model.logs[k[j], k[j + 1], k[j + 2]]) for j in range(len(k) - 2))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.judged(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= 0.8 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    texts, toxic = corpus(400)
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = {i: 1 - t if i in held else t for i, t in toxic.items()}
    docs = frame(spark, texts)
    a, b = (sorted((r.doc_id, r.held_out, r.score) for r in toxicity.judged(docs, spark.createDataFrame(list(x.items()), "doc_id long, toxic int")).collect()) for x in (toxic, wrong))
    assert a == b and {i for i, h, _ in a if h} == held


def test_odd_rows(spark, odd, empty, scorer):
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.judged(empty, labels).count() == 0
    assert all(r.score < 1e-8 for r in toxicity.judged(odd, labels.limit(0)).collect())
    clash = toxicity.score(odd.withColumn("__text", F.lit(1)), scorer)
    assert clash.columns == [*odd.columns, "__text", "toxicity"]


def test_rejected_documents_go(spark):
    texts, toxic = corpus(600)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    kept = toxicity.without_toxic(frame(spark, texts).withColumn("toxicity", F.lit("x")), labels)
    assert "toxicity" in kept.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in toxic.items() if not t}


def test_regression_separates():
    held = [[0], [0, 1], [1], [], [2], [0, 2]] * 20
    y = np.array([1, 1, 0, 0, 0, 1] * 20, float)
    row, column = np.array([(i, p) for i, h in enumerate(held) for p in h]).T
    w, b = toxicity.fitted(row, column, y, 3)
    p = [1 / (1 + np.exp(-(b + sum(w[k] for k in h)))) for h in held]
    assert all((q > 0.9) == bool(t) for q, t in zip(p, y, strict=True))


def test_a_very_long_token_is_decoded_in_linear_time():
    import time

    model = toxicity.CharModel({chr(97 + i): i + 2 for i in range(26)}, np.log(np.random.default_rng(0).random((28, 28, 28))).astype(np.float32))
    for word in ("a0" * 500_000, "ii1" * 333_333, "x" * 1_000_000):
        began = time.perf_counter()
        model._viterbi(word)
        assert time.perf_counter() - began < 10


def test_what_is_remembered_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED_BYTES", 1 << 14)
    model = toxicity.CharModel({"a": 2}, np.zeros((3, 3, 3), np.float32))
    known = toxicity._Known(model)
    for k in range(200):
        list(known.features([" ".join(f"{'a0' * 20}{k}x{i}" for i in range(9))]))
        assert known.held < (1 << 14) + 9 * 2000 and len(known.seen) < 200 and len(model.known) < 200
