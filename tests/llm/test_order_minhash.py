import hashlib

import numpy as np
import pytest

from markhive.llm import order_minhash as om

from .conftest import ODD, frame


def numbered(text: str, k: int) -> list[tuple[str, int]]:
    seen, out = {}, []
    for i in range(max(1, len(text) - k + 1)):
        w = text[i : i + k]
        out.append((w, seen.get(w, 0)))
        seen[w] = seen.get(w, 0) + 1
    return out


@pytest.mark.parametrize("text", ["a", "ab", "x" * 40, "abc" * 9, "hello world hello world hello world", "é你😀" * 20])
@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_kmers_are_numbered_by_occurrence(text, k):
    got, want = om._kmers(text, k), numbered(text, k)
    assert len(got) == len(want)
    names = {}
    for h, w in zip(got.tolist(), want, strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(got.tolist())) == len(set(want))


def plain_sketch(text: str) -> np.ndarray:
    """The definition, one k-mer after the other."""
    h = [int(x) for x in om._kmers(text, om.K)]
    mask, step = (1 << 64) - 1, int(om.STEP)

    def spread(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    out = []
    for s, m in enumerate(om._multipliers(om.SKETCHES).tolist()):
        low = sorted(range(len(h)), key=lambda i: h[i] * m & mask)[: om.TUPLE]
        v = s
        for i in sorted(low):
            v = spread((v * step & mask) + h[i] & mask)
        out.append(v >> 32)
    return np.array(out, np.uint32)


def test_sketch_follows_the_definition(monkeypatch):
    texts = ["short", "some text that is a little longer than that", "abc" * 50]
    want = [plain_sketch(t) for t in texts]
    for block in (7, 4096):
        monkeypatch.setattr(om, "BLOCK", block)
        for t, w in zip(texts, want, strict=True):
            assert (om.sketch(t) == w).all()


def test_order_matters():
    a = " ".join(f"left{i}" for i in range(100))
    b = " ".join(f"right{i}" for i in range(100))
    same, moved = om.likeness(om.sketch(a + b), om.sketch(a + b)), om.likeness(om.sketch(a + b), om.sketch(b + a))
    assert same == 1.0 and moved < 0.8
    assert om.likeness(om.sketch(a), om.sketch(b)) == 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    out = []
    for i, (doc, text) in enumerate(zip([r[0] for r in order], texts, strict=True)):
        after = texts[(i + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, other, following = om.sketch(text), om.sketch(edited), om.sketch(after)
        out.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), om._printed(own), om._printed(other), om.likeness(own, other), om.likeness(own, following)))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in om.with_edited(df).collect())


def test_documents_and_their_next_ones(spark, odd, empty):
    assert got(odd) == expected([(r[0], r[1]) for r in ODD])
    assert got(frame(spark, {5: "only one document here"})) == expected([(5, "only one document here")])
    assert om.with_edited(empty).count() == 0


def test_real_documents_over_any_number_of_ranges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 8, 61):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert got(docs.repartition(5)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edited_copies_are_nearer_than_other_documents(spark):
    rows = om.with_edited(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_fingerprints_keep_other_columns(odd):
    df = om.fingerprints(odd.withColumnRenamed("lang", "__text"))
    assert df.columns == ["doc_id", "text", "__text", "source", "n_chars", "fingerprint"]
    prints = {r.text: r.fingerprint for r in df.collect()}
    assert prints[None] == prints[""] == "0" * 8 * om.SKETCHES
