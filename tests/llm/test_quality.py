import re
from collections import Counter

from markhive.llm import quality
from markhive.llm.quality import Measures, Rule

from .conftest import ODD, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_base_measures(odd, empty):
    rows = quality.assess(odd).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((str(i), *plain(t)) for i, t, *_ in ODD)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.assess(empty).count() == 0


def test_measures_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(docs).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs.collect()}


def test_many_distinct_words():
    text = " ".join(f"w{i}" for i in range(1_100_000)) + " w0 w1 w2"
    assert Measures(text.encode()).n_repeat_words == 6


def test_order_is_rejection_per_cost():
    a, b, c = (Rule(n, lambda m: False) for n in "abc")
    # a rejects most for its cost; b rejects nothing that a leaves; c is dear
    order = quality.best_order((c, b, a), {0b110: 50, 0b101: 30, 0b001: 5, 0: 100}, [50.0, 1.0, 1.0])
    assert [r.name for r in order] == ["a", "c", "b"]


def test_cascade_stops_at_the_first_rejection():
    asked = []

    def rule(name, verdict):
        return Rule(name, lambda m: asked.append(name) or verdict)

    assert quality.first_rejection(Measures(b"x"), (rule("a", False), rule("b", True), rule("c", True))) == "b"
    assert asked == ["a", "b"]


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r.doc_id: r.kept for r in quality.assess(docs, quality.RULES).collect()}
    two = {r.doc_id: r.kept for r in quality.assess(docs, quality.RULES[::-1]).collect()}
    assert one == two == {r.doc_id: r.kept for r in quality.assess(docs).collect()}


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    found = quality.assess(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


def test_kept_documents_keep_their_columns(spark, odd):
    text = " ".join(f"some{i} words{i}" for i in range(60))
    docs = frame(spark, {1: text, 2: "Bad*** words### " * 40, 3: None})
    kept = quality.keep_good(docs.withColumnRenamed("lang", "rejected_by"))
    assert kept.columns == ["doc_id", "text", "rejected_by", "source", "n_chars"]
    assert [r.doc_id for r in kept.collect()] == [1]
    assert {r.doc_id for r in quality.keep_good(odd).collect()} == {7, 8}
