import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from markhive.llm import elias_fano, ngram_lm
from markhive.llm.common import stored

from .conftest import ODD, frame


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 7, 64, 65, 1 << 50], list(range(0, 5000, 3)), sorted(random.Random(1).sample(range(1 << 60), 999))])
def test_elias_fano_round_trip(values):
    level = elias_fano.pack(np.array(values, np.int64))
    assert elias_fano.unpack(level).tolist() == values
    assert elias_fano.unpack(memoryview(level)).tolist() == values


@pytest.mark.parametrize("top, n", [(1, 40), (60, 300), (1 << 20, 500), (1 << 61, 200), (5, 0)])
def test_levels_are_searched_in_place(top, n):
    rnd = random.Random(top)
    values = sorted(rnd.choices(range(top), k=n))
    level = elias_fano.Level(b"12345678" + elias_fano.pack(np.array(values, np.int64)), 8)
    asked = [*values, *(rnd.randrange(top) for _ in range(200)), 0, top, 1 << 61]
    bounds = [sorted(rnd.choices(range(n + 1), k=2)) for _ in asked]
    want = [next((i for i in range(a, b) if values[i] == x), -1) for x, (a, b) in zip(asked, bounds, strict=True)]
    begin, end = np.array(bounds).T
    assert level.search(np.array(asked), begin, end).tolist() == want
    order = [rnd.randrange(n) for _ in range(n)]
    assert level.values(np.array(order, np.int64)).tolist() == [values[i] for i in order]


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 100_000))
    assert len(elias_fano.pack(values)) < 100_000 * (30 - 16 + 3) / 8


def test_trie_finds_what_it_holds():
    rnd = random.Random(2)
    contexts = np.array(sorted(rnd.sample(range(1 << 62), 50)), np.int64)
    pairs = {(rnd.randrange(50), rnd.randrange(1 << 40)): rnd.randrange(1, 256) for _ in range(2000)}
    keys = np.array(sorted(c << 40 | s for c, s in pairs), np.int64)
    codes = np.array([pairs[k >> 40, k & (1 << 40) - 1] for k in keys.tolist()])
    trie = elias_fano.Trie.build(contexts, keys, codes)
    asked = [*pairs, *((c, s + 1) for c, s in pairs)]
    got = trie.find(contexts[[c for c, _ in asked]], np.array([s for _, s in asked]))
    assert got.tolist() == [pairs.get(a, 0) for a in asked]
    assert trie.find(contexts[:3] + 1, np.array([1, 2, 3])).tolist() == [0, 0, 0]
    empty = elias_fano.Trie.build(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    assert empty.find(np.array([4]), np.array([4])).tolist() == [0]


def plain(rows: list[tuple]) -> list[tuple]:
    """The model's definition with dictionaries, without quantising."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, before = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            for a, b in zip(["<s>", *t], t, strict=False):
                two[a, b] += 1
                before[a] += 1
    types = Counter(a for a, _ in two)
    n, v = sum(one.values()), len(one)
    n1, n2 = (sum(c == k for w, c in one.items() if w is not None) for k in (1, 2))
    d1 = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for (i, _), t, h in zip(rows, tokens, held, strict=True):
        score = 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            p1 = (one[b] - d1) / n if one[b] else d1 * v / n if n else 1.0
            p = max(two[a, b] - 0.75, 0) / before[a] + 0.75 * types[a] / before[a] * p1 if before[a] else p1
            score += math.log10(p)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        out.append((str(i), h, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return sorted(out)


def check(df, rows):
    got = sorted((str(r[0]), *r[1:]) for r in ngram_lm.score(df).collect())
    want = plain(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        # a step of the quantiser is 0.0315 in log10; codes are rounded down
        assert -1e-6 <= w[6] - g[6] <= 0.032 * g[2]


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_small_blocks_and_hot_contexts(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK", 700)
    monkeypatch.setattr(ngram_lm, "CELL", 300)
    monkeypatch.setattr(ngram_lm, "HOT", 400)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 80")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd, empty):
    check(odd, [(r[0], r[1]) for r in ODD])
    assert ngram_lm.score(empty).count() == 0


def test_no_training_documents(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = ngram_lm.score(frame(spark, {i: "some words" for i in held})).collect()
    assert [(r.held_out, r.train_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(True, 0, 0, 0.0, 0.0)] * 3


def test_probabilities_sum_to_one_at_most():
    p = np.array([1e-9, 1e-8, 0.001, 0.02, 0.5, 1.0])
    assert (ngram_lm.VALUES[ngram_lm.quantised(p)][1:] <= p[1:] * (1 + 1e-12)).all()


def test_held_out_texts_beat_the_base(spark):
    rows = [r for r in ngram_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_a_cell_asks_its_trie_for_some_bigrams_at_a_time(monkeypatch):
    rnd = np.random.default_rng(1)
    rows, want = [], Counter()
    for block in range(3):
        contexts = np.unique(rnd.integers(0, 20, 12))
        bigrams = [(c, s) for c in contexts.tolist() for s in np.unique(rnd.integers(0, 30, 8)).tolist()]
        sizes = np.array([sum(c == x for c, _ in bigrams) for x in contexts], np.uint32)
        successors = b"".join(s.to_bytes(5, "little") for _, s in bigrams)
        rows.append((block, contexts.tobytes(), sizes.tobytes(), successors, np.full(len(bigrams), block, np.uint32).tobytes(), None))
        want.update({b: block for b in bigrams})
    most, whole = [], elias_fano.Trie.codes_after
    monkeypatch.setattr(elias_fano.Trie, "codes_after", lambda self, place, successor: most.append(len(place)) or whole(self, place, successor))
    none = np.empty(0, np.int64)
    at_once = ngram_lm._answer(0, rows, (none, none))
    monkeypatch.setattr(ngram_lm, "ASKED", 7)
    most.clear()
    assert ngram_lm._answer(0, rows, (none, none)).equals(at_once)
    assert max(most) == 7 and sum(most) == len(want)
    # a context that is not split makes a cell no more than twice as large
    assert ngram_lm.HOT <= ngram_lm.CELL


def cell_rows(n_blocks: int, n_contexts: int, n_successors: int, parts: bytes | None = None) -> list[tuple]:
    rnd = np.random.default_rng(n_blocks)
    rows = []
    for block in range(n_blocks):
        contexts = np.unique(rnd.integers(0, 1 << 40, n_contexts) % (3 * n_contexts))
        sizes = rnd.integers(1, n_successors, len(contexts)).astype(np.uint32)
        successors = np.concatenate([np.sort(rnd.choice(4 * n_successors, n, replace=False)) for n in sizes])
        raw = np.ascontiguousarray(successors.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        rows.append((block, contexts.tobytes(), sizes.tobytes(), raw, rnd.integers(0, 3, len(successors)).astype(np.uint32).tobytes(), parts))
    return rows


@pytest.mark.parametrize("most", [1, 13, 60, 10_000])
def test_a_cell_is_answered_by_ranges_of_contexts(monkeypatch, most):
    # the second context of each block is a part of a hot word
    rows = cell_rows(5, 20, 9, np.array([[1, 0]], np.int32).tobytes())
    hot = np.array([77]), np.array([1000])
    whole = ngram_lm._answer(0, rows, hot)
    sizes, one = [], ngram_lm._answer_range
    monkeypatch.setattr(ngram_lm, "RANGE", most)
    monkeypatch.setattr(ngram_lm, "_answer_range", lambda names, of, *rest: sizes.append((len(names), len(of))) or one(names, of, *rest))
    assert ngram_lm._answer(0, rows, hot).equals(whole)
    assert all(contexts == 1 or bigrams <= most for contexts, bigrams in sizes)
    assert sum(bigrams for _, bigrams in sizes) == sum(len(r[3]) for r in rows) // 5


def test_memory_of_a_cell_follows_its_ranges():
    rows = cell_rows(240, 250, 80)
    sent = sum(len(x) for r in rows for x in r[1:5])
    assert sent > 15 << 20
    none = np.empty(0, np.int64)
    tracemalloc.start()
    ngram_lm._answer(0, rows, (none, none))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * sent


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_answers_follow_their_block_over_batches(size):
    def block(number: int, texts: list[int]) -> dict:
        words = np.array(texts, np.uint64)
        return {"block": number, "cell": None, "doc_ids": [None], "held": b"\0", "sizes": np.array([len(words)]).tobytes(), "words": words.tobytes(), "tokens": bytes(range(len(words)))}

    rows = [block(1, [5, 6]), *({"block": 1, "cell": c, "codes": bytes([c]), "totals": b"t", "types": b"y"} for c in (0, 3, 4)), block(2, [7]), block(3, [8]), {"block": 3, "cell": 2, "codes": b"c", "totals": b"t", "types": b"y"}]
    schema = pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("held", "sizes", "words", "tokens", "codes", "totals", "types"))])
    whole = pa.Table.from_pylist(rows, schema)
    got = [(b.words.tolist(), b"".join(codes), len(totals), len(types)) for b, codes, totals, types in ngram_lm._answered(whole.to_batches(size))]
    assert got == [([5, 6], b"\0\3\4", 3, 3), ([7], b"", 0, 0), ([8], b"c", 1, 1)]


def test_a_blocks_answers_are_no_list_in_one_row(spark):
    plan = ngram_lm.score(frame(spark, {i: f"a b c{i}" for i in range(20)}))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and "Join" not in plan


@pytest.mark.parametrize("top", [1, 2, 256, 257, 65_536, 65_537, 1 << 24, (1 << 24) + 1])
def test_tokens_of_a_block_in_planes(top):
    tokens = np.array([0, top - 1, top // 2, 0])
    raw = ngram_lm._planes(tokens, top)
    row = pa.RecordBatch.from_pylist([{"words": b"", "sizes": np.array([4]).tobytes(), "held": b"\1", "tokens": raw}])
    assert ngram_lm._Block(row, 0).tokens.tolist() == tokens.tolist()


def test_wide_rows_are_stored_in_small_row_groups(spark, monkeypatch):
    files = stored(spark.range(10).coalesce(1), "test-rows", 3).inputFiles()
    (own,) = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert [own.row_group(i).num_rows for i in range(own.num_row_groups)] == [3, 3, 3, 1]
    limits = {}
    monkeypatch.setattr(ngram_lm, "stored", lambda df, name, rows=None: limits.setdefault(name, rows) and stored(df, name, rows))
    ngram_lm.score(frame(spark, {1: "a b", 2: "b c"}))
    assert limits == {"lm-blocks": 1, "lm-answers": ngram_lm.ANSWERS}


def test_the_requests_shuffle_goes_before_the_last_one(spark, monkeypatch):
    names = []
    monkeypatch.setattr(ngram_lm, "stored", lambda df, name, rows=None: names.append(name) or stored(df, name, rows))
    monkeypatch.setattr(ngram_lm, "drop_shuffles", lambda s: names.append("dropped"))
    ngram_lm.score(frame(spark, {1: "a b", 2: "b c"}))
    assert names == ["lm-blocks", "lm-answers", "dropped"]
