import random

import pytest
from pyspark.sql import functions as F

from markhive.llm import mixing

from .conftest import ODD, frame


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Targets by reallocating until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_targets(spark):
    rnd = random.Random(5)
    for _ in range(4):
        sizes = {s: rnd.randrange(0, 10 ** rnd.randrange(1, 6)) for s in ["a", "B", "é", "zz", "m", None, "10", "9"]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(filled(sizes))


def test_taken_comes_near_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.taken(docs, block_words=256).join(docs.select("doc_id", "source"), "doc_id")
    rows = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.sum("size").alias("s"), F.first("source_size").alias("ss")).collect()
    assert len(rows) == 20
    for r in rows:
        assert abs(r.t - r.target) <= 1 and r.s == r.ss
    assert got.where("taken > 2 * size").count() == 0
    again = mixing.taken(docs, block_words=256)
    key = ["doc_id", "taken", "first_slot"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, got.select(*key).collect()))
    assert sorted(map(tuple, mixing.taken(docs.repartition(7), block_words=256).select(*key).collect())) == sorted(map(tuple, got.select(*key).collect()))


def test_every_stretch_holds_the_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    wanted = mixing.targets(sizes).cache()
    slots = mixing.schedule(wanted, 64).toPandas()
    target = {"s" + r.source: r.target for r in wanted.collect()}
    whole = sum(target.values())
    early = slots[slots.slot < len(slots) // 2]
    for source, t in target.items():
        share = (early.source_key == source).mean()
        assert abs(share - t / whole) < 0.01
        ranks = slots[slots.source_key == source].sort_values("slot")["rank"].tolist()
        assert ranks == list(range(len(ranks)))


def test_small_sources_beside_a_big_one_get_all_blocks(spark):
    blocks = {f"a{n}": n for n in range(1, 21)} | {"big": 500_000} | {f"c{n}": n for n in range(1, 21)}
    wanted = spark.createDataFrame([(s, 64.0 * n) for s, n in blocks.items()], "source string, target double")
    slots = mixing.schedule(wanted, 64).toPandas()
    assert slots.groupby("source_key")["rank"].count().to_dict() == {"s" + s: n for s, n in blocks.items()}
    assert slots.slot.is_unique and not slots.duplicated(["source_key", "rank"]).any()
    assert (slots.groupby("source_key")["rank"].max() + 1).to_dict() == {"s" + s: n for s, n in blocks.items()}


def test_ranks_that_no_point_reaches_follow(spark, monkeypatch):
    # all points in one place: every other source has to get its blocks afterwards
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    rows = [(1, "only once", "a"), (2, " ".join(["w"] * 300), "b"), (3, " ".join(["w"] * 40), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df, block_words=8)
    assert {r.source: (r.t, r.target) for r in got.join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.round(F.first("target")).alias("target")).collect()} == {
        "a": (4, 4.0), "b": (429, 429.0), None: (80, 80.0)
    }


def test_odd_rows(odd, empty):
    rows = mixing.taken(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.taken <= 2 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=6)
    assert mixing.taken(empty).count() == 0


def test_nothing_to_mix(spark):
    rows = mixing.taken(frame(spark, {1: "", 2: None})).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_mixed_documents_come_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mixed_documents(docs.withColumnRenamed("lang", "row"))
    assert mixed.columns == ["doc_id", "text", "row", "source", "n_chars"]
    times = mixed.groupBy("doc_id").count().toPandas()["count"]
    assert times.max() == 2
    words = mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    total = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words - 1.5 * total) < 0.05 * total
    assert mixed.join(docs, ["doc_id", "text"], "left_anti").count() == 0


def plain_mix(rows, block_words, weights=(5, 2, 1)):
    """(taken, first_slot) of rows (number, doc_id, source, size, hash), one slot after the other."""
    sizes = {}
    for _, _, source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    target = filled(sizes, weights)
    keys = {s: "n" if s is None else "s" + s for s in sizes}
    order = sorted(sizes, key=keys.get)
    blocks = {s: -int(-target[s] // block_words) for s in order}
    whole = sum(blocks.values())
    ends, upto = [], 0
    for s in order:
        upto += blocks[s]
        ends.append(upto / whole)
    slot_of, ranks = {}, dict.fromkeys(order, 0)
    n_slots = whole * 9 // 8 + 64 * len(order)
    for slot in range(n_slots):
        point = slot * mixing.GOLDEN % mixing.PERIOD / mixing.PERIOD
        s = next(s for s, end in zip(order, ends, strict=True) if point < end)
        slot_of[s, ranks[s]] = slot
        ranks[s] += 1
    late = n_slots
    for s in order:
        for rank in range(ranks[s], blocks[s]):
            slot_of[s, rank] = late
            late += 1
    out = {number: [0, None] for number, *_ in rows}
    for s in order:
        at, end = 0, int(target[s] + 0.5)
        for _ in range(2):
            for number, _, _, size, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (r[4], r[1], r[3], r[0])):
                used = max(0, min(at + size, end) - at)
                if used:
                    out[number][0] += used
                    slots = [slot_of[s, b] for b in range(at // block_words, (at + used - 1) // block_words + 1)]
                    out[number][1] = min([*slots, *([out[number][1]] if out[number][1] is not None else [])])
                at += size
    return out


def test_every_document_is_taken_as_the_slots_say(spark):
    rnd = random.Random(1)
    texts = [(i, " ".join(["w"] * rnd.choice([0, 1, 7, 40, 300])), rnd.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    hashed = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(10), "doc_id").alias("h")).collect()
    want = plain_mix([(r.doc_id, r.doc_id, r.source, r["size"], r.h) for r in hashed], 16)
    got = {r.doc_id: [r.taken, r.first_slot] for r in mixing.taken(df, block_words=16).collect()}
    assert got == want


def test_mixed_documents_follow_the_schedule(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"__row": F.lit("mine"), "__slot": F.lit("too")})
    mixed = mixing.mixed_documents(docs, slot="slot", block_words=256)
    assert mixed.columns == [*docs.columns, "slot"]
    rows = mixed.select("slot", "source", "__row", "__slot", F.spark_partition_id().alias("p")).collect()
    assert [r.slot for r in rows] == sorted(r.slot for r in rows) and len({r.p for r in rows}) > 1
    assert {(r["__row"], r["__slot"]) for r in rows} == {("mine", "too")}
    # both halves hold the sources in about the same shares; with all points in one place they do not
    share = lambda some: {s: sum(r.source == s for r in some) / len(some) for s in {r.source for r in rows}}
    early, late = share(rows[: len(rows) // 2]), share(rows[len(rows) // 2 :])
    assert sum(abs(early[s] - late[s]) for s in early) / 2 < 0.25
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    apart = mixing.mixed_documents(docs, slot="slot", block_words=256).select("slot", "source").collect()
    early, late = share(apart[: len(apart) // 2]), share(apart[len(apart) // 2 :])
    assert sum(abs(early[s] - late[s]) for s in early) / 2 > 0.5
    with pytest.raises(ValueError):
        mixing.mixed_documents(docs, slot="Text")
