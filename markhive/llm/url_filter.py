"""URL verdicts by prefix rules and an exact Bloom filter cascade.

The cascade answers, for every key of a known universe, whether it is listed.
Level 1 is a Bloom filter of the listed keys; level 2 one of the unlisted keys
that level 1 lets through; level 3 one of the listed keys that level 2 lets
through, and so on until no key of the universe gets a wrong answer.  A key's
depth is the number of levels it passes one after the other; it is listed if
that number is odd.  All keys of the corpus take part, so there are no false
answers and pages need no join.

Each level is built by Spark: tasks set bits, ``bit_or`` joins their words.  The
driver holds the filters only, at most MAX_BITS of them.  A list that needs more
is dealt to shards of about SHARD_KEYS keys: a task builds each shard's cascade,
and the rows meet the filters of their key's shard in tasks.  Nothing of these
passes the driver, and the rows of a hot key are dealt to SALTS tasks.

Cases: null URLs and URLs without ``://`` have an empty host and path and fit no
rule; an empty host is a key like any other, never listed by the default list.
An empty list gives no level: nothing is listed.  Repeated rows get the same verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import partitions_of, per_task, stored, with_field

#: Bits of all levels together (16 MB).
MAX_BITS = 1 << 27
#: (verdict, host, path): the rules of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labels of hosts that are listed by default (fixed values: advertising and spam hosts).
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Keys of a shard, about, and tasks that its rows are dealt to.
SHARD_KEYS, SALTS = 1 << 20, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]], what: int | None = None) -> Column:
    """The longest rule that fits (host and subdomains, path prefix): its text, or its verdict; else null."""
    out: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        verdict, on, start = rule
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        out = F.when(fits, F.lit(on + start if what is None else verdict)).otherwise(out)
    return out


# ------------------------------------------------------------------ the cascade


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _positions(h: np.ndarray, g: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
    a, b = _mixed(h, 2 * level), _mixed(g, 2 * level + 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)])


def depth(h: np.ndarray, g: np.ndarray, levels: list[Level]) -> np.ndarray:
    """How many levels each key passes one after the other."""
    out, open_ = np.zeros(len(h), np.int64), np.arange(len(h))
    for k, level in enumerate(levels):
        at = _positions(h[open_], g[open_], k, level.hashes, level.bits)
        through = (level.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=0)
        open_ = open_[through]
        out[open_] += 1
    return out


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("h", "g"))


def _wrong(batches: Iterable[pa.RecordBatch], levels) -> Iterator[pa.RecordBatch]:
    """The keys that the levels so far answer wrongly (h, g)."""
    for batch in batches:
        h, g = _hashes(batch)
        listed = batch.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        wrong = (depth(h, g, levels.value) % 2 == 1) != listed
        yield pa.RecordBatch.from_arrays([pa.array(x[wrong].view(np.int64)) for x in (h, g)], names=["h", "g"])


def _set_bits(batches: Iterable[pa.RecordBatch], level: int, hashes: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = _positions(*_hashes(batch), level, hashes, bits).ravel()
        word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
        mask = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("h", F.xxhash64(F.lit(1), key)).withColumn("g", F.xxhash64(F.lit(2), key))


def _shape(n: int, level: int, n_listed: int, n_other: int) -> tuple[int, int]:
    """Bits and hashes of a level for n keys."""
    # level 1 lets through about as many other keys as there are listed ones; later levels half of what they see
    p = 0.5 if level else min(0.5, 0.7 * n_listed / max(1, n_other))
    if level > 64:
        raise ValueError("keys that equal hashes can't tell apart")
    return max(64, math.ceil(n * math.log2(1 / p) * 1.4427 / 64) * 64), max(1, round(math.log2(1 / p)))


def build(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """The cascade over ``universe`` (key, listed); None if it would take more than ``max_bits``.

    Keys are distinguished by 128 hashed bits.
    """
    spark = universe.sparkSession
    keys = stored(_keyed(universe, "key").select("h", "g", "listed").distinct(), "url-keys")
    counts = {r[0]: r[1] for r in keys.groupBy("listed").count().collect()}
    n_listed, n_other = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    used = 0
    while True:
        told = spark.sparkContext.broadcast(levels)
        wrong = per_task(keys, _wrong, "h long, g long", told)
        n = n_listed if not levels else wrong.count()
        if not n:
            return levels
        bits, hashes = _shape(n, len(levels), n_listed, n_other)
        used += bits
        if used > max_bits:
            return None
        words = per_task(wrong, _set_bits, "word long, mask long", len(levels), hashes, bits).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        filled = np.zeros(bits // 64, np.uint64)
        filled[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        levels = [*levels, Level(bits, hashes, filled)]


def _answered(batches: Iterable[pa.RecordBatch], levels, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = depth(*_hashes(batch), levels.value) % 2 == 1
        rest = [(n, batch.column(n)) for n in batch.schema.names if n not in ("h", "g")]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(listed)], names=[n for n, _ in rest] + [name])


def with_listed(df: DataFrame, key: str, universe: DataFrame, name: str = "listed", max_bits: int = MAX_BITS) -> DataFrame:
    """``df`` with a boolean column: whether ``key`` is listed in ``universe`` (key, listed), which holds all keys of ``df``."""
    if {name, "h", "g"} & set(df.columns):
        raise ValueError(f"columns {name}, h and g are made here; rename them first")
    levels = build(universe, max_bits)
    if levels is None:
        return _with_listed_by_shards(df, key, universe, name)
    told = df.sparkSession.sparkContext.broadcast(levels)
    return per_task(_keyed(df, key), _answered, with_field(df.schema, name, "boolean"), told, name)


# ------------------------------------------------------------------ cascades in shards

FILTER_FIELDS = "shard long, bits array<long>, hashes array<long>, words binary"


def cascade(h: np.ndarray, g: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The cascade of keys that one task holds."""
    levels: list[Level] = []
    n_listed = int(listed.sum())
    while True:
        wrong = (depth(h, g, levels) % 2 == 1) != listed
        if not wrong.any():
            return levels
        bits, hashes = _shape(int(wrong.sum()), len(levels), n_listed, len(h) - n_listed)
        at = _positions(h[wrong], g[wrong], len(levels), hashes, bits).ravel()
        words = np.zeros(bits // 64, np.uint64)
        np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        levels.append(Level(bits, hashes, words))


def _segments(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Runs of rows with equal values of some columns."""
    own = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (np.diff(own, axis=0) != 0).any(axis=1)])
    for a, b in zip(starts, np.r_[starts[1:], len(own)], strict=True):
        yield tuple(own[a].tolist()), batch.slice(a, b - a)


def _filters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cascade of each shard, from keys sorted by shard."""
    at, held = None, []

    def made() -> pa.RecordBatch:
        levels = cascade(*(np.concatenate(x) for x in zip(*held, strict=True)))
        row = [at], [[x.bits for x in levels]], [[x.hashes for x in levels]], [b"".join(x.words.tobytes() for x in levels)]
        types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=[f.split()[0] for f in FILTER_FIELDS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        for (shard,), part in _segments(batch, ("shard",)):
            if shard != at and held:
                yield made()
                held = []
            at = shard
            held.append((*_hashes(part), part.column("listed").to_numpy(zero_copy_only=False).astype(bool)))
    if held:
        yield made()


def _answered_by_shard(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with their answers, from filters and rows sorted by shard, salt and role."""
    at, levels = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        for (shard, salt, role), part in _segments(batch, ("shard", "salt", "role")):
            if (shard, salt) != at:
                at, levels = (shard, salt), []  # a shard without a filter has nothing listed
            if role:
                listed = depth(*_hashes(part), levels) % 2 == 1
                yield pa.RecordBatch.from_arrays([*part.column("row").flatten(), pa.array(listed)], names=names)
                continue
            words = np.frombuffer(part.column("words")[0].as_py(), np.uint64)
            first = 0
            for bits, hashes in zip(part.column("bits")[0].as_py(), part.column("hashes")[0].as_py(), strict=True):
                levels.append(Level(bits, hashes, words[first : first + bits // 64]))
                first += bits // 64


def _with_listed_by_shards(df: DataFrame, key: str, universe: DataFrame, name: str) -> DataFrame:
    n = partitions_of(df.sparkSession)
    shards = max(1, universe.count() // SHARD_KEYS)
    shard = lambda k: F.pmod(F.xxhash64(F.lit(3), k), F.lit(shards)).alias("shard")
    keys = _keyed(universe, "key").select(shard("key"), "h", "g", F.coalesce("listed", F.lit(False)).alias("listed")).distinct()
    filters = stored(per_task(keys.repartition(n, "shard").sortWithinPartitions("shard"), _filters, FILTER_FIELDS), "url-filters")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    rows = _keyed(df, key).select(shard(key), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.lit(1).alias("role"), own, "h", "g")
    met = rows.unionByName(filters.select("shard", salts, F.lit(0).alias("role"), "bits", "hashes", "words"), allowMissingColumns=True)
    met = met.repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "role")
    return per_task(met, _answered_by_shard, with_field(df.schema, name, "boolean"), [*df.columns, name])


def listed_hosts(hosts: DataFrame, labels: Iterable[str] = LISTED_LABELS) -> DataFrame:
    """(key, listed) for each host: listed if one of its labels is."""
    return hosts.select(F.col("host").alias("key"), F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))).alias("listed"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, labels: Iterable[str] = LISTED_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page: the longest rule's verdict, else block for listed hosts."""
    rules = tuple(rules)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = listed_hosts(parts.select("host").distinct(), tuple(labels))
    known = with_listed(parts, "host", universe)
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(rule_of(host, path, rules, 0), F.when(F.col("listed"), "block").otherwise("allow"))
    return known.select("page_id", "host", "path", rule_of(host, path, rules).alias("rule"), verdict.alias("verdict"))


#: DuckDB SQL for judge() with the default rules and labels.
ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
