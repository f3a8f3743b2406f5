"""Quality rules as a short-circuit cascade.

Every rule looks at one document and may reject it.  What a rule costs and
which documents it rejects is estimated on a sample; rules then run in order of
rejection per cost among the documents that the rules before them leave, and a
document's first rejection ends its way.  The order only changes the time:
a document is kept when no rule rejects it.

A document's measures are computed when a rule first asks for them and shared
by the rules that ask again.

Cases: null and empty texts have no words; every measure is 0 and only rules on
too little text reject them.  Words are ``[^\\x20\\x09-\\x0D]+``.  Whole texts are
measured, whatever their length.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markhive.llm.common import as_text, per_task, pieces, text_bytes, with_field

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


class Measures:
    """What the rules can ask about one text; each computed at most once."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def text(self) -> str:
        return as_text(self.raw)

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes: exactly the six ASCII white-space characters

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, WHITE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words found twice or more in the text."""
        if self.n_words < 4:
            return 0
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        n = len(number)
        pair = code[:-1] * n + code[1:]
        if n >= 1 << 20:  # three of them would not fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * n + code[2:]
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        again = count[inverse] > 1
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : len(again) + k] |= again
        return int(covered.sum())

    @cached_property
    def n_shouted(self) -> int:
        return sum(len(w) > 1 and w.isupper() for w in self.words)

    @cached_property
    def n_letters(self) -> int:
        return sum(map(str.isalpha, self.text))

    @cached_property
    def n_broken(self) -> int:
        """Replacement characters and control characters other than white space."""
        return self.text.count("�") + len(self.raw) - len(self.raw.translate(None, bytes(set(range(32)) - set(WHITE)) + b"\x7f"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: Limits of the default rules, in percent of the measure named.
RULES = (
    Rule("symbols", lambda m: 100 * m.n_symbols > 3 * m.word_chars),
    Rule("shouting", lambda m: 100 * m.n_shouted > 20 * m.n_words),
    Rule("repetition", lambda m: 100 * m.n_repeat_words > 40 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 40 * len(m.lines)),
    Rule("few_letters", lambda m: 100 * m.n_letters < 50 * m.word_chars),
    Rule("broken", lambda m: 100 * m.n_broken > 2 * m.word_chars),
)

#: Documents on which costs and rejections are estimated.  They decide the order of the rules, never a verdict.
SAMPLE_ROWS = 2000


def base_failed(m: Measures) -> bool:
    return m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words


def _measured(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], base: Rule | None) -> Iterator[pa.RecordBatch]:
    """Per task: for each combination of rejecting rules the documents, and each rule's seconds.

    With a base, only of documents that it leaves, and beyond what it has measured.
    """
    for batch in pieces(batches):
        for raw in batch.column("text").to_pylist():
            known = Measures(raw)
            if base is not None and base.rejects(known):
                continue
            mask, seconds = 0, []
            for k, rule in enumerate(rules):
                own = Measures(raw)  # what other rules have asked is not counted as known
                own.__dict__.update(known.__dict__)
                began = time.perf_counter()
                mask |= bool(rule.rejects(own)) << k
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_pydict({"mask": [mask], "n": [1], "seconds": [seconds]}, schema=pa.schema({"mask": pa.int64(), "n": pa.int64(), "seconds": pa.list_(pa.float64())}))


def best_order(rules: tuple[Rule, ...], masks: dict[int, int], seconds: list[float]) -> tuple[Rule, ...]:
    """Greedy: next comes the rule with most rejections per cost among documents not rejected yet."""
    left, order = list(range(len(rules))), []
    while left:
        gain = {k: sum(n for mask, n in masks.items() if mask >> k & 1) / max(seconds[k], 1e-12) for k in left}
        best = max(left, key=lambda k: (gain[k], -seconds[k]))
        order.append(best)
        left.remove(best)
        masks = {mask: n for mask, n in masks.items() if not mask >> best & 1}
    return tuple(rules[k] for k in order)


def plan(df: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7, base: Rule | None = None) -> tuple[Rule, ...]:
    """The rules in the order that the sample suggests, behind ``base`` if there is one.  Only sums by rule reach the driver."""
    rows = df.count()
    if not rows:
        return tuple(rules)
    sample = df.select(text_bytes().alias("text"))
    if rows > sample_rows:
        sample = sample.sample(sample_rows / rows, seed)
    found = per_task(sample, _measured, "mask long, n long, seconds array<double>", tuple(rules), base)
    sums = [F.sum(F.col("seconds")[k]) for k in range(len(rules))]
    got = found.groupBy("mask").agg(F.sum("n"), *sums).collect()
    seconds = [sum(r[2 + k] for r in got) for k in range(len(rules))]
    return best_order(tuple(rules), {r[0]: r[1] for r in got}, seconds)


def first_rejection(m: Measures, rules: Iterable[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(m)), None)


def _judged(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], column: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, column):
        by = [first_rejection(Measures(raw), rules) for raw in batch.column(column).to_pylist()]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != column]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(by, pa.string())], names=[n for n, _ in rest] + [name])


def judge(df: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text", rejected_by: str = "rejected_by") -> DataFrame:
    """``df`` with the rule that rejected the document, or null.

    ``rules`` run in the order given; None: the default rules in the order of plan().
    """
    if rejected_by in df.columns:
        raise ValueError(f"column {rejected_by} exists; name another one")
    if rules is None:
        rules = plan(df.select(F.col(f"`{text}`").alias("text")))
    raw = "__text"
    while raw in df.columns:
        raw = "_" + raw
    schema = with_field(df.schema, rejected_by, "string")
    return per_task(df.withColumn(raw, text_bytes(f"`{text}`")), _judged, schema, rules, raw, rejected_by)


#: What op2 rejects: the base of its contract, then the rules in the order found.
BASE_RULE = Rule("base", base_failed)


def _assessed(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in pieces(batches):
        rows = []
        for raw in batch.column("text").to_pylist():
            m = Measures(raw)
            failed = BASE_RULE.rejects(m)
            rows.append([*(getattr(m, n) for n in names), failed, not failed and first_rejection(m, rules) is None])
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.bool_()) for c in columns[5:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names, "base_failed", "kept"])


def assess(df: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, and kept: neither the base nor a rule rejects the document."""
    if rules is None:
        rules = plan(df, base=BASE_RULE)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return per_task(df.select("doc_id", text_bytes().alias("text")), _assessed, schema, rules)


def keep_good(df: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The documents that neither the base nor a rule rejects, with their columns."""
    name = "rejected_by"
    while name in df.columns:
        name = "_" + name
    rules = (BASE_RULE, *(plan(df, base=BASE_RULE) if rules is None else rules))
    return judge(df, rules, rejected_by=name).where(F.col(name).isNull()).drop(name)
