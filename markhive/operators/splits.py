"""Tokens of files that are read in many splits (P1, P2 for files of any size).

Where a split begins inside a file, it may be in plain text, in a comment, in a
script or in a quoted value, and only all the text before tells which.  So:

1. Every split is scanned for its first ``>``; regions begin right after one, which
   is never inside a name, a comment's end or the like.  The file's last ``>`` and the
   last quotes before it are found on the way (a quote that never closes opens
   nothing, see ``lexer``).
2. Every region is lexed from each state that it may begin in, which gives its
   transition: entry state to exit state.  The runs soon meet, so this costs little
   more than one.
3. Transitions are composed in file order: every region learns its entry state.
4. Every region is lexed once more from that state and cut into segments.  What
   stands before its first structural tag continues the segment that an earlier
   region left open, and is put to it.

Steps 1, 2 and 4 read the file in tasks, all regions at a time; step 3 handles a
few numbers a region.  Tags, comments, scripts and values may span lines, splits
and any number of regions.  The tokens are those of ``extract.tokenize`` over the
whole file; ``pos`` is the byte at which a token begins.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..packaging import ship
from ..session import ensure_checkpoint_dir
from ..sources.sinks import filesystem_of
from . import lexer
from .extract import Tree, resolve_tree, token_columns

# Bytes of a split, and bytes of a file that share a chunk of the tree's windows.
SPLIT = 32 << 20
CHUNK = 1 << 22

# States: plain text, comment, script, style, and inside a quoted value of a tag (for each kind of tag and quote).
TEXT, COMMENT, SCRIPT, STYLE, VALUE = 0, 1, 2, 3, 4
STATES = 10
_QUOTES = (b'"', b"'")
_RAW = {b"script": 1, b"style": 2}
_STRUCTURAL = {b"a", b"h3", b"dl", b"dt", b"dd"}
_OPENING = re.compile(rb"<(?:(!--)|([/!?])|([a-zA-Z][^ \t\n\r\f/>]*))")
_LIST_END = re.compile(rb"(?i)</dl[ \t\n\r\f/>]")
_COMMENT_END = re.compile(rb"--!?>")
_RAW_END = {SCRIPT: re.compile(rb"(?i)</script[ \t\n\r\f/>]"), STYLE: re.compile(rb"(?i)</style[ \t\n\r\f/>]")}
_REST = re.compile(rb"(?:[^>=/]++|/(?!>))*+")
_EQUALS = re.compile(rb"=+[ \t\n\r\f]*")
_BARE = re.compile(rb"[^ \t\n\r\f>]*")


class Region:
    """The bytes of a region, which end with ``>``, and where the last quotes before the file's last ``>`` are."""

    def __init__(self, data: bytes, base: int, last_quotes: tuple[int, int]):
        self.data, self.base, self.last = data, base, last_quotes
        self.met: dict[int, int] | None = None  # where the run from plain text found markup, once it is known
        self.exit = TEXT

    def lex(self, state: int, starts: list[int] | None = None, met: set[int] | None = None) -> int:
        """The state at the end, from ``state`` at the beginning; ``starts`` collects structural tags."""
        data, pos = self.data, 0
        while True:
            if state == COMMENT:
                m = _COMMENT_END.search(data, pos)
                if not m:
                    return state
                state, pos = TEXT, m.end()
            elif state in _RAW_END:
                m = _RAW_END[state].search(data, pos)
                if not m:
                    return state
                state, pos = TEXT, data.index(b">", m.end() - 1) + 1
            elif state >= VALUE:
                kind, quote = divmod(state - VALUE, 2)
                pos = data.find(_QUOTES[quote], pos) + 1
                if not pos:
                    return state
                state, pos = self._rest(pos, kind)
            else:
                m = _OPENING.search(data, pos)
                if not m:
                    return TEXT
                if self.met is not None and m.start() in self.met:
                    return self.exit  # from here on as the run from plain text
                if met is not None:
                    met.add(m.start())
                state, pos = self._markup(m, starts)

    def _markup(self, m: re.Match[bytes], starts: list[int] | None) -> tuple[int, int]:
        data = self.data
        if m[1]:
            for short in (b"<!-->", b"<!--->"):
                if data.startswith(short, m.start()):
                    return TEXT, m.start() + len(short)
            return COMMENT, m.end()
        if m[2]:
            if starts is not None and _LIST_END.match(data, m.start()):
                starts.append(m.start())
            return TEXT, data.index(b">", m.end()) + 1
        name = m[3].lower()
        if starts is not None and name in _STRUCTURAL:
            starts.append(m.start())
        return self._rest(m.end(), _RAW.get(name, 0))

    def _rest(self, pos: int, kind: int) -> tuple[int, int]:
        """From inside a tag to its end, or to the end of the region in a quoted value."""
        data = self.data
        while True:
            pos = _REST.match(data, pos).end()
            if data[pos] != 0x3D:
                return (TEXT, SCRIPT, STYLE)[kind], pos + (2 if data[pos] == 0x2F else 1)
            pos = _EQUALS.match(data, pos).end()
            quote = _QUOTES.index(data[pos : pos + 1]) if data[pos : pos + 1] in _QUOTES else None
            if quote is None or self.base + pos >= self.last[quote]:
                pos = _BARE.match(data, pos).end()
                continue
            end = data.find(_QUOTES[quote], pos + 1)
            if end < 0:
                return VALUE + 2 * kind + quote, len(data)
            pos = end + 1

    def transition(self) -> list[int]:
        """The exit state for each entry state."""
        met: set[int] = set()
        self.exit = self.lex(TEXT, met=met)
        self.met = met
        return [self.exit, *(self.lex(s) for s in range(1, STATES))]


# ------------------------------------------------------------------ reading


def _bytes(path: str, start: int, end: int) -> bytes:
    filesystem, place = filesystem_of(path)
    with filesystem.open_input_file(place) as f:
        f.seek(start)
        return f.read(end - start)


def _scanned(batches) -> Iterator[pd.DataFrame]:
    """Of each split: the first and last ``>``, the last quotes before that one, and the last quotes."""
    for b in batches:
        rows = []
        for path, start, end in zip(b["path"], b["start"], b["end"], strict=True):
            data = _bytes(path, start, end)
            at = [data.find(b">"), last := data.rfind(b">")]
            at += [data.rfind(q, 0, max(0, last)) for q in _QUOTES] + [data.rfind(q) for q in _QUOTES]
            rows.append((path, start, *(start + i if i >= 0 else None for i in at)))
        yield pd.DataFrame(rows, columns=["path", "start", *_SCAN]).astype(dict.fromkeys(_SCAN, "Int64"))


_SCAN = ["first_end", "last_end", "dq", "sq", "dq_any", "sq_any"]


def _transitions(batches) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, start, end, dq, sq in zip(b["path"], b["start"], b["end"], b["dq"], b["sq"], strict=True):
            yield pd.DataFrame({"path": [path], "start": [start], "exits": [Region(_bytes(path, start, end), start, (dq, sq)).transition()]})


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """Entry states of a file's regions: their transitions, composed in order."""
    group = group.sort_values("start")
    state, found = TEXT, []
    for exits in group["exits"]:
        found.append(state)
        state = int(exits[state])
    return pd.DataFrame({"path": group["path"], "start": group["start"], "entry": found})


_ROWS = "path string, region bigint, pos bigint, role string, text string"


def _cut(batches) -> Iterator[pd.DataFrame]:
    """Segments of each region: what continues an earlier one (head), whole ones (token), and the last, which may go on (last)."""
    token = lexer.compiled(lexer.TOKEN_START_RE)
    for b in batches:
        for path, start, end, entry, dq, sq in zip(b["path"], b["start"], b["end"], b["entry"], b["dq"], b["sq"], strict=True):
            data, starts = _bytes(path, start, end), []
            if entry >= 0:  # else the text behind the file's last tag
                Region(data, start, (dq, sq)).lex(entry, starts)
            rows = [(path, start, start, "head" if starts else "through", data[: starts[0] if starts else None].decode("utf-8", "replace"))]
            for at, to in itertools.pairwise([*starts, len(data)]):
                text = data[at:to].decode("utf-8", "replace")
                if to == len(data):
                    rows.append((path, start, start + at, "last", text))
                elif token.match(text):
                    rows.append((path, start, start + at, "token", text))
                if len(rows) == 20_000:
                    yield pd.DataFrame(rows, columns=["path", "region", "pos", "role", "text"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "region", "pos", "role", "text"])


def _per_row(df: DataFrame, make, schema: str, rows: int) -> DataFrame:
    """``make`` in tasks that get a few rows each: a row is a whole split."""
    tasks = max(1, min(rows, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(tasks).mapInPandas(make, schema)


# ------------------------------------------------------------------ tokens


def tokenize_splits(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Tokens ``(file_id, pos, kind, name, url, title, attrs)`` of ``files`` (path, size), read in splits."""
    spark = files.sparkSession
    ship(spark)
    ensure_checkpoint_dir(spark)
    places = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / split))
    splits = files.where("size > 0").select("path", "size", F.explode(places).alias("k"))
    splits = splits.select("path", (F.col("k") * split).alias("start"), F.least((F.col("k") + 1) * split, F.col("size")).alias("end"), "size")
    n = splits.count()
    scanned = _per_row(splits, _scanned, "path string, start bigint, " + ", ".join(f"{c} bigint" for c in _SCAN), n).checkpoint(eager=True)

    # regions: from behind a split's first '>' to the next one's
    whole, later = Window.partitionBy("path"), Window.partitionBy("path").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    begins = F.when(F.col("start") == 0, F.lit(0)).otherwise(F.col("first_end") + 1)
    known = scanned.withColumns({"end_of_file": F.max("last_end").over(whole), "begin": begins})
    behind = F.col("start") > F.col("end_of_file")
    quote = lambda c: F.coalesce(F.max(F.when(F.col("last_end") == F.col("end_of_file"), F.col(c)).when(~behind, F.col(f"{c}_any"))).over(whole), F.lit(-1))
    known = known.withColumns({"last_dq": quote("dq"), "last_sq": quote("sq"), "next": F.first("begin", ignorenulls=True).over(later)})
    regions = known.where("begin is not null and end_of_file is not null").select(
        "path", F.col("begin").alias("start"), F.least(F.coalesce("next", F.col("end_of_file") + 1), F.col("end_of_file") + 1).alias("end"), F.col("last_dq").alias("dq"), F.col("last_sq").alias("sq")
    )
    regions = regions.where("end > start").checkpoint(eager=True)

    exits = _per_row(regions, _transitions, "path string, start bigint, exits array<int>", n)
    entries = exits.groupBy("path").applyInPandas(_entries, "path string, start bigint, entry int")
    # the text behind the last '>' is a region without markup
    end_of_file = scanned.groupBy("path").agg(F.coalesce(F.max("last_end") + 1, F.lit(0)).alias("start"))
    rest = files.join(end_of_file, "path").where("start < size").select("path", "start", F.col("size").alias("end"), F.lit(-1).alias("entry"), F.lit(-1).alias("dq"), F.lit(-1).alias("sq"))
    work = regions.join(entries, ["path", "start"]).select("path", "start", "end", "entry", "dq", "sq").unionByName(rest)
    rows = _per_row(work, _cut, _ROWS, n).checkpoint(eager=True)

    # what continues a segment is put to the last one that an earlier region has begun
    heads = rows.where("role in ('head', 'through')")
    before = Window.partitionBy("path").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    owned = heads.withColumn("owner", F.last(F.when(F.col("role") == "head", F.col("region")), ignorenulls=True).over(before)).where("owner is not null and text <> ''")
    parts = F.array_sort(F.collect_list(F.struct("region", "text")))
    more = owned.groupBy("path", F.col("owner").alias("region")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("more"))
    last = rows.where("role = 'last'").join(more, ["path", "region"], "left").withColumn("text", F.concat("text", F.coalesce("more", F.lit(""))))
    segments = rows.where("role = 'token'").select("path", "pos", "text").unionByName(last.where(F.col("text").rlike(lexer.TOKEN_START_RE)).select("path", "pos", "text"))
    return segments.select(F.col("path").alias("file_id"), "pos", F.col("text").alias("tok")).select("file_id", "pos", *token_columns())


def parse_splits(files: DataFrame, split: int = SPLIT) -> Tree:
    """Links and folders with folder paths of ``files`` (path, size), each spread over many tasks from the read on."""
    return resolve_tree(tokenize_splits(files, split), chunk_rows=CHUNK)
