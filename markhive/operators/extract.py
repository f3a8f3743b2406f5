"""Regex extraction of bookmarks and folders from HTML.

Documents are rows ``(doc, html)``.  ``tokenize`` turns each document into
token rows in document order with native regex functions; ``resolve_tree``
gives every link and folder its folder path with windows and joins, exact for
any nesting depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import lexer
from .ordered import DEFAULT_CHUNK_ROWS, chunk_of, last_before, running_sum_before

# Token kinds: dl, end (</dl>), folder (<h3>), link (<a>).


def _kind(tok):
    return (
        F.when(tok.rlike(r"(?i)^<dl"), F.lit("dl"))
        .when(tok.rlike(r"(?i)^</dl"), F.lit("end"))
        .when(tok.rlike(r"(?i)^<h3"), F.lit("folder"))
        .otherwise(F.lit("link"))
    )


def _href(start):
    value = F.regexp_extract(start, lexer.HREF_RE, 1)
    quote = F.substring(value, 1, 1)
    closed = (F.length(value) > 1) & F.endswith(value, quote)
    inside = F.when(closed, value.substr(F.lit(2), F.length(value) - 2)).otherwise(value.substr(F.lit(2), F.length(value)))
    return F.when(quote.isin('"', "'"), inside).otherwise(value)


def segments(text):
    """The text cut before each structural tag, without gaps (array of strings)."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(lexer.SEGMENT_RE), 1)


def tokenize(
    docs: DataFrame, doc: str = "file_id", html: str = "html", anchors_only: bool = False, keep=()
) -> DataFrame:
    """Tokens ``(doc, pos, kind, name, url, title, attrs)`` of each document.

    ``pos`` is the token's place in its document.  ``name`` is a folder's
    name, ``url``/``title`` a link's raw href and text (inner tags and comments
    removed, entities kept, as written in the file), ``attrs`` all attributes of a
    folder's or link's start tag as written (dates, icons).  The grammar is
    ``lexer``'s, the same as that of the tolerant parser.
    """
    start = lexer.LINK_START_RE if anchors_only else lexer.TOKEN_START_RE
    tokens = F.filter(segments(html), lambda x: x.rlike(start))
    exploded = docs.select(doc, *keep, F.posexplode(tokens).alias("pos", "tok"))
    return exploded.select(doc, *keep, F.col("pos").cast("bigint").alias("pos"), *token_columns(anchors_only))


def token_columns(anchors_only: bool = False):
    """``kind, name, url, title, attrs`` of the token in column ``tok``."""
    tok = F.col("tok")
    kind = F.lit("link") if anchors_only else _kind(tok)
    start = F.regexp_extract(tok, lexer.START_RE, 1)
    inner = F.regexp_replace(F.regexp_extract(tok, lexer.INNER_RE, 1), lexer.MARKUP_RE, "")
    return [
        kind.alias("kind"),
        F.when(kind == "folder", inner).alias("name"),
        F.when(kind == "link", _href(start)).alias("url"),
        F.when(kind == "link", inner).alias("title"),
        F.when(kind.isin("folder", "link"), F.trim(F.regexp_extract(start, lexer.ATTRS_RE, 1))).alias("attrs"),
    ]


def links_of(tokens: DataFrame, doc: str = "file_id") -> DataFrame:
    """Bookmarks without folder paths: links with a non-empty href (decision D12)."""
    return tokens.where((F.col("kind") == "link") & (F.col("url") != "")).select(doc, "pos", "url", "title")


def extract_links(docs: DataFrame, doc: str = "file_id", html: str = "html") -> DataFrame:
    """``(doc, pos, url, title)`` for every anchor of every document."""
    return links_of(tokenize(docs, doc, html, anchors_only=True), doc)


@dataclass
class Tree:
    """Result of ``resolve_tree``: links and folders with full folder paths."""

    links: DataFrame  # doc, pos, folder array<string>, folder_pos array<bigint>, url, title, attrs
    folders: DataFrame  # doc, pos, folder array<string> (own name last), folder_pos, attrs array<bigint>


def _with_depth(tokens: DataFrame, doc: str, chunk_rows: int) -> DataFrame:
    """``depth`` = open ``<DL>`` before the token (chunked running sum)."""
    t = tokens.withColumn("_chunk", chunk_of("pos", chunk_rows)).withColumn(
        "_delta", F.when(F.col("kind") == "dl", 1).when(F.col("kind") == "end", -1).otherwise(0)
    )
    return running_sum_before(t, [doc], "pos", "_chunk", "_delta", "depth").drop("_delta")


def _ancestors(items: DataFrame, doc: str) -> DataFrame:
    """For every folder and link, the folder that is its ancestor at each level.

    The ancestor of an item at level k is the last folder at depth k before
    it.  Each folder is a marker at its own depth and probes every level
    above it; a link probes only its parent's level.  Markers and probes come
    from one ``explode`` and one chunked window over ``(doc, level)`` answers
    all probes.  Output rows: ``(doc, owner, kind, _lvl, anc, url, title)``
    where ``anc`` is ``struct(o: pos, n: name)``; a folder's own row has
    itself as ``anc``.
    """
    own = F.struct(F.col("pos").alias("o"), F.col("name").alias("n"))
    d = F.col("depth").cast("int")
    probe = lambda lvl: F.struct(lvl.alias("lvl"), F.lit(False).alias("mark"))
    folder_rows = F.concat(
        F.array(F.struct(d.alias("lvl"), F.lit(True).alias("mark"))),
        F.when(d >= 1, F.transform(F.sequence(F.lit(0), d - 1), probe)).otherwise(
            F.array().cast("array<struct<lvl:int,mark:boolean>>")
        ),
    )
    link_rows = F.when(d >= 1, F.array(probe(d - 1))).otherwise(F.array().cast("array<struct<lvl:int,mark:boolean>>"))
    rows = items.select(
        doc, "pos", "kind", "_chunk", "url", "title", "attrs", own.alias("_own"),
        F.explode(F.when(F.col("kind") == "folder", folder_rows).otherwise(link_rows)).alias("_r"),
    ).select(
        doc, "pos", "kind", "_chunk", "url", "title", "attrs",
        F.col("_r.lvl").alias("_lvl"),
        F.when(F.col("_r.mark"), F.col("_own")).alias("_marker"),
    )
    found = last_before(rows, [doc, "_lvl"], "pos", "_chunk", "_marker", "_anc")
    return found.select(
        doc, F.col("pos").alias("owner"), "kind", "_lvl", F.coalesce("_marker", "_anc").alias("anc"), "url", "title", "attrs"
    )


def resolve_tree(tokens: DataFrame, doc: str = "file_id", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> Tree:
    """Folder path of every link and folder, exact for any depth.

    No loop: depth is a chunked running sum, ancestors
    come from one chunked window over ``(doc, level)``, a folder's path is
    the list of its ancestors (bounded by its depth) and a link takes its
    parent's path through one join on ``(doc, parent)``.  The branches after
    the ancestor window read the same shuffle output.
    """
    if "attrs" not in tokens.columns:
        tokens = tokens.withColumn("attrs", F.lit(None).cast("string"))
    # Several branches below read the tokens (chunk carries, paths, links).
    # Materialize them once in the checkpoint folder: the regex pass over the
    # documents then runs once, and lineage is cut for executor loss.
    ensure_checkpoint_dir(tokens.sparkSession)
    tokens = tokens.checkpoint(eager=True)
    items = _with_depth(tokens, doc, chunk_rows).where(F.col("kind").isin("folder", "link"))
    anc = _ancestors(items, doc)
    paths = (
        anc.where((F.col("kind") == "folder") & F.col("anc").isNotNull())
        .groupBy(doc, "owner")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("_lvl").alias("l"), F.col("anc").alias("a")))).alias("_p"),
            F.max("attrs").alias("attrs"),
        )
        .select(
            doc,
            F.col("owner").alias("pos"),
            F.transform("_p", lambda x: x["a"]["n"]).alias("folder"),
            F.transform("_p", lambda x: x["a"]["o"]).alias("folder_pos"),
            "attrs",
        )
    )
    links = anc.where((F.col("kind") == "link") & (F.col("url") != "")).select(
        doc, F.col("owner").alias("pos"), F.col("anc.o").alias("parent"), "url", "title", "attrs"
    )
    parent_paths = paths.select(
        F.col(doc).alias("_d"), F.col("pos").alias("_fpos"), F.col("folder").alias("_f"), F.col("folder_pos").alias("_fp")
    )
    links = links.join(
        parent_paths, (F.col(doc) == F.col("_d")) & (F.col("parent") == F.col("_fpos")), "left"
    ).select(
        doc,
        "pos",
        F.coalesce("_f", F.array().cast("array<string>")).alias("folder"),
        F.coalesce("_fp", F.array().cast("array<bigint>")).alias("folder_pos"),
        "url",
        "title",
        "attrs",
    )
    return Tree(links=links, folders=paths)


def parse_bookmarks(docs: DataFrame, doc: str = "file_id", html: str = "html") -> Tree:
    """HTML bookmark documents -> links and folders with folder paths (P1 + P2)."""
    return resolve_tree(tokenize(docs, doc, html), doc)
