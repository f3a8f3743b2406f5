"""Removing bookmarks from a document's own text.

A document is cut into pieces that tile it (``lexer.PIECE_RE``).  Each link is a
piece, together with what belongs to it: its ``<DT>``, its note, and its line.
Removing a link leaves its piece out; all other text -- header, comments,
folders, ``<HR>``, notes of other links, spacing -- is copied as it is.  A document
without removed links comes back character for character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lexer
from .extract import segments


def pieces(docs: DataFrame, doc: str = "file_id", html: str = "html") -> DataFrame:
    """``(doc, piece, link, text)``: the document's pieces in order; ``link`` counts the links, null for other text."""
    cut = F.regexp_extract_all(F.col(html), F.lit(lexer.PIECE_RE), 1)
    numbered = F.transform("_cut", lambda x, i: F.struct(i.alias("piece"), x.rlike(lexer.ITEM_START_RE).alias("link"), x.alias("text")))
    row = lambda x, k: F.struct(x["piece"].alias("piece"), k.cast("bigint").alias("link"), x["text"].alias("text"))
    links = F.transform(F.filter("_numbered", lambda x: x["link"]), lambda x, k: row(x, k))
    others = F.transform(F.filter("_numbered", lambda x: ~x["link"]), lambda x: row(x, F.lit(None)))
    cut_up = docs.select(doc, cut.alias("_cut")).select(doc, numbered.alias("_numbered"))
    return cut_up.select(doc, F.explode(F.concat(links, others)).alias("_p")).select(doc, F.col("_p.piece").cast("bigint").alias("piece"), "_p.link", "_p.text")


def link_places(docs: DataFrame, doc: str = "file_id", html: str = "html") -> DataFrame:
    """``(doc, pos, link)``: the place among the document's links of the link token at ``pos``."""
    tokens = F.filter(segments(html), lambda x: x.rlike(lexer.TOKEN_START_RE))
    links = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("pos"), x.rlike(lexer.LINK_START_RE).alias("is_link"))), lambda x: x["is_link"])
    placed = docs.select(doc, F.posexplode(links).alias("link", "_t"))
    return placed.select(doc, F.col("_t.pos").cast("bigint").alias("pos"), F.col("link").cast("bigint").alias("link"))


def without_links(docs: DataFrame, removed: DataFrame, doc: str = "file_id", html: str = "html") -> DataFrame:
    """Pieces ``(doc, piece, text)`` of the documents without the links at ``removed`` (doc, pos)."""
    gone = removed.select(doc, "pos").join(link_places(docs, doc, html), [doc, "pos"]).select(doc, "link")
    return pieces(docs, doc, html).join(gone, [doc, "link"], "left_anti").select(doc, "piece", "text")


def joined(kept: DataFrame, doc: str = "file_id") -> DataFrame:
    """``(doc, html)``: pieces put together, for documents that are rows (``sinks.write_named_pieces`` needs no row)."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return kept.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("html"))
