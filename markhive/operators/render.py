"""Rendering bookmark trees as documents (P5).

Input is a table of tree items, one row per link or folder:

    doc, kind ('link'|'folder'), path array<struct<t,o,n>>, elem struct<t,o,n>,
    pos, name, url, title [, attrs]

``path`` holds one element per enclosing folder and ``elem`` the item's own
element.  Sorting items by ``(path + [elem], pos)`` gives document order:
a folder's opening line sorts before everything inside it and its closing
line (an extra element with t=2) after.  Every line is computed per row; only
the final concatenation groups a document, whose size is that of one input
document.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html

# The Netscape bookmark file header and footer.
NETSCAPE_HEADER = (
    "<!DOCTYPE NETSCAPE-Bookmark-file-1>\n"
    "<!-- This is an automatically generated file.\n"
    "     It will be read and overwritten.\n"
    "     DO NOT EDIT! -->\n"
    '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8">\n'
    "<TITLE>Bookmarks</TITLE>\n"
    "<H1>Bookmarks</H1>\n"
    "<DL><p>"
)
NETSCAPE_FOOTER = "</DL><p>"


def elem(t, o, n) -> Column:
    return F.struct(
        F.lit(t).cast("int").alias("t") if not isinstance(t, Column) else t.cast("int").alias("t"),
        (o if isinstance(o, Column) else F.lit(o)).cast("bigint").alias("o"),
        (n if isinstance(n, Column) else F.lit(n)).cast("string").alias("n"),
    )


def items_from_links(
    links: DataFrame, doc: str = "file_id", folder: str = "folder", pos: str = "pos", sep: str = "/"
) -> DataFrame:
    """Tree items from flat links whose folder is a path string or array.

    Folders are ordered by name, links before subfolders, links by ``pos``.
    Every folder on a link's path becomes a folder item.  One pass over the
    links: a folder item is emitted with each of its links and the copies
    are merged when the document is assembled.
    """
    col = F.col(folder)
    split = col if dict(links.dtypes)[folder].startswith("array") else F.split(col, re.escape(sep))
    # a column before the explode: computed once per link
    links = links.withColumn("_names", F.filter(split, lambda n: n != ""))
    names = F.col("_names")
    link_item = F.struct(
        F.lit("link").alias("kind"),
        F.transform(names, lambda n: elem(1, 0, n)).alias("path"),
        elem(0, 0, "").alias("elem"),
        F.col(pos).cast("bigint").alias("pos"),
        F.lit(None).cast("string").alias("name"),
        F.col("url").alias("url"),
        F.col("title").alias("title"),
    )

    def folder_item(k):
        prefix = F.slice(names, 1, k)
        return F.struct(
            F.lit("folder").alias("kind"),
            F.transform(F.slice(prefix, 1, k - 1), lambda n: elem(1, 0, n)).alias("path"),
            elem(1, 0, F.element_at(prefix, -1)).alias("elem"),
            F.lit(-1).cast("bigint").alias("pos"),
            F.element_at(prefix, -1).alias("name"),
            F.lit(None).cast("string").alias("url"),
            F.lit(None).cast("string").alias("title"),
        )

    folder_items = F.when(F.size(names) > 0, F.transform(F.sequence(F.lit(1), F.size(names)), folder_item))
    all_items = F.concat(F.array(link_item), F.coalesce(folder_items, F.array().cast("array<" + _ITEM + ">")))
    return links.select(F.col(doc).alias("doc"), F.explode(all_items).alias("_i")).select("doc", "_i.*")


_ITEM = (
    "struct<kind:string,path:array<struct<t:int,o:bigint,n:string>>,elem:struct<t:int,o:bigint,n:string>,"
    "pos:bigint,name:string,url:string,title:string>"
)


def items_from_tree(links: DataFrame, folders: DataFrame | None = None, doc: str = "file_id") -> DataFrame:
    """Tree items in the parsed document's own order (``extract.Tree``).

    Every folder of ``folders`` is kept, also one left without links
    (dedup never removes folders, decision D13).
    """

    link_items = links.select(
        F.col(doc).alias("doc"),
        F.lit("link").alias("kind"),
        F.transform(F.arrays_zip(F.col("folder_pos").alias("o"), F.col("folder").alias("n")), lambda z: elem(1, z["o"], z["n"])).alias("path"),
        elem(1, F.col("pos"), "").alias("elem"),
        F.col("pos").cast("bigint").alias("pos"),
        F.lit(None).cast("string").alias("name"),
        "url",
        "title",
        _attrs(links),
    )
    if folders is None:
        return link_items
    zipped = F.arrays_zip(F.col("folder_pos").alias("o"), F.col("folder").alias("n"))
    folder_items = folders.select(
        F.col(doc).alias("doc"),
        F.lit("folder").alias("kind"),
        F.transform(F.slice(zipped, 1, F.size("folder") - 1), lambda z: elem(1, z["o"], z["n"])).alias("path"),
        elem(1, F.col("pos"), F.element_at("folder", -1)).alias("elem"),
        F.col("pos").cast("bigint").alias("pos"),
        F.element_at("folder", -1).alias("name"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("title"),
        _attrs(folders),
    )
    return link_items.unionByName(folder_items)


def _attrs(df: DataFrame) -> Column:
    """Attributes as the file wrote them, where they are known."""
    return (F.col("attrs") if "attrs" in df.columns else F.lit(None).cast("string")).alias("attrs")


def _lines(items: DataFrame, fmt: str, escape: bool) -> DataFrame:
    """One or two lines per item: ``(doc, k, p, role, line)``."""
    depth = F.size("path") + 1
    own = F.concat("path", F.array("elem"))
    close_key = F.concat(own, F.array(elem(2, 0, "")))
    name, url, title = F.col("name"), F.col("url"), F.col("title")
    if fmt == "html":
        if escape:
            name, url, title = escape_html(name, False), escape_html(url, True), escape_html(title, False)
        else:
            url = F.replace(url, F.lit('"'), F.lit("&quot;"))  # raw text, but it ends up between quotes
        indent = F.repeat(F.lit("    "), depth)
        # raw text brings its own attributes (dates, icons) back as they were written
        raw = F.col("attrs") if "attrs" in items.columns and not escape else F.lit(None).cast("string")
        heading = F.when(F.length(raw) > 0, F.concat(F.lit("<DT><H3 "), raw, F.lit(">"))).otherwise(F.lit("<DT><H3>"))
        anchor = F.when(F.length(raw) > 0, F.concat(F.lit("<DT><A "), raw, F.lit(">"))).otherwise(F.concat(F.lit('<DT><A HREF="'), url, F.lit('">')))
        open_line = F.concat(indent, heading, name, F.lit("</H3>\n"), indent, F.lit("<DL><p>"))
        close_line = F.concat(indent, F.lit("</DL><p>"))
        link_line = F.concat(indent, anchor, title, F.lit("</A>"))
    elif fmt == "json":
        folder_json = F.to_json(F.struct(F.lit("folder").alias("type"), F.col("name").alias("name")))
        open_line = F.concat(F.regexp_replace(folder_json, r"\}$", ""), F.lit(',"children":['))
        close_line = F.lit("]}")
        link_line = F.to_json(F.struct(F.lit("url").alias("type"), F.col("title").alias("name"), F.col("url").alias("url")))
    else:
        raise ValueError("fmt must be html or json")
    is_folder = F.col("kind") == "folder"
    rows = F.when(
        is_folder,
        F.array(
            F.struct(own.alias("k"), F.lit(-1).cast("bigint").alias("p"), F.lit("open").alias("role"), open_line.alias("line")),
            F.struct(close_key.alias("k"), F.lit(-1).cast("bigint").alias("p"), F.lit("close").alias("role"), close_line.alias("line")),
        ),
    ).otherwise(
        F.array(F.struct(own.alias("k"), F.col("pos").alias("p"), F.lit("item").alias("role"), link_line.alias("line")))
    )
    return items.select("doc", F.explode(rows).alias("r")).select("doc", "r.k", "r.p", "r.role", "r.line")


def render_lines(items: DataFrame, escape: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """All lines of every HTML document, header and footer included, with
    their sort key ``(k, p)``: ``(doc, k, p, role, line)``.

    For documents too large to be one row, write these lines in key order
    (``sinks.write_named_lines``) instead of building one string each.
    ``docs`` (doc) lists the documents, also those without items.
    """
    body = _lines(items, "html", escape).dropDuplicates(["doc", "k", "p", "role"])
    docs = items.select("doc").distinct() if docs is None else docs
    empty_key = F.array().cast("array<struct<t:int,o:bigint,n:string>>")
    header = docs.select(
        "doc", empty_key.alias("k"), F.lit(-1).cast("bigint").alias("p"), F.lit("open").alias("role"),
        F.lit(NETSCAPE_HEADER).alias("line"),
    )
    footer = docs.select(
        "doc", F.array(elem(3, 0, "")).alias("k"), F.lit(-1).cast("bigint").alias("p"), F.lit("close").alias("role"),
        F.lit(NETSCAPE_FOOTER).alias("line"),
    )
    return header.unionByName(body).unionByName(footer)


def render_documents(items: DataFrame, fmt: str = "html", escape: bool = True, root_name: str = "Bookmarks bar") -> DataFrame:
    """One document per ``doc``: ``(doc, text)``.

    ``html``: a Netscape bookmark file.  ``json``: a Chromium-style
    ``Bookmarks`` file whose ``bookmark_bar`` root (named ``root_name``)
    holds the tree.  ``escape`` HTML-escapes plain text; pass ``False`` when
    the values are already HTML text (raw values read from a bookmark file).
    """
    lines = _lines(items, fmt, escape)
    line = F.struct("k", "p", "role", "line")
    is_item = F.col("role") == "item"
    # Folder lines may come once per link (items_from_links); collect_set
    # merges the copies, partly before the shuffle.
    doc_lines = lines.groupBy("doc").agg(
        F.collect_list(F.when(is_item, line)).alias("_items"),
        F.collect_set(F.when(~is_item, line)).alias("_folders"),
    ).select("doc", F.array_sort(F.concat("_items", "_folders")).alias("_l"))
    if fmt == "html":
        body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
        text = F.concat(F.lit(NETSCAPE_HEADER + "\n"), body, F.lit("\n" + NETSCAPE_FOOTER + "\n"))
        text = F.when(F.size("_l") > 0, text).otherwise(F.lit(NETSCAPE_HEADER + "\n" + NETSCAPE_FOOTER + "\n"))
    else:
        # A comma goes between two neighbours unless the first opens a folder
        # or the second closes one.
        body = F.array_join(
            F.transform(
                "_l",
                lambda x, i: F.concat(
                    F.when(
                        (i > 0) & (F.get("_l", i - 1)["role"] != "open") & (x["role"] != "close"), F.lit(",")
                    ).otherwise(F.lit("")),
                    x["line"],
                ),
            ),
            "",
        )
        head = F.lit('{"roots":{"bookmark_bar":{"type":"folder","name":' + _json_str(root_name) + ',"children":[')
        text = F.concat(head, body, F.lit("]}}}"))
    return doc_lines.select("doc", text.alias("text"))


def _json_str(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)
