"""HTML text helpers as native Column expressions (C1 entity decode, U1 escape).

Everything here builds Catalyst expressions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqlfuncs import ensure_functions


def decode_entities(col: Column | str) -> Column:
    """Decode HTML character references once (``&amp;lt;`` -> ``&lt;``).

    Named references of HTML 4 and numeric ones (decimal, hex) are decoded;
    unknown names and references without ``;`` stay as they are.  Runs as
    the session SQL function ``markhive_decode_entities`` (see sqlfuncs).
    """
    ensure_functions()
    return F.call_function("markhive_decode_entities", F.col(col) if isinstance(col, str) else col)


def escape_html(col: Column | str, quote: bool = True) -> Column:
    """HTML-escape plain text for output; ``&`` goes first."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    if quote:
        out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return out


def strip_tags(col: Column | str) -> Column:
    """Drop inner markup such as ``<b>`` from a title (text content only)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"<[^>]*+>", "")
