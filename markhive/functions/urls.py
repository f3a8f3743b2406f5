"""URL normalisation as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqlfuncs import ensure_functions

# The protocols kept by the compare filter (-f).
FILTER_PROTOCOLS = ("http", "https", "ftp")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_percent(col: Column | str) -> Column:
    """Percent-decode as UTF-8, one pass (decision D4).

    Only runs of valid ``%XX`` escapes are decoded; ``+`` stays ``+`` and a
    malformed ``%zz`` stays as written.  Bytes that are not UTF-8 become
    U+FFFD.  Plain ``url_decode`` is not used: it raises on ``%zz`` and turns
    ``+`` into a space.  Runs as the session SQL function
    ``markhive_decode_percent`` (see sqlfuncs).
    """
    ensure_functions()
    return F.call_function("markhive_decode_percent", _c(col))


def fold_scheme(col: Column | str) -> Column:
    """Treat http and https alike: ``http://x`` and ``https://x`` -> ``//x``."""
    return F.regexp_replace(_c(col), r"(?i)^https?://", "//")


def strip_trailing_slash(col: Column | str) -> Column:
    """``page/`` -> ``page`` (all slashes at the very end, decision D3)."""
    return F.regexp_replace(_c(col), r"/+$", "")


def url_scheme(col: Column | str) -> Column:
    """Lower-case scheme of a URL, ``''`` when there is none."""
    return F.lower(F.regexp_extract(_c(col), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def has_allowed_protocol(col: Column | str, protocols=FILTER_PROTOCOLS) -> Column:
    """Predicate for the protocol filter (F1)."""
    return url_scheme(col).isin(*protocols)
