"""Comparison keys under the three decode profiles.

Order of steps (decision D6): entity decode -> percent decode -> scheme fold
-> trailing slash.  Options are Python values, so steps that are off never
enter the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import KeyOptions
from .sqlfuncs import ensure_functions
from .text import decode_entities
from .urls import decode_percent, fold_scheme, strip_trailing_slash


def decoded_url(url: Column, opts: KeyOptions) -> Column:
    """URL after the profile's decoding.

    v3: entities always, percent only with -d.
    v2 and v1: entities and percent, both only with -d.
    """
    out = url
    if opts.profile == "v3" or opts.decode:
        out = decode_entities(out)
    if opts.decode:
        out = decode_percent(out)
    return out


def decoded_title(title: Column, opts: KeyOptions) -> Column:
    """Title after the profile's decoding (titles are never percent-decoded).

    v3 and v2: entities always.  v1: entities only with -d (decision D7).
    """
    if opts.profile in ("v2", "v3") or opts.decode:
        return decode_entities(title)
    return title


def url_key(url: Column, opts: KeyOptions) -> Column:
    out = decoded_url(url, opts)
    if not opts.strict_protocol:
        out = fold_scheme(out)
    if opts.ignore_slash:
        out = strip_trailing_slash(out)
    return out


def title_key(title: Column, opts: KeyOptions) -> Column:
    if opts.mode == "url-title":
        return decoded_title(title, opts)
    return F.lit("")


def with_keys(links: DataFrame, opts: KeyOptions, url: str = "url", title: str = "title") -> DataFrame:
    """Add ``key_url`` and ``key_title`` (``''`` in url mode); never null."""
    ensure_functions(links.sparkSession)
    return links.withColumn("key_url", F.coalesce(url_key(F.col(url), opts), F.lit(""))).withColumn(
        "key_title", F.coalesce(title_key(F.col(title), opts), F.lit(""))
    )
