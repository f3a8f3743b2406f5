"""Scalar Column expressions: decoding, normalisation and keys."""

from .keys import decoded_title, decoded_url, title_key, url_key, with_keys
from .text import decode_entities, escape_html, strip_tags
from .urls import (
    FILTER_PROTOCOLS,
    decode_percent,
    fold_scheme,
    has_allowed_protocol,
    strip_trailing_slash,
    url_scheme,
)

__all__ = [
    "FILTER_PROTOCOLS",
    "decode_entities",
    "decode_percent",
    "decoded_title",
    "decoded_url",
    "escape_html",
    "fold_scheme",
    "has_allowed_protocol",
    "strip_tags",
    "strip_trailing_slash",
    "title_key",
    "url_key",
    "url_scheme",
    "with_keys",
]
