"""SQL functions of the session for the decoders.

Decoding walks the pieces of a string with ``transform``; written as a
Python ``Column`` tree that costs hundreds of JVM calls per use.  As SQL
functions (``CREATE TEMPORARY FUNCTION ... RETURN <expr>``) they are defined
once per session and Catalyst inlines the body into the plan: the work still
runs as native expressions, and a call from Python is one JVM call.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import SparkSession


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _named_entities_sql() -> str:
    """Literal map name -> character.

    The HTML 4 named entity set (252 names) is taken from the Python standard
    library instead of being written out here.  Characters follow the HTML5
    table, as browsers read them (``&lang;`` is U+27E8, not U+2329).
    """
    names = sorted(name2codepoint)
    keys = ", ".join(_sql_str(n) for n in names)
    values = ", ".join(_sql_str(html5[n + ";"]) for n in names)
    return f"map_from_arrays(array({keys}), array({values}))"


# One entity reference (';' required, decision D5), a run of other text, or a
# lone '&'.  Possessive quantifiers keep the Java regex iterative on long text.
ENTITY_PIECES = r"(&(?:#[0-9]++|#[xX][0-9A-Fa-f]++|[A-Za-z][A-Za-z0-9]*+);|[^&]++|&)"
# A run of %XX escapes, a run of other text, or a lone '%'.
PERCENT_PIECES = r"((?:%[0-9A-Fa-f]{2})++|[^%]++|%)"


def _codepoint_char(cp: str) -> str:
    """Character for a code point; U+FFFD for 0, surrogates and > U+10FFFF."""
    return (
        f"CASE WHEN ({cp}) > 0 AND ({cp}) <= 1114111 AND NOT (({cp}) BETWEEN 55296 AND 57343) "
        f"THEN decode(unhex(lpad(hex({cp}), 8, '0')), 'UTF-32') ELSE '\\uFFFD' END"
    )


def _entities_body() -> str:
    # any number of digits; what is left without leading zeros is no character if it is longer than 8
    digits = "ltrim('0', substr(p, {0}, length(p) - {0}))".format
    hex_cp = f"CASE WHEN length({digits(4)}) BETWEEN 1 AND 8 THEN try_cast(conv({digits(4)}, 16, 10) AS BIGINT) END"
    dec_cp = f"CASE WHEN length({digits(3)}) BETWEEN 1 AND 8 THEN try_cast({digits(3)} AS BIGINT) END"
    piece = (
        "CASE WHEN NOT (startswith(p, '&') AND endswith(p, ';') AND length(p) > 2) THEN p "
        f"WHEN substr(p, 2, 2) IN ('#x', '#X') THEN {_codepoint_char(hex_cp)} "
        f"WHEN substr(p, 2, 1) = '#' THEN {_codepoint_char(dec_cp)} "
        f"ELSE coalesce(try_element_at({_named_entities_sql()}, substr(p, 2, length(p) - 2)), p) END"
    )
    return (
        f"CASE WHEN instr(x, '&') > 0 THEN "
        f"array_join(transform(regexp_extract_all(x, '{ENTITY_PIECES}', 1), p -> {piece}), '') ELSE x END"
    )


def _percent_body() -> str:
    piece = "CASE WHEN startswith(p, '%') AND length(p) >= 3 THEN coalesce(try_url_decode(p), p) ELSE p END"
    return (
        f"CASE WHEN instr(x, '%') > 0 THEN "
        f"array_join(transform(regexp_extract_all(x, '{PERCENT_PIECES}', 1), p -> {piece}), '') ELSE x END"
    )


FUNCTIONS = {
    "markhive_decode_entities": _entities_body,
    "markhive_decode_percent": _percent_body,
}


def ensure_functions(spark: SparkSession | None = None) -> SparkSession:
    """Define the functions in ``spark`` (default: the active session) if
    they are missing.  Operators that hold a DataFrame pass its session."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    if not spark.catalog.functionExists("markhive_decode_percent"):
        for name, body in FUNCTIONS.items():
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body()}"
            )
    return spark
