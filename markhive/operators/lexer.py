"""The lexical grammar of bookmark files and pages, shared by all parsers.

A document is a row of lexemes: text, comments, declarations, tags, and
``<script>``/``<style>`` elements as a whole.  The rules follow browsers:

* a quote opens an attribute value only right after ``=``; elsewhere it is an
  ordinary character (``TITLE="it"s"``, ``X=don't``).  A value whose quote does
  not close in the rest of the document ends at white space or ``>``; if it
  closes after the document's last ``>``, the tag ends at its first ``>``;
* a ``>`` inside a quoted value does not end its tag;
* a comment ends with ``-->`` (or ``--!>``), or with the document;
* what looks like a tag inside a comment, a script or a quoted value is none;
* a ``<`` that begins nothing is text.

Structural tags are ``<A>``, ``<H3>``, ``<DL>``, ``<DT>``, ``<DD>`` and ``</DL>``.  A
document is cut before each of them: these segments tile it, and each holds one
structural tag at most, at its start.  So an open ``<A>`` or ``<H3>`` ends with its
end tag or with the next structural tag, whichever comes first.

The patterns are written once, in the syntax that Java's and Python's regular
expressions share.  All loops are possessive: they never go back, and Java runs
them without recursion, however long the text.
"""

from __future__ import annotations

import re

_W = r"[ \t\n\r\f]"
_NAME_END = r"(?=[ \t\n\r\f/>])"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+)"""
_REST = rf"(?:[^>=/]++|/(?!>)|=++{_W}*+{_VALUE})*+"
# what follows a tag's name: if no '>' comes after its values, quotes are ordinary characters
_TO_END = rf"(?:{_REST}/?+>|[^>]*+>)"
_COMMENT = r"<!--(?:-?+>|(?:[^-]++|-(?!-!?+>))*+(?:--!?+>|(?!.)))"


def _raw_element(name: str) -> str:
    return rf"<{name}{_NAME_END}{_TO_END}(?:[^<]++|<(?!/{name}{_NAME_END}))*+(?:</[^>]*+>?+)?+"


_TAG = rf"<[a-z][^ \t\n\r\f/>]*+{_TO_END}"
_MARKUP = rf"(?:{_COMMENT}|{_raw_element('script')}|{_raw_element('style')}|<[/!?][^>]*+>|{_TAG})"
_START = rf"<(?:a|h3|d[ltd]){_NAME_END}{_TO_END}"
_LIST_END = rf"</dl{_NAME_END}[^>]*+>"
_STRUCTURAL = rf"(?:{_START}|{_LIST_END})"
_OTHER = rf"(?:[^<]++|(?!{_STRUCTURAL})(?:{_MARKUP}|<))"
_ENDING = rf"</(?:a|h3){_NAME_END}[^>]*+>"
# inside a segment nothing else is structural
_INNER = rf"(?:[^<]++|(?!{_ENDING})(?:{_MARKUP}|<))*+"
_NOT_HREF = rf"(?:[ \t\n\r\f/]++|(?!href{_W}*+=)[^ \t\n\r\f/>=]++|=++{_W}*+{_VALUE})*+"

# Segments of a document, one after the other without gaps (group 1).
SEGMENT_RE = rf"(?is)({_STRUCTURAL}{_OTHER}*+|{_OTHER}++)"
# A segment that is a token: <A>, <H3>, <DL> or </DL>.
TOKEN_START_RE = rf"(?is)^(?:<(?:a|h3|dl){_NAME_END}{_TO_END}|{_LIST_END})"
LINK_START_RE = rf"(?is)^<a{_NAME_END}{_TO_END}"
# A token's start tag (group 1).
START_RE = rf"(?is)^({_START})"
# What is between the name and the end of a start tag (group 1).
ATTRS_RE = rf"(?is)^<(?:a|h3|d[ltd])({_REST}(?=/?+>)|[^>]*+)"
# The value of a link's href as its start tag has it, with its quotes (group 1).
HREF_RE = rf"(?is)^<a{_NOT_HREF}href{_W}*+=++{_W}*+({_VALUE})"
# What a link or folder holds, up to its end tag or the segment's end (group 1).
INNER_RE = rf"(?is)^{_START}({_INNER})"
# A link or folder with its end tag, without what follows in its segment (group 1).
ELEMENT_RE = rf"(?is)^({_START}{_INNER}(?:{_ENDING})?+)"
# Everything inside a title that is not its text.
MARKUP_RE = rf"(?is){_MARKUP}"
# ------------------------------------------------ bookmarks as pieces of a document
#
# A bookmark's piece is all that goes when it is removed: its <DT>, the link, the note
# (<DD>) that follows it, and, where it has its lines to itself, the indentation before and
# the line break after.  Pieces tile the document; the others hold no link.

_S = r"[ \t]*+"
_DT = rf"<dt{_NAME_END}{_TO_END}"
_A = rf"<a{_NAME_END}{_TO_END}"
_HELD = rf"(?:[^<]++|(?!{_ENDING}|{_STRUCTURAL})(?:{_MARKUP}|<))*+"
# a note ends before the next structural tag, rule or the end, and before white space in front of it
_NOTE = rf"(?:(?!{_W}*+(?:{_STRUCTURAL}|<hr{_NAME_END}|(?!.)))(?:[^< \t\n\r\f]++|{_W}++|{_MARKUP}|<))*+"
_BOOKMARK = rf"(?:{_DT}{_W}*+)?+{_A}{_HELD}(?:{_ENDING})?+(?:{_W}*+<dd{_NAME_END}{_TO_END}{_NOTE})?+"
_ITEM = rf"(?:(?<![^\n]){_S}{_BOOKMARK}{_S}(?:\r?\n|(?!.))|{_BOOKMARK})"

# Pieces of a document, one after the other without gaps (group 1).
PIECE_RE = rf"(?is)({_ITEM}|(?:(?!{_ITEM})(?:[^<\n]++|\n|{_MARKUP}|<))++)"
# A piece that is a bookmark.
ITEM_START_RE = rf"(?is)^{_S}(?:{_DT}{_W}*+)?+{_A}"

# A tag of which every quoted value has closed.
CLOSED_TAG_RE = rf"(?is)<[a-z][^ \t\n\r\f/>]*+{_REST}/?+>".replace("|[^ \\t\\n\\r\\f>]*+)", "|(?![\"'])[^ \\t\\n\\r\\f>]*+)")


def compiled(pattern: str) -> re.Pattern[str]:
    """The pattern for Python; letters are ASCII letters, as in Java."""
    return re.compile(pattern, re.A)


def unquoted(value: str) -> str:
    """An attribute value without its quotes (a quote that never closed goes too)."""
    if value[:1] not in ('"', "'"):
        return value
    return value[1:-1] if len(value) > 1 and value.endswith(value[0]) else value[1:]
