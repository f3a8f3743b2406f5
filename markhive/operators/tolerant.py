"""Tolerant extraction with the standard library's ``HTMLParser``.

The parser is fed a document piece by piece and hands over tokens as soon as
they are whole, so that its memory follows a piece, the longest tag and the
longest title, not the document.  The lexical rules are those of ``lexer``, so the
tokens are the regex ``tokenize``'s also for irregular files (unclosed elements,
odd quotes, comments, scripts), and the same ``resolve_tree`` gives folder paths.

``tokenize_tolerant`` parses documents that are rows; ``tokenize_files`` opens files
in the tasks and reads them in pieces, for files larger than a row.  Files are
parsed in parallel across tasks.

Values stay raw: ``href`` comes from the start tag's text (``HTMLParser`` would
hand it over decoded) and entity references in text are copied as written.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..packaging import ship
from ..sources.sinks import filesystem_of
from . import lexer

# Tokens handed over at a time, and bytes of a file read at a time.
SLICE = 20_000
PIECE = 1 << 20

# An open <A> or <H3> is closed by the next structural tag.
_STRUCTURAL = {"dl", "dt", "dd", "h3", "a"}
_RAW_TEXT = {n: lexer.compiled(rf"(?i)</{n}{lexer._NAME_END}") for n in ("script", "style")}
_LT = re.compile("<")
_START = lexer.compiled(rf"(?is){lexer._TAG}")
# While more text may come, a value whose quote has not closed yet waits for it.
_START_SO_FAR = lexer.compiled(lexer.CLOSED_TAG_RE)
_COMMENT_END = re.compile(r"--!?>")
_SHORT_COMMENT = re.compile(r"<!---?>")
_END_NAME = lexer.compiled(r"(?i)</([a-z][^ \t\n\r\f/>]*+)")
_ATTRS = lexer.compiled(lexer.ATTRS_RE)
_HREF = lexer.compiled(lexer.HREF_RE)


class BookmarkEvents(HTMLParser):
    """Tokens ``(kind, name, url, title, attrs)`` of one document, in ``tokens`` as they become whole."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.interesting = _LT
        self.ended = False
        self.tokens: list[tuple] = []
        self.mode: str | None = None
        self.buf: list[str] = []
        self.href: str | None = None
        self.attrs: str | None = None

    def feed(self, data: str) -> None:
        super().feed(data)
        # what an open comment or script has shown so far is not needed any more
        if self.cdata_elem:
            self.rawdata = self.rawdata[-16:]
        elif self.rawdata.startswith("<!--") and len(self.rawdata) > 16:
            self.rawdata = "<!-- " + self.rawdata[-3:]

    def close(self) -> None:
        self.ended = True
        super().close()
        self._flush()

    # ------------------------------------------------ lexical rules (lexer)

    def clear_cdata_mode(self) -> None:
        self.interesting, self.cdata_elem = _LT, None

    def _more(self, i: int) -> int:
        """Nothing whole begins at ``i``: wait for more text, or take the ``<`` as text."""
        if not self.ended:
            return -1
        self.handle_data("<")
        return i + 1

    def parse_starttag(self, i: int) -> int:
        m = (_START if self.ended else _START_SO_FAR).match(self.rawdata, i)
        if not m:
            return self._more(i)
        tag = re.match(r"[^ \t\n\r\f/>]+", m[0][1:])[0].lower()
        self._started(tag, m[0])
        if tag in _RAW_TEXT:
            self.cdata_elem, self.interesting = tag, _RAW_TEXT[tag]
        return m.end()

    def parse_endtag(self, i: int) -> int:
        end = self.rawdata.find(">", i) + 1
        if not end:
            return len(self.rawdata) if self.cdata_elem and self.ended else self._more(i)
        if self.cdata_elem:
            self.clear_cdata_mode()
        elif m := _END_NAME.match(self.rawdata, i, end):
            self._closed(m[1].lower())
        return end

    def parse_comment(self, i: int, report: bool = True) -> int:
        if m := _SHORT_COMMENT.match(self.rawdata, i) or _COMMENT_END.search(self.rawdata, i + 4):
            return m.end()
        return len(self.rawdata) if self.ended else -1

    def parse_html_declaration(self, i: int) -> int:
        if not self.ended and len(self.rawdata) - i < 4 and "<!--".startswith(self.rawdata[i:]):
            return -1
        return self.rawdata.find(">", i) + 1 or self._more(i)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or self._more(i)

    # ------------------------------------------------ tokens

    def _flush(self) -> None:
        if self.mode == "a":
            self.tokens.append(("link", None, self.href, "".join(self.buf), self.attrs))
        elif self.mode == "h3":
            self.tokens.append(("folder", "".join(self.buf), None, None, self.attrs))
        self.mode, self.buf, self.href, self.attrs = None, [], None, None

    def _started(self, tag: str, text: str) -> None:
        if tag in _STRUCTURAL:
            self._flush()
        if tag == "dl":
            self.tokens.append(("dl", None, None, None, None))
        elif tag in ("h3", "a"):
            self.mode, self.attrs = tag, _ATTRS.match(text)[1].strip(" ")
            if tag == "a":
                m = _HREF.match(text)
                self.href = lexer.unquoted(m[1]) if m else ""

    def _closed(self, tag: str) -> None:
        if tag == "dl":
            self._flush()
            self.tokens.append(("end", None, None, None, None))
        elif tag in ("a", "h3"):
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.mode and not self.cdata_elem:
            self.buf.append(data)


def tokens_of(pieces: Iterable[str]) -> Iterator[tuple]:
    """Tokens ``(kind, name, url, title, attrs)`` of one document that comes in pieces."""
    p = BookmarkEvents()
    for piece in pieces:
        p.feed(piece)
        yield from p.tokens
        p.tokens.clear()
    p.close()
    yield from p.tokens


def parse_tokens(html: str | None) -> list[tuple]:
    """Tokens ``(kind, name, url, title, attrs)`` of one document in order."""
    return list(tokens_of([html or ""]))


def parse_events(html: str | None) -> list[tuple]:
    """Tokens ``(kind, name, url, title)`` of one document in order."""
    return [t[:4] for t in parse_tokens(html)]


_COLUMNS = ["pos", "kind", "name", "url", "title", "attrs"]


def _sliced(doc: str, documents: Iterator[tuple[object, Iterable[str]]]) -> Iterator[pd.DataFrame]:
    """Token rows of (document, pieces of its text), SLICE at a time."""
    rows = []
    for d, pieces in documents:
        for i, token in enumerate(tokens_of(pieces)):
            rows.append((d, i, *token))
            if len(rows) == SLICE:
                yield pd.DataFrame(rows, columns=[doc, *_COLUMNS])
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=[doc, *_COLUMNS])


def _schema(docs: DataFrame, doc: str) -> str:
    return f"`{doc}` {dict(docs.dtypes)[doc]}, pos bigint, kind string, name string, url string, title string, attrs string"


def tokenize_tolerant(docs: DataFrame, doc: str = "file_id", html: str = "html") -> DataFrame:
    """Tokens ``(doc, pos, kind, name, url, title, attrs)`` like ``extract.tokenize``.

    Tokens leave in slices, so a task holds one document and a slice of its tokens at a time.
    """
    ship(docs.sparkSession)

    def parse(batches):
        for b in batches:
            yield from _sliced(doc, ((d, [text or ""]) for d, text in zip(b[doc], b[html], strict=True)))

    return docs.select(doc, html).mapInPandas(parse, _schema(docs, doc))


def read_pieces(path: str, size: int = PIECE) -> Iterator[str]:
    """The text of a file in pieces of ``size`` bytes; invalid UTF-8 becomes U+FFFD."""
    filesystem, place = filesystem_of(path)
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    with filesystem.open_input_stream(place) as f:
        while raw := f.read(size):
            yield decoder.decode(raw)
    yield decoder.decode(b"", True)


def tokenize_files(files: DataFrame, path: str = "file_id", piece: int = PIECE) -> DataFrame:
    """Tokens of files named in ``files``, opened in the tasks and parsed as they are read.

    Like ``tokenize_tolerant`` over the read files, but no file is ever a value:
    a task holds ``piece`` bytes of its file, so files may be larger than a row.
    The paths must be such that tasks can open them (see ``sinks.filesystem_of``).
    """
    ship(files.sparkSession)

    def parse(batches):
        for b in batches:
            yield from _sliced(path, ((p, read_pieces(p, piece)) for p in b[path]))

    return files.select(path).mapInPandas(parse, _schema(files, path))
