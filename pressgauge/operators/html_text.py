"""Main text of a page.

The only per-row Python in the batch path: HTML needs a real tokenizer. The
helper walks the stdlib tokenizer once per page and keeps no tree, only the
texts of the elements that may turn out to be the article.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# --- fixed values -------------------------------------------------------------

DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
# Preferred places of the article, best first: tag, class or role.
PLACES = [
    ("tag", "article"), ("role", "article"), ("class", "article-content"), ("class", "article-body"),
    ("class", "entry-content"), ("class", "post-content"), ("class", "content"), ("tag", "main"),
    ("class", "main-content"),
]
ENOUGH = 100
VOID = set(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
UNFINISHED = 100  # more tags than this that never end are text
UNREAD = {"template"}  # text below these is not part of an element's text

# ------------------------------------------------------------------------------


class _Reader(HTMLParser):
    """Collects the strings of the first element of each place, and of the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, list]] = []  # open tags with the collectors they started
        self.open: Counter[str] = Counter()  # how many of each name are open
        self.found: dict[int, list[str]] = {}
        self.active: list[list[str]] = []
        self.pending: list[str] = []
        self.muted = 0
        self.skipped = 0
        self.comments_until = self.sections_until = sys.maxsize

    def _flush(self) -> None:
        if self.pending:
            text = "".join(self.pending).strip()
            self.pending.clear()
            if text and not self.skipped and not self.muted:
                for texts in self.active:
                    texts.append(text)

    def _matches(self, tag: str, attrs: dict) -> Iterator[int]:
        classes = (attrs.get("class") or "").split()
        for i, (kind, name) in enumerate(PLACES):
            if (
                (kind == "tag" and tag == name) or (kind == "class" and name in classes)
                or (kind == "role" and attrs.get("role") == name)
            ):
                yield i
        if tag == "body":
            yield len(PLACES)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._open(tag, dict(attrs))
        if tag in VOID:
            self._close(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._open(tag, dict(attrs))
        self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag not in VOID:
            self._close(tag)

    def _open(self, tag: str, attrs: dict) -> None:
        self._flush()
        started: list = []
        self.skipped += tag in DROPPED
        self.muted += tag in UNREAD
        if not self.skipped:
            for place in self._matches(tag, attrs):
                if place not in self.found:
                    self.found[place] = []
                    started.append(self.found[place])
        self.active.extend(started)
        self.stack.append((tag, started))
        self.open[tag] += 1

    def _close(self, tag: str) -> None:
        """Close up to the innermost open tag of that name; a stray end tag is ignored."""
        self._flush()
        if not self.open[tag]:
            return
        while self.stack:
            name, started = self.stack.pop()
            self.open[name] -= 1
            self.skipped -= name in DROPPED
            self.muted -= name in UNREAD
            if started:
                self.active = [t for t in self.active if not any(t is s for s in started)]
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def handle_entityref(self, name: str) -> None:
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name: str) -> None:
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            if code < 256:
                try:
                    self.pending.append(bytes([code]).decode("windows-1252"))
                    return
                except UnicodeDecodeError:
                    pass
            self.pending.append(chr(code))
        except (ValueError, OverflowError):
            self.pending.append("\N{REPLACEMENT CHARACTER}")

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Where no comment ends after one place, none ends after a later one: looked for once."""
        if i < self.comments_until:
            end = super().parse_comment(i, report)
            if end >= 0:
                return end
            self.comments_until = i
        return -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        if i < self.sections_until:
            end = super().parse_marked_section(i, report)
            if end >= 0:
                return end
            self.sections_until = i
        return -1

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()


def read_page(html: str | None) -> tuple[str | None, str | None]:
    """Main text and the reader's error, one of them at most."""
    try:
        return main_text(html), None
    except Exception as error:  # reported with the page: one bad page must not stop a job
        return None, f"{type(error).__name__}: {error}"


def main_text(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Reader()
    whole = html.rfind(">") + 1
    if html.count("<", whole) > UNFINISHED:  # the tokenizer would look for the end of each of these tags
        reader.feed(html[:whole])
        reader.close()
        if not reader.cdata_elem:
            reader.handle_data(html[whole:])
    else:
        reader.feed(html)
        reader.close()
    reader._flush()
    text: str | None = None
    for place in range(len(PLACES)):
        if place in reader.found:
            text = " ".join(reader.found[place])
            if len(text) > ENOUGH:
                break
    if (not text or len(text) < ENOUGH) and len(PLACES) in reader.found:
        text = " ".join(reader.found[len(PLACES)])
    if not text:
        return None
    return "\n".join(line.strip() for line in text.split("\n") if line.strip())


def extract_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, html) to (key, text, error). Whole pages in, whole texts out; NULL when nothing was found.

    Input stays in its partitions; ``spark.sql.execution.arrow.maxRecordsPerBatch`` bounds how many pages a batch holds.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [read_page(h) for h in batch["html"]]
            yield pd.DataFrame({key: batch[key], "text": [t for t, _ in read], "error": [e for _, e in read]})

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInPandas(each, f"{key} {kind}, text string, error string")
