"""HTML and XML extraction: a tolerant tree from the standard library's parsers, walked inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the walk does with tags.
HEADINGS = {"h2": "##", "h3": "###", "h4": "####"}
CONTAINERS, IGNORED = {"div", "section"}, {"hr"}
ALERT_CLASS, ALERT = "alert-message", "[ALERT] "
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = {"ul", "ol", "table", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "article", "footer", "nav", "hr", "blockquote"}


class Node:
    __slots__ = ("name", "attrs", "kids")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def strings(self) -> Iterator[str]:
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.strings()
            else:
                yield k

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]


class _Tree(HTMLParser):
    """Open paragraphs and list items close where the next one or a block begins; stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCKS else set())
        while self.open[-1].name in shut:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse_html(html: str) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def clean(node: Node, separator: str = " ") -> str:
    """Text of a node, single-spaced and tight around marks; an empty separator keeps the text nodes' own spaces."""
    parts = (s.strip() for s in node.strings()) if separator else node.strings()
    text = re.sub(r"\s+", " ", separator.join(p for p in parts if p))
    return re.sub(r"([(\[])\s+", r"\1", re.sub(r"\s+([,.;:)\]])", r"\1", text)).strip()


def _classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def extract_elements(nodes: list[Node], out: list[str], unhandled: set[str], prefix: str = "") -> None:
    """Lines of a level in document order; unknown tags are reported."""
    for n in nodes:
        if n.name in HEADINGS or n.name == "p":
            text = clean(n)
            if text:
                out.append(prefix + (HEADINGS[n.name] + " " if n.name in HEADINGS else "") + text)
        elif n.name in ("ul", "ol"):
            out += [f"{prefix}- {t}" for t in (clean(x) for x in n.walk() if x.name == "li") if t]
        elif n.name == "table":
            out += [prefix + t for t in (clean(x) for x in n.walk() if x.name == "caption") if t][:1]
            out += [prefix + "| " + " | ".join(clean(c) for c in r.walk() if c.name in ("td", "th")) + " |" for r in n.walk() if r.name == "tr"]
        elif n.name in CONTAINERS:
            extract_elements(n.elements(), out, unhandled, prefix or (ALERT if ALERT_CLASS in _classes(n) else ""))
        elif n.name not in IGNORED:
            unhandled.add(n.name)


def parse_chapter(html: str) -> tuple[list[str], list[str], str | None]:
    """(lines, unhandled tags, error) of a chapter page; ``structure_changed`` where its body is missing."""
    guidance = next((n for n in parse_html(html).walk() if n.name == "div" and n.attrs.get("id") == "guidance"), None)
    body = guidance and next((n for n in guidance.walk() if n.name == "div" and "field--name-body" in _classes(n)), None)
    if body is None:
        return [], [], "structure_changed"
    out: list[str] = []
    unhandled: set[str] = set()
    extract_elements(body.elements(), out, unhandled)
    return out, sorted(unhandled), None


def parse_page(html: str) -> tuple[list[str], list[str], str | None]:
    """(lines, unhandled tags, error) of any page, from its article, else its body, else all of it."""
    root = parse_html(html)
    top = next((n for n in root.walk() if n.name == "article"), None) or next((n for n in root.walk() if n.name == "body"), None) or root
    out: list[str] = []
    unhandled: set[str] = set()
    extract_elements(top.elements(), out, unhandled)
    return out, sorted(unhandled), None


def _extracted(parse: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parse(h) for h in batch.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cols[0]), pa.list_(pa.string())), pa.array(list(cols[1]), pa.list_(pa.string())), pa.array(list(cols[2]), pa.string())], ["page_id", "lines", "unhandled", "error"])

    return run


def extract(pages: DataFrame, parse: Callable = parse_page) -> DataFrame:
    """page_id, lines, unhandled, error of (page_id, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_extracted(parse), "page_id long, lines array<string>, unhandled array<string>, error string")


class StructureChanged(ValueError):
    """A table of contents isn't built as expected."""


def _label(title: str) -> str | None:
    m = re.match(r"(Volume\s+\d+|Part\s+[A-Z])\b", title)
    return re.sub(r"\s+", " ", m[1]) if m else None


def _first(node: Node, name: str, cls: str | None = None) -> Node | None:
    return next((n for n in node.walk() if n.name == name and (cls is None or cls in _classes(n))), None)


def contents(html: str, volume: str, parts: list[str] | None = None) -> list[tuple[str, str, str, str, str]]:
    """(volume, volume title, part title, chapter title, chapter path) of a volume in a table of contents.

    A volume is a ``level--2`` block; its parts are the ``level--3`` siblings up to the
    next volume. ``parts`` picks parts by their exact label, None takes all; a wanted
    part that isn't there raises. Parts and chapters without a link are left out.
    """
    root = parse_html(html)
    for holder in (root, *root.walk()):
        kids = holder.elements()
        for i, block in enumerate(kids):
            if block.name != "div" or "level--2" not in _classes(block):
                continue
            head = _first(block, "div", "level__title")
            link = head and _first(head, "a")
            if link is None or _label(clean(link)) != volume:
                continue
            out, seen = [], []
            for part in kids[i + 1 :]:
                if "level--2" in _classes(part):
                    break
                if "level--3" not in _classes(part):
                    continue
                item = _first(part, "li", "level__item--3")
                if item is None:
                    raise StructureChanged(f"{volume}: a part has no title element")
                anchor = _first(item, "a")
                title = clean(anchor or item)
                seen.append(_label(title))
                chapters = _first(part, "ul", "level--4")
                if (parts is not None and seen[-1] not in parts) or anchor is None or chapters is None:
                    continue
                for chapter in (n for n in chapters.walk() if n.name == "li" and "level__item--4" in _classes(n)):
                    to = _first(chapter, "a")
                    if to is not None:
                        out.append((volume, clean(link), title, clean(to), to.attrs.get("href", "")))
            missing = [p for p in parts or [] if p not in seen]
            if missing:
                raise StructureChanged(f"{volume}: no such part(s): {', '.join(missing)}")
            return out
    raise StructureChanged(f"{volume} not found in the table of contents")


_CONTENTS = "page_id long, volume string, volume_title string, part_title string, chapter_title string, chapter_path string, error string"


def contents_table(pages: DataFrame, wanted: dict[str, list[str] | None]) -> DataFrame:
    """page_id, volume, volume_title, part_title, chapter_title, chapter_path, error: the chapters that tables of contents (page_id, html) list.

    ``wanted``: volume labels, each with its parts' labels or None for all. A page on which a volume or
    part isn't as expected gives one row with the error for that volume.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CONTENTS.split(", ")]
        for batch in batches:
            rows = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for volume, parts in wanted.items():
                    try:
                        rows += [(page, *r, None) for r in contents(html or "", volume, parts)]
                    except StructureChanged as e:
                        rows.append((page, volume, None, None, None, None, str(e)))
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "page_id" else pa.string()) for c, n in zip(cols, names, strict=True)], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, _CONTENTS)


# ---------------------------------------------------------------- XML opinions

# The markups of page numbers, notes and note marks, as (tag, class).
PAGE_MARKS = (("page-number", None), ("span", "star-pagination"), ("a", "page-label"))
NOTES = (("footnote", None), ("div", "footnote"))
NOTE_MARKS = (("footnotemark", None), ("a", "footnote"))
#: The mark of a note reference for :func:`footnotes.place`.
PRIVATE_MARK = "\\s*\ue000(\\d+)\ue001"
LINE_PREFIX = {"p": "", "author": "", "blockquote": "> "}


def _tree(e: ElementTree.Element) -> Node:
    node = Node(e.tag, dict(e.attrib))
    if e.text:
        node.kids.append(e.text)
    for child in e:
        node.kids.append(_tree(child))
        if child.tail:
            node.kids.append(child.tail)
    return node


def _is(n: Node, kinds) -> bool:
    return any(n.name == tag and (cls is None or cls in _classes(n)) for tag, cls in kinds)


def _prune(n: Node, kinds) -> int:
    removed, kept = 0, []
    for k in n.kids:
        if isinstance(k, Node) and _is(k, kinds):
            removed += 1
        else:
            removed += _prune(k, kinds) if isinstance(k, Node) else 0
            kept.append(k)
    n.kids = kept
    return removed


def parse_opinion(xml: str) -> tuple[list[str], dict[int, str], dict[str, int], str | None]:
    """(body lines with marks as [N] in private-use brackets, notes, counts of unknown tags, error)."""
    try:
        root = _tree(ElementTree.fromstring("".join(c for c in xml or "" if unicodedata.category(c) != "Cf")))
    except ElementTree.ParseError:
        return [], {}, {}, "bad_xml"
    top = root if root.name == "opinion" else next((n for n in root.walk() if n.name == "opinion"), None)
    if top is None:
        return [], {}, {}, "structure_changed"
    _prune(top, PAGE_MARKS)
    notes: dict[int, str] = {}
    for n in [x for x in top.walk() if _is(x, NOTES)]:
        label = n.attrs.get("label", "").strip()
        if label.isdigit():
            _prune(n, (("a", None),))
            text = re.sub(r"^[.\s]+", "", clean(n, ""))
            if text:
                notes[int(label)] = text
    _prune(top, (*NOTES, ("div", "footnotes")))
    for n in [x for x in top.walk() if _is(x, NOTE_MARKS)]:
        digits = re.sub(r"\D", "", "".join(n.strings()))
        if digits:
            n.kids = [f"\ue000{digits}\ue001"]
    lines, unknown = [], {}
    for n in top.elements():
        if n.name not in LINE_PREFIX:
            unknown[n.name] = unknown.get(n.name, 0) + 1
        elif text := clean(n, ""):
            lines.append(LINE_PREFIX[n.name] + text)
    return lines, notes, unknown, None


def _opinions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [parse_opinion(x) for x in batch.column(1).to_pylist()]
        cols = list(zip(*got, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cols[0]), pa.list_(pa.string())), pa.array([list(d.items()) for d in cols[1]], pa.map_(pa.int32(), pa.string())), pa.array([list(d.items()) for d in cols[2]], pa.map_(pa.string(), pa.int32())), pa.array(list(cols[3]), pa.string())], ["source_id", "body", "notes", "unhandled", "error"])


def opinions(payloads: DataFrame) -> DataFrame:
    """source_id, body, notes, unhandled, error of (source_id, xml)."""
    return payloads.select(F.col("source_id").cast("string").alias("source_id"), "xml").mapInArrow(_opinions, "source_id string, body array<string>, notes map<int,string>, unhandled map<string,int>, error string")
