"""Wikitext to HTML, plain text and structured rows.

A small parser makes a tree of nodes; renderer, plain text, infobox and footnote extraction walk it.
Links are extracted by regular expression inside the JVM. Brackets are matched once for a stretch of
text, closing tags are found in sorted lists, and what lies inside brackets is skipped by jumps, so
the time is in proportion to the length, whatever is left open and however deep brackets nest. A
text that cannot be rendered comes out escaped within <pre>, and fails no task.
"""

from __future__ import annotations

import html as _html
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frames of the interpreter that a deeply nested text may use; they lie on the heap.
FRAMES = 1_000_000
#: Prefix of the classes in rendered HTML.
CSS = "wk"
_FILE = ("file:", "image:")
_TABLE_ATTRIBUTES = re.compile(r"^[^|\[\]{}]*\|(?!\|)")
_INLINE = re.compile(r"'''''|'''|''|\{\{|\[\[|\[(?=(?:https?:)?//)|<!--|<nowiki\s*/?>|<ref\b[^<>]*>|</?[A-Za-z][^<>]*>|&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|__[A-Z]+__", re.I)
_BRACKETS = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_MARKS = {mark: re.compile(r"\{\{|\[\[|" + re.escape(mark)) for mark in "|="}
_CLOSERS = {"]": re.compile(r"\]"), "-->": re.compile("-->"), "nowiki": re.compile(r"</nowiki\s*>", re.I), "ref": re.compile(r"</ref\s*>", re.I)}


class Node(NamedTuple):
    kind: str
    text: str = ""
    kids: tuple = ()
    extra: object = None


class _Stretch:
    """A stretch of text with the places where its brackets and tags close."""

    def __init__(self, s: str):
        if sys.getrecursionlimit() < FRAMES:
            sys.setrecursionlimit(FRAMES)
        self.s = s
        self.ends: dict[int, int] = {}  # opening bracket -> index after the one that closes it
        self._closers: dict[str, tuple[list[int], list[int]]] = {}
        open_: dict[str, list[int]] = {"{{": [], "[[": []}
        for m in _BRACKETS.finditer(s):
            if m[0] in open_:
                open_[m[0]].append(m.start())
            elif stack := open_["{{" if m[0] == "}}" else "[["]:
                self.ends[stack.pop()] = m.end()

    def closed(self, at: int, hi: int) -> int:
        """Index after the bracket that closes the one at ``at``; -1 if none does before ``hi``."""
        end = self.ends.get(at, -1)
        return end if end <= hi else -1

    def closer(self, kind: str, at: int, hi: int) -> tuple[int, int]:
        """Start and end of the first closing tag of a kind from ``at`` on; (-1, -1) if there is none before ``hi``."""
        if kind not in self._closers:
            found = list(_CLOSERS[kind].finditer(self.s))
            self._closers[kind] = [m.start() for m in found], [m.end() for m in found]
        starts, ends = self._closers[kind]
        k = bisect_left(starts, at)
        return (starts[k], ends[k]) if k < len(starts) and ends[k] <= hi else (-1, -1)

    def split(self, lo: int, hi: int, mark: str) -> list[tuple[int, int]]:
        """Parts between marks that stand outside brackets; after a bracket left open there is no mark."""
        out, last = [], lo
        pattern, i = _MARKS[mark], lo
        while (m := pattern.search(self.s, i, hi)) is not None:
            i = m.end()
            if m[0] == mark:
                out.append((last, m.start()))
                last = i
            else:
                i = self.closed(m.start(), hi)
                if i < 0:
                    break
        out.append((last, hi))
        return out

    def template(self, lo: int, hi: int) -> Node:
        """Node('template', name, extra = [(name or None, nodes), ...]) in order."""
        (a, b), *parts = self.split(lo, hi, "|")
        params = []
        for x, y in parts:
            key = self.split(x, y, "=")[0]
            named = key[1] < y
            params.append((self.s[key[0] : key[1]].strip() if named else None, self.inline(key[1] + 1 if named else x, y)))
        return Node("template", plain(self.inline(a, b)).strip(), (), params)

    def link(self, lo: int, hi: int) -> Node:
        (a, b), *parts = self.split(lo, hi, "|")
        target = self.s[a:b].strip()
        if target.lower().startswith(_FILE):
            return Node("image", target)
        if target.lower().startswith("category:"):
            return Node("none")
        return Node("link", target, self.inline(parts[0][0], hi) if parts else ())

    def inline(self, lo: int, hi: int) -> tuple[Node, ...]:
        """Inline nodes of s[lo:hi]."""
        s = self.s
        out: list[Node] = []
        at = lo
        while (m := _INLINE.search(s, at, hi)) is not None:
            t, low, end = m[0], m[0].lower(), m.end()
            node = None
            if t[0] == "'":
                node = Node({2: "italic", 3: "bold", 5: "bolditalic"}[len(t)])
            elif t in ("{{", "[["):
                close = self.closed(m.start(), hi)
                if close > 0:
                    node, end = (self.template if t == "{{" else self.link)(end, close - 2), close
            elif t == "[":
                close, after = self.closer("]", end, hi)
                if close > 0:
                    node, end = Node("extlink", s[end:close]), after
            elif t == "<!--":
                close, after = self.closer("-->", end, hi)
                node, end = Node("none"), hi if close < 0 else after
            elif low.startswith("<nowiki") or low.startswith("<ref"):
                kind = "nowiki" if low[1] == "n" else "ref"
                close, after = (-1, -1) if low.endswith("/>") else self.closer(kind, end, hi)
                if low.endswith("/>"):
                    node = Node("none")
                elif close > 0:
                    node, end = Node(kind, s[end:close], self.inline(end, close) if kind == "ref" else ()), after
            elif t[0] == "<":
                node = Node("none")
            elif t[0] == "&":
                x = _html.unescape(t)
                node = Node("text", x) if x != t else None
            else:
                node = Node("none")
            if m.start() > at:
                out.append(Node("text", s[at : m.start()]))
            if node is None:
                out.append(Node("text", t))
                end = m.end()
            elif node.kind != "none":
                out.append(node)
            at = end
        if at < hi:
            out.append(Node("text", s[at:hi]))
        return tuple(out)


def inline(s: str) -> tuple[Node, ...]:
    """Inline nodes of a stretch of text."""
    return _Stretch(s).inline(0, len(s))


_HEADING = re.compile(r"^(={1,6})(.+?)\1\s*$")


def blocks(s: str) -> Iterator[Node]:
    """Block nodes of a document: heading, rule, list, pre, table, para, break."""
    lines = s.replace("\r\n", "\n").split("\n")
    i, n = 0, len(lines)
    para: list[str] = []

    def flush() -> Iterator[Node]:
        if para:
            yield Node("para", "", inline("\n".join(para)))
            para.clear()

    while i < n:
        line = lines[i]
        h = _HEADING.match(line)
        if h:
            yield from flush()
            yield Node("heading", "", inline(h[2].strip()), len(h[1]))
        elif line.startswith("----"):
            yield from flush()
            yield Node("rule")
        elif line[:1] in "*#;:" and line[:1]:
            yield from flush()
            kind, items = line[0], []
            group = "*" if kind == "*" else "#" if kind == "#" else ";:"
            while i < n and lines[i][:1] and lines[i][0] in group:
                items.append((lines[i][0], inline(lines[i].lstrip("*#;:").strip())))
                i += 1
            yield Node("list", group, (), items)
            continue
        elif line.startswith("{|"):
            yield from flush()
            body = [line]
            while i + 1 < n and not lines[i].startswith("|}"):
                i += 1
                body.append(lines[i])
            yield _table(body)
        elif line.startswith(" ") and line.strip():
            yield from flush()
            body = []
            while i < n and lines[i].startswith(" ") and lines[i].strip():
                body.append(lines[i][1:])
                i += 1
            yield Node("pre", "", inline("\n".join(body)))
            continue
        elif not line.strip():
            yield from flush()
            yield Node("break")
        else:
            open_ = line.count("{{") - line.count("}}")
            para.append(line)
            while open_ > 0 and i + 1 < n:  # a template over several lines is one piece
                i += 1
                para.append(lines[i])
                open_ += lines[i].count("{{") - lines[i].count("}}")
        i += 1
    yield from flush()


def _table(lines: list[str]) -> Node:
    captions, rows, row = [], [], []
    for line in lines[1:]:
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            if row:
                rows.append(row)
            row = []
        elif line.startswith("|+"):
            captions.append(inline(line[2:].strip()))
        elif line[:1] in "|!" and line[:1]:
            head = line[0] == "!"
            for cell in re.split(r"\|\||!!" if head else r"\|\|", line[1:]):
                row.append((head, inline(_TABLE_ATTRIBUTES.sub("", cell).strip())))
        elif row:
            head, nodes = row[-1]
            row[-1] = (head, (*nodes, Node("text", "\n"), *inline(line)))
    if row:
        rows.append(row)
    return Node("table", "", (), (captions, rows))


def plain(nodes) -> str:
    """The text of nodes; toggles, images and footnotes' marks have none, a template its name in braces."""
    out = []
    for x in nodes:
        if x.kind in ("text", "nowiki"):
            out.append(x.text)
        elif x.kind == "link":
            out.append(plain(x.kids) if x.kids else x.text)
        elif x.kind == "template":
            out.append("{" + x.text + "}")
        elif x.kind in ("ref", "heading", "para"):
            out.append(plain(x.kids))
    return "".join(out)


def _esc(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def slug(x: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "-", x).strip("-").lower() or "section"


def url_title(x: str) -> str:
    return re.sub(r'[#?%&"<>\\|{}]', lambda m: f"%{ord(m[0]):02X}", x.replace(" ", "_"))


class Renderer:
    """HTML of one document; ``there`` tells which titles exist (None: all)."""

    def __init__(self, there=None, css: str = CSS, levels: tuple[int, int] = (2, 6)):
        self.there, self.css, self.levels = there, css, levels
        self.out: list[str] = []
        self.refs: list[str] = []
        self.ids: dict[str, int] = {}
        self.on: dict[str, bool] = {}
        self.in_p = False

    def heading_id(self, text: str) -> str:
        """repeated slugs get -2, -3, ..."""
        s = slug(text)
        self.ids[s] = self.ids.get(s, 0) + 1
        return f"s-{s}" + (f"-{self.ids[s]}" if self.ids[s] > 1 else "")

    def open_p(self) -> None:
        if not self.in_p:
            self.out.append("<p>")
            self.in_p = True

    def close_inline(self) -> None:
        for kind, tag in (("bolditalic", "</em></strong>"), ("bold", "</strong>"), ("italic", "</em>")):
            if self.on.pop(kind, False):
                self.out.append(tag)

    def end_block(self) -> None:
        self.close_inline()
        if self.in_p:
            self.out.append("</p>")
            self.in_p = False

    def inside(self, tag: str, nodes, attributes: str = "") -> None:
        """Nodes within a tag, without paragraphs of their own."""
        self.out.append(f"<{tag}{attributes}>")
        was, self.in_p = self.in_p, True
        self.walk(nodes)
        self.close_inline()
        self.in_p = was
        self.out.append(f"</{tag}>")

    def document(self, text: str) -> str:
        for b in blocks(text):
            self.block(b)
        self.end_block()
        if self.refs:
            anchor = self.heading_id("References")
            items = "".join(f'<li id="ref-{i}">{r}</li>' for i, r in enumerate(self.refs, 1))
            self.out.append(f'<section class="{self.css}-notes"><h2 id="{anchor}">References</h2><ol>{items}</ol></section>')
        return "".join(self.out)

    def block(self, b: Node) -> None:
        if b.kind == "para":
            self.walk(b.kids)
            return
        self.end_block()
        if b.kind == "heading":
            level = min(max(b.extra, self.levels[0]), self.levels[1])
            self.inside(f"h{level}", b.kids, f' id="{_esc(self.heading_id(plain(b.kids)))}"')
        elif b.kind == "rule":
            self.out.append("<hr/>")
        elif b.kind == "pre":
            self.out.append(f'<pre class="{self.css}-typed">{_esc(plain(b.kids))}</pre>')
        elif b.kind == "list":
            tag = {"*": "ul", "#": "ol"}.get(b.text, "dl")
            self.out.append(f"<{tag}>")
            for mark, nodes in b.extra:
                self.inside({";": "dt", ":": "dd"}.get(mark, "li"), nodes)
            self.out.append(f"</{tag}>")
        elif b.kind == "table":
            captions, rows = b.extra
            self.out.append(f'<table class="{self.css}-grid">')
            for c in captions:
                self.inside("caption", c)
            for row in rows:
                self.out.append("<tr>")
                for head, nodes in row:
                    self.inside("th" if head else "td", nodes)
                self.out.append("</tr>")
            self.out.append("</table>")

    def walk(self, nodes) -> None:
        for x in nodes:
            k = x.kind
            if k == "template":
                self.template(x)
                continue
            self.open_p()
            if k in ("text", "nowiki"):
                self.out.append(_esc(x.text))
            elif k in ("bold", "italic", "bolditalic"):
                on, off = {"bold": ("<strong>", "</strong>"), "italic": ("<em>", "</em>"), "bolditalic": ("<strong><em>", "</em></strong>")}[k]
                self.out.append(off if self.on.get(k) else on)
                self.on[k] = not self.on.get(k)
            elif k == "link":
                missing = "" if self.there is None or x.text in self.there else f" {self.css}-absent"
                self.out.append(f'<a href="#/article/{_esc(url_title(x.text))}" class="{self.css}-link{missing}">')
                if x.kids:
                    self.walk(x.kids)
                else:
                    self.out.append(_esc(x.text))
                self.close_inline()
                self.out.append("</a>")
            elif k == "extlink":
                url, _, label = x.text.strip().partition(" ")
                shown = plain(inline(label)).strip() or url
                self.out.append(f'<a href="{_esc(url)}" class="{self.css}-web" target="_blank" rel="noopener noreferrer">{_esc(shown)}</a>')
            elif k == "image":
                self.out.append(f'<span class="{self.css}-picture">{_esc(x.text)}</span>')
            elif k == "ref":
                saved = self.out, self.on
                self.out, self.on = [], {}
                self.walk(x.kids)
                self.close_inline()
                body = "".join(self.out)
                self.out, self.on = saved
                self.refs.append(body)
                n = len(self.refs)
                self.out.append(f'<sup class="{self.css}-note"><a href="#ref-{n}">[{n}]</a></sup>')

    def template(self, t: Node) -> None:
        """Known families readably, others as a placeholder."""
        name = t.text.lower().replace("_", " ")
        places = [plain(v).strip() for k, v in t.extra if k is None]
        if name.startswith("infobox"):
            rows = [(k, v) for k, v in infobox_rows(t) if v]
            if rows:
                self.end_block()
                body = "".join(f"<tr><th>{_esc(k)}</th><td>{_esc(v)}</td></tr>" for k, v in rows)
                title = t.text.replace("_", " ")
                self.out.append(f'<div class="{self.css}-facts"><div class="{self.css}-facts-name">{_esc(title[:1].upper() + title[1:])}</div><table>{body}</table></div>')
                return
        elif name == "citation" or name.startswith("cite"):
            parts = citation_parts(t)
            if parts:
                self.open_p()
                self.out.append(f'<span class="{self.css}-source">{". ".join(parts)}</span>')
                return
        elif name == "convert" and len(places) >= 2:
            self.open_p()
            self.out.append(f'<span class="{self.css}-measure">{_esc(places[0])} {_esc(places[1])}</span>')
            return
        elif name == "lang" or name.startswith("ipa"):
            shown = (places[-1] if name == "lang" else places[0]) if places else ""
            if shown:
                self.open_p()
                self.out.append(_esc(shown))
                return
        self.open_p()
        self.out.append(f'<span class="{self.css}-template">{{{_esc(t.text)}}}</span>')


def infobox_rows(t: Node) -> list[tuple[str, str]]:
    """Named parameters with a value, '_' in names as spaces."""
    rows = [((k or "").replace("_", " ").strip(), plain(v).strip()) for k, v in t.extra if k]
    return [(k, v) for k, v in rows if k and v]


def named(t: Node, key: str) -> str | None:
    """The first non-empty value of a parameter, name compared without ASCII case."""
    for k, v in t.extra:
        if k is not None and k.lower() == key and (x := plain(v).strip()):
            return x
    return None


def citation_parts(t: Node) -> list[str]:
    """Title in quotes, author, (date), url, as far as there are any."""
    out = []
    if title := named(t, "title"):
        out.append(f"“{_esc(title)}”")
    author = named(t, "author")
    if author is None and (last := named(t, "last")):
        first = named(t, "first")
        author = f"{last}, {first}" if first else last
    if author:
        out.append(_esc(author))
    if date := named(t, "date"):
        out.append(f"({_esc(date)})")
    if url := named(t, "url"):
        web = url.startswith(("http://", "https://"))
        out.append(f'<a href="{_esc(url)}" target="_blank" rel="noopener noreferrer">{_esc(url)}</a>' if web else _esc(url))
    return out


def _walk_all(nodes) -> Iterator[Node]:
    """All nodes, each before those within it."""
    stack = [iter(nodes)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            continue
        yield x
        inner = [x.kids]
        if x.kind in ("template", "list"):
            inner += [v for _, v in x.extra]
        elif x.kind == "table":
            inner += x.extra[0] + [v for row in x.extra[1] for _, v in row]
        stack.append(chain.from_iterable(inner))


def _each(f, otherwise=None, null=None):
    """Applied to every text; ``otherwise`` gives the value of a text that cannot be parsed, ``null`` that of a null."""

    def one(x: str | None):
        if x is None:
            return null
        try:
            return f(x)
        except Exception:
            if otherwise is None:
                raise
            return otherwise(x)

    return one


def render_text(text: str) -> str:
    """The HTML of a text; a text that cannot be parsed comes out as it is, escaped within <pre>."""
    return _each(lambda x: Renderer().document(x), lambda x: f'<pre class="{CSS}-unread">{_esc(x)}</pre>')(text)


@F.pandas_udf(T.StringType())
def render(texts: pd.Series) -> pd.Series:
    """HTML; null stays null."""
    return texts.map(lambda x: None if x is None else render_text(x))


@F.pandas_udf(T.StringType())
def plain_text(texts: pd.Series) -> pd.Series:
    """paragraphs' and headings' text, one per line."""
    return texts.map(_each(lambda x: "\n".join(p for p in (plain(b.kids).strip() for b in blocks(x)) if p), lambda x: x))


_ROWS = T.ArrayType(T.StructType().add("name", "string").add("key", "string").add("value", "string"))


@F.pandas_udf(_ROWS)
def infoboxes(texts: pd.Series) -> pd.Series:
    """(template, key, value) of every infobox parameter with a value."""

    def one(x):
        found = [t for t in _walk_all(blocks(x)) if t.kind == "template" and t.text.lower().startswith("infobox")]
        return [(t.text, k, v) for t in found for k, v in infobox_rows(t)]

    return texts.map(_each(one, lambda _: [], []))


@F.pandas_udf(T.ArrayType(T.StringType()))
def references(texts: pd.Series) -> pd.Series:
    """The plain text of each footnote, in order; its number is its place."""
    return texts.map(_each(lambda x: [plain(r.kids).strip() for r in _walk_all(blocks(x)) if r.kind == "ref"], lambda _: [], []))


def internal_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, target) of internal links, files and categories left out; inside the JVM."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|{}<>\n]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    x = df.select(key, F.posexplode(found).alias("pos", "target")).withColumn("target", F.btrim("target"))
    return x.where(~F.lower("target").rlike("^(?:file|image|category):") & (F.col("target") != ""))


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, level, text, id) of headings, repeated slugs numbered within the document; inside the JVM."""
    from .scalars import slugify

    found = F.regexp_extract_all(text, F.lit(r"(?m)^(={2,6}[^=\n][^\n]*?={2,6})[ \t]*$"), F.lit(1))
    x = df.select(key, F.posexplode(found).alias("pos", "h"))
    x = x.select(key, "pos", F.length(F.regexp_extract("h", "^(=+)", 1)).alias("level"), F.btrim(F.btrim("h", F.lit("="))).alias("text")).withColumn("slug", slugify("text"))
    n = F.row_number().over(Window.partitionBy(key, "slug").orderBy("pos"))
    anchor = F.concat(F.lit("s-"), "slug", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise(""))
    return x.select(key, "pos", "level", "text", anchor.alias("id"))


def with_availability(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links with ``available``, by a join on the titles."""
    from ..operators.lookup import links_available

    return links_available(links, articles)


