"""Paper pages: a small tree of each page and what its layout says of it. One Arrow pass; a row per page."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def all(self, *tags: str, cls: str | None = None, **attrs: str) -> list[Node]:
        """Elements below of these tags (any, if none is named) with a class that matches ``cls`` in full and these attributes."""
        fits = lambda n: (not tags or n.tag in tags) and (cls is None or any(re.fullmatch(cls, k) for k in n.attrs.get("class", "").split())) and all(n.attrs.get(k) == v for k, v in attrs.items())
        return [n for n in self.walk() if fits(n)]

    def first(self, *tags: str, **how: str) -> Node | None:
        return next(iter(self.all(*tags, **how)), None)

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x is self or x.tag not in _SILENT:
                todo += reversed(x.children)

    def text(self, between: str = " ") -> str:
        return re.sub(r"\s+", " ", between.join(self.strings()))

    def after(self) -> Iterator[Node]:
        """Elements that follow under the same parent."""
        line = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        yield from line[next((i for i, c in enumerate(line) if c is self), len(line)) + 1 :]

    def within(self, tag: str, cls: str) -> bool:
        node = self.parent
        while node:
            if node.tag == tag and cls in node.attrs.get("class", "").split():
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:  # an end without a start is nothing
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _text(node: Node | None) -> str:
    return node.text() if node else ""


def _meta(page: Node, **attrs: str) -> list[str]:
    return [v for n in page.all("meta", **attrs) if (v := n.attrs.get("content", ""))]


def markdown_table(table: Node) -> tuple[str, int, int]:
    """Markdown, rows and columns; short rows are filled up."""
    rows = [[c.text("") for c in tr.all("th", "td")] for tr in table.all("tr")]
    width = max(map(len, rows), default=0)
    if not rows:
        return "", 0, 0
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), len(rows), width


def _table(node: Node, caption: Node | None) -> tuple:
    return (markdown_table(node)[0], _text(caption) if caption else None, *markdown_table(node)[1:])


def _figure(node: Node, caption: Node | None) -> tuple[str | None, str | None]:
    image = node.first("img")
    return _text(caption) if caption else None, image.attrs.get("src") if image else None


def _items(node: Node | None, **how: str) -> list[str]:
    return [t for li in (node.all("li", **how) if node else ()) if len(t := li.text()) > 10]


def _paragraphs(node: Node | None) -> str:
    return " ".join(p.text() for p in node.all("p")).strip() if node else ""


def _headed(page: Node, word: str) -> Node | None:
    """The first section whose first heading has the word."""
    return next((s for s in page.all("section") if (h := s.first(*HEADINGS)) and word in h.text().lower()), None)


class Generic:
    """Pages without a layout of their own."""

    def title(self, p: Node) -> str:
        return next(iter(_meta(p, name="citation_title") + _meta(p, property="og:title")), None) or _text(p.first("h1"))

    def authors(self, p: Node) -> list[str]:
        return _meta(p, name="citation_author")

    def abstract(self, p: Node) -> str:
        block = next((d for c in ("abstract", "Abstract", "paper-abstract") if (d := p.first("div", cls=c))), None) or p.first("div", id="abstract")
        return block.text() if block else next(iter(_meta(p, name="description")), "")

    def sections(self, p: Node) -> list[tuple[str, int, str]]:
        out = []
        for h in (p.first("article") or p.first("main") or p.first("body") or p).all(*HEADINGS):
            parts = []
            for n in h.after():
                if n.tag in HEADINGS:
                    break
                if n.tag in ("p", "div"):
                    parts.append(n.text())
            if len(h.text()) > 1:
                out.append((h.text(), int(h.tag[1]), " ".join(filter(None, parts))))
        return out

    def tables(self, p: Node) -> list[tuple]:
        return [t for n in p.all("table") if (t := _table(n, n.first("caption")))[2] > 1]

    def figures(self, p: Node) -> list[tuple]:
        return [_figure(n, n.first("figcaption")) for n in p.all("figure")]

    def references(self, p: Node) -> list[str]:
        order = list(p.walk())
        at = next((k for k, n in enumerate(order) if n.tag in HEADINGS and "reference" in n.text().lower()), None)
        behind = order[at + 1 :] if at is not None else []
        return _items(next((n for n in behind if n.tag == "ul"), None) or next((n for n in behind if n.tag == "ol"), None))


class Arxiv(Generic):
    """Pages made from LaTeX; classes begin with ltx_."""

    def title(self, p: Node) -> str:
        own = p.first("h1", cls="ltx_title")
        return own.text() if own else _text(p.first("title")).replace(" - arXiv", "").strip()

    def authors(self, p: Node) -> list[str]:
        return [t for n in p.all("span", cls="ltx_personname") if len(t := n.text()) > 1] or super().authors(p)

    def abstract(self, p: Node) -> str:
        return _paragraphs(p.first("div", cls="ltx_abstract"))

    def sections(self, p: Node) -> list[tuple[str, int, str]]:
        out = []
        for s in p.all("section", cls=r".*ltx_(?:sub){0,2}section.*"):
            head, named = s.first(*HEADINGS[1:]), s.attrs["class"]
            own = [c.text() for c in s.children if isinstance(c, Node) and c.tag in ("p", "div") and "ltx_abstract" not in c.attrs.get("class", "")]
            if head and head.text():
                out.append((head.text(), 3 if "ltx_subsubsection" in named else 2 if "ltx_subsection" in named else 1, " ".join(own).strip()))
        return out

    def tables(self, p: Node) -> list[tuple]:
        framed = [_table(t, f.first("figcaption")) for f in p.all("figure", cls="ltx_table") if (t := f.first("table"))]
        bare = [_table(t, None) for t in p.all("table", cls="ltx_tabular") if not t.within("figure", "ltx_table")]
        return framed + [t for t in bare if t[2] > 1]

    def figures(self, p: Node) -> list[tuple]:
        return [_figure(f, f.first("figcaption")) for f in p.all("figure", cls="ltx_figure")]

    def references(self, p: Node) -> list[str]:
        return _items(p.first("section", cls="ltx_bibliography") or p.first("ul", cls="ltx_biblist"), cls="ltx_bibitem")


class Pmc(Generic):
    def title(self, p: Node) -> str:
        own = p.first("h1", cls="content-title")
        return own.text() if own else next(iter(_meta(p, name="citation_title")), None) or _text(p.first("h1"))

    def authors(self, p: Node) -> list[str]:
        return super().authors(p) or [t for n in p.all("a", cls="contrib-author") if (t := n.text())]

    def abstract(self, p: Node) -> str:
        return _paragraphs(p.first("div", cls="abstract") or p.first("div", id="abstract") or _headed(p, "abstract"))

    def sections(self, p: Node) -> list[tuple[str, int, str]]:
        out = []
        for s in p.all("div", cls="tsec") or p.all("section"):
            head = s.first(*HEADINGS[1:])
            if head and head.text() and "abstract" not in head.text().lower():
                own = " ".join(c.text() for c in s.children if isinstance(c, Node) and c.tag == "p").strip()
                out.append((head.text(), max(1, int(head.tag[1]) - 1), own))
        return out

    def tables(self, p: Node) -> list[tuple]:
        wrapped = [_table(t, w.first("div", cls="caption") or w.first("caption")) for w in p.all("div", cls="table-wrap") if (t := w.first("table"))]
        return wrapped or super().tables(p)

    def figures(self, p: Node) -> list[tuple]:
        return [_figure(f, f.first("div", "figcaption", cls=".*caption.*") or f.first("figcaption")) for f in p.all("div", "figure", cls=".*fig.*")]

    def references(self, p: Node) -> list[str]:
        return _items(p.first("div", cls="ref-list") or p.first("ul", cls="references") or _headed(p, "reference"))


class Acl(Generic):
    """Landing pages: title, authors and abstract only."""

    def title(self, p: Node) -> str:
        own = p.first("h2", id="title")
        return own.text() if own else next(iter(_meta(p, name="citation_title")), "")

    def abstract(self, p: Node) -> str:
        return _text(p.first("div", cls="acl-abstract"))

    sections = tables = figures = references = lambda self, p: []


LAYOUTS: dict[str, Generic] = {"arxiv": Arxiv(), "pmc": Pmc(), "acl": Acl(), "generic": Generic()}
SCHEMA = (
    "title string, abstract string, authors array<string>, sections array<struct<title:string,level:int,content:string>>, "
    "tables array<struct<markdown:string,caption:string,rows:int,cols:int>>, figures array<struct<caption:string,url:string>>, references array<string>"
)
_PARTS: dict[str, Callable[[tuple], dict]] = {
    "sections": lambda s: dict(zip(("title", "level", "content"), s, strict=True)), "tables": lambda t: dict(zip(("markdown", "caption", "rows", "cols"), t, strict=True)),
    "figures": lambda f: dict(zip(("caption", "url"), f, strict=True)),
}


def parse(html: str | None, layout: str | None) -> dict:
    page, how = tree(html or ""), LAYOUTS.get(layout or "generic", LAYOUTS["generic"])
    got = {name: getattr(how, name)(page) for name in ("title", "abstract", "authors", "sections", "tables", "figures", "references")}
    return {k: [_PARTS[k](x) for x in v] if k in _PARTS else v for k, v in got.items()}


def parse_pages(pages: DataFrame, html: str = "html", layout: Column | str = "layout") -> DataFrame:
    """All columns but the HTML, the parts of every page, its raw text and its Markdown. A null page has empty parts."""

    @F.pandas_udf(SCHEMA)
    def parts(page: pd.Series, how: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(p, k) for p, k in zip(page, how, strict=True)], columns=["title", "abstract", "authors", "sections", "tables", "figures", "references"])

    out = pages.withColumn("_p", parts(F.col(html), F.col(layout) if isinstance(layout, str) else layout)).drop(html).select("*", "_p.*").drop("_p")
    return out.withColumns({"raw_text": raw_text(), "markdown": markdown()})


def raw_text() -> Column:
    """Abstract, and title and content of every section, with blank lines between."""
    filled = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(filled(F.col("abstract")), F.flatten(F.transform("sections", lambda s: F.concat(F.array(s.title), filled(s.content))))), "\n\n")


def markdown() -> Column:
    """The whole document as Markdown."""
    none = F.array().cast("array<string>")
    lines = lambda *c: F.array(*c)
    sections = F.transform("sections", lambda s: F.concat(F.repeat(F.lit("#"), F.least(s.level + 1, F.lit(6))), F.lit(" "), s.title, F.lit("\n\n"), s.content, F.lit("\n")))
    tables = F.transform("tables", lambda t, i: F.concat(F.lit("### "), F.when(F.coalesce(t.caption, F.lit("")) != "", t.caption).otherwise(F.concat(F.lit("Table "), (i + 1).cast("string"))), F.lit("\n\n"), t.markdown, F.lit("\n")))
    references = F.transform("references", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r))
    some = lambda c, a: F.when(F.size(c) > 0, a).otherwise(none)
    return F.array_join(F.concat(
        lines(F.concat(F.lit("# "), "title", F.lit("\n"))), some("authors", lines(F.concat(F.lit("**Authors:** "), F.array_join("authors", ", "), F.lit("\n")))),
        F.when(F.col("abstract") != "", lines(F.concat(F.lit("## Abstract\n\n"), "abstract", F.lit("\n")))).otherwise(none), sections,
        some("tables", F.concat(lines(F.lit("## Tables\n")), tables)), some("references", F.concat(lines(F.lit("## References\n")), references, lines(F.lit("")))),
    ), "\n")
