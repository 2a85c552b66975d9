"""Pages as trees: one row for each page, with its elements in document order and its strings.

An element knows its ancestors and its stretch of the page's strings, so text of
an element, climbing to an ancestor and looking for one inside are array
expressions on the page's own row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlake.functions.text import bound  # noqa: F401

# Elements without content, what an opening tag closes, where that ends, and elements whose content is no text.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), **dict.fromkeys(("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"), ("p",))}
SCOPES = ("ul", "ol", "dl", "table", "select", "div", "section", "article", "body", "html")
SILENT = ("script", "style", "template")
#: Elements nested deeper are taken for children of the one at this depth.
DEEPEST = 512

_ELEMENT = "struct<node:int,last:int,tag:string,attrs:map<string,string>,above:array<int>,first:int,until:int>"


class _Builder(HTMLParser):
    """Collects elements [tag, attrs, above, first, last, until] and trimmed strings, or their trimmed lines of more than ``over`` characters."""

    def __init__(self, over: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.over = over
        self.elements: list[list] = [["[document]", {}, [], 0, 0, 0]]
        self.strings: list[str] = []
        self.open = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for inner in reversed(self.open[1:]) if tag in CLOSES else ():
            name = self.elements[inner][0]
            if name in CLOSES[tag]:
                self._close(inner)
            elif name in SCOPES:
                break
        self.elements.append([tag, {k: v or "" for k, v in attrs}, self.open[::-1], len(self.strings), 0, 0])
        self.open.append(len(self.elements) - 1)
        if tag in VOID or len(self.open) > DEEPEST:
            self._close(self.open[-1])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.elements[self.open[-1]][0] == tag and self.open[-1] == len(self.elements) - 1:
            self._close(self.open[-1])

    def handle_endtag(self, tag: str) -> None:
        for inner in reversed(self.open[1:]):
            if self.elements[inner][0] == tag:
                self._close(inner)
                return

    def _close(self, element: int) -> None:
        while self.open[-1] >= element and len(self.open) > 1:
            one = self.elements[self.open.pop()]
            one[4:] = [len(self.elements) - 1, len(self.strings)]

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or self.elements[self.open[-1]][0] in SILENT:
            return
        if self.over is None:
            self.strings.append(text)
        else:
            self.strings.extend(line for x in text.split("\n") if len(line := x.strip(" ")) > self.over)

    def done(self) -> None:
        self.close()
        self._close(1)
        self.elements[0][4:] = [len(self.elements) - 1, len(self.strings)]


class _Trees:
    """Parsed pages as Arrow columns, an element's fields as flat lists."""

    def __init__(self) -> None:
        self.pages, self.node, self.last, self.tag, self.first, self.until = [0], [], [], [], [], []
        self.attrs, self.keys, self.values = [0], [], []
        self.aboves, self.above = [0], []
        self.texts, self.strings = [0], []

    def add(self, page: _Builder) -> None:
        for node, (tag, attrs, above, first, last, until) in enumerate(page.elements):
            self.node.append(node)
            self.last.append(last)
            self.tag.append(tag)
            self.first.append(first)
            self.until.append(until)
            if attrs:
                self.keys.extend(attrs)
                self.values.extend(attrs.values())
            self.attrs.append(len(self.keys))
            self.above.extend(above)
            self.aboves.append(len(self.above))
        self.strings.extend(page.strings)
        self.pages.append(len(self.node))
        self.texts.append(len(self.strings))

    def columns(self) -> list[pa.Array]:
        number = lambda x: pa.array(x, pa.int32())
        attrs = pa.MapArray.from_arrays(number(self.attrs), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        above = pa.ListArray.from_arrays(number(self.aboves), number(self.above))
        fields = [number(self.node), number(self.last), pa.array(self.tag, pa.string()), attrs, above, number(self.first), number(self.until)]
        elements = pa.StructArray.from_arrays(fields, ["node", "last", "tag", "attrs", "above", "first", "until"])
        return [pa.ListArray.from_arrays(number(self.pages), elements), pa.ListArray.from_arrays(number(self.texts), pa.array(self.strings, pa.string()))]


#: Pages are handed over together up to about so many characters, elements and ancestors.
_TOGETHER = 1 << 18


def _parsed(batches: Iterator[pa.RecordBatch], over: int | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        carried = [n for n in batch.schema.names if n != "html"]
        html, begun, trees, size = batch.column("html"), 0, _Trees(), 0
        for at in range(batch.num_rows):
            text = html[at].as_py() or ""
            builder = _Builder(over)
            builder.feed(text)
            builder.done()
            trees.add(builder)
            size += len(text)
            if at == batch.num_rows - 1 or size + len(trees.node) + len(trees.above) >= _TOGETHER:
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(begun, at + 1 - begun) for n in carried], *trees.columns()], names=[*carried, "elements", "strings"])
                begun, trees, size = at + 1, _Trees(), 0


def tree(pages: DataFrame, *carried: str, html: str = "html", over: int | None = None) -> DataFrame:
    """(carried columns, elements, strings) of pages; element 0 is the document.

    Unclosed elements end with their parent, list items, table cells, rows and
    paragraphs also where the next one opens; closing tags without an opening one are
    ignored.  Scripts and styles have no strings.  A null page is an empty document.
    With ``over``, the strings are lines of more than so many characters, so an
    element's stretch says how many it holds without looking at them.
    """
    rows = pages.select(*carried, F.col(html).alias("html"))
    kept = StructType([f for f in rows.schema.fields if f.name != "html"])
    return rows.mapInArrow(partial(_parsed, over=over), StructType(kept.fields + StructType.fromDDL(f"elements array<{_ELEMENT}>, strings array<string>").fields))


Test = Callable[[Column], Column]


def strings_of(e: Column) -> Column:
    return F.slice(F.col("strings"), e["first"] + 1, e["until"] - e["first"])


def text_of(e: Column) -> Column:
    """The strings inside an element, joined by spaces; empty for none."""
    return F.coalesce(F.array_join(strings_of(e), " "), F.lit(""))


def attribute(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def has_class(e: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(e, "class"), r"\s+"), name), F.lit(False))


def is_tag(e: Column, *names: str) -> Column:
    return e["tag"].isin(*names)


def all_of(test: Test) -> Column:
    """All elements of the page that pass, in order."""
    return F.filter("elements", test)


def links_to(pattern: str) -> Column:
    return all_of(lambda e: is_tag(e, "a") & attribute(e, "href").rlike(pattern))


def ancestors(e: Column, most: int | None = None) -> Column:
    """The element's ancestors, nearest first."""
    above = e["above"] if most is None else F.slice(e["above"], 1, most)
    return F.transform(above, lambda i: F.get(F.col("elements"), i))


def climbed(e: Column, test: Test, most: int | None = None) -> Column:
    """The nearest ancestor that passes, of the nearest ``most``; null for none."""
    return F.get(F.filter(ancestors(e, most), test), 0)


def inside(e: Column, test: Test) -> Column:
    """The first element inside that passes; null for none."""
    return F.get(F.filter(F.slice(F.col("elements"), e["node"] + 2, e["last"] - e["node"]), test), 0)
