"""Elements of web pages, by the parser of the standard library in Arrow batches.

Visible text is all text outside script, style and template; computed visibility
needs a browser and is not known here.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
RAW = {"script", "style", "template", "noscript"}
BOILERPLATE = {"nav", "header", "footer", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KINDS = {"a": "link", "p": "paragraph", "button": "button", "li": "list_item", "img": "image", "form": "form", "input": "input", "article": "article", "nav": "nav", "footer": "footer", "title": "title"} | {h: "heading" for h in HEADINGS}


class Collector(HTMLParser):
    """Elements in document order: tag, text, attributes, and whether a boilerplate element holds them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "p":  # an open paragraph ends where the next begins
            self._close("p")
        own = None
        if tag in KINDS:
            inside = next((t for t, _ in self.open if t in BOILERPLATE), None)
            article = next((e["at"] for t, e in reversed(self.open) if t == "article"), None)
            own = {"tag": tag, "kind": KINDS[tag], "attrs": {k: v or "" for k, v in attrs}, "text": [], "zone": inside, "article": article, "at": len(self.found)}
            self.found.append(own)
        if tag not in VOID:
            self.open.append((tag, own))

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in BOILERPLATE | {"article", "body", "div"} and tag == "p":
                return

    def handle_data(self, data):
        if any(t in RAW for t, _ in self.open):
            return
        self.text.append(data)
        for _, own in self.open:
            if own is not None:
                own["text"].append(data)


#: Elements that are handed on at a time.
HANDED = 5_000


def _flat(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


_ELEMENTS = "page_id long, url string, pos int, element_type string, tag string, text string, zone string, article int, attrs map<string,string>"


def elements(pages: DataFrame) -> DataFrame:
    """One row an element of (page_id, url, html), in document order; article is the pos of the innermost article around it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()))
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _ELEMENTS.split(", ")])
        for b in batches:
            rows: list[tuple] = []
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                c = Collector()
                c.feed(html or "")
                c.close()
                rows += [(page, url, k, e["kind"], e["tag"], _flat(e["text"]), e["zone"], e["article"], list(e["attrs"].items())) for k, e in enumerate(c.found)]
                if len(rows) > HANDED:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    return pages.select("page_id", "url", "html").mapInArrow(work, _ELEMENTS)


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, text: visible text with white space collapsed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for html in b.column(1).to_pylist():
                c = Collector()
                c.feed(html or "")
                c.close()
                out.append(_flat(c.text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(work, "page_id long, text string")


class Siblings(HTMLParser):
    """Headings and links with what stands around them: whether a paragraph is among the next five siblings, and the parent's HTML."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.lines = html, [0]
        for k, c in enumerate(html):
            if c == "\n":
                self.lines.append(k + 1)
        root = {"tag": "", "children": [], "start": 0, "end": len(html), "text": [], "parent": None}
        self.open, self.all = [root], []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1]["tag"] == "p":
            self.open.pop()["end"] = self._at()
        node = {"tag": tag, "children": [], "start": self._at(), "end": None, "text": [], "parent": self.open[-1], "href": dict(attrs).get("href"), "place": len(self.open[-1]["children"])}
        self.open[-1]["children"].append(tag)
        if tag in HEADINGS or tag == "a":
            self.all.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k]["tag"] == tag:
                for node in self.open[k + 1 :]:
                    node["end"] = self._at()
                self.open[k]["end"] = self.html.find(">", self._at()) + 1
                del self.open[k:]
                return

    def handle_data(self, data):
        for node in self.open:
            if node["tag"] in HEADINGS or node["tag"] == "a":
                node["text"].append(data)

    def rows(self, chars: int, reach: int) -> Iterator[tuple]:
        for k, n in enumerate(self.all):
            up = n["parent"]
            end = up["end"] if up["end"] is not None else len(self.html)
            yield k, "link" if n["tag"] == "a" else "heading", _flat(n["text"]), n["href"], "p" in up["children"][n["place"] + 1 : n["place"] + 1 + reach], self.html[up["start"] : min(end, up["start"] + chars)]


def siblings(pages: DataFrame, chars: int = 500, reach: int = 5) -> DataFrame:
    """Headings and links of pages (page_id, html): page_id, pos, kind, text, href, paragraph_follows, context; page by page."""
    names = "page_id long, pos int, kind string, text string, href string, paragraph_follows boolean, context string"
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, html in zip(*(c.to_pylist() for c in b.columns)):
                own = Siblings(html or "")
                own.feed(html or "")
                own.close()
                rows = [(page, *r) for r in own.rows(chars, reach)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in names.split(", ")])

    return pages.select("page_id", "html").mapInArrow(work, names)


def links(found: DataFrame, strip: bool = False) -> DataFrame:
    """Links of elements(); strip leaves out those in navigation, headers and footers."""
    own = found.where("element_type = 'link'").select("page_id", "url", "pos", "text", F.try_element_at("attrs", F.lit("href")).alias("href"), "zone")
    return own.where("zone is null") if strip else own


def containers(found: DataFrame) -> DataFrame:
    """A heading with what follows it up to the next: up to three paragraphs of over 20 characters, and the first link."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("page_id").orderBy("pos")
    own = found.where("zone is null").withColumn("part", F.count(F.when(F.col("element_type") == "heading", 1)).over(order)).where("part > 0")
    text = F.when((F.col("element_type") == "paragraph") & (F.length("text") > 20), F.struct("pos", "text"))
    return own.groupBy("page_id", "part").agg(
        F.min_by("text", "pos").alias("heading"), F.min_by("tag", "pos").alias("tag"),
        F.transform(F.slice(F.sort_array(F.collect_list(text)), 1, 3), lambda x: x["text"]).alias("paragraphs"),
        F.min_by(F.when(F.col("element_type") == "link", F.try_element_at("attrs", F.lit("href"))), F.when(F.col("element_type") == "link", F.col("pos"))).alias("main_link"),
    )


def cards(found: DataFrame) -> DataFrame:
    """One row an article: its first heading, first paragraph of over 20 characters (the excerpt) and first link, null where it has none."""
    kind, first = F.col("element_type"), lambda of, where: F.min_by(of, F.when(where, F.col("pos")))
    own = found.where("article is not null").groupBy("page_id", "article").agg(
        first(F.col("text"), kind == "heading").alias("heading"),
        first(F.col("text"), (kind == "paragraph") & (F.length("text") > 20)).alias("excerpt"),
        first(F.try_element_at("attrs", F.lit("href")), kind == "link").alias("link"),
    )
    return own


def main_content(found: DataFrame, long: int = 100, least: int = 200) -> DataFrame:
    """page_id, text: paragraphs of over 100 characters within articles, blank lines between; below 200 characters, all paragraphs outside navigation."""
    own = found.where("element_type = 'paragraph' and zone is null and text <> ''")
    join = lambda where: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(where, F.struct("pos", "text")))), lambda x: x["text"]), "\n\n")
    both = own.groupBy("page_id").agg(join(F.col("article").isNotNull() & (F.length("text") > long)).alias("core"), join(F.lit(True)).alias("body"))
    return both.select("page_id", F.when(F.length("core") < least, F.col("body")).otherwise(F.col("core")).alias("text"))


def following(found: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """What stands below each heading up to the next: up to five paragraphs of over 10 characters, joined and cut at 500."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("page_id").orderBy("pos")
    own = found.where("zone is null").withColumn("part", F.count(F.when(F.col("element_type") == "heading", 1)).over(order)).where("part > 0")
    text = F.when((F.col("element_type") == "paragraph") & (F.length("text") > 10), F.struct("pos", "text"))
    below = F.transform(F.slice(F.sort_array(F.collect_list(text)), 1, most), lambda x: x["text"])
    return own.groupBy("page_id", "part").agg(F.min_by("text", "pos").alias("heading"), F.left(F.array_join(below, " "), F.lit(chars)).alias("content"))


def primary_heading(found: DataFrame) -> DataFrame:
    """page_id, heading: the first h1, else the first h2, else the first heading, 50 characters of it."""
    level = F.when(F.col("tag") == "h1", 1).when(F.col("tag") == "h2", 2).otherwise(3)
    return found.where("element_type = 'heading' and text <> ''").groupBy("page_id").agg(F.min_by(F.left("text", F.lit(50)), F.struct(level, "pos")).alias("heading"))


def data_attributes(attrs):
    return F.map_filter(attrs, lambda k, v: k.startswith("data-"))
