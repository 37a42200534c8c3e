"""Outlined pages of works as nodes, their links and ancestors, and volumes of segments.

A page is parsed in one pass by the standard library's parser; what follows are joins and expressions over nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.marks import J_SPACE

#: The form of a node's id (work, outline, number), classes of elements, and page marks within texts.
NODE_ID = r"([A-Z]\d+)D(\d+)_(\d+)"
NODE, HEAD, HEAD_TEXT, VERSE, PAGE, LINK, VOLUME, PARAGRAPH = "ybhDiv", "YBh_head", "head_text", "lg", "ref", "link2oth", "juan_text", "normal"
PAGE_MARKS = [r"\[T\d+,\s*p?\d+[a-c]?\d*\]", r"\[\d+[a-c]\d+\]"]
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

NODES = StructType(
    [StructField("node_id", StringType()), StructField("head", StringType()), StructField("path", StringType()), StructField("text", StringType()), StructField("page", StringType())]
    + [StructField(c, ArrayType(StringType())) for c in ("ancestors", "links")]
    + [StructField("number", IntegerType())]
)
_NODES = pa.list_(pa.struct([(c, pa.string()) for c in NODES.names[:5]] + [(c, pa.list_(pa.string())) for c in ("ancestors", "links")] + [("number", pa.int32())]))


class _Node:
    def __init__(self, node_id: str | None, ancestors: list[str]):
        self.id, self.ancestors = node_id, ancestors
        self.path, self.page = "", None
        self.named: list[str] | None = None
        self.heads: list[list[str]] = []
        self.headed = False
        self.paragraphs: list[list[str]] = []
        self.verses: list[list[str]] = []
        self.links: list[str] = []

    def row(self, number: int) -> dict:
        said = lambda parts: [t for t in map("".join, parts) if t]
        head = "".join(self.named) if self.named is not None else next(iter(said(self.heads)), "")
        text = "\n".join(said(self.paragraphs) + said(self.verses))
        return {"node_id": self.id, "head": head, "path": self.path, "text": text, "page": self.page or "", "ancestors": self.ancestors, "links": self.links, "number": number}


class _Page(HTMLParser):
    """The open elements are a stack; an element may be a node, and may have a list that takes every text within it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, _Node | None, list[str] | None, _Node | None]] = []  # tag, node, sink, node whose head this is
        self.nodes: list[_Node] = []
        self.plain: list[_Node] = []
        self.outlined = False
        self.volume: int | None = None  # depth of the first volume's element
        self.volumes = 0
        self.last_page = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = {k: v or "" for k, v in attrs}
        classes, id_ = has.get("class", "").split(), has.get("id", "")
        _, parent, _, head_of = self.open[-1] if self.open else ("", None, None, None)
        within = [n for _, n, _, _ in self.open if n]
        node, sink, head = None, None, None
        if tag == "div" and NODE in classes:
            self.outlined = True
            if re.match(NODE_ID, id_):
                node = _Node(id_, [n.id for n in within])
                self.nodes.append(node)
        elif parent and tag == "p":
            sink = []
            parent.paragraphs.append(sink)
        elif parent and tag == "div" and VERSE in classes:
            sink = []
            parent.verses.append(sink)
        elif parent and tag == "div" and HEAD in classes and not parent.headed:
            parent.headed, head = True, parent
        elif head_of and tag not in ("a", "span"):
            sink = []
            head_of.heads.append(sink)
        if tag == "span" and HEAD_TEXT in classes:
            owner = next((h for *_, h in reversed(self.open) if h), None)
            if owner and owner.named is None:
                owner.named = sink = []
                owner.path = has.get("path", "")
        if tag == "a" and PAGE in classes:
            self.last_page = id_
            for n in within:
                n.page = id_ if n.page is None else n.page
        if tag == "a" and LINK in classes and re.match(NODE_ID, id_):
            for n in within:
                n.links.append(id_)
        if tag == "div" and VOLUME in classes and self.volumes == 0:
            self.volumes, self.volume = 1, len(self.open)
        if tag == "p" and PARAGRAPH in classes and self.volume is not None:
            extra = _Node(None, [])
            extra.page, extra.paragraphs = self.last_page, [sink if sink is not None else []]
            sink = extra.paragraphs[0]
            self.plain.append(extra)
        if tag not in _EMPTY:
            self.open.append((tag, node, sink, head))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is not None:
            del self.open[at:]
            if self.volume is not None and at <= self.volume:
                self.volume = None

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or (self.open and self.open[-1][0] in ("script", "style")):
            return
        for _, _, sink, _ in self.open:
            if sink is not None:
                sink.append(text)
        if self.open and self.open[-1][3]:
            self.open[-1][3].heads.append([text])


def parsed(html: str, name: str) -> list[dict]:
    """The nodes of a page; of a page without an outline its paragraphs, named by the page and their number."""
    page = _Page()
    page.feed(html)
    page.close()
    if not page.outlined:
        for k, n in enumerate(page.plain, 1):
            n.id = f"{name}_p{k}"
    return [n.row(k) for k, n in enumerate(page.nodes if page.outlined else page.plain, 1)]


def outline(pages: DataFrame, name: str, html: str) -> DataFrame:
    """A10: name, number, node_id, work, head, path, text, page, ancestors (ids of the nodes around it, outermost first) and links, a row a node in the order of the page, with or without a text. A node's text is of its own paragraphs and then its verses, without page marks, white space squeezed. A null page has no nodes; a page may be split from others anywhere, since each is parsed alone."""
    rows = pages.select(F.col(name).cast("string").alias("name"), F.coalesce(html, F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = (b.column(k) for k in (0, 1))
            for k in range(b.num_rows):  # a page at a time: its nodes may be as large as it is
                yield pa.RecordBatch.from_arrays([names.slice(k, 1), pa.array([parsed(texts[k].as_py(), names[k].as_py())], _NODES)], ["name", "nodes"])

    found = rows.mapInArrow(run, StructType([StructField("name", StringType()), StructField("nodes", ArrayType(NODES))]))
    text = F.col("text")
    for mark in PAGE_MARKS:
        text = F.regexp_replace(text, mark, "")
    nodes = found.select(F.col("name").alias(name), F.inline("nodes"))
    return nodes.withColumns({"text": F.trim(F.regexp_replace(text, f"{J_SPACE}+", " ")), "work": F.regexp_extract("node_id", "^" + NODE_ID, 1)})


def closure(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys, ancestor, descendant, distance (0: the node itself): what a subtree (by ancestor) or a path from the root (by descendant) is read from."""
    every = F.concat("ancestors", F.array("node_id"))
    return nodes.select(*keys, F.col("node_id").alias("descendant"), F.size("ancestors").alias("depth"), F.posexplode(every).alias("at", "ancestor")).select(*keys, "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def links(nodes: DataFrame, base: str, *keys: str) -> DataFrame:
    """keys, node_id, ord, link, work, to_base: references of nodes to the base work and to commentaries."""
    x = nodes.select(*keys, "node_id", F.posexplode("links").alias("ord", "link")).withColumn("work", F.regexp_extract("link", "^" + NODE_ID, 1))
    return x.withColumn("to_base", F.col("work") == base)


def volumes(nodes: DataFrame, work: str, volume: str) -> DataFrame:
    """Work, volume, n_segments and segments (in order) of nodes with text: a record a volume, to be written as JSON by work."""
    own = F.struct("number", "node_id", "head", "path", "text", "page", "links")
    g = nodes.where("text <> ''").groupBy(work, volume).agg(F.array_sort(F.collect_list(own)).alias("segments"))
    return g.select(work, volume, F.size("segments").cast("long").alias("n_segments"), "segments")


def write_volumes(records: DataFrame, path: str, work: str) -> None:
    records.write.mode("overwrite").partitionBy(work).json(path)


def read_volumes(spark, path: str) -> DataFrame:
    """Segments of written volumes, a row each."""
    one = "array<struct<number: int, node_id: string, head: string, path: string, text: string, page: string, links: array<string>>>"
    r = spark.read.schema(f"volume long, n_segments long, segments {one}, work string").json(path)
    return r.select("work", "volume", F.inline("segments"))


def catalogue(records: DataFrame, works: DataFrame) -> DataFrame:
    """Work, volume (1 to n_volumes of works), n_segments and available, for works that have any volume at all."""
    listed = works.join(records.select("work").distinct(), "work", "left_semi").where("n_volumes > 0")
    all_ = listed.select("work", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_volumes").cast("long"))).alias("volume"))
    x = all_.join(records.select("work", "volume", "n_segments"), ["work", "volume"], "left")
    return x.select("work", "volume", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.col("n_segments").isNotNull().alias("available"))
