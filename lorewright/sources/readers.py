"""Document sources: files by suffix, strings, web pages, e-books and PDF.

All give (doc_id, title, source, doc_type, text) and, for e-books and PDF,
blocks; chapters and chunks are made by :mod:`lorewright.operators.chunk`.
Ids are hashes of the address, so reading again gives the same ids.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import html_title, html_to_text, strip
from ..operators.chunk import markdown_title
from .mobi import blocks as mobi_blocks
from .tables import written

TEXT_SUFFIXES, MARKDOWN_SUFFIXES, BOOK_SUFFIXES, MOBI_SUFFIXES = (".txt",), (".md", ".markdown"), (".epub",), tuple(".azw .azw3 .mobi".split())
TAG = re.compile("<[^>]+>")
MAX_CHARS, MAX_BYTES, MIN_BLOCK = 2_000_000, 20 << 20, 12


def doc_id(source: Column) -> Column:
    return F.concat(F.lit("DOC_"), F.upper(F.substring(F.sha2(source, 256), 1, 8)))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


class TooLarge(ValueError):
    """A file or text over the size that is taken in; nothing of its batch is."""


def _files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(source, content); a file over ``MAX_BYTES`` is an error that names it, told from the listing alone."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if large := rows.where(F.col("length") > MAX_BYTES).select("path", "length").first():
        raise TooLarge(f"{large.path}: {large.length} bytes, over {MAX_BYTES}")
    return rows.select(F.col("path").alias("source"), "content")


def _named(rows: DataFrame, doc_type: str, title: Column) -> DataFrame:
    return rows.select(doc_id(F.col("source")).alias("doc_id"), title.alias("title"), "source", F.lit(doc_type).alias("doc_type"), "text")


def utf8(content: Column) -> Column:
    """Bytes as text, invalid ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def markdown(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    rows = _files(spark, path, glob).select("source", utf8(F.col("content")).alias("text"))
    return _named(rows, "MARKDOWN", markdown_title(F.col("text"), stem(F.col("source"))))


def text(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return _named(_files(spark, path, glob).select("source", utf8(F.col("content")).alias("text")), "TXT", stem(F.col("source")))


def inline(rows: DataFrame, source: str = "inline") -> DataFrame:
    """Markdown given as a ``text`` column; identity is the text's."""
    named = rows.select(F.concat(F.lit(source + ":"), F.sha2("text", 256)).alias("source"), "text")
    return _named(named, "MARKDOWN", markdown_title(F.col("text"), F.lit(source)))


class _MainText(HTMLParser):
    """Text of article, main or body without navigation, scripts and the like."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "head"}
    BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "blockquote", "pre"}
    VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.main, self.all, self.article = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in ("article", "main"):
            self.main += 1
        if tag in self.BREAK:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("article", "main"):
            self.main = max(0, self.main - 1)
        if tag in self.BREAK:
            self.handle_data("\n")

    def handle_data(self, data):
        if not self.skip:
            self.all.append(data)
            if self.main:
                self.article.append(data)


def main_text(html: str) -> str:
    """Main text of a page; blank lines between blocks."""
    p = _MainText()
    p.feed(html)
    p.close()
    lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.article or p.all).split("\n"))
    return "\n\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def main_text_udf(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action="ignore")


def html_pages(pages: DataFrame) -> DataFrame:
    """Web pages given as (url, html); pages without main text fall back to all their text."""
    body = main_text_udf("html")
    rows = pages.select(F.col("url").alias("source"), "html", body.alias("m"))
    rows = rows.select("source", html_title(F.col("html"), F.col("source")).alias("t"), F.when(F.col("m") != "", F.col("m")).otherwise(html_to_text(F.col("html"))).alias("text"))
    return _named(rows, "WEB", F.col("t"))


def fetch(urls: DataFrame, get: Callable[[str], str] | None = None, timeout: int = 15) -> DataFrame:
    """(url, html) by HTTP, a connection a worker; failed fetches give null.  ``get`` replaces the client."""

    def client(url: str) -> str:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"Accept": "text/html", "User-Agent": "lorewright"}), timeout=timeout) as r:  # noqa: S310
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    call = get or client

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    out.append(call(url))
                except Exception:  # noqa: BLE001 - one page's failure isn't the batch's
                    out.append(None)
            yield pd.DataFrame({"url": b["url"], "html": out})

    return urls.select("url").mapInPandas(run, "url string, html string")


def epub_blocks(content: bytes) -> tuple[str, list[str]]:
    """(title, text of each XHTML item in the order of the spine)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//{*}rootfile").get("full-path")
        root = ElementTree.fromstring(z.read(opf))
        title = root.findtext(".//{http://purl.org/dc/elements/1.1/}title") or ""
        base = opf.rpartition("/")[0]
        items = {i.get("id"): i for i in root.iterfind(".//{*}manifest/{*}item")}
        order = [items[r.get("idref")] for r in root.iterfind(".//{*}spine/{*}itemref") if r.get("idref") in items] or list(items.values())
        blocks = []
        for item in order:
            if "html" in (item.get("media-type") or ""):
                name = f"{base}/{item.get('href')}" if base else item.get("href")
                if name in z.namelist():
                    raw = z.read(name).decode("utf-8", "replace")
                    blocks.append(" ".join(TAG.sub(" ", raw).split()))
        return title, blocks


def epub(spark: SparkSession, path: str, glob: str = "*", unpack: Callable[[bytes], tuple[str, list[str]]] = epub_blocks) -> DataFrame:
    """E-books: one chapter of the blocks of 12 characters or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, content in zip(b["source"], b["content"]):
                title, blocks = unpack(content)
                rows.append((source, title, "\n\n".join(x for x in blocks if len(x.strip()) >= MIN_BLOCK)))
            yield pd.DataFrame(rows, columns=["source", "t", "text"])

    rows = _files(spark, path, glob).mapInPandas(run, "source string, t string, text string")
    return _named(rows, "EBOOK", F.when(F.col("t") != "", F.col("t")).otherwise(stem(F.col("source"))))


def mobi(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """MOBI, AZW and AZW3 books."""
    return epub(spark, path, glob, mobi_blocks)


def pdf_spans(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple[int, int, float, str]]], glob: str = "*") -> DataFrame:
    """(doc_id, page, block, size, text) of a PDF's spans by the injected parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for source, content in zip(b["source"], b["content"]):
                yield pd.DataFrame([(source, *span) for span in parse(content)], columns=["source", "page", "block", "size", "text"])

    rows = _files(spark, path, glob).mapInPandas(run, "source string, page int, block int, size double, text string")
    return rows.select(doc_id(F.col("source")).alias("doc_id"), "source", "page", "block", "size", "text")


HEADING_RATIO, HEADING_CHARS, BODY_PAGES, DEFAULT_BODY = 1.2, 120, 3, 12.0


def pdf_chapters(spans: DataFrame) -> DataFrame:
    """(doc_id, chapter, title, text): blocks in a font of 1.2 times the body's, and short, are headings.

    The body's font is the commonest rounded size of the first three pages.
    """
    body = spans.where(F.col("page") < BODY_PAGES).groupBy("doc_id").agg(F.mode(F.round("size"), deterministic=True).alias("body"))
    blocks = spans.groupBy("doc_id", "page", "block").agg(F.max("size").alias("size"), strip(F.array_join(F.collect_list("text"), " ")).alias("text")).where("text != ''")
    rows = blocks.join(body, "doc_id", "left").withColumn("head", (F.col("size") >= HEADING_RATIO * F.coalesce("body", F.lit(DEFAULT_BODY))) & (F.length("text") < HEADING_CHARS))
    w = Window.partitionBy("doc_id").orderBy("page", "block")
    rows = rows.withColumn("part", F.sum(F.col("head").cast("int")).over(w)).withColumn("title", F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(w))
    g = rows.where("NOT head").groupBy("doc_id", "part").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("page", "block", "text"))).alias("s"))
    return g.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("part")).alias("chapter"), F.coalesce("title", F.lit("")).alias("title"), F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"))


def pdf_title(spans: DataFrame) -> DataFrame:
    """(doc_id, title): the largest text of more than three characters on the first page."""
    first = spans.where((F.col("page") == 0) & (F.length(F.trim("text")) > 3))
    return first.groupBy("doc_id").agg(F.max_by(F.trim("text"), F.struct("size", -F.col("block"))).alias("title"))


def pdf(spark: SparkSession, path: str, glob: str, parse: Callable[[bytes], list[tuple[int, int, float, str]]]) -> DataFrame:
    """PDF files as documents: chapters by the headings' font, as Markdown; titles by the largest text of the first page."""
    spans = written(pdf_spans(spark, path, parse, glob), "pdf-spans")
    body = pdf_chapters(spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "title", "text"))).alias("c"))
    part = lambda x: F.concat_ws("\n\n", F.when(x["title"] != "", F.concat(F.lit("# "), x["title"])), x["text"])
    rows = spans.select("doc_id", "source").distinct().join(body, "doc_id").join(pdf_title(spans), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("title", stem(F.col("source"))).alias("title"), "source", F.lit("PDF").alias("doc_type"), F.array_join(F.transform("c", part), "\n\n").alias("text"))


def read_any(spark: SparkSession, path: str, parse_pdf: Callable[[bytes], list[tuple[int, int, float, str]]] | None = None) -> DataFrame:
    """Every supported file of a folder by its suffix; others are an error, and so are PDF files without a parser."""
    listed = spark.read.format("binaryFile").load(path).select(suffix(F.col("path")).alias("s")).distinct()
    known = {s: f for group, f in ((MARKDOWN_SUFFIXES, markdown), (TEXT_SUFFIXES, text), (BOOK_SUFFIXES, epub), (MOBI_SUFFIXES, mobi)) for s in group}
    if parse_pdf is not None:
        known[".pdf"] = lambda spark, path, glob: pdf(spark, path, glob, parse_pdf)
    kinds = [r.s for r in listed.collect()]  # suffixes, not files
    if bad := sorted(set(kinds) - set(known)):
        raise ValueError(f"unsupported suffixes: {', '.join(bad)}")
    out = None
    for s in sorted(kinds):
        rows = known[s](spark, path, "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Names the taxonomy's file where no path is given.
TAXONOMY_ENV = "LOREWRIGHT_TAXONOMY"


def taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Abilities from JSON lines or a multi-line array, one object each, in the schema of the engine."""
    path = path or os.environ.get(TAXONOMY_ENV)
    if not path:
        raise ValueError(f"no taxonomy: give a path or set {TAXONOMY_ENV}")
    schema = "ability_key string, display_name string, domain string, domains array<string>, required_skills array<string>, optional_skills array<string>, min_coverage double, workflows array<struct<name string, steps array<string>>>, concept_checklist map<string, array<string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("domains", F.coalesce("domains", F.array("domain")))
