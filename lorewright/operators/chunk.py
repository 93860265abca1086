"""Documents to overlapping chunks, and Markdown or plain text to chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import WHITE, once, strip, strip_markdown

WINDOW, STEP, LOOK_BACK, MAX_CHUNKS, PARAGRAPHS = 1792, 1568, 100, 500, 10
BOUNDARIES = ("\n\n", *"。！？!?", "\n", " ")
#: A paragraph that is a heading.
HEADING = "^#{1,4}" + r"\s+(\S.*)$"


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, position and text of every paragraph that isn't blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n{2,}")).alias("pos", "para"))
    return rows.withColumn("para", strip(F.col("para"))).where("para != ''")


def text_chapters(docs: DataFrame) -> DataFrame:
    """Plain text: (doc_id, chapter, sections, text), ten paragraphs a chapter; blank text is one raw section."""
    own = F.filter(F.transform(F.split("text", "\n{2,}"), strip), lambda p: p != "")
    own = F.when(F.size(own) == 0, F.array("text")).otherwise(own)
    rows = docs.select("doc_id", own.alias("p")).select("doc_id", "p", F.explode(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / PARAGRAPHS).cast("int"))).alias("k"))
    part = F.slice("p", F.col("k") * PARAGRAPHS + 1, F.lit(PARAGRAPHS))
    return rows.select("doc_id", (F.col("k") + 1).alias("chapter"), F.size(part).alias("sections"), F.array_join(part, "\n\n").alias("text"))


def markdown_chapters(docs: DataFrame) -> DataFrame:
    """Markdown: (doc_id, chapter, title, sections, text); a paragraph that is one heading line opens a chapter.

    Headings without text are dropped; a document without any section is one raw section.
    """
    p = paragraphs(docs)
    heading = F.regexp_extract("para", HEADING, 1)
    p = p.withColumn("heading", heading).withColumn("is_heading", F.col("para").rlike(HEADING))
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = p.withColumn("part", F.sum(F.col("is_heading").cast("int")).over(w)).withColumn("title", F.last(F.when(F.col("is_heading"), strip(F.col("heading"))), ignorenulls=True).over(w))
    body = p.where(~F.col("is_heading")).withColumn("para", strip_markdown(F.col("para"))).where("para != ''")
    chapters = body.groupBy("doc_id", "part").agg(F.first("title").alias("title"), F.sort_array(F.collect_list(F.struct("pos", "para"))).alias("s"))
    chapters = chapters.withColumn("chapter", F.row_number().over(Window.partitionBy("doc_id").orderBy("part")))
    made = chapters.select("doc_id", "chapter", F.coalesce("title", F.lit("")).alias("title"), F.size("s").alias("sections"), F.array_join(F.transform("s", lambda x: x["para"]), "\n\n").alias("text"))
    raw = docs.join(made.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("chapter"), F.lit("").alias("title"), F.lit(1).alias("sections"), "text")
    return made.unionByName(raw)


def markdown_title(text: Column, fallback: Column) -> Column:
    t = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(t != "", t).otherwise(fallback)


def _snap(piece: Column) -> Column:
    """Characters of a window that goes on: up to the last boundary within the look-back, else all."""
    cut = lambda seg, b: F.when(F.contains(seg, F.lit(b)), WINDOW - F.instr(F.reverse(seg), b[::-1]) + 1)
    return once(F.substring(piece, WINDOW - LOOK_BACK + 1, LOOK_BACK), lambda seg: F.coalesce(*[cut(seg, b) for b in BOUNDARIES], F.lit(WINDOW)))


def _every(t: Column) -> Column:
    return F.when(F.length(t) <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(t) - 1, F.lit(STEP)))


def starts(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row a window, with its ``start``; a text within one window has the start 0."""
    return docs.select("*", F.explode(_every(F.col(text))).alias("start"))


def _window(t: Column, start: Column) -> Column:
    """(start, end, content); it is cut out of the text once, with a character more that tells whether the text goes on."""

    def cut(piece: Column) -> Column:
        more = F.length(piece) > WINDOW
        content = lambda n: F.when((start == 0) & ~more, piece).otherwise(strip(F.substring(piece, F.lit(1), n)))
        return once(F.when(more, _snap(piece)).otherwise(F.length(piece)), lambda n: F.struct(start.alias("start"), (start + n).alias("end"), content(n).alias("content")))

    return once(F.substring(t, start + 1, F.lit(WINDOW + 1)), cut)


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start and snapped end of every window of every text, without blank ones."""
    every = F.transform(_every(F.col(text)), lambda s: _window(F.col(text), s))
    return docs.select("*", F.inline(F.filter(every, lambda w: F.ltrim(w["content"], F.lit(WHITE)) != "")))


def chunks(chapters: DataFrame, limit: int = MAX_CHUNKS) -> DataFrame:
    """(doc_id, chunk_idx, chunk_id, source_hint, content): the first ``limit`` chunks of each document.

    ``chapters`` has doc_id, chapter, title and text.
    """
    rows = windows(chapters).withColumn("chunk_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter", "start")) - 1)
    rows = rows.where(F.col("chunk_idx") < limit)
    return rows.select("doc_id", "chunk_idx", F.concat(F.col("doc_id").cast("string"), F.lit("_C"), F.lpad(F.col("chunk_idx").cast("string"), 4, "0")).alias("chunk_id"), F.col("title").alias("source_hint"), "content")


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, chapter_id, title, section_id, content) of document trees, in order of ``chapter`` and ``section``."""
    c = documents.select("doc_id", F.posexplode("chapters").alias("chapter", "c"))
    return c.select("doc_id", "chapter", F.col("c.chapter_id").alias("chapter_id"), F.col("c.title").alias("title"), F.posexplode("c.sections").alias("section", "s")).select("doc_id", "chapter", "chapter_id", "title", "section", "s.section_id", "s.content")


def full_text(documents: DataFrame) -> DataFrame:
    """(doc_id, text): titles and sections of a document tree, a blank line between."""
    part = F.transform("chapters", lambda c: F.concat(F.when(c["title"] != "", F.array(c["title"])).otherwise(F.array().cast("array<string>")), F.transform(c["sections"], lambda s: s["content"])))
    return documents.select("doc_id", F.array_join(F.flatten(part), "\n\n").alias("text"))
