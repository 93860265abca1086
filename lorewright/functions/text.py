"""Scalar functions: names, fingerprints, tokens, polarity, markup.  All JVM-side but NFKC."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

NEGATIONS = tuple("bad false harmful never no not worse 不 不好 差 无 非".split())
_BRACKET, _PAREN = r"\[([^\]]+)\]", r"\([^)]+\)"
_RUN = "{1,3}"
#: A page's title element.
TITLE = "(?i)<title[^>]*>" "([^<]+)</title>"
#: White space as regular expressions have it.
WHITE = " \t\n\x0b\f\r"
CJK = "\\x{4e00}-\\x{9fff}"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it (the optimizer would put the whole expression for each name)."""
    return F.transform(F.array(c), use)[0]


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC of a batch of strings (Spark has no built-in)."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_name(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, lower case, letters and numbers only; null reads as empty.

    ``ascii_only`` promises that NFKC changes nothing and keeps the
    expression inside generated code.
    """
    c = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(c if ascii_only else nfkc(c)), r"[^\p{L}\p{N}]", "")


def fingerprint(ku_type: Column, name: Column, domain: Column, ascii_only: bool = False) -> Column:
    """Identity of a unit: 24 hex digits over type, normalised name and domain."""
    parts = [F.lower(F.trim(ku_type)), normalize_name(name, ascii_only), normalize_name(domain, ascii_only)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def light_fingerprint(content: Column) -> Column:
    """Identity of a candidate's text: 16 hex digits, without case and extra white space."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(F.trim(content)), r"\s+", " ")), 256), 1, 16)


def tokens(text: Column) -> Column:
    """Search tokens: ASCII words of two letters or more; other words give CJK uni- and bigrams."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"(?U)[^\\w\\s{CJK}]", " ")
    words = F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")

    def cjk(w: Column) -> Column:
        chars = F.filter(F.split(F.regexp_replace(w, f"[^{CJK}]", ""), ""), lambda c: c != "")
        pairs = F.transform(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda c, i: F.concat(F.element_at(chars, i + 1), c))
        return F.concat(chars, pairs)

    def expand(w: Column) -> Column:
        plain = w.rlike("^[a-z0-9_-]+$")
        return F.when(plain & (F.length(w) >= 2), F.array(w)).when(plain, F.array().cast("array<string>")).otherwise(cjk(w))

    # Texts without CJK need no expansion, only the ASCII words.
    plain = F.filter(words, lambda w: w.rlike("^[a-z0-9_-]{2,}$"))
    return F.when(clean.rlike(f"[{CJK}]"), F.flatten(F.transform(words, expand))).otherwise(plain)


def words(text: Column) -> Column:
    """Distinct lower-case words between white space, as claims are compared."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def polarity(a: Column, b: Column) -> Column:
    """Direction of two claims' word sets: 0 without shared topic, -0.5 against, up to 0.8 along."""
    neg = F.array(*[F.lit(w) for w in NEGATIONS])
    shared = F.size(F.array_except(F.array_intersect(a, b), neg))
    against = F.arrays_overlap(a, neg) != F.arrays_overlap(b, neg)
    return F.when(shared == 0, 0.0).when(against, -0.5).otherwise(F.least(F.lit(0.8), shared * F.lit(0.15)))


def transition(status: Column, confidence: Column, conflict: Column, gap: Column) -> Column:
    """Next status of a claim."""
    close = conflict & (gap < 0.15)
    pending = F.when((confidence > 0.7) & ~conflict, "active").when(close, "disputed").when(confidence < 0.3, "rejected").otherwise(status)
    active = F.when(close, "disputed").when(confidence < 0.3, "superseded").otherwise(status)
    return F.when(status == "pending", pending).when(status == "active", active).when((status == "disputed") & (gap > 0.2), "active").otherwise(status)


#: Markup of Markdown in the order it is taken off: fences, code, links, images, emphasis, quotes, lists.
MARKDOWN = (("```" + r"[\s\S]*?" + "```", ""), (r"`([^`]+)`", "$1"), (_BRACKET + _PAREN, "$1"), (r"!\[[^\]]*\]" + _PAREN, ""), (rf"\*{_RUN}([^*]+)\*{_RUN}", "$1"), (f"_{_RUN}([^_]+)_{_RUN}", "$1"), (r"(?m)^>\s*", ""), (r"(?m)^[-*+]\s+", ""), (r"(?m)^\d+\.\s+", ""))


def strip(c: Column) -> Column:
    """White space, as regular expressions have it, off both ends; only the ends are read."""
    return F.btrim(c, F.lit(WHITE))


def strip_markdown(c: Column) -> Column:
    for pattern, by in MARKDOWN:
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def html_title(html: Column, fallback: Column) -> Column:
    """The page's title, else the last part of its address."""
    title = F.trim(F.regexp_extract(html, TITLE, 1))
    last = F.element_at(F.split(F.regexp_replace(fallback, "/+$", ""), "/"), -1)
    return F.when(title != "", title).otherwise(last)


def html_to_text(html: Column) -> Column:
    """Tags to blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def source_type(source: Column) -> Column:
    """Kind of an evidence by its address."""
    s = F.lower(source)
    return F.when(s.startswith("http"), "Web").when(s.endswith(".pdf"), "Book").when(s.rlike(r"\.(md|txt|docx)$"), "Article").otherwise("Book")


def display_name(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def ku_id(ku_type: str, number: Column) -> Column:
    from ..schema import PREFIX

    return F.concat(F.lit(PREFIX[ku_type] + "_"), F.lpad(number.cast("string"), 8, "0"))
