"""Language identification by Bayesian evidence fusion.

log P(language | row) is, up to a constant, the sum of four parts:

* text: naive Bayes over the letter n-grams (1 to 4, with word ends) of every
  word, each word's likelihood averaged over its n-grams so that one row's
  evidence grows with its words;
* markup: P(declared language | language) from a confusion table estimated
  together with the priors;
* address: likewise for the URL's language suffix, the country part of the
  host's last label or a two-letter first path part;
* host prior: P(language | host), smoothed hierarchically: a host's counts are
  drawn towards its registered domain's (two labels, three under a shared
  suffix of ``SHARED_SUFFIXES``), those towards the whole table's, by
  pseudo-counts.  A host that is its domain's only one is drawn towards the
  table's straight away, so that no row's decision counts at two levels.

Text models are fitted on a bounded sample of rows with a known language
(``MAX_LABELLED`` rows a language, those of lowest hash; all their n-grams).  Counts for the host priors and the
confusion tables come from all rows by grouped aggregation over the
text-only decisions.  Documents have no markup and no address; their source
stands for the host.

Defined results: a null text, or one without a letter, has no text evidence
and is decided by the other parts, in the end by the prior of the whole table;
null or unknown markup and suffixes give no evidence (of declared markup the
primary subtag counts, whatever its length, region and script don't); a null
host has the prior of the whole table; a very long host is one like any other;
ties go to the first language in order of name; repeated rows are each decided
and each count (in the text model, once: by id and text); empty tables give empty
results; without labelled rows every language is equally likely; other columns
are ignored.  Every row is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import written
from ._words import segment_sum, slices, text_column, word_codes

#: Labelled rows a language that the text model is fitted on, at most.
MAX_LABELLED = 2_000
#: Pseudo-counts: of n-grams, and of the parent level for a domain and a host.
GRAM_PSEUDO, DOMAIN_PSEUDO, HOST_PSEUDO, TABLE_PSEUDO = 0.5, 20.0, 10.0, 1.0
#: Two-letter suffixes that stand for a language.
SUFFIX_LANGUAGE = {"uk": "en", "us": "en", "au": "en", "ie": "en", "at": "de", "ch": "de", "mx": "es", "ar": "es", "be": "fr", "en": "en", "de": "de", "fr": "fr", "es": "es"}
#: Suffixes under which everybody registers a third label.
SHARED_SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ac.jp co.kr co.in com.br com.ar com.mx com.tr com.cn com.tw co.za com.es org.es com.fr asso.fr example.com example.net example.org github.io gitlab.io blogspot.com wordpress.com herokuapp.com".split())
ORDER = 4
#: Words whose likelihoods a worker keeps.
CACHE_WORDS = 100_000
_DROP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def grams(word: str) -> list[str]:
    """Letter n-grams of a word with its ends marked."""
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)]


@dataclass
class TextModel:
    """Languages in order of name, and the log likelihoods of n-grams; the table's last row is for unseen ones."""

    languages: list[str]
    grams: dict[str, int]
    table: np.ndarray

    def words(self, words: list[str], cache: dict[str, np.ndarray]) -> np.ndarray:
        """A row per word: the mean over its n-grams; words without a letter give no evidence."""
        out = np.zeros((len(words), len(self.languages)))
        new, index, starts = [], [], []
        get, last = self.grams.get, len(self.grams)
        for k, word in enumerate(words):
            known = cache.get(word)
            if known is not None:
                out[k] = known
            elif any(map(str.isalpha, word)):
                new.append(k)
                starts.append(len(index))
                index.extend([get(g, last) for g in grams(word)])
        if new:
            sums = np.add.reduceat(self.table[index], starts, axis=0) / np.diff([*starts, len(index)])[:, None]
            out[new] = sums
            if len(cache) > CACHE_WORDS:
                cache.clear()
            cache.update(zip([words[k] for k in new], sums))
        return out


def visible(html: str) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return unescape(_DROP.sub(" ", html))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, codes, words = word_codes(text_column(batch, "text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            language = batch.column(batch.schema.get_field_index("language")).dictionary_encode()
            of = language.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
            pair, n = np.unique(of * max(1, len(words)) + codes, return_counts=True)
            names = language.dictionary.take(pa.array(pair // max(1, len(words))))
            yield pa.RecordBatch.from_arrays([names, pa.array(words, pa.string()).take(pa.array(pair % max(1, len(words)))), pa.array(n, pa.int64())], names=["language", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[str, str], int] = {}
    for batch in batches:
        for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if any(map(str.isalpha, word)):
                for g in grams(word):
                    totals[(name, g)] = totals.get((name, g), 0) + n
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], names=["language", "gram", "n"])


def _least(most: int):
    """A batch's ids of lowest hash by language, ``most`` a language at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            table = table.sort_by([("language", "ascending"), ("_h", "ascending"), ("doc_id", "ascending")]).combine_chunks()
            if table.num_rows:
                code = table.column("language").combine_chunks().dictionary_encode().indices.to_numpy()
                start = np.searchsorted(code, code)
                held = table.filter(pa.array(np.arange(len(code)) - start < most)).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return run


def sample_ids(known: DataFrame, most: int) -> DataFrame:
    """(doc_id, language, _h) of the ``most`` rows of lowest hash of every language, in one pass.

    Partitions keep that many a language each before anything is shuffled.
    """
    hashed = known.select("doc_id", "language", F.xxhash64("doc_id", F.lit(5)).alias("_h"))
    least = hashed.mapInArrow(_least(most), hashed.schema)
    rank = F.row_number().over(Window.partitionBy("language").orderBy("_h", "doc_id"))
    return least.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def fit_text(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> TextModel:
    """Text model from ``labelled`` (doc_id, text, language): at most ``max_labelled`` rows a language, those of lowest hash."""
    known = labelled.where("language IS NOT NULL AND text IS NOT NULL").select("doc_id", "language")
    chosen = written(sample_ids(known, max_labelled), "language-sample")
    names = sorted(r[0] for r in chosen.select("language").distinct().collect())  # as many rows as languages
    if not names:
        return TextModel([], {}, np.zeros((1, 0)))
    # Bounded by max_labelled ids a language whatever the corpus is, hence broadcast.
    chosen = chosen.select(F.col("doc_id").alias("_id")).distinct()
    sample = labelled.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").where("language IS NOT NULL AND text IS NOT NULL")
    sample = sample.select("doc_id", "text", "language").distinct().select("text", "language")
    words = sample.mapInArrow(_count_words, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_grams, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # the n-grams of a bounded sample
    if rows.empty:
        return TextModel(names, {}, np.zeros((1, len(names))))
    column = {name: k for k, name in enumerate(names)}
    gram, order = np.unique(rows["gram"].to_numpy(str), return_inverse=True)
    table = np.zeros((len(gram), len(names)))
    table[order, rows["language"].map(column).to_numpy()] = rows["n"].to_numpy()
    size = np.char.str_len(gram)
    out, unseen = np.zeros_like(table), []
    for n in range(1, ORDER + 1):
        own = size == n
        total = table[own].sum(axis=0) + GRAM_PSEUDO * (own.sum() + 1)
        out[own] = np.log((table[own] + GRAM_PSEUDO) / total)
        unseen.append(np.log(GRAM_PSEUDO / total))
    return TextModel(names, {g: k for k, g in enumerate(gram.tolist())}, np.vstack([out, np.mean(unseen, axis=0)]))


def _evidence(model: TextModel, html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, np.ndarray] = {}
        k = len(model.languages)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = text_column(batch, "text")
                if html:
                    texts = pa.array([visible(x) for x in texts.to_pylist()], pa.string())
                offsets, codes, words = word_codes(texts)
                scores = model.words(words, cache)
                total = np.zeros((len(texts), k))
                for a in range(0, len(texts), 256):  # bounds the gathered matrix
                    span = offsets[a : a + 257]
                    total[a : a + 256] = segment_sum(scores[codes[span[0] : span[-1]]], span - span[0])
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * k, pa.int32()), pa.array(total.ravel()))
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), rows], names=[*names, "evidence"])

    return run


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def registered(name: Column) -> Column:
    """A host's registered domain: its last two labels, three under a shared suffix, or itself if it has fewer."""
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*sorted(SHARED_SUFFIXES)), F.substring_index(name, ".", -3)).otherwise(two)


def declared(html: Column) -> Column:
    """The primary subtag of the declared language, two or three letters."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def suffix(url: Column) -> Column:
    """Language of the address: a two-letter first path part, else the host's country label."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    label = F.substring_index(host(url), ".", -1)
    pairs = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, path), F.try_element_at(pairs, label))


def _argmax(column: Column, names: list[str]) -> Column:
    """First language of the highest value."""
    best = F.array_position(column, F.array_max(column)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in names]), best)


def _log_table(counts: list[tuple], names: list[str]) -> list[tuple[str, list[float]]]:
    """(seen, log P(seen | language) by language) from (seen, language, n) rows."""
    seen = sorted({r[0] for r in counts})
    n = {(r[0], r[1]): r[2] for r in counts}
    total = {x: sum(n.get((s, x), 0) for s in seen) + TABLE_PSEUDO * (len(seen) + 1) for x in names}
    return [(s, [float(np.log((n.get((s, x), 0) + TABLE_PSEUDO) / total[x])) for x in names]) for s in seen]


def fuse(rows: DataFrame, names: list[str]) -> DataFrame:
    """Decide rows of (…, evidence, markup, suffix, host): adds ``language`` and its ``confidence``.

    Priors and confusion tables are counted over all rows' text-only decisions.
    """
    zero = F.array(*[F.lit(0.0) for _ in names])
    by_text = F.when(F.array_max("evidence") > F.array_min("evidence"), _argmax(F.col("evidence"), names))
    rows = rows.withColumn("_text", by_text).withColumn("_domain", registered(F.col("host")))
    told = rows.where("_text IS NOT NULL")
    # Codes of two or three letters by languages: bounded by the alphabet, whatever the rows are, hence broadcast.
    confused = lambda seen: rows.sparkSession.createDataFrame(_log_table(told.where(F.col(seen).isNotNull()).groupBy(seen, "_text").count().collect(), names), f"_of_{seen} string, _log_{seen} array<double>")
    markup, address = F.broadcast(confused("markup")), F.broadcast(confused("suffix"))
    root = dict(told.groupBy("_text").count().collect())
    n = sum(root.values())
    base = [float((root.get(x, 0) + 1.0) / (n + len(names))) for x in names]
    counts = [F.count_if(F.col("_text") == x).cast("double") for x in names]
    hosts = told.where("host IS NOT NULL").groupBy("host", "_domain").agg(F.array(*counts).alias("c"))
    domains = hosts.groupBy("_domain").agg(F.array(*[F.sum(F.element_at("c", k + 1)) for k in range(len(names))]).alias("d"), F.count("*").alias("_hosts"))
    smooth = lambda c, parent, pseudo: F.zip_with(c, parent, lambda a, p: (a + pseudo * p) / (F.aggregate(c, F.lit(0.0), lambda t, x: t + x) + pseudo))
    up = F.array(*[F.lit(b) for b in base])
    priors = hosts.join(domains, "_domain").select(F.col("host").alias("_host"), F.transform(smooth(F.col("c"), F.when(F.col("_hosts") > 1, smooth(F.col("d"), up, DOMAIN_PSEUDO)).otherwise(up), HOST_PSEUDO), lambda p: F.log(p)).alias("_prior"))
    prior0 = F.array(*[F.lit(float(np.log(b))) for b in base])
    out = rows.join(markup, rows.markup == markup._of_markup, "left").join(address, rows.suffix == address._of_suffix, "left")
    out = out.join(priors, rows.host == priors._host, "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    post = add(add(F.coalesce("evidence", zero), F.coalesce("_prior", prior0)), add(F.coalesce("_log_markup", zero), F.coalesce("_log_suffix", zero)))
    out = out.withColumn("_post", post)
    sure = F.aggregate(F.transform("_post", lambda x: F.exp(x - F.array_max("_post"))), F.lit(0.0), lambda t, x: t + x)
    return out.withColumn("language", _argmax(F.col("_post"), names)).withColumn("confidence", F.round(1 / sure, 6)).drop("_text", "_domain", "_host", "_prior", "_post", "_of_markup", "_log_markup", "_of_suffix", "_log_suffix", "evidence")


def identify(docs: DataFrame, pages: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, page_id, language, confidence) of every document (page_id null) and every page (doc_id null).

    ``labelled`` has doc_id, text and language; by default the documents' own
    declared languages, of which only a bounded sample is read.
    """
    model = fit_text(docs.select("doc_id", "text", F.col("lang").alias("language")) if labelled is None else labelled, max_labelled)
    names = model.languages or ["und"]
    if not model.languages:
        model = TextModel(names, {}, np.zeros((1, 1)))
    none = F.lit(None).cast("string")
    d = docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("bigint").alias("id"), "text", none.alias("markup"), none.alias("suffix"), F.col("source").alias("host"))
    p = pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("bigint").alias("id"), F.col("html").alias("text"), declared(F.col("html")).alias("markup"), suffix(F.col("url")).alias("suffix"), host(F.col("url")).alias("host"))
    schema = "kind string, id bigint, markup string, suffix string, host string, evidence array<double>"
    rows = written(d.mapInArrow(_evidence(model, False), schema).unionByName(p.mapInArrow(_evidence(model, True), schema)), "language-evidence")
    # Two tables with their own hosts and priors.
    none = F.lit(None).cast("bigint")
    of = lambda kind, doc, page: fuse(rows.where(F.col("kind") == kind), names).select(doc.alias("doc_id"), page.alias("page_id"), "language", "confidence")
    return of("document", F.col("id"), none).unionByName(of("page", none, F.col("id")))
