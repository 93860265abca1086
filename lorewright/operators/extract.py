"""Extraction of facts, claims, entities and concepts from chunks: plug-in, parsing, validation, packaging."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import once, source_type, strip
from ..schema import ENTITY_TYPES, EXTRACTION, PREFIX

RAW = "facts array<struct<statement string, source_hint string>>, claims array<struct<statement string, confidence string, domain string>>, entities array<struct<name string, type string, aliases array<string>>>, concepts array<struct<name string, domain string, definition string>>"
MAX_ITEMS, NAME = 5, 80
SENTENCE_END, CAPITALISED = re.compile(r"[.!?。！？\n]+"), re.compile(r"\b[A-Z][a-z]{3,}\b")
#: A character that ``str.isdigit`` takes: those of ``\d`` and 128 more, as ranges (single ones beyond 0xffff are tried one by one).
DIGIT = re.compile(r"[\d²³¹\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792\U00010a40-\U00010a43\U00010e60-\U00010e68\U00011052-\U0001105a\U0001f100-\U0001f10a]")
FENCE_START, FENCE_END = "(?m)^```" + r"(?:json)?\s*", "(?m)" + r"\s*```$"


def parse(response: Column) -> Column:
    """A model's answer as the raw struct: code fences off, then JSON; null if it isn't JSON."""
    fenced = F.contains(response, F.lit("```"))
    bare = F.when(fenced, F.regexp_replace(F.regexp_replace(response, FENCE_START, ""), FENCE_END, "")).otherwise(response)
    return F.from_json(strip(bare), RAW)


def validated(raw: Column) -> Column:
    """The first five items of each kind, without blank ones; confidence within [0, 1], 0.5 if it is none; unknown entity types are persons."""
    return once(raw, _validated)


def _validated(raw: Column) -> Column:
    first = lambda kind: F.slice(F.coalesce(raw[kind], F.array()), 1, MAX_ITEMS)
    text = lambda c: F.coalesce(c, F.lit(""))
    full = lambda field: lambda x: strip(text(x[field])) != ""
    number = lambda c: F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    conf = lambda x: number(x["confidence"].try_cast("double"))
    kind = lambda x: F.when(x["type"].isin(*ENTITY_TYPES), x["type"]).otherwise("Person")
    facts = F.transform(F.filter(first("facts"), full("statement")), lambda x: F.struct(strip(x["statement"]).alias("statement"), text(x["source_hint"]).alias("source_hint")))
    claims = F.transform(F.filter(first("claims"), full("statement")), lambda x: F.struct(strip(x["statement"]).alias("statement"), conf(x).alias("confidence"), text(x["domain"]).alias("domain")))
    entities = F.transform(F.filter(first("entities"), full("name")), lambda x: F.struct(strip(x["name"]).alias("name"), kind(x).alias("type"), F.coalesce(x["aliases"], F.array().cast("array<string>")).alias("aliases")))
    concepts = F.transform(F.filter(first("concepts"), full("name")), lambda x: F.struct(strip(x["name"]).alias("name"), text(x["domain"]).alias("domain"), text(x["definition"]).alias("definition")))
    out = F.struct(facts.alias("facts"), claims.alias("claims"), entities.alias("entities"), concepts.alias("concepts")).cast(EXTRACTION)
    some = lambda x: F.size(x["facts"]) + F.size(x["claims"]) + F.size(x["entities"]) + F.size(x["concepts"]) > 0
    return F.when(raw.isNotNull(), once(out, lambda x: F.when(some(x), x)))


def rule_extractor(text: str) -> str:
    """A deterministic stand-in for a language model: sentences become facts and claims, capitalised names entities."""
    sentences = [s for s in map(str.strip, SENTENCE_END.split(text)) if s]
    numbered = [bool(DIGIT.search(s)) for s in sentences]
    names = list(dict.fromkeys(CAPITALISED.findall(text)))
    return json.dumps({
        "facts": [{"statement": s, "source_hint": ""} for s, n in zip(sentences, numbered) if n],
        "claims": [{"statement": s, "confidence": round(0.4 + 0.05 * (len(s) % 12), 2), "domain": ""} for s, n in zip(sentences, numbered) if not n],
        "entities": [{"type": "Person", "name": n, "aliases": []} for n in names],
        "concepts": [{"name": w, "domain": "", "definition": s} for s in sentences[:1] for w in s.split()[:1]],
    }, ensure_ascii=False)


def extract(chunks: DataFrame, extractor: Callable[[str], str] = rule_extractor, concurrency: int = 5) -> DataFrame:
    """(doc_id, chunk_idx, extraction) of the chunks that gave something.

    ``extractor`` runs in Python workers, up to ``concurrency`` calls at once
    (a model's answer is waited for, not computed); a call that fails skips
    its chunk, and results keep the order of chunks.  The stand-in computes,
    so threads would only get in each other's way.
    """
    together = 1 if extractor is rule_extractor else concurrency

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def safe(text: str) -> str | None:
            try:
                return extractor(text)
            except Exception:  # noqa: BLE001 - a failed call skips its chunk
                return None

        with ThreadPoolExecutor(together) as pool:
            for b in batches:
                answers = pa.array(list((map if together == 1 else pool.map)(safe, b["content"].to_pylist())), pa.string())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["chunk_idx"], answers], names=["doc_id", "chunk_idx", "response"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    rows = chunks.select("doc_id", "chunk_idx", "content").mapInArrow(run, f"doc_id {kind}, chunk_idx int, response string")
    # A filter on x would be pushed below its projection and parse each answer again.
    some = F.filter(F.array(validated(parse(F.col("response")))), lambda x: x.isNotNull())
    return rows.select("doc_id", "chunk_idx", F.explode(some).alias("x"))


def items(extractions: DataFrame, kind: str) -> DataFrame:
    """(doc_id, chunk_idx, pos, …) of all facts, claims, entities or concepts."""
    return extractions.select("doc_id", "chunk_idx", F.posexplode(f"x.{kind}").alias("pos", "i")).select("doc_id", "chunk_idx", "pos", "i.*")


def package(extractions: DataFrame, documents: DataFrame, domain: str = "") -> tuple[DataFrame, DataFrame]:
    """(units, relations) from extractions (doc_id, chunk_idx, x) and documents (doc_id, source, title).

    Each document has one evidence; it supports the document's claims, is a
    source of its concepts and facts, and mentions its entities.  ``domain``
    fills claims that have none.
    """
    docs = documents.select("doc_id", "source", "title").join(extractions.select("doc_id").distinct(), "doc_id", "left_semi")
    evd = F.concat(F.lit("EVD_"), F.col("doc_id").cast("string"))
    empty = F.array().cast("array<string>")

    def units(kind: str, field: str, name: Column, summary: Column, dom: Column, confidence: Column, sources: Column, supports: Column) -> DataFrame:
        rows = extractions.select("doc_id", "chunk_idx", F.posexplode(f"x.{field}").alias("pos", "i"))
        number = F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_idx").cast("string"), F.lit("_"), F.col("pos").cast("string"))
        return rows.select("doc_id", F.concat(F.lit(PREFIX[kind] + "_"), number).alias("ku_id"), F.lit(kind).alias("ku_type"), name.alias("name"), summary.alias("summary"), dom.alias("domain"), confidence.alias("confidence"), sources.alias("sources"), supports.alias("supports"), (F.col("chunk_idx") * 100 + F.col("pos")).cast("bigint").alias("ord")).withColumn("detail", F.lit(None).cast("string"))

    i = F.col("i")
    own = F.array(evd)
    parts = [
        units("Entity", "entities", i["name"], F.lit(""), F.lit(""), F.lit(1.0), empty, empty),
        units("Concept", "concepts", i["name"], i["definition"], i["domain"], F.lit(1.0), own, empty),
        units("Fact", "facts", F.substring(i["statement"], 1, NAME), i["statement"], F.lit(""), F.lit(1.0), own, empty),
        units("Claim", "claims", F.substring(i["statement"], 1, NAME), i["statement"], F.when(i["domain"] == "", F.lit(domain)).otherwise(i["domain"]), i["confidence"], empty, own),
        docs.select("doc_id", evd.alias("ku_id"), F.lit("Evidence").alias("ku_type"), F.coalesce("title", "source").alias("name"), F.concat(F.lit("from "), F.coalesce("title", "source")).alias("summary"), F.lit("").alias("domain"), F.lit(1.0).alias("confidence"), empty.alias("sources"), empty.alias("supports"), F.lit(-1).cast("bigint").alias("ord"), source_type(F.col("source")).alias("detail")),
    ]
    ku = parts[0]
    for p in parts[1:]:
        ku = ku.unionByName(p)
    ku = ku.withColumn("status", F.lit("active"))
    rel = ku.where("ku_type IN ('Entity', 'Claim')").select("doc_id", evd.alias("from_ku"), F.col("ku_id").alias("to_ku"), F.when(F.col("ku_type") == "Claim", "SUPPORTS").otherwise("MENTIONS").alias("rel_type"), F.when(F.col("ku_type") == "Claim", 0.6).otherwise(1.0).alias("weight"))
    return ku, rel

