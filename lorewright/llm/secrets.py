"""Secret scans: pattern candidates, and a random forest that removes false positives.

Candidates are strings of 16 or more key characters with a digit, and values
assigned to a name such as ``password`` or ``api_key``.  A random forest
(Spark ML) judges each by its length, its character transitions under a
bigram model of ordinary words, the share of it that dictionary words cover,
its alphabet, the path (source) it was found under, and the neighbouring
words.  The forest is fitted on a table of labelled findings (``LABELLED``),
the ``MAX_LABELLED`` of lowest hash; where none is given, on
``synthetic_findings``: generated keys against identifiers, digests, card
numbers and placeholders.  Transitions are counted over the words of all
documents; the dictionary has every word that a part of the corpus (a source,
in a language where the table has ``lang``) uses in ``MIN_SHARE`` of its
documents, so that a hot source doesn't crowd out the words of others.

Defined results: null and empty texts have no findings; a null source is the
empty path; overlapping candidates count once, the assigned one first; equal
candidates at different places, and repeated rows, are each reported; a
candidate whose probability is the threshold is a secret; null ids are kept;
labelled findings without a candidate or label don't count, other nulls in
them read as empty or false, repeated ones count once; an empty table gives an empty result; other columns are ignored.
The secret itself is never put out, only its place, length and SHA-256.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._store import written
from ._words import row_of, slices, text_column, word_codes

#: Documents of a source and language that have a word of the dictionary at least, as a number and a share; labelled findings at most.
MIN_DOCS, MIN_SHARE, MAX_LABELLED = 3, 1 / 2_000, 20_000
TREES, DEPTH, THRESHOLD = 40, 8, 0.5
#: Characters of context on each side whose words are neighbours.
CONTEXT = 48

_KEY = re.compile(r"(?<![\w+/=.-])[A-Za-z0-9_+/=.\-]{16,}(?![\w+/=-])")
#: No part before the telling name and a bounded one after: linear in a text of one endless word.
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential|passphrase|auth(?!or(?!iz)|entic)|bearer)\w{0,64}[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'`,;<>]{8,})")
_HINT = "(?i)password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential|passphrase|auth|bearer"
_WORD = re.compile(r"[A-Za-z]{2,}")
SECRET_WORDS = frozenset("password passwd passphrase pwd secret token key apikey api auth bearer credential credentials access private login".split())
PLAIN_WORDS = frozenset("example sample dummy placeholder changeme commit sha md5 checksum digest hash uuid guid revision version build card phone fax order invoice isbn".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_", "ya29.")
LABELLED = "candidate string, before string, after string, path string, assigned boolean, label int"
FEATURES = ("length", "transition", "dictionary", "entropy", "digits", "upper", "hex", "classes", "runs", "prefix", "assigned", "quoted", "secret_words", "plain_words", "path_test", "path_config")


@dataclass
class Language:
    """Dictionary and character transitions of ordinary text."""

    words: frozenset[str]
    transition: np.ndarray  # log probabilities, 27 x 27

    def coverage(self, text: str) -> float:
        """Share of characters in the longest dictionary words, left to right."""
        low, i, covered = text.lower(), 0, 0
        while i < len(low):
            for size in range(min(16, len(low) - i), 3, -1):
                if low[i : i + size] in self.words:
                    covered += size
                    i += size
                    break
            else:
                i += 1
        return covered / len(low)

    def surprise(self, text: str) -> float:
        """Mean log probability of a letter after a letter; other characters are one class."""
        codes = _codes(text)
        return float(self.transition[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8)
    return np.where((raw >= 97) & (raw <= 122), raw - 96, 0).astype(np.int64)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by part: their occurrences and the number of rows that have them, slice by slice."""
    for whole in batches:
        for batch in slices(whole, "text"):
            offsets, codes, words = word_codes(text_column(batch, "text"))
            fit = np.array([4 <= len(w) <= 16 and w.isalpha() for w in words], bool)
            own, base = fit[codes] if len(codes) else np.zeros(0, bool), max(1, len(words))
            parts, part = np.unique(batch.column(batch.schema.get_field_index("part")).to_numpy(), return_inverse=True)
            row, code = np.divmod(np.unique(row_of(offsets)[own] * base + codes[own]), base)
            at, n = np.unique(part[row_of(offsets)[own]] * base + codes[own], return_counts=True)
            rows = np.unique(part[row] * base + code, return_counts=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(parts[at // base]), pa.array([words[k] for k in at % base], pa.string()), pa.array(n), pa.array(rows)], names=["part", "word", "n", "docs"])


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each pair of classes, first * 27 + second, in a batch's words."""
    for batch in batches:
        words = [f" {w.lower()} " for w in batch.column(0).to_pylist()]
        codes = _codes("".join(words))
        n = np.repeat(batch.column(1).to_numpy(), [len(w) for w in words])
        table = np.bincount(codes[:-1] * 27 + codes[1:], weights=n[:-1])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].astype(np.int64))], names=["cell", "n"])


def learn_language(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> Language:
    """Transitions of all documents' words, and the words that enough documents of a source and language have."""
    part = F.xxhash64(*[c for c in ("source", "lang") if c in docs.columns]).alias("part")
    rows = docs.where("text IS NOT NULL").select("text", part)
    counts = rows.mapInArrow(_vocabulary, "part bigint, word string, n bigint, docs bigint")
    counts = written(counts.groupBy("part", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "secret-words")
    table = np.full((27, 27), 0.5)
    # 729 cells at most, whatever the corpus is.
    for r in counts.select("word", "n").mapInArrow(_transitions, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[divmod(r.cell, 27)] += r.n
    table[0, 0] = 0.5
    parts = rows.groupBy("part").agg((F.count("*") * min_share).alias("least"))
    # A share of documents bounds it: of a part, to the words of a document divided by the share.
    words = counts.where(F.col("docs") >= min_docs).join(parts, "part").where("docs >= least").select("word").distinct().collect()
    return Language(frozenset(r.word for r in words), np.log(table / table.sum(axis=1, keepdims=True)))


def features(language: Language, text: str, before: str, after: str, path: str, assigned: bool) -> list[float]:
    """The forest's view of one candidate, in the order of ``FEATURES``."""
    n = len(text)
    counts = np.unique(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] / max(1, len(text.encode("utf-8", "replace")))
    digits, upper, lower = sum(c.isdigit() for c in text), sum(c.isupper() for c in text), sum(c.islower() for c in text)
    near = {w.lower() for w in _WORD.findall(before[-CONTEXT:]) + _WORD.findall(after[:CONTEXT])}
    path = path.lower()
    return [
        float(n), language.surprise(text), language.coverage(text), float(-(counts * np.log2(counts)).sum()), digits / n, upper / n,
        float(all(c in "0123456789abcdefABCDEF" for c in text)), float((digits > 0) + (upper > 0) + (lower > 0) + (digits + upper + lower < n)),
        max((len(m) for m in re.findall(r"\d+", text)), default=0) / n, float(text.startswith(PREFIXES)), float(assigned), float(before[-1:] in "\"'`" and before[-1:] != ""),
        float(len(near & SECRET_WORDS)), float(len(near & PLAIN_WORDS)), float(any(x in path for x in ("test", "example", "sample", "fixture", "docs"))), float(any(x in path for x in ("config", "env", "deploy", "prod"))),
    ]


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of a text's candidates, in order, without overlaps."""
    found = [(m.start(1), m.end(1), True) for m in _ASSIGNED.finditer(text)]
    taken = sorted(found)
    for m in _KEY.finditer(text):
        if any(c.isdigit() for c in m.group()) and not any(a < m.end() and m.start() < b for a, b, _ in taken):
            found.append((m.start(), m.end(), False))
    return sorted(found)


def _findings(language: Language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = text_column(batch, "text")
                # Texts without a long token with a digit, and without a telling name, have no candidate.
                split = pc.utf8_split_whitespace(texts)
                encoded = split.flatten().dictionary_encode()
                d = encoded.dictionary
                long = pc.and_(pc.greater_equal(pc.utf8_length(d), 16), pc.match_substring_regex(d, "[0-9]"))
                odd = pc.or_(long, pc.match_substring_regex(d, _HINT)).to_numpy(zero_copy_only=False).astype(bool)
                offsets = split.offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(texts)), np.diff(offsets))
                out: dict[str, list] = {k: [] for k in ("row", "start", "length", "sha256", "assigned", "features")}
                paths = pc.fill_null(batch.column(batch.schema.get_field_index("source")).cast(pa.string()), "")
                for i in np.unique(row[odd[encoded.indices.to_numpy(zero_copy_only=False)]]).tolist() if len(row) else []:
                    text, path = texts[i].as_py(), paths[i].as_py()
                    for a, b, assigned in candidates(text):
                        own = text[a:b]
                        out["row"].append(i)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["sha256"].append(hashlib.sha256(own.encode("utf-8", "replace")).hexdigest())
                        out["assigned"].append(assigned)
                        out["features"].append(features(language, own, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path, assigned))
                ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(out["row"], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out["start"], pa.int32()), pa.array(out["length"], pa.int32()), pa.array(out["sha256"], pa.string()), pa.array(out["assigned"], pa.bool_()), pa.array(out["features"], pa.list_(pa.float64()))], names=["doc_id", "start", "length", "sha256", "assigned", "features"])

    return run


def findings(docs: DataFrame, language: Language) -> DataFrame:
    """Every candidate of every document with its features."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "source").mapInArrow(_findings(language), f"doc_id {kind}, start int, length int, sha256 string, assigned boolean, features array<double>")


def synthetic_findings(words: list[str], n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, str, bool, int]]:
    """(candidate, before, after, path, assigned, label): generated keys and look-alikes."""
    r = random.Random(seed)
    words = words or ["value", "index", "reader", "window", "table"]
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, base, digits = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789"
    prose = lambda: " ".join(r.choice(words) for _ in range(5))
    lead = [" Authorization: Bearer ", " authorization bearer ", " private key ", " passphrase ", " login with ", " https://api/v1?key="]
    out = []
    for _ in range(n):
        path = r.choice(["src1", "src12", "app/config.env", "deploy/prod.yml", "tests/fixture.txt", "docs/example.md", ""])
        if r.random() < 0.5:
            secret = r.choice([lambda: pick(hexa, r.choice([32, 40, 64])), lambda: pick(hexa, 40).upper(), lambda: "AKIA" + pick(base.upper(), 16), lambda: "ghp_" + pick(base, 36), lambda: pick(base + "+/", 40), lambda: "sk_live_" + pick(base, 24), lambda: pick(base, r.randint(16, 48)), lambda: pick(base + "!@#$%", r.randint(10, 20))])()
            if r.random() < 0.2:  # bare, often without a prefix, with secret neighbour words or, where it looks like nothing else, without
                mixed = pick(base, r.randint(24, 48))
                out.append((secret, prose() + r.choice(lead), " " + prose(), path, False, 1) if r.random() < 0.7 else (mixed, prose() + " ", " " + prose(), path, False, 1))
                continue
            name = r.choice(["token", "password", "secret", "api_key", "TOKEN", "auth_token", "access_key", "PASSWORD", "private_key", "passphrase", "auth", "bearer"])
            form = r.choice([' = "', ": ", "=", " = '", '": "'])
            out.append((secret, f"{prose()} {name}{form}", f'" {prose()}', path, True, 1) if r.random() < 0.85 or not secret.startswith(PREFIXES) else (secret, prose() + " ", " " + prose(), path, False, 1))
            continue
        kind = r.randrange(7)
        if kind == 0:
            out.append(("_".join(r.choice(words) for _ in range(3)) + pick(digits, 2), prose() + " ", " " + prose(), path, False, 0))
        elif kind == 1:
            out.append((pick(digits, r.choice([16, 17, 20])), prose() + r.choice([" ", " card ", " order "]), " " + prose(), path, False, 0))
        elif kind == 2:
            out.append((pick(hexa, r.choice([32, 40, 64])), prose() + r.choice([" commit ", " sha ", " md5 ", " checksum: ", " digest "]), " " + prose(), path, False, 0))
        elif kind == 3:
            u = pick(hexa, 32)
            out.append((f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", prose() + r.choice([" ", " uuid ", " build "]), " " + prose(), path, False, 0))
        elif kind == 4:
            out.append((r.choice(["your_token_here", "changeme123", "<password>1234", "xxxxxxxxxxxx1", "example-" + r.choice(words) + "-key1", "REPLACE_ME_123"]), f"{prose()} {r.choice(['token', 'password', 'secret'])} = ", " " + prose(), r.choice([path, "docs/example.md"]), True, 0))
        elif kind == 5:
            out.append(("".join(r.choice(words).title() for _ in range(4)) + pick(digits, 1), prose() + " ", "(" + prose(), path, False, 0))
        else:
            out.append(("/".join(r.choice(words) for _ in range(4)) + "/" + pick(digits, 4), prose() + " ", " " + prose(), path, False, 0))
    return out


def by_hash(items, most: int, seed: int = 7) -> list:
    """The ``most`` items of lowest seeded hash."""
    return heapq.nsmallest(most, items, key=lambda x: hashlib.sha256(f"{seed}|{x!r}".encode("utf-8", "surrogatepass")).digest())


def _labelled(language: Language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *given, label, at = (c.to_pylist() for c in batch.columns)
            rows = [features(language, c, b or "", a or "", p or "", bool(x)) for c, b, a, p, x in zip(*given)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array([float(y) for y in label]), pa.array(at)], names=["features", "label", "at"])

    return run


def train(spark: SparkSession, language: Language, labelled: DataFrame | None = None, seed: int = 7) -> RandomForestClassificationModel:
    """Forest from a table of ``LABELLED`` findings, the ``MAX_LABELLED`` of lowest hash at most."""
    if labelled is None:
        labelled = spark.createDataFrame(synthetic_findings(sorted(by_hash(language.words, 5000))), LABELLED)
    names = [x.split()[0] for x in LABELLED.split(", ")]
    rows = labelled.where("length(candidate) > 0 AND label IS NOT NULL").select(*names).distinct().withColumn("at", F.xxhash64(*names, F.lit(seed)))
    chosen = rows.orderBy("at", *names).limit(MAX_LABELLED)
    told = chosen.repartition(spark.sparkContext.defaultParallelism, "at").mapInArrow(_labelled(language), "features array<double>, label double, at bigint")
    # A bounded table in one fixed order: the same forest in every run, however the rows lay.
    told = told.repartition(1).sortWithinPartitions("at", "features", "label").select(array_to_vector("features").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(told)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, sha256, assigned, ``probability`` and the decision ``secret`` of every candidate."""
    language = learn_language(docs)
    model = train(docs.sparkSession, language, labelled)
    scored = model.transform(findings(docs, language).withColumn("features", array_to_vector("features")))
    p = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.select("doc_id", "start", "length", "sha256", "assigned", p.alias("probability"), (p >= threshold).alias("secret"))
