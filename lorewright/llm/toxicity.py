"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one machine that reads the word
classes of a clause:

* ``insult``   insult words (weighted by a lexicon) become hits;
* ``threat``   threat verbs become hits;
* ``negation`` a hit within two words after a negation is damped;
* ``reported`` a hit after a verb of saying or a quotation mark is damped
  until the clause ends;
* ``target``   a hit near a word of address is raised, an untargeted threat
  lowered.

A document's score is the sum of its clauses' scores, so a word counts by the
clause it stands in, not alone.  The lexicon's weights are log odds in a
bounded sample of labelled rows (``MAX_LABELLED``) on top of a built-in list;
the threshold is fitted on the same sample.

Defined results: null or empty text scores 0.0 and is not toxic; repeated rows
are scored each for itself; an empty table gives an empty result; columns of
the input other than the id and the text never reach the scoring, whatever
their names; null ids are kept as they are; an empty or missing labelled sample leaves the built-in
lexicon and the default threshold.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import written
from ._words import mix64, row_of, slices, text_column, word_codes

#: Labelled rows used at most, those of lowest hash: the bound of the fit.
MAX_LABELLED = 30_000
#: An insult learned from labels occurs in that many distinct toxic documents at least,
MIN_TOXIC = 5
#: and more often than chance by that many standard deviations, with these log odds at least.
MIN_Z, MIN_ODDS = 6.0, 2.0
#: Weight of a built-in word, and the threshold when no labels are given.
BUILT_IN, DEFAULT_THRESHOLD = 4.0, 3.0

INSULTS = frozenset("idiot idiots moron morons imbecile stupid dumbass scum trash pathetic worthless loser losers clown clowns disgusting vermin bastard bastards retard subhuman filth parasite parasites".split())
THREATS = frozenset("kill murder destroy hurt stab strangle shoot slaughter exterminate beat hang burn".split())
TARGETS = frozenset("you your yours yourself u ur he she they him her them his their these those people everyone vous ton tes usted ustedes ihr".split())
NEGATIONS = frozenset("not no never isn aren wasn weren don doesn didn won wouldn shouldn cannot neither nor without hardly kein keine niemals jamais aucun nunca jamás tampoco".split())
REPORTS = frozenset("said says say told wrote writes claimed claims called calls quoted quotes reported reports accused accuses alleged according quote sagte schrieb nannte dijo escribió llamó affirme disait écrit".split())
QUOTES = frozenset('"“”„«»')

INSULT, THREAT, TARGET, NEG, REPORT, QUOTE, OTHER = range(7)
#: Hits are HIT plus 4 for a threat, 2 for quoted or reported, 1 for negated.
HIT = 7
_CLAUSE = re.compile(r"[.!?;\n]+")
_TOKEN = re.compile(r'[^\W]+|["“”„«»]')


@dataclass
class Transducer:
    """Deterministic weighted transducer; a pair without an arc loops and copies its symbol.

    ``arcs[(state, symbol)] = (next state, output symbol, factor, bonus)``:
    ``factor`` multiplies the weight of the symbol that passes, ``bonus``
    multiplies the last hit's weight and is added after the fact.
    """

    start: int
    arcs: dict[tuple[int, int], tuple[int, int, float, float]]
    fade: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float, float]:
        got = self.arcs.get((state, symbol))
        return got if got else (self.fade.get(state, state), symbol, 1.0, 0.0)


def compose(*machines: Transducer) -> Transducer:
    """The product machine, with only the states that can be reached."""
    start = tuple(m.start for m in machines)
    number, todo, arcs = {start: 0}, [start], {}
    while todo:
        state = todo.pop()
        for symbol in range(OTHER + 1):
            out, factor, bonus, nexts = symbol, 1.0, 0.0, []
            for machine, s in zip(machines, state):
                s2, out, f, b = machine.step(s, out)
                factor, bonus = factor * f, bonus + b
                nexts.append(s2)
            key = tuple(nexts)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            arcs[(number[state], symbol)] = (number[key], out, factor, bonus)
    return Transducer(0, arcs)


def grammar() -> Transducer:
    """insult ∘ threat ∘ negation ∘ reported speech ∘ target."""
    insult = Transducer(0, {(0, INSULT): (0, HIT, 1.0, 0.0)})
    threat = Transducer(0, {(0, THREAT): (0, HIT + 4, 1.0, 0.0)})
    arcs = {(s, NEG): (2, NEG, 1.0, 0.0) for s in range(3)}
    arcs |= {(s, h): (0, h + 1, 0.3, 0.0) for s in (1, 2) for h in (HIT, HIT + 4)}
    negation = Transducer(0, arcs, fade={2: 1, 1: 0})
    arcs = {(0, REPORT): (1, REPORT, 1.0, 0.0), (0, QUOTE): (2, QUOTE, 1.0, 0.0), (2, QUOTE): (0, QUOTE, 1.0, 0.0)}
    arcs |= {(s, h): (s, h + 2, 0.5, 0.0) for s in (1, 2) for h in (HIT, HIT + 1, HIT + 4, HIT + 5)}
    reported = Transducer(0, arcs)
    # States: 1-3 words after a word of address; 4-6 after an insult, 7-9 after a threat.
    arcs = {(s, TARGET): (3, TARGET, 1.0, (0.0, 0.5, 7.0)[(s - 1) // 3 if s else 0]) for s in range(10)}
    for h in range(HIT, HIT + 8):
        is_threat = h >= HIT + 4
        arcs |= {(s, h): (9 if is_threat else 6, h, (8.0 if is_threat else 1.5) if 0 < s <= 3 else 1.0, 0.0) for s in range(10)}
    target = Transducer(0, arcs, fade={3: 2, 2: 1, 1: 0, 6: 5, 5: 4, 4: 0, 9: 8, 8: 7, 7: 0})
    return compose(insult, threat, negation, reported, target)


_GRAMMAR = grammar().arcs


def classify(word: str, weights: dict[str, float]) -> tuple[int, float]:
    """The class of a lower-case word, and its weight."""
    if word in weights:
        return INSULT, weights[word]
    if word in THREATS:
        return THREAT, 0.5
    for words, symbol in ((TARGETS, TARGET), (NEGATIONS, NEG), (REPORTS, REPORT), (QUOTES, QUOTE)):
        if word in words:
            return symbol, 0.0
    return OTHER, 0.0


def clause_score(clause: str, weights: dict[str, float]) -> float:
    """Score of one clause (lower case) by the composed grammar.

    A threat verb weighs little by itself; a word of address within three
    words, on either side, makes a threat of it.
    """
    state, score, last = 0, 0.0, 0.0
    for word in _TOKEN.findall(clause):
        symbol, weight = classify(word, weights)
        state, out, factor, bonus = _GRAMMAR[(state, symbol)]
        if out >= HIT:
            last = weight * factor
            score += last
        elif bonus:
            score += last * bonus
    return score


def document_score(text: str, weights: dict[str, float]) -> tuple[float, int]:
    """Sum over clauses, and the number of clauses that scored."""
    total, matched = 0.0, 0
    for clause in _CLAUSE.split(text.lower()):
        if score := clause_score(clause, weights):
            total, matched = total + score, matched + 1
    return round(total, 6), matched


def _scorer(id_column: str, text_name: str, weights: dict[str, float], threshold: float, keep_text: bool):
    heads = set(weights) | THREATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_name):
                texts = text_column(batch, text_name)
                offsets, codes, words = word_codes(texts)
                is_head = np.fromiter((w in heads for w in words), bool, len(words))
                score, matched = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
                # Only texts that hold a head word can match a clause; the others score 0.
                for i in np.unique(row_of(offsets)[is_head[codes]]) if len(codes) else ():
                    score[i], matched[i] = document_score(texts[int(i)].as_py(), weights)
                own = [pa.array(score), pa.array(matched), pa.array(score >= threshold)]
                if keep_text:
                    yield batch.filter(pa.array(score < threshold))
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_column)), *own], names=[id_column, "toxicity", "clauses", "toxic"])

    return run


@dataclass
class Model:
    """Fitted parts of the grammar: the lexicon's weights and the threshold."""

    weights: dict[str, float]
    threshold: float


def built_in() -> Model:
    return Model(dict.fromkeys(INSULTS, BUILT_IN), DEFAULT_THRESHOLD)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled text with a sketch that near copies share."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            offsets, codes, words = word_codes(text_column(batch, "text"))
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            base = mix64(np.array([hash_of(w) for w in words], np.uint64)) if words else np.zeros(0, np.uint64)
            for i, y in enumerate(toxic):
                own = np.unique(codes[offsets[i] : offsets[i + 1]])
                sketch = 0
                for seed in range(3):
                    sketch = sketch * 1_000_003 + (int(mix64(base[own] ^ np.uint64(seed)).min()) if len(own) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([sketch % (1 << 63)], pa.int64()), pa.array([int(y)], pa.int32()), pa.array([sorted(words[c] for c in own)], pa.list_(pa.string()))], names=["sketch", "toxic", "words"])


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode())


def fit(docs: DataFrame, labels: DataFrame | None, max_labelled: int = MAX_LABELLED) -> Model:
    """Lexicon weights and threshold from at most ``max_labelled`` labelled rows.

    Near copies in the sample count once, so that one copied toxic text does
    not make insults of its words.  A word is an insult if it occurs in
    ``MIN_TOXIC`` distinct toxic texts and is ``MIN_Z`` deviations more
    frequent there than chance.
    """
    model = built_in()
    if labels is None:
        return model
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled)
    # Bounded by max_labelled rows of 12 bytes whatever the corpus is, hence broadcast.
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = written(sample, "toxicity-sample")
    rows = sample.mapInArrow(_vocabulary, "sketch bigint, toxic int, words array<string>")
    # Of near copies the greatest row, not any: the fit is the same in every run.
    distinct = written(rows.groupBy("sketch").agg(F.max(F.struct("toxic", "words")).alias("m")).select("m.*"), "toxicity-words")
    n1, n0 = distinct.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n1 or not n0:
        return model
    rate = n1 / (n1 + n0)
    counts = distinct.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("seen"))
    rows = counts.where((F.col("bad") >= MIN_TOXIC) & (F.col("bad") > F.col("seen") * rate + MIN_Z * F.sqrt(F.col("seen") * rate * (1 - rate)))).collect()  # at most the insults of a bounded sample
    for word, bad, seen in rows:
        odds = math.log(((bad + 0.5) / (n1 + 1)) / ((seen - bad + 0.5) / (n0 + 1)))
        if odds >= MIN_ODDS:
            model.weights[word] = max(odds, model.weights.get(word, 0.0))
    scored = sample.mapInArrow(_sample_scores(model.weights), "score double, toxic int").collect()
    model.threshold = best_threshold([r.score for r in scored], [r.toxic for r in scored])
    return model


def _sample_scores(weights: dict[str, float]):
    run = _scorer("toxic", "text", weights, math.inf, False)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], names=["score", "toxic"])

    return scores


def best_threshold(scores: list[float], toxic: list[int]) -> float:
    """The threshold of highest F1, a quarter up the gap below it (rather catch than miss); ties go to the higher one."""
    order = np.argsort(-np.asarray(scores), kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(toxic)[order]
    if not y.sum():
        return DEFAULT_THRESHOLD
    last = np.r_[s[1:] != s[:-1], True] & (s > 0)
    if not last.any():
        return DEFAULT_THRESHOLD
    f1 = np.where(last, 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else 0.0
    return float(below + (s[k] - below) / 4)


def score(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column_name: str = "text") -> DataFrame:
    """One row per document: id, ``toxicity``, matched ``clauses`` and the decision ``toxic``."""
    model = model or built_in()
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column_name).mapInArrow(_scorer(id_column, text_column_name, model.weights, model.threshold, False), f"`{id_column}` {kind}, toxicity double, clauses int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the grammar doesn't reject, with the columns they came with."""
    return docs.mapInArrow(_scorer("doc_id", "text", model.weights, model.threshold, True), docs.schema)
