"""Types and enumerations of knowledge units, relations and conflict cards.

Field order is part of the contract.  ``ord`` is the arrival order that makes
every limit, tie and first-wins rule deterministic.
"""

from __future__ import annotations

from pyspark.sql import types as T

KU_TYPES = tuple("Entity Concept Fact Claim Evidence Ability".split())
ENTITY_TYPES = tuple("Event Organization Person Place Product".split())
CLAIM_STATUSES = ("pending", "active", "disputed", "superseded", "rejected")
CONFLICT_STATUSES = ("open", "resolved", "deferred")
SOURCE_TYPES = ("Book", "Paper", "Article", "Speech", "Dataset", "Web")
RELATION_TYPES = ("CREATED_BY", "SUPPORTS", "DERIVED_FROM", "MENTIONS")
INACTIVE = tuple("deleted disputed rejected superseded".split())
EVENTS = (
    "knowledge.created", "knowledge.updated", "knowledge.merged", "knowledge.deleted", "claim.status_changed", "conflict.detected", "conflict.resolved",
    "ability.created", "ability.updated", "memory.created", "memory.updated", "memory.deleted", "agent.used_ability",
)

#: Id prefixes, numbered with eight digits.
PREFIX = dict(zip((*KU_TYPES, "Relation", "Conflict", "Skill"), "ENT CON FCT CLM EVD ABL REL CFL SKL".split()))

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_A = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


EXTRA = _struct(
    ("entity_type", _S), ("aliases", _A), ("birth", _S), ("active", _B), ("aka", _A), ("definition", _S), ("statement", _S), ("verifiable", _B), ("source_ref", _S),
    ("claim_status", _S), ("supports", _A), ("contradicts", _A), ("conflict_refs", _A), ("source", _S), ("source_type", _S), ("author", _S), ("year", _I), ("page", _I), ("quote", _S),
    ("ability_key", _S), ("skills", _A), ("workflows", _A), ("coverage", T.MapType(_S, _D)), ("knowledge_refs", _A), ("package_path", _S), ("pkg_version", _S), ("source_text", _S),
)
KU = _struct(
    ("ku_id", _S), ("ku_type", _S), ("name", _S), ("summary", _S), ("confidence", _D), ("status", _S), ("domain", _S), ("version", _I), ("tags", _A), ("sources", _A), ("relations", _A),
    ("extra", EXTRA), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()), ("ord", T.LongType()),
)
RELATION = _struct(("rel_id", _S), ("from_ku", _S), ("to_ku", _S), ("rel_type", _S), ("weight", _D), ("source", _S), ("created_at", T.TimestampType()), ("ord", T.LongType()))
CONFLICT = _struct(("conflict_id", _S), ("claim_a_id", _S), ("claim_b_id", _S), ("domain", _S), ("status", _S), ("resolution_strategy", _S), ("resolution_note", _S), ("resolved_by", _S), ("resolved_at", T.TimestampType()), ("created_at", T.TimestampType()))
EVENT = _struct(("event_id", _S), ("event", _S), ("version", _S), ("timestamp", T.TimestampType()), ("source", _S), ("payload", _S))
SECTION = _struct(("section_id", _S), ("content", _S))
CHAPTER = _struct(("chapter_id", _S), ("title", _S), ("sections", T.ArrayType(SECTION)))
DOCUMENT = _struct(("doc_id", _S), ("title", _S), ("source", _S), ("doc_type", _S), ("chapters", T.ArrayType(CHAPTER)), ("metadata", T.MapType(_S, _S)))
EXTRACTION = _struct(
    ("facts", T.ArrayType(_struct(("statement", _S), ("source_hint", _S)))),
    ("claims", T.ArrayType(_struct(("statement", _S), ("confidence", _D), ("domain", _S)))),
    ("entities", T.ArrayType(_struct(("name", _S), ("type", _S), ("aliases", _A)))),
    ("concepts", T.ArrayType(_struct(("name", _S), ("domain", _S), ("definition", _S)))),
)
