"""Schemas of the engine's tables: one row per thing, in every table the repository's id first."""

from __future__ import annotations

from pyspark.sql import types as T

from plumbline.functions.ids import SPAN

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


LITERAL = _struct(type=S, canonical=S)
PARAMETER = _struct(name=S, kind=S, required=B, value_state=S, typed_value=LITERAL, expression=S)
FILES = _struct(repo_id=S, head_sha=S, path=S, content=T.BinaryType())
ENTITIES = _struct(repo_id=S, entity_id=S, kind=S, qualified_name=S, module=S, signature=T.ArrayType(PARAMETER), decorators=T.ArrayType(S), span=SPAN)
FACTS = _struct(repo_id=S, fact_id=S, entity_id=S, subject=S, property=S, value_state=S, typed_value=LITERAL, expression=S, span=SPAN, fact_kind=S, parameters=T.ArrayType(PARAMETER), receiver=S, provenance=T.ArrayType(SPAN), seq=I)
IMPORTS = _struct(repo_id=S, module=S, path=S, source_module=S, name=S, binding=S, span=SPAN)
CLAIMS = _struct(repo_id=S, claim_id=S, subject=S, predicate=S, kind=S, value=LITERAL, qualifiers=T.ArrayType(S), version_scope=S, span=SPAN, value_span=SPAN, quote=S, extraction_method=S, source_hint=S, positional_count=I, keyword_names=T.ArrayType(S), unpacking=B, bound_receiver=B, seq=I)
DIAGNOSTICS = _struct(repo_id=S, code=S, message=S, stage=S, path=S, retryable=B, affects_completeness=B)
SCANNED_CODE = _struct(repo_id=S, entities=T.ArrayType(ENTITIES), facts=T.ArrayType(FACTS), imports=T.ArrayType(IMPORTS), diagnostics=T.ArrayType(DIAGNOSTICS))
SCANNED_DOCS = _struct(repo_id=S, claims=T.ArrayType(CLAIMS), diagnostics=T.ArrayType(DIAGNOSTICS))
