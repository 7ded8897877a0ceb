"""Schemas and enumerations of the code graph."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _struct(
    id=_s, label=_s, name=_s, file_path=_s, start_line=_l, end_line=_l, is_exported=T.BooleanType(), content=_s, description=_s, complexity=_l, sloc=_l,
    response_keys=T.ArrayType(_s), error_keys=T.ArrayType(_s), middleware=T.ArrayType(_s), entry_point_id=_s, step_count=T.IntegerType(), cohesion=_d, props=T.MapType(_s, _s),
)
EVIDENCE = _struct(kind=_s, weight=_d, note=_s)
EDGES = _struct(id=_s, src=_s, dst=_s, type=_s, confidence=_d, reason=_s, step=T.IntegerType(), evidence=T.ArrayType(EVIDENCE))
EMBEDDINGS = _struct(node_id=_s, chunk_index=T.IntegerType(), start_line=_l, end_line=_l, embedding=T.ArrayType(T.FloatType()), content_hash=_s)
COMMITS = _struct(commit_id=_s, file=_s)
CONTRACTS = _struct(contract_id=_s, type=_s, role=_s, repo=_s, service=_s, symbol_uid=_s, file_path=_s, symbol_name=_s, confidence=_d, meta=_s)
CONTRACT_LINKS = _struct(
    contract_id=_s, type=_s, match_type=_s, confidence=_d, from_repo=_s, from_service=_s, from_symbol=_s, to_repo=_s, to_service=_s, to_symbol=_s
)
BLOCKS = _struct(fn_id=_s, block=T.IntegerType(), start_line=_l, end_line=_l, text=_s, callees=_s, kind=_s)
CFG_EDGES = _struct(fn_id=_s, src_block=T.IntegerType(), dst_block=T.IntegerType(), kind=_s)
HUNKS = _struct(file_path=_s, start_line=_l, end_line=_l)

# Relation types that a traversal accepts, and the confidence of a relation that has none stored.
TRAVERSABLE = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "ACCESSES", "ADVISED_BY", "HAS_PROPERTY"]
DEFAULT_CONFIDENCE = {
    "CALLS": 0.9, "IMPORTS": 0.9, "EXTENDS": 0.85, "IMPLEMENTS": 0.85, "METHOD_OVERRIDES": 0.85, "METHOD_IMPLEMENTS": 0.85,
    "HAS_METHOD": 0.95, "HAS_PROPERTY": 0.95, "ACCESSES": 0.8, "CONTAINS": 0.95,
}
OTHER_CONFIDENCE = 0.5

# Contract types, roles and ways of matching.
CONTRACT_TYPES = ["http", "grpc", "graphql", "thrift", "topic", "lib", "include", "custom"]
CONTRACT_ROLES = ["provider", "consumer"]
MATCH_TYPES = ["exact", "manifest", "wildcard"]


def check_types(types: list[str]) -> list[str]:
    """The given relation types, if a traversal accepts all of them."""
    wrong = [t for t in types if t not in TRAVERSABLE]
    if wrong:
        raise ValueError(f"not traversable: {', '.join(wrong)}")
    return types
