"""Row schemas of the engine's tables."""

from pyspark.sql import types as T

_STRING, _INT, _DOUBLE, _BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_STRINGS = T.ArrayType(_STRING)


def _row(strings: str = "", **fields: T.DataType) -> T.StructType:
    """String columns by name, then others."""
    return T.StructType([T.StructField(n, _STRING) for n in strings.split()] + [T.StructField(n, t) for n, t in fields.items()])


def _ordered(schema: T.StructType, names: str) -> T.StructType:
    return T.StructType([schema[n] for n in names.split()])


DOCUMENT = _row("parallel_id lang title url body commit_sha")
BLOCK = _row(section_path=_STRINGS, text=_STRING)
CHUNK = _ordered(
    _row("chunk_id doc_id parallel_id lang title text url strategy commit_sha", section_path=_STRINGS, token_count=_INT, char_count=_INT, ordinal=_INT, meta=T.MapType(_STRING, _STRING)),
    "chunk_id doc_id parallel_id lang title section_path text token_count char_count ordinal url strategy commit_sha meta",
)
HIT = _row("query_id", rank=_INT, chunk_id=_STRING, score=_DOUBLE)
GOLD = _row("id query lang topic", relevant_parallel_ids=_STRINGS, reference_answer=_STRING, answerable=_BOOL, notes=_STRING)
FAITHFULNESS = _row("id lang topic", evidence=_STRINGS, claim=_STRING, true_label=_STRING, notes=_STRING)
VERDICT = _row("claim label", score=_DOUBLE, best_evidence_index=_INT, method=_STRING)
TRACE = _row(
    "trace_id",
    timestamp=_DOUBLE,
    question=_STRING,
    lang_filter=_STRING,
    retrieved=T.ArrayType(_row("chunk_id parallel_id title lang", score=_DOUBLE)),
    answer_text=_STRING,
    llm_name=_STRING,
    embedder_name=_STRING,
    verifier_name=_STRING,
    claims=T.ArrayType(_row("text label action method")),
    final_text=_STRING,
    refused=_BOOL,
    refusal_reason=_STRING,
    latency_ms=T.MapType(_STRING, _DOUBLE),
)
