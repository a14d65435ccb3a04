"""The parse record: one row per source file, nested, of a fixed version."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = 5

_RECORD = """ir_version BIGINT, path STRING, language STRING, content_hash STRING, byte_len BIGINT, line_count BIGINT,
metrics STRUCT<code_lines: BIGINT, comment_lines: BIGINT, blank_lines: BIGINT>, docstring STRING,
symbols ARRAY<STRUCT<local_key: STRING, name: STRING, qualified_name: STRING, kind: STRING, start_line: BIGINT, end_line: BIGINT, start_byte: BIGINT, end_byte: BIGINT, signature: STRING,
  parameters: ARRAY<STRUCT<name: STRING, type_annotation: STRING, default_value: STRING>>, return_type: STRING, docstring: STRING, is_test: BOOLEAN>>,
calls ARRAY<STRUCT<caller_local_key: STRING, callee_name: STRING, callee_local_key: STRING, callee_file: STRING, callee_external: BOOLEAN, line: BIGINT, column: BIGINT>>,
imports ARRAY<STRUCT<import_name: STRING, target_module: STRING, kind: STRING, line: BIGINT, column: BIGINT, resolved: STRING>>,
diagnostics ARRAY<STRUCT<severity: STRING, message: STRING, line: BIGINT, byte_span: ARRAY<BIGINT>>>,
retrieval_card STRUCT<card_version: BIGINT, est_tokens: BIGINT, text: STRING>, symbol_cards ARRAY<STRUCT<card_version: BIGINT, est_tokens: BIGINT, text: STRING>>"""


def record() -> T.StructType:
    return T.StructType.fromDDL(_RECORD)


RECORD_DDL = _RECORD
