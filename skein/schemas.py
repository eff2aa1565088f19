"""Schemas of the tables the engine makes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


SOURCES = _struct(("source_id", _S), ("sql_text", _S), ("path", _S))
TOKENS = _struct(("source_id", _S), ("tok_no", _I), ("stmt_no", _I), ("batch_no", _I), ("kind", _S), ("value", _S), ("position", _I))
PARAMETER = _struct(("name", _S), ("datatype", _S), ("default_value", _S), ("output", _B))
VARIABLE = _struct(("name", _S), ("value", _S))
REFERENCE = _struct(("name", _S), ("schema", _S), ("database", _S), ("kind", _S))
OBJECTS = _struct(
    ("source_id", _S),
    ("object_ord", _I),
    ("name", _S),
    ("schema", _S),
    ("object_type", _S),
    ("parameters", T.ArrayType(PARAMETER)),
    ("variables", T.ArrayType(VARIABLE)),
    ("references", T.ArrayType(REFERENCE)),
    ("temporary_tables", T.ArrayType(_S)),
    ("dynamic_sql", _B),
)
