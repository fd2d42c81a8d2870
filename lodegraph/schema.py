"""Schemas and kinds of the graph's two tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The kinds of nodes and of relations, and the languages.
NODE_KINDS = (
    "File", "Folder", "Function", "Class", "Method", "Interface", "Property", "Variable", "Enum", "TypeAlias",
    "Constructor", "Module", "Namespace", "Import", "Community", "Process", "CodeElement",
)
RELATION_KINDS = (
    "CONTAINS", "DEFINES", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "ACCESSES",
    "OVERRIDES", "MEMBER_OF", "STEP_IN_PROCESS",
)
CALLABLE = ("Function", "Method", "Constructor")

NODES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("is_exported", T.BooleanType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ord", T.LongType()),
])

EDGES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", T.StringType()),
    T.StructField("step", T.IntegerType()),
    T.StructField("ord", T.LongType()),
])
