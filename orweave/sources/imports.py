"""Import of CSV dumps with the schema of a CREATE TABLE script."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def parse_schemas(script: str) -> dict[str, T.StructType]:
    """Tables of a script of CREATE TABLE statements; integers are int, everything else string."""
    out = {}
    for name, body in re.findall(r"create\s+table\s+(\w+)\s*\((.*?)\)\s*;", script, re.I | re.S):
        fields = []
        for part in re.split(r",(?![^(]*\))", body):
            words = part.split()
            if words and words[0].lower() not in ("primary", "foreign", "unique", "constraint", "check"):
                fields.append(T.StructField(words[0], T.IntegerType() if words[1].lower().startswith(("int", "serial")) else T.StringType()))
        out[name.lower()] = T.StructType(fields)
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated, double-quoted, backslash-escaped rows without a header; blanks are null."""
    return spark.read.csv(path, schema=schema, quote='"', escape="\\", nullValue="", multiLine=True)
