"""Scripts of several statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def split_statements(text: str) -> list[str]:
    """Statements between semicolons; those in quotes or comments do not count, empty ones are dropped."""
    parts, at = [""], 0
    token = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)
    for m in token.finditer(text):
        parts[-1] += text[at : m.start()]
        at = m.end()
        if m[0] == ";":
            parts.append("")
        elif not m[0].startswith(("--", "/*")):
            parts[-1] += m[0]
    parts[-1] += text[at:]
    return [p.strip() for p in parts if p.strip()]


def run_script(spark: SparkSession, text: str, result: int | None = None) -> DataFrame | None:
    """Runs the statements in order; gives the DataFrame of statement ``result`` or else of the last query.

    ``CREATE VIEW`` becomes a temp view: a permanent one can't stand on temp views. A view that is dropped
    later in the script still serves the result, as its plan was resolved before.
    """
    found, last = [], None
    for statement in split_statements(text):
        statement = re.sub(r"(?is)^create\s+(or\s+replace\s+)?view\b", "CREATE OR REPLACE TEMP VIEW", statement)
        df = spark.sql(statement)
        found.append(df)
        if re.match(r"(?is)^\s*(select|with|values|from)\b", statement):
            last = df
    return found[result] if result is not None else last
