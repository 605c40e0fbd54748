"""What went wrong, as one small vocabulary; the original text always stays reachable."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException, PySparkException

#: Kind by Spark's error condition (prefix match), most specific first.
BY_CONDITION = (
    ("PARSE_", "sql"),
    ("UNRESOLVED_", "schema"),
    ("AMBIGUOUS_", "schema"),
    ("FIELD_NOT_FOUND", "schema"),
    ("COLUMN_ALREADY_EXISTS", "schema"),
    ("TABLE_OR_VIEW_", "plan"),
    ("PATH_NOT_FOUND", "object_store"),
    ("FAILED_READ_FILE", "io"),
    ("DIVIDE_BY_ZERO", "arithmetic"),
    ("ARITHMETIC_OVERFLOW", "arithmetic"),
    ("CAST_INVALID_INPUT", "execution"),
    ("UNSUPPORTED_", "not_implemented"),
    ("NOT_SUPPORTED_", "not_implemented"),
    ("INVALID_CONF", "configuration"),
    ("INTERNAL_ERROR", "internal"),
    ("USER_RAISED_EXCEPTION", "execution"),
)


@dataclass(frozen=True)
class Failure:
    kind: str
    condition: str | None
    sql_state: str | None
    message: str
    root: str = ""  # what was raised first, without the way it came


_RAISED = re.compile(r"^(?:[\w.]+\.)?\w*(?:Error|Exception): (.*)$", re.M)


def _root(text: str) -> str:
    """The text of the last exception that a Python traceback in ``text`` names, else its first line."""
    part = text.split("JVM stacktrace:")[0]
    if "Traceback (most recent call last)" in part and (found := _RAISED.findall(part)):
        return found[-1].strip()
    return text.split("\n")[0].strip()


def classify(e: BaseException) -> Failure:
    """Kind, Spark condition and SQL state of an exception that reached the driver."""
    text = str(e)
    if not isinstance(e, PySparkException):
        kind = {FileNotFoundError: "io", MemoryError: "resources_exhausted", NotImplementedError: "not_implemented", ValueError: "configuration"}.get(type(e), "external")
        return Failure(kind, None, None, text, _root(text))
    condition = e.getCondition()
    kind = next((k for p, k in BY_CONDITION if condition and condition.startswith(p)), None)
    if kind is None:
        kind = "sql" if isinstance(e, ParseException) else "plan" if isinstance(e, AnalysisException) else "resources_exhausted" if "OutOfMemory" in text else "execution"
    return Failure(kind, condition, e.getSqlState(), text, _root(text))
