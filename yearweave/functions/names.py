"""Column names: safe identifiers and the int-named columns that form the axis."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_NAME = re.compile(r"\s*[+-]?[0-9]+\s*\Z")


def axis_value(name: str) -> int | None:
    return int(name) if INT_NAME.match(name) else None


def overlap_columns(columns: list[str], start: int, end: int) -> list[str]:
    """Names that read as an int within [start, end], in table order."""
    found = {c: axis_value(c) for c in columns}
    names = [c for c in columns if found[c] is not None and start <= found[c] <= end]
    values = [found[c] for c in names]
    if len(set(values)) < len(values):
        raise ValueError(f"two column names stand for the same axis value: {names}")
    return names


def safe_identifier(col: Column) -> Column:
    """Letters, digits and single inner underscores; a leading digit gets an underscore."""
    cleaned = F.btrim(F.regexp_replace(col, "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    return F.regexp_replace(cleaned, r"\A([0-9])", "_$1")


def safe_name(name: str) -> str:
    """The same rule for one name on the driver."""
    words = [w for w in re.split("[^0-9a-zA-Z]+", name) if w]
    joined = "_".join(words)
    return f"_{joined}" if joined[:1].isdigit() else joined


def sanitize_columns(df: DataFrame) -> DataFrame:
    names = [safe_name(c) for c in df.columns]
    if len(set(names)) < len(names) or "" in names:
        raise ValueError(f"column names collide or vanish when made safe: {df.columns}")
    return df.toDF(*names)
