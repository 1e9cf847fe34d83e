"""Functions on dotted paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), "[^A-Za-z0-9_]+", "_"))


def parent_path(path: Column) -> Column:
    """Null at the root."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", ""))


def depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def is_ancestor(above: Column, path: Column) -> Column:
    """Strictly above."""
    return F.startswith(path, F.concat(above, F.lit(".")))


def append_child(path: Column, label: Column) -> Column:
    return F.concat_ws(".", path, label)


def valid_path(path: Column) -> Column:
    return path.rlike(r"^[a-z0-9_]+(\.[a-z0-9_]+)*$")
