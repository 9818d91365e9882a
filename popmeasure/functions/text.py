"""Label and text expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def before_first(text: Column | str, sep: str) -> Column:
    """Text before the first separator, blanks kept; the whole text when there is no separator."""
    return F.substring_index(_col(text), sep, 1)


def after_first(text: Column | str, sep: str) -> Column:
    """Text after the first separator, blanks kept; the whole text when there is no separator."""
    text = _col(text)
    at = F.instr(text, sep)
    return F.when(at > 0, F.substring(text, at + F.lit(len(sep)), F.length(text))).otherwise(text)


def relabel(
    value: Column | str, mapping: Mapping[Any, Any], default: Any = None, keep_other: bool = False
) -> Column:
    """Exact replacement by `mapping`.

    Values outside the mapping, null included, become `default`; with `keep_other` they stay as they are.
    """
    value = _col(value)
    out: Column | None = None
    for old, new in mapping.items():
        test = value == F.lit(old)
        out = F.when(test, F.lit(new)) if out is None else out.when(test, F.lit(new))
    if out is None:
        return value if keep_other else F.lit(default)
    if keep_other:
        return out.otherwise(value)
    return out if default is None else out.otherwise(F.lit(default))


def fill_null(value: Column | str, replacement: Any) -> Column:
    return F.coalesce(_col(value), F.lit(replacement))


def null_if(value: Column | str, sentinel: Any) -> Column:
    return F.nullif(_col(value), F.lit(sentinel))
