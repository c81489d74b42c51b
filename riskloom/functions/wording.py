"""Sentence templates as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F


def fill(template: str, **values: Column) -> Column:
    """Replace ``{name}`` in a template by columns. Null when any value used is null."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(values[name])
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)
