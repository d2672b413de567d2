"""Shared view of a sequence column: symbols without white space, in upper case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_seq(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, r"\s+", ""))
