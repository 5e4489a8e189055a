"""Bounded samples, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 24


def among_lowest(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The rows whose ids hash below a bound, about `most` of them: what follows is to be made small before it is ordered and cut.

    Rows of one id stay or go together; those without an id are left out, as any number of rows may lack one."""
    share = min(1.0, most / max(1, rows.where(F.col(id_col).isNotNull()).count()))
    return rows.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(_SPAN)) < int(share * _SPAN) + 1))
