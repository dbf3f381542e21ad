"""Embeddings as whole numbers, for the operators that need exact sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import by_name

#: Entries are counted in steps of 1 / STEPS.
STEPS = 256
#: Steps beyond which an entry counts as not finite: sums of squares of entries up to here stay exact in 64 bits.
LARGEST = 1 << 28


def whole_vectors(df: DataFrame, *more: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>: floor(STEPS * entry)) and the columns ``more``, under their names.

    A row goes if its vector is null or empty, or has a null, NaN, infinite or too large (``LARGEST``) entry. Null ids stay.
    """
    at = F.transform(by_name(df, vector_col), lambda c: F.lit(float(STEPS)) * c.cast("double"))
    rows = df.select(by_name(df, id_col).cast("long").alias("vec_id"), *(by_name(df, c).alias(c) for c in more), at.alias("at"))
    # NaN is greater than all other numbers here, so the comparison drops it too.
    fine = rows.where((F.size("at") > 0) & F.forall("at", lambda c: c.isNotNull() & (F.abs(c) < float(LARGEST))))
    return fine.select("vec_id", *more, F.transform("at", lambda c: F.floor(c)).alias("x"))


def dimensions(kept: DataFrame) -> int:
    """The length of the vectors of a written table; 0 if there are none. Vectors of several lengths are an error."""
    low, high = kept.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} entries in one table")
    return low or 0
