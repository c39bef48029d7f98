"""Attribution edges: (opportunity, account) pairs drawn from several id columns.

The reference pulls one projection per id column, filters present values,
binds them and de-duplicates.  Here it is one scan: the present values of
each row are put in an array, de-duplicated inside the row and exploded.
When the opportunity id is the table key (the CRM Id is), per-row
de-duplication is the full de-duplication, so there is no shuffle at all,
and any other column of the same opportunity can ride along instead of
being joined back by Id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import present


def present_values(cols: Sequence[str]):
    """Array of the present values of ``cols``, first occurrence kept, bind order."""
    arr = F.array(*[F.col(c) for c in cols])
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != F.lit(""))))


def edges(df: DataFrame, cols: Sequence[str], id_col: str = "Id",
          out_col: str = "Account_Id", carry: Sequence[str] = (),
          unique_id: bool = True, first_flag: str | None = None) -> DataFrame:
    """Distinct (id, account) over ``cols``, with ``carry`` columns of the opportunity.

    ``first_flag`` (unique ids only) adds a boolean column that is true on
    exactly one edge per opportunity, so per-opportunity figures can be
    summed over the edges without de-duplicating by id.
    ``unique_id=False`` handles a source whose id repeats: the edges are then
    de-duplicated with a shuffle and ``carry`` is joined back by id (N:M, as
    the reference's left join would be).
    """
    carry = [c for c in carry if c not in (id_col, out_col)]
    if unique_id:
        if first_flag:
            x = df.select(F.col(id_col), F.posexplode(present_values(cols)).alias("__pos", out_col),
                          *[F.col(c) for c in carry])
            return x.select(id_col, out_col, (F.col("__pos") == 0).alias(first_flag), *carry)
        return df.select(F.col(id_col), F.explode(present_values(cols)).alias(out_col),
                         *[F.col(c) for c in carry])
    e = (df.select(F.col(id_col), F.explode(F.array(*[F.col(c) for c in cols])).alias(out_col))
           .filter(present(out_col))
           .dropDuplicates([id_col, out_col]))
    if carry:
        e = e.join(df.select(id_col, *carry), id_col, "left")
    return e
