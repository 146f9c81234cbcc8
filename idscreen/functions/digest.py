"""Column expressions that turn rows into digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_FIELD = "-:"


def row_text(columns: Sequence[str]) -> Column:
    """The columns as one string. Each value comes with its length in bytes, so text cannot move between fields."""
    values = [F.col(c).cast("string") for c in columns]
    fields = [F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in values]
    return F.concat(*[F.coalesce(f, F.lit(NULL_FIELD)) for f in fields])


def chain(texts: Column) -> Column:
    """Digest of each text together with the digest before it, starting from an empty one."""
    return F.aggregate(texts, F.lit(""), lambda before, text: F.sha2(F.concat(before, text), 256))
