"""Column functions for object names and source ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def name_key(c: Column | str) -> Column:
    """Outer blanks and tabs dropped, lower case; blank or null names give null."""
    key = F.lower(F.btrim(_col(c), F.lit(" \t")))
    return F.when(key != "", key)


def normal_source_id(c: Column | str) -> Column:
    """Outer white space dropped, ``\\`` to ``/``, every leading ``./`` dropped."""
    blanks = F.regexp_replace(_col(c), r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", "")
    return F.regexp_replace(F.translate(blanks, "\\", "/"), r"^(?:\./)+", "")


def fold(c: Column | str) -> Column:
    """Case folding: lower case, with sharp s and final sigma as full folding has them.

    Other letters whose full folding differs from lower case keep the lower case.
    """
    low = F.lower(_col(c))
    return F.when(low.rlike(r"^[\x00-\x7F]*$"), low).otherwise(
        F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "ςſ", "σs")
    )
