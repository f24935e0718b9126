"""Blocking functions: from an author struct to the name of its block."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Canopy = Callable[[Column], Column]


def full_name(a: Column) -> Column:
    return F.concat(F.lit("LAST_"), a["lastName"], F.lit("_FIRST_"), a["firstName"], F.lit("_MIDDLE_"), F.array_join(a["middleNames"], "_"))


def first_and_last(a: Column) -> Column:
    return F.concat(F.lit("LAST_"), a["lastName"], F.lit("_FIRST_"), a["firstName"])


def last_and_first_n(n: int) -> Canopy:
    return lambda a: F.concat(F.lit("LAST_"), a["lastName"], F.lit("_FIRST_"), F.substring(a["firstName"], 1, n))


def from_name(name: str) -> Canopy:
    """fullName, firstAndLast or lastAndFirst<N>ofFirst, in any case."""
    known = {"fullname": full_name, "firstandlast": first_and_last}
    name = name.lower()
    if name in known:
        return known[name]
    found = re.fullmatch(r"lastandfirst(\d+)offirst", name)
    if not found:
        raise ValueError(f"no such canopy: {name}")
    return last_and_first_n(int(found[1]))


#: From fine to coarse.
DEFAULT = ("fullName", "firstAndLast", "lastAndFirst3ofFirst", "lastAndFirst1ofFirst")
