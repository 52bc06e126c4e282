"""Column expressions over type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape(type_: Column) -> Column:
    """A struct of base and mods: ``decimal(10, 2)`` is (numeric, [10, 2]).  Both are null for texts of another form, such as arrays."""
    text = F.lower(F.trim(type_))
    form = r"^([a-z_][a-z0-9_ ]*?)\s*(?:\(\s*(\d+(?:\s*,\s*\d+)*)\s*\))?$"
    base = F.regexp_extract(text, form, 1)
    name = F.when(base == "character varying", "varchar").when(base == "decimal", "numeric").otherwise(F.nullif(base, F.lit("")))
    mods = F.transform(F.regexp_extract_all(F.regexp_extract(text, form, 2), F.lit(r"(\d+)")), lambda x: x.cast("int"))
    return F.struct(name.alias("base"), F.when(name.isNotNull(), mods).alias("mods"))


def binary_coercible(old: Column, new: Column) -> Column:
    """Whether stored values of ``old`` are values of ``new`` as they are, so that only the catalog changes.  False for types of unknown form."""
    a, b = shape(old), shape(new)
    one, two = F.size(a.mods), F.size(b.mods)
    free = two == 0
    longer = (one == 1) & (two == 1) & (F.get(b.mods, F.lit(0)) >= F.get(a.mods, F.lit(0)))
    wider = (one == 2) & (two == 2) & (F.get(b.mods, F.lit(0)) >= F.get(a.mods, F.lit(0))) & (F.get(b.mods, F.lit(1)) == F.get(a.mods, F.lit(1)))
    fits = (
        F.when((a.base == b.base) & (a.mods == b.mods), True)
        .when((a.base == "varchar") & (b.base == "text"), True)
        .when((a.base == "varchar") & (b.base == "varchar"), free | longer)
        .when((a.base == "numeric") & (b.base == "numeric"), free | wider)
    )
    return F.coalesce(fits, F.lit(False))


def fitted(name: Column, most: int = 63) -> Column:
    """An identifier of at most ``most`` bytes: a longer one is cut, after a whole character, and given eight digits of its SHA-256."""
    data = name.cast("binary")
    heads = [F.try_validate_utf8(F.substring(data, 1, most - 9 - k).cast("string")) for k in range(4)]  # a character has four bytes at most
    return F.when(F.octet_length(name) <= most, name).otherwise(F.concat(F.coalesce(*heads), F.lit("_"), F.substring(F.sha2(data, 256), 1, 8)))
