"""Numbers, dates and names that come as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """`1,234.5` is 1234.5, `(x)` is -x, `<1` is 0; `n.d.`, `n.a.` and all else is null."""
    bare = F.regexp_replace(F.trim(text), r"[,\s]", "")
    inside = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    return F.when(bare == "<1", F.lit(0.0)).when(inside != "", -inside.try_cast("double")).otherwise(bare.try_cast("double"))


def date(text: Column) -> Column:
    """ISO, day-first, `YYYY-Qn`, `Qn YYYY`, `YYYYMM` and `Mon-YY`; quarters are stamped at their last month."""
    x = F.trim(text)
    tries = [F.try_to_timestamp(x, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy")]
    for pattern, year, quarter in ((r"^(\d{4})-Q([1-4])$", 1, 2), (r"^Q([1-4]) (\d{4})$", 2, 1)):
        y, q = (F.nullif(F.regexp_extract(x, pattern, g), F.lit("")).cast("int") for g in (year, quarter))
        tries.append(F.make_date(y, q * 3, F.lit(1)))
    six = F.when(x.rlike(r"^\d{6}$"), F.concat(x, F.lit("01")))
    short = F.when(x.rlike(r"^[A-Z][a-z]{2}-\d{2}$"), F.concat(F.lit("01-"), x))
    return F.coalesce(*tries, F.try_to_timestamp(six, F.lit("yyyyMMdd")).cast("date"), F.try_to_timestamp(short, F.lit("dd-MMM-yy")).cast("date"))


def spec_parts(name: Column, pattern: str = r"^([A-Za-z]+)#?(\d+)(.*)$") -> list[Column]:
    """method, k and variant of a specification's name."""
    part = lambda g: F.regexp_extract(name, pattern, g)
    return [part(1).alias("method"), F.nullif(part(2), F.lit("")).cast("int").alias("k"), part(3).alias("variant")]


#: Names of the vintages of the grid from -2 to 2.
LEGACY = {-2: "two_back", -1: "one_back", 0: "zero_back", 1: "one_ahead", 2: "two_ahead"}


def vintage_name(v: Column, grid: Iterable[int] = ()) -> Column:
    """The column name of a vintage; the grid from -2 to 2, and no other, has names of its own."""
    if sorted(grid) == sorted(LEGACY):
        return F.element_at(F.create_map(*[F.lit(x) for pair in LEGACY.items() for x in pair]), v.cast("int"))
    return F.format_string("p%+d", v)


def slug(text: Column) -> Column:
    """Lower case, marks off, runs of anything else one underscore, none at the ends."""
    plain = F.translate(F.lower(text), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_|_$", "")
