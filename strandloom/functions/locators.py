"""Locators: which parts of which sequence, as ``id beg,length,strand;beg,length;...`` with begins from 1.

As a column: a struct of id and locs, an array of structs (beg from 0, len, strand + or -). A locator
without parts names the whole sequence: locs is null. Anything else that doesn't follow the form, and a
null, is a null locator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import reverse_complement

_PART = r"[0-9]+,[0-9]+(?:,?[+-])?"


def parse_locator(text: Column) -> Column:
    good = text.rlike(rf"^[^ ]+(?: {_PART}(?:;{_PART})*;?)?$")
    parts = F.filter(F.split(F.regexp_extract(text, r"^[^ ]+ (.*)$", 1), ";"), lambda x: x != "")
    number = lambda x, i: F.regexp_extract(x, r"^([0-9]+),([0-9]+)", i).cast("int")
    strand = lambda x: F.when(x.endswith("-"), "-").otherwise("+")
    locs = F.transform(parts, lambda x: F.struct((number(x, 1) - 1).alias("beg"), number(x, 2).alias("len"), strand(x).alias("strand")))
    return F.when(good, F.struct(F.regexp_extract(text, r"^([^ ]+)", 1).alias("id"), F.when(F.size(parts) > 0, locs).alias("locs")))


def format_locator(locator: Column) -> Column:
    parts = F.transform(locator["locs"], lambda x: F.concat_ws(",", (x["beg"] + 1).cast("string"), x["len"].cast("string"), x["strand"]))
    return F.concat_ws(" ", locator["id"], F.array_join(parts, ";"))


def shifted(locs: Column, by: int) -> Column:
    """Parts that begin ``by`` characters later (or, if negative, earlier)."""
    return F.transform(locs, lambda x: F.struct((x["beg"] + by).alias("beg"), x["len"].alias("len"), x["strand"].alias("strand")))


def turned(locs: Column, length: Column) -> Column:
    """The same parts on the other strand of a sequence of ``length``, in the opposite order."""
    other = lambda s: F.when(s == "+", "-").otherwise("+")
    return F.reverse(F.transform(locs, lambda x: F.struct((length - x["beg"] - x["len"]).alias("beg"), x["len"].alias("len"), other(x["strand"]).alias("strand"))))


def located(seq: Column, locs: Column) -> Column:
    """The parts of a sequence, joined, those on - turned and complemented; all of it without parts."""
    part = lambda x: F.substring(seq, x["beg"] + 1, x["len"])
    joined = F.array_join(F.transform(locs, lambda x: F.when(x["strand"] == "-", reverse_complement(part(x))).otherwise(part(x))), "")
    return F.when(locs.isNull(), seq).otherwise(joined)


def insert_break(seq: Column, at: Column, character: str = " ") -> Column:
    """A character put in after ``at`` others, so that no word spans the join of mates; as it is where
    ``at`` is null or negative."""
    return F.when(at >= 0, F.concat(F.substring(seq, F.lit(1), at), F.lit(character), F.substring(seq, at + 1, F.length(seq)))).otherwise(seq)
