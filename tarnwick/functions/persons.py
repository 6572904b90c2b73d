"""Names of people as column expressions: parts, classes of given names, keys under which compatible names meet, overlap."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions.text import fold_key, normalize_text

# Given names that count as one; a prefix of two letters or more counts anyway.
GIVEN_CLASSES = (
    ("tom", "thomas", "tommy"),
    ("rob", "robert", "bob", "bobby"),
    ("bill", "william", "will", "billy", "liam"),
    ("dick", "richard", "rick", "ricky"),
    ("jim", "james", "jimmy", "jamie"),
    ("mike", "michael", "mick"),
    ("joe", "joseph", "joey"),
    ("dave", "david"),
    ("dan", "daniel", "danny"),
    ("chris", "christopher", "kit"),
    ("matt", "matthew"),
    ("steve", "stephen", "steven"),
    ("beth", "elizabeth", "liz", "betty", "eliza"),
    ("kate", "catherine", "katherine", "kathy", "cathy"),
    ("alex", "alexander", "alexandra"),
)
# What follows a family name, and what leads one.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "junior", "senior")
PARTICLES = ("de", "da", "di", "del", "della", "der", "den", "van", "von", "la", "le", "el", "al", "st", "ste")


def tokens(x: str | Column) -> Column:
    """Words of the folded name without closing dots; initials go where other words stay. Null has none."""
    every = F.filter(F.transform(F.split(F.coalesce(fold_key(x), F.lit("")), r"\s+"), lambda t: F.regexp_replace(t, r"\.+$", "")), lambda t: t != "")
    return F.when(F.size(every) > 1, F.filter(every, lambda t: ~t.rlike("^[a-z]$"))).otherwise(every)


def parts(x: str | Column) -> Column:
    """struct(given, family) of the tokens: suffixes give way, a lone word is both; a family name that is a particle gives way to a word before it."""
    every = tokens(x)
    names = F.filter(every, lambda t: ~t.isin(*SUFFIXES))
    names = F.when(F.size(names) > 0, names).otherwise(every)
    inner = F.filter(F.slice(names, F.lit(2), F.greatest(F.size(names) - 2, F.lit(0))), lambda t: ~t.isin(*PARTICLES))
    last = F.try_element_at(names, F.lit(-1))
    family = F.when(last.isin(*PARTICLES), F.coalesce(F.try_element_at(inner, F.lit(-1)), last)).otherwise(last)
    return F.struct(F.try_element_at(names, F.lit(1)).alias("given"), family.alias("family"))


def given_class(given: Column) -> Column:
    """The first name of its class; null for names of none."""
    named = F.create_map(*(F.lit(v) for v in chain.from_iterable((n, c[0]) for c in GIVEN_CLASSES for n in c)))
    return F.try_element_at(named, given)


def compatible(a: Column, b: Column) -> Column:
    """Equal given names, names of one class, or one the beginning of the other from two letters on; false for nulls."""
    prefix = F.when(F.length(a) <= F.length(b), b.startswith(a) & (F.length(a) >= 2)).otherwise(a.startswith(b) & (F.length(b) >= 2))
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(given_class(a) == given_class(b), F.lit(False)) | F.coalesce(prefix, F.lit(False))


def keys(given: Column, family: Column) -> Column:
    """Keys of which compatible given names of one family share one: its class, its first two letters."""
    own = [F.concat(F.lit("class:"), given_class(given)), F.concat(F.lit("letters:"), F.substring(given, 1, 2))]
    return F.filter(F.transform(F.array(*own), lambda k: F.concat(k, F.lit(" "), family)), lambda k: k.isNotNull())


def overlap(a: str | Column, b: str | Column) -> Column:
    """100 for equal folded names, else 40 where one holds the other; 50 for the family and 40 more for a compatible given name, 25 for that alone; 15 for a shared word.

    Family and given name are here the last and the first word, suffixes included. 0 where a name is null or has no words.
    """
    x, y, p, q = normalize_text(a), normalize_text(b), tokens(a), tokens(b)
    first, last = lambda t: F.try_element_at(t, F.lit(1)), lambda t: F.try_element_at(t, F.lit(-1))
    given, family = compatible(first(p), first(q)), F.coalesce(last(p) == last(q), F.lit(False))
    score = F.when(fold_key(a) == fold_key(b), 100).when(F.contains(x, y) | F.contains(y, x), 40).otherwise(0)
    score = score + F.when(family & given, 90).when(family, 50).when(given, 25).otherwise(0) + F.when(F.arrays_overlap(p, q), 15).otherwise(0)
    return F.when((F.size(p) > 0) & (F.size(q) > 0), score).otherwise(0)
