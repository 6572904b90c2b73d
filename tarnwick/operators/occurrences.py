"""Evidence found again in raw texts, through a normalised copy whose characters know where they stand."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of evidence that are looked for in one pass over a text.
NEEDLES = 256
# Marks that are written in several ways, and what they count as.
_QUOTES = "\"'`´‘’‚‛“”„‟«»′″"
_DASHES = "‐‑‒–—―−"
_SAME = str.maketrans({**dict.fromkeys(_QUOTES, "'"), **dict.fromkeys(_DASHES, "-")})
_MARKS = (_QUOTES + _DASHES).replace("'", "")
_TRAILING = ",;:.…" + _QUOTES
# blanks, also as a backslash and a letter; characters that no mark follows; any other with what may belong to it
_PARTS = re.compile(r"((?:\s|\\[nrt])+)|((?:[\x21-\x5b\x5d-\x7e](?![^\x00-\x7f]))+)|\S[^\x00-\x7f\s]*")

_ESCAPES = ("\\n", "\\r", "\\t")
_BLANK = re.compile(r"(?:\s|\\[nrt])+")
# a blank of several characters, or a backslash and a letter
_WIDE = re.compile(r"[\s\\](?:(?<=\s)(?:\s|\\[nrt])+|(?<=\\)[nrt](?:\s|\\[nrt])*)")


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """The text with blanks joined and trimmed, marks alike and letters composed (NFKC), and where each of its characters begins and ends in the raw text."""
    out, starts, ends = [], [], []
    for m in _PARTS.finditer(text):
        a, b = m.span()
        if m.group(1):
            if out and b < len(text):
                out.append(" ")
                starts.append(a)
                ends.append(b)
        elif m.group(2):
            out.append(m.group(2).translate(_SAME))
            starts += range(a, b)
            ends += range(a + 1, b + 1)
        else:
            while a < b:
                end = a + 1
                while end < b and unicodedata.combining(text[end]):
                    end += 1
                unit = text[a:end].translate(_SAME)
                unit = unicodedata.normalize("NFKC", unit).translate(_SAME)
                out.append(unit)
                starts += [a] * len(unit)
                ends += [end] * len(unit)
                a = end
    return "".join(out), starts, ends


def _joined(text: str) -> str | None:
    """What `normalised` gives as text, where it leaves all but blanks one for one; None where composition changes a character."""
    for escape in _ESCAPES:
        text = text.replace(escape, " ")
    whole = " ".join(text.split())
    for mark in '"`' if whole.isascii() else _MARKS:
        whole = whole.replace(mark, _SAME[ord(mark)])
    return whole if unicodedata.is_normalized("NFKC", whole) else None


def _stretches(whole: str, needle: str, whole_words: bool, inside: Callable[[int], bool]) -> list[tuple[int, int]]:
    out, at = [], whole.find(needle)
    while at >= 0:
        end = at + len(needle)
        apart = not whole_words or ((at == 0 or not whole[at - 1].isalnum()) and (end == len(whole) or not whole[end].isalnum()))
        # a match doesn't begin or end inside of what one raw character became
        edges = (at == 0 or not inside(at)) and (end == len(whole) or not inside(end))
        if apart and edges:
            out.append((at, end))
        at = whole.find(needle, end if apart and edges else at + 1)
    return out


def _places(text: tuple[str, list[int], list[int]], needle: str, whole_words: bool) -> list[tuple[int, int]]:
    whole, starts, ends = text
    return [(starts[a], ends[b - 1]) for a, b in _stretches(whole, needle, whole_words, lambda p: starts[p - 1] == starts[p])]


class _Plain:
    """A text whose characters count one for one: only blanks move them, and their places are worked out once something is found."""

    def __init__(self, text: str, whole: str) -> None:
        self.text, self.whole = text, whole
        self.blanks: list[int] | None = None
        self.moved = [0]

    def _inside(self, p: int) -> bool:
        return unicodedata.combining(self.whole[p]) > 0 and self.whole[p - 1] != " "

    def _raw(self, p: int) -> int:
        if self.blanks is None:
            self.blanks, lead = [], _BLANK.match(self.text)
            if lead:
                self.blanks.append(-1)
                self.moved.append(lead.end())
            if len(self.text) > len(self.whole) + self.moved[-1]:
                for m in _WIDE.finditer(self.text, self.moved[-1]):
                    self.blanks.append(m.start() - self.moved[-1])
                    self.moved.append(self.moved[-1] + m.end() - m.start() - 1)
        return p + self.moved[bisect_left(self.blanks, p)]

    def places(self, needle: str, whole_words: bool) -> list[tuple[int, int]]:
        return [(self._raw(a), self._raw(b - 1) + 1) for a, b in _stretches(self.whole, needle, whole_words, self._inside)]


def _searched(text: str) -> Callable[[str, bool], list[tuple[int, int]]]:
    """A function that finds the places of a normalised needle in `text`."""
    if (whole := _joined(text)) is not None:
        return _Plain(text, whole).places
    copy = normalised(text)
    return lambda needle, whole_words: _places(copy, needle, whole_words)


def _finder(whole_words: bool):
    @F.pandas_udf("array<struct<needle: string, start: int, end: int, raw: string>>")
    def find(text: pd.Series, needles: pd.Series) -> pd.Series:
        rows = []
        for t, asked in zip(text, needles, strict=True):
            places, row = _searched(t or ""), []
            for needle in asked:
                wanted = normalised(needle)[0]
                found = places(wanted, whole_words) if wanted else []
                if not found and (bare := wanted.rstrip(_TRAILING + " ")):
                    found = places(bare, whole_words)
                row += [{"needle": needle, "start": a, "end": b, "raw": t[a:b]} for a, b in found]
            rows.append(row)
        return pd.Series(rows)

    return find


def proven(texts: DataFrame, key: str, text: str, evidence: DataFrame, needle: str, *, whole_words: bool = False) -> DataFrame:
    """(key, needle, start, end, raw) for each place where a piece of evidence stands in the text of its key.

    Quotes, dashes, compositions and runs of blanks count alike on both sides; case doesn't. Offsets are code points of the raw text, and `raw` is
    what stands there. Matches of one needle don't overlap. Evidence that isn't found is tried again without its trailing marks; what
    isn't found then, null or blank has no row: nothing is guessed. Equal pieces of one key count once. A key with many pieces has them dealt to
    blocks of some `NEEDLES`, each with the text beside it, and each text is normalised once a block, in time linear in its length.
    """
    pieces = evidence.select(F.col(key), F.col(needle).alias("__needle")).filter("__needle is not null").distinct()
    blocks = pieces.groupBy(key).agg(F.ceil(F.count("*") / NEEDLES).alias("__blocks"))
    block = F.pmod(F.xxhash64("__needle"), F.col("__blocks"))
    asked = pieces.join(blocks, key).groupBy(key, block.alias("__block")).agg(F.collect_list("__needle").alias("__asked"))
    found = texts.select(key, F.col(text).alias("__text")).join(asked, key).select(key, F.explode(_finder(whole_words)("__text", "__asked")).alias("__found"))
    return found.select(key, F.col("__found.needle").alias(needle), *(F.col(f"__found.{c}").alias(c) for c in ("start", "end", "raw")))
