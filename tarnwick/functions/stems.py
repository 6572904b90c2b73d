"""English stems as column expressions: the published suffix-stripping algorithm of M. F. Porter (1980) as a list of replacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search leaves out.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves"
    " what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while"
    " of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there"
    " when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)

# The algorithm's suffixes and what takes their place.
_SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# a run of consonants and one of vowels; a word whose measure is over 0, over 1, or 1; one with a vowel; one that ends in consonant, vowel, consonant
_C, _V = "[^aeiou~][^aeiouy~]*", "[aeiouy][aeiou]*"
_OVER_0 = f"(?:{_C})?{_V}{_C}"
_OVER_1 = f"{_OVER_0}{_V}{_C}"
_ONE = f"(?:{_C})?{_V}{_C}(?:{_V})?"
_VOWEL = f"(?:{_C})?[aeiouy]"
_SHORT = f"{_C}[aeiouy][^aeiouwxy~]"


def _marked(suffixes, over: str, new) -> list[tuple[str, str]]:
    """The longest suffix is marked with ~; it is replaced where what stands before it has the measure."""
    rules = [(f"^(.+?)({'|'.join(sorted(suffixes, key=len, reverse=True))})$", r"\1~\2")]
    return rules + [(f"^({over}[^~]*)~{s}$", r"\1" + new(s)) for s in suffixes] + [("~", "")]


#: Patterns and replacements, in order, for a lower-cased word of three letters or more; Y is a consonant.
RULES: list[tuple[str, str]] = [
    ("^y", "Y"),
    ("^(.+)(ss|i)es$", r"\1\2"),
    ("^(.+[^s])s$", r"\1"),
    (f"^({_OVER_0}.*)eed$", r"\1ee"),
    (f"^((?:{_C})?(?:[aiouy]|[aeiouy].*[^e]))ed$", r"\1~"),
    (f"^({_VOWEL}.*)ing$", r"\1~"),
    ("(at|bl|iz)~$", r"\1e"),
    *((f"{x}{x}~$", x) for x in "bcdfghjkmnpqrtvwx"),
    (f"^({_SHORT})~$", r"\1e"),
    ("~$", ""),
    (f"^({_VOWEL}.*)y$", r"\1i"),
    *_marked(_SECOND, _OVER_0, _SECOND.get),
    *_marked(_THIRD, _OVER_0, _THIRD.get),
    (f"^(.+?)({'|'.join(sorted(_FOURTH, key=len, reverse=True))})$", r"\1~\2"),
    ("^([^~]+[st])(ion)$", r"\1~\2"),
    (f"^({_OVER_1}[^~]*)~.*$", r"\1"),
    ("~", ""),
    ("^(.+)e$", r"\1~e"),
    (f"^({_OVER_1}[^~]*)~e$", r"\1"),
    (f"^({_SHORT})~e$", r"\1e"),
    (f"^({_ONE})~e$", r"\1"),
    ("~", ""),
    (f"^((?:(?:{_C})?{_V}{_C}{_V}|{_OVER_1}.*)l)l$", r"\1"),
    ("Y", "y"),
]


def stem(word: Column) -> Column:
    """The stem of a lower-cased word: words of other letters than a to z, and of fewer than three, are their own."""
    found = reduce(lambda w, rule: F.regexp_replace(w, rule[0], rule[1].replace("\\", "$")), RULES, word)
    return F.when(word.rlike("^[a-z]{3,}$"), found).otherwise(word)


def stem_sql(word: str) -> str:
    """The same for a SQL that writes groups as \\1."""
    found = reduce(lambda w, rule: f"regexp_replace({w}, '{rule[0]}', '{rule[1]}')", RULES, word)
    return f"case when regexp_matches({word}, '^[a-z]{{3,}}$') then {found} else {word} end"


def stems_of(words: list[str]) -> list[str]:
    """The stems of the few words of a query, by the same rules."""
    import re

    out = []
    for word in words:
        w = word
        if re.fullmatch("[a-z]{3,}", w):
            for pattern, new in RULES:
                w = re.sub(pattern, new, w, count=1)
        out.append(w)
    return out
