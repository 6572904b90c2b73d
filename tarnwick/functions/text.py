"""Text functions as column expressions: normalisation, keys, similarities, previews, cursors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no initial in an acronym, and suffixes that are no family name.
SMALL_WORDS = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "the", "to")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "esq")
NAME_PARTICLES = ("da", "de", "del", "della", "der", "di", "du", "la", "le", "van", "von", "den", "bin", "al", "st")
# Latin letters with marks and what they fold to, derived from Unicode decomposition.
_MARKED = "".join(chr(c) for c in range(0xC0, 0x180) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<"))
_FOLDED = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(x: str | Column) -> Column:
    """Trimmed, lower-cased, curly apostrophes straight, runs of white space one space; null stays null."""
    return F.lower(F.regexp_replace(F.trim(F.translate(_c(x), "‘’ʼ", "'''")), r"\s+", " "))


def fold_key(x: str | Column) -> Column:
    """`normalize_text` with Latin letters freed of their marks."""
    return F.translate(normalize_text(x), _MARKED, _FOLDED)


def alias_keys(x: str | Column) -> Column:
    return F.array_distinct(F.array(normalize_text(x), fold_key(x)))


def block_key(x: str | Column, kind: str = "none") -> Column:
    """The normalised text itself, its part before the first comma, or its first token."""
    norm = normalize_text(x)
    if kind == "comma_head":
        return F.trim(F.split_part(norm, F.lit(","), F.lit(1)))
    if kind == "first_token":
        return F.split_part(norm, F.lit(" "), F.lit(1))
    return norm


def tokens(x: str | Column) -> Column:
    """Distinct alphanumeric tokens, lower-cased, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda t: t != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 where either is empty."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / every)


def trigrams(x: str | Column) -> Column:
    """The distinct three-letter sequences of each word, padded with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda t: t != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: str | Column, b: str | Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def acronym(x: str | Column) -> Column:
    """Initials of the words that count; null unless there are two to eight."""
    words = F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*SMALL_WORDS))
    letters = F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")
    return F.when(F.length(letters).between(2, 8), F.upper(letters))


def name_parts(x: str | Column) -> Column:
    """struct(given, family): suffixes dropped, particles kept with the family name."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.trim(_c(x))), r"[.,]", " "), r"\s+"), lambda t: (t != "") & ~t.isin(*NAME_SUFFIXES))
    n = F.size(words)
    particle = (n > 2) & F.element_at(words, -2).isin(*NAME_PARTICLES)
    family = F.when(n == 0, F.lit(None)).when(particle, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1))).otherwise(F.try_element_at(words, F.lit(-1)))
    given = F.when(n > 1, F.try_element_at(words, F.lit(1)))
    return F.struct(given.alias("given"), family.alias("family"))


def name_overlap(a: str | Column, b: str | Column) -> Column:
    """100 for equal names; else 40 for containment, 50 and 40 for family and given names (25 for a given name alone), 15 for a shared token."""
    x, y = normalize_text(a), normalize_text(b)
    p, q = name_parts(a), name_parts(b)
    family = F.coalesce(p["family"] == q["family"], F.lit(False))
    given = F.coalesce(p["given"] == q["given"], F.lit(False))
    contained = F.contains(x, y) | F.contains(y, x)
    shared = F.size(F.array_intersect(F.split(x, " "), F.split(y, " "))) > 0
    score = F.when(contained, 40).otherwise(0) + F.when(family, 50).otherwise(0)
    score = score + F.when(family & given, 40).when(given, 25).otherwise(0) + F.when(shared & ~family & ~given, 15).otherwise(0)
    return F.when(x == y, 100).otherwise(F.least(score, F.lit(99)))


def person_sort_key(label: str | Column, explicit: str | Column | None = None) -> Column:
    """An explicit key, else the last white-space token of the name, normalised."""
    last = F.element_at(F.split(normalize_text(label), " "), -1)
    return last if explicit is None else F.coalesce(F.nullif(normalize_text(explicit), F.lit("")), last)


def preview(x: str | Column, limit: int = 280) -> Column:
    """The stripped text; beyond `limit` characters one fewer and an ellipsis."""
    text = F.trim(_c(x))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def outlet_host(url: str | Column) -> Column:
    """The lower-cased host without port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def approx_tokens(x: str | Column) -> Column:
    """A quarter of the characters, rounded up, one at least."""
    return F.greatest(F.ceil(F.length(_c(x)) / 4), F.lit(1)).cast("long")


def snippet(text: str | Column, needle: str | Column, around: int = 300) -> Column:
    """`around` characters before and behind the first occurrence, without case; null if there is none."""
    at = F.position(F.lower(_c(needle)), F.lower(_c(text)))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(_c(text), begin, at + F.length(_c(needle)) + around - begin))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as compact JSON with sorted keys; null and blank fields are left out."""
    kept = [F.when(F.trim(F.coalesce(v.cast("string"), F.lit(""))) != "", v.cast("string")).alias(k) for k, v in sorted(fields.items())]
    return F.sha2(F.to_json(F.struct(*kept)), 256)


def signature(secret: str | Column, timestamp: str | Column, body: str | Column) -> Column:
    """HMAC-SHA256 of timestamp.body in hex; null where any of them is."""
    raw = F.encode(_c(secret), "UTF-8")
    digits = F.when(F.length(raw) > 64, F.sha2(raw, 256)).otherwise(F.lower(F.hex(raw)))
    key = F.rpad(digits, 128, "0")

    # eight numbers of eight bytes each, signed as Spark's longs are
    numbers = [F.conv(F.substring(key, at, 16), 16, -10).cast("long") for at in range(1, 129, 16)]

    def padded(byte: int) -> Column:
        mask = F.lit(int.from_bytes(bytes([byte]) * 8, "big"))
        return F.unhex(F.concat(*(F.lpad(F.hex(n.bitwiseXOR(mask)), 16, "0") for n in numbers)))

    message = F.encode(F.concat(_c(timestamp), F.lit("."), _c(body)), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(padded(0x36), message), 256))
    return F.sha2(F.concat(padded(0x5C), inner), 256)


def cursor(sequence: str | Column, seconds: str | Column) -> Column:
    """An opaque URL-safe position in an event feed: version, sequence and epoch second in Base64 without padding."""
    raw = F.concat(F.lit("v1:"), _c(sequence).cast("string"), F.lit(":"), _c(seconds).cast("string"))
    return F.regexp_replace(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/", "-_"), "=+$", "")


def read_cursor(x: str | Column) -> Column:
    """struct(sequence, seconds) of a cursor; nulls for anything else."""
    padded = F.rpad(F.translate(_c(x), "-_", "+/"), (F.ceil(F.length(_c(x)) / 4) * 4).cast("int"), F.lit("="))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    part = lambda i: F.regexp_extract(raw, r"^v1:(\d+):(\d+)$", i).try_cast("long")
    return F.struct(part(1).alias("sequence"), part(2).alias("seconds"))


def coerce(x: str | Column, kind: str) -> Column:
    """A string read as number, boolean, date or list of strings; null where it is none."""
    text = F.trim(_c(x))
    if kind == "number":
        return F.regexp_replace(text, ",", "").try_cast("double")
    if kind == "boolean":
        word = F.lower(text)
        return F.when(word.isin("true", "yes", "1", "y"), True).when(word.isin("false", "no", "0", "n"), False)
    if kind == "date":
        return F.try_to_date(text, "yyyy-MM-dd")
    if kind == "list":
        return F.filter(F.transform(F.split(text, ","), F.trim), lambda t: t != "")
    return F.nullif(text, F.lit(""))
