"""Location strings to components, from right to left: country, postal code, state, county, city, then what stands ahead by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.places import STATES

# Names of countries that locations end with, and their two-letter codes; callers may pass more.
COUNTRIES = {
    "us": "US", "u.s.": "US", "u.s.a.": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "britain": "GB", "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB",
    "canada": "CA", "mexico": "MX", "france": "FR", "germany": "DE", "italy": "IT", "spain": "ES", "portugal": "PT", "ireland": "IE", "netherlands": "NL", "holland": "NL",
    "belgium": "BE", "switzerland": "CH", "austria": "AT", "poland": "PL", "czechia": "CZ", "czech republic": "CZ", "russia": "RU", "ukraine": "UA", "turkey": "TR", "türkiye": "TR",
    "israel": "IL", "iran": "IR", "iraq": "IQ", "india": "IN", "china": "CN", "japan": "JP", "south korea": "KR", "north korea": "KP", "australia": "AU", "new zealand": "NZ",
    "brazil": "BR", "argentina": "AR", "chile": "CL", "colombia": "CO", "peru": "PE", "egypt": "EG", "nigeria": "NG", "kenya": "KE", "south africa": "ZA", "georgia": "GE", "ivory coast": "CI",
}
# Postal codes at the end of a part, by country; the last is for all others.
POSTAL = {
    "CA": r"(?i)(?<![A-Z0-9])([ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z][ -]?\d[ABCEGHJ-NPRSTV-Z]\d)$",
    "GB": r"(?i)(?<![A-Z0-9])(GIR ?0AA|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})$",
    "US": r"(?<!\d)(\d{5}(?:-\d{4})?)$",
    "": r"(?i)(?<![A-Z0-9])([A-Z]{0,2}\d[A-Z0-9-]*(?:[ -][A-Z0-9]{2,4})?)$",
}
# Short forms in addresses of a block.
SHORT = {"South": "S", "North": "N", "East": "E", "West": "W", "Avenue": "Ave", "Street": "St", "Boulevard": "Blvd", "Road": "Rd"}
_HOUSE = r"^\d+[A-Za-z]?(?:-\d+)?\s+\S"
_BLOCK = r"(?i)(\d+)\s+block\s+of\s+"
_BETWEEN = r"(?i)^(.+?)\s+between\s+(.+?)\s+and\s+(.+)$"
_FROM = r"(?i)^(.+?)\s+from\s+(.+?)\s+to\s+(.+)$"
_TO = r"(?i)^(.+?)\s+(.+?)\s+to\s+(.+)$"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def _last(parts: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(parts), F.lit(-1)), F.lit(""))


def _without(parts: str, gone: Column) -> Column:
    return F.when(gone, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.col(parts))


def located(rows: DataFrame, location: str = "location", kind: str = "kind", *, countries: dict[str, str] = COUNTRIES) -> DataFrame:
    """`rows` with `components`, a struct of name, street, span_start, span_end, address, neighborhood, city, county,
    state, state_code, country and postal_code.

    The kind is one of address, intersection_road, intersection_highway, street_road, span, place, neighborhood, region_city,
    county, city, state, country, natural or another region; natural places and regions get no country that isn't named,
    all others default to the United States. States are those of the United States. A last part of up to three letters
    is a state before it is a country, and so is any of kind state. A span's ends stand behind `between`, else behind `from`, else behind the first word. Fields without a value, and those of null and
    empty locations, are empty texts. Narrow: nothing is shuffled. Columns that start with `__at_` must not exist.
    """
    text, sort = F.coalesce(F.col(location).cast("string"), F.lit("")), F.coalesce(F.col(kind).cast("string"), F.lit(""))
    short = F.regexp_replace("__at_head", _BLOCK, "$1 ")
    for word, form in SHORT.items():
        short = F.regexp_replace(short, rf"(?i)\b{word}\b", form)
    codes = {**{code: code for code in STATES}, **{name: code for code, name in STATES.items()}}
    as_state = F.upper(F.coalesce(F.try_element_at(_map(codes), F.trim(F.regexp_replace(F.lower(F.replace(_last("__at_p"), F.lit("."), F.lit(""))), r"[\s-]+", " "))), F.lit("")))
    k, n = F.col("__at_kind"), F.size("__at_p")
    free = (k == "natural") | k.startswith("region")
    out = rows.withColumns({"__at_kind": sort, "__at_p": F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")})
    out = out.withColumn("__at_head", F.coalesce(F.try_element_at("__at_p", F.lit(1)), F.lit("")))
    out = out.withColumn("__at_head", F.when(F.col("__at_head").rlike(_BLOCK), short).otherwise(F.col("__at_head")))
    out = out.withColumn("__at_p", F.when(n > 0, F.concat(F.array("__at_head"), F.slice("__at_p", F.lit(2), n))).otherwise(F.col("__at_p")))
    out = out.withColumns({"__at_named": F.coalesce(F.try_element_at(_map(countries), F.lower(_last("__at_p"))), F.lit("")), "__at_state": as_state})
    rather = (F.col("__at_state") != "") & ((k == "state") | ((k != "country") & (F.length(_last("__at_p")) <= 3)))
    out = out.withColumn("__at_country", F.when(rather, "").otherwise(F.col("__at_named")))
    out = out.withColumn("__at_p", F.when(k == "country", F.slice("__at_p", 1, 0)).otherwise(_without("__at_p", F.col("__at_country") != "")))
    # postal code: the form of the country, or the first that fits
    found = {c: F.regexp_extract(_last("__at_p"), p, 1) for c, p in POSTAL.items()}
    known = F.when(F.col("__at_country") == "", "").otherwise(F.col("__at_country"))
    of = F.when(known.isin(*(c for c in POSTAL if c)), known)
    for c in ("CA", "GB", "US"):
        of = of.when((known == "") & (found[c] != ""), c)
    out = out.withColumn("__at_form", of.otherwise(""))
    code = F.lit("")
    for c in POSTAL:
        code = F.when(F.col("__at_form") == c, found[c]).otherwise(code)
    out = out.withColumn("__at_code", code)
    rest = F.regexp_replace(F.substring(_last("__at_p"), F.lit(1), F.length(_last("__at_p")) - F.length("__at_code")), r"[ ,]+$", "")
    ahead = _without("__at_p", F.lit(True))
    out = out.withColumn("__at_p", F.when(F.col("__at_code") == "", F.col("__at_p")).when(rest == "", ahead).otherwise(F.concat(ahead, F.array(rest))))
    out = out.withColumn("__at_country", F.when((F.col("__at_country") == "") & (F.col("__at_code") != ""), F.col("__at_form")).otherwise(F.col("__at_country")))
    out = out.withColumn("__at_state", F.when(((k == "state") | (n >= 2)) & F.col("__at_country").isin("", "US"), as_state).otherwise(""))
    out = out.withColumn("__at_p", _without("__at_p", F.col("__at_state") != ""))
    out = out.withColumn("__at_county", F.when(_last("__at_p").rlike(r"(?i)\bcounty\b"), _last("__at_p")).otherwise(""))
    out = out.withColumn("__at_p", _without("__at_p", F.col("__at_county") != ""))
    takes = (n >= 1) & (~free | (n >= 2))
    out = out.withColumns({"__at_city": F.when(takes, _last("__at_p")).otherwise(""), "__at_p": _without("__at_p", takes)})
    us = (F.col("__at_country") == "") & ((F.col("__at_state") != "") | ~free)
    out = out.withColumn("__at_country", F.when((k == "country") | ~us, F.when(k == "country", F.col("__at_named")).otherwise(F.col("__at_country"))).otherwise("US"))
    first = F.coalesce(F.try_element_at("__at_p", F.lit(1)), F.col("__at_head"))
    out = out.withColumn("__at_first", F.when(k == "country", "").otherwise(first))
    first, where = F.col("__at_first"), F.concat_ws(", ", F.when(F.col("__at_city") != "", F.col("__at_city")), F.when(F.col("__at_state") != "", F.col("__at_state")))
    # the ends of a span are crossings in the city
    ends = F.when(F.lit(False), F.array(F.lit("")))
    for form in (_BETWEEN, _FROM, _TO):
        ends = ends.when(first.rlike(form), F.array(*(F.regexp_extract(first, form, g) for g in (2, 3))))
    out = out.withColumns({"__at_where": where, "__at_ends": F.when(k == "span", F.transform(ends, lambda e: F.regexp_replace(e, r"^[ ,.]+|[ ,.]+$", "")))})
    end = lambda i: F.when(F.col("__at_ends").isNull(), "").when((F.col("__at_where") == "") | F.contains(F.lower(F.col("__at_ends")[i]), F.lower("__at_where")), F.col("__at_ends")[i]).otherwise(F.concat_ws(", ", F.col("__at_ends")[i], "__at_where"))
    # the address of a place: the first part behind its name, or text in parentheses, that starts with a house number
    inside = F.regexp_extract_all(first, F.lit(r"\(([^)]+)\)"), F.lit(1))
    house = F.filter(F.concat(F.slice("__at_p", F.lit(2), F.greatest(F.size("__at_p"), F.lit(1))), F.transform(inside, lambda p: F.trim(p))), lambda x: x.rlike(_HOUSE))
    name = F.trim(F.regexp_replace(F.regexp_replace(first, r"\(\s*\d+[A-Za-z]?(?:-\d+)?\s+[^)]*\)", ""), r"\s{2,}", " "))
    address = F.when(k == "place", F.coalesce(F.try_element_at(house, F.lit(1)), F.lit(""))).when(k.isin("address", "street_road") | (k.startswith("intersection") & first.rlike(_HOUSE)), first).otherwise("")
    in_city = F.when(k == "city", first).when(k.isin("state", "country"), "").otherwise(F.col("__at_city"))
    county = F.when((F.col("__at_county") == "") & (k == "county"), F.concat(first, F.lit(" County"))).otherwise(F.col("__at_county"))
    state = F.when(k == "country", "").otherwise(F.col("__at_state"))
    fields = {
        "name": F.when(k == "place", F.when(name == "", first).otherwise(name)).otherwise(""), "street": F.when(k.isin("street_road", "span"), first).otherwise(""), "span_start": end(0), "span_end": end(1),
        "address": address, "neighborhood": F.when(k.isin("neighborhood", "region_city"), first).otherwise(""), "city": in_city, "county": county,
        "state": F.initcap(F.coalesce(F.try_element_at(_map(STATES), F.lower(state)), F.lit(""))), "state_code": state, "country": F.col("__at_country"), "postal_code": F.upper("__at_code"),
    }
    out = out.withColumn("components", F.struct(*(v.alias(c) for c, v in fields.items())))
    return out.select(*rows.columns, "components")
