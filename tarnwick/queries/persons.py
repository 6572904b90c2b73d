"""People of compatible given names: pairs of identities, recall of a catalog."""

from itertools import chain

from tarnwick.functions.persons import GIVEN_CLASSES
from tarnwick.operators import persons as p
from tarnwick.queries import query
from tarnwick.session import table

_GIVEN = [*chain.from_iterable(GIVEN_CLASSES), "al", "ann", "anna", "jo", "lee"]
_N = len(_GIVEN)
_LIST = ", ".join(f"'{g}'" for g in _GIVEN)
_CLASSES = "c as (select * from (values " + ", ".join(f"('{n}', {i})" for i, c in enumerate(GIVEN_CLASSES) for n in c) + ") t(name, class))"
_FAMILY = "translate(cast({} % 7 as varchar(9)), '0123456', 'abcdefg') || 'son'"
_PEOPLE = f"people as (select [{_LIST}][c_custkey % {_N} + 1] as given, {_FAMILY.format(f'(c_custkey // {_N})')} as family, given || case c_custkey % 2 when 0 then ' q. ' else ' ' end || family as label from customer)"
_COMPATIBLE = "(a.given = b.given or a.class = b.class or starts_with(a.given, b.given) or starts_with(b.given, a.given))"


def _people(spark, sf_dir):
    given = f"element_at(array({_LIST}), cast(c_custkey % {_N} + 1 as int))"
    family = _FAMILY.format(f"(c_custkey div {_N})")
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"initcap({given}) || case c_custkey % 2 when 0 then ' Q. ' else ' ' end || {family} as label")


@query(f"with {_PEOPLE}, {_CLASSES}, k as (select distinct family, given, class from people left join c on given = name) select a.family, a.given as a, b.given as b from k a join k b on a.family = b.family and a.given < b.given where {_COMPATIBLE}")
def compatible_names(spark, sf_dir):
    return p.pairs(_people(spark, sf_dir), "label")


@query(
    f"with {_PEOPLE}, {_CLASSES}, a as (select distinct label, family, given, class from people left join c on given = name), s as (select s_suppkey as canonical, [{_LIST}][s_suppkey * 7 % {_N} + 1] as given, {_FAMILY.format('s_suppkey')} as family from supplier),"
    " b as (select s.*, class, given || ' ' || family as label from s left join c on given = name)"
    " select upper(a.label) as label, canonical, cast(105 + case when a.label = b.label then 100 when contains(a.label, b.label) or contains(b.label, a.label) then 40 else 0 end as integer) as score"
    f" from a join b on a.family = b.family where {_COMPATIBLE}"
)
def nickname_recall(spark, sf_dir):
    catalog = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"upper(element_at(array({_LIST}), cast(s_suppkey * 7 % {_N} + 1 as int))) || ' ' || {_FAMILY.format('s_suppkey')} as s_label")
    return p.recall(_people(spark, sf_dir), "label", catalog, "s_suppkey", "s_label").selectExpr("upper(label) as label", "canonical", "score")
