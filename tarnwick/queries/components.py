"""Location strings of several forms to components; a number that ends the city of a foreign country is read as its postal code."""

from __future__ import annotations

from tarnwick.operators.components import located
from tarnwick.queries import query
from tarnwick.session import table

_N = "cast(c_custkey as string)"
_LOCATION = f"""case c_custkey % 8
  when 0 then concat({_N}, ' Main St, Springfield, IL 62701') when 1 then concat('Oak Ave between 1st St and ', {_N}, 'th St, Chicago, IL')
  when 2 then concat('Museum ', {_N}, ' (', {_N}, ' Elm St), Boston, MA, USA') when 3 then concat('Soho ', {_N}, ', London W1D 3QF, UK')
  when 4 then concat('Cook ', {_N}, ', Illinois') when 5 then concat({_N}, ' block of South Hermitage Avenue, Chicago, IL')
  when 6 then concat('Town ', {_N}, ', Georgia') end"""
_KIND = "case c_custkey % 8 when 0 then 'address' when 1 then 'span' when 2 then 'place' when 3 then 'neighborhood' when 4 then 'county' when 5 then 'address' when 6 then 'city' end"


@query("""
with c as (select c_custkey, cast(c_custkey as varchar) as n, c_custkey % 8 as k from customer)
select c_custkey, case k when 2 then 'Museum ' || n else '' end as name,
  case k when 1 then 'Oak Ave between 1st St and ' || n || 'th St' else '' end as street,
  case k when 1 then '1st St, Chicago, IL' else '' end as span_start, case k when 1 then n || 'th St, Chicago, IL' else '' end as span_end,
  case k when 0 then n || ' Main St' when 2 then n || ' Elm St' when 5 then n || ' S Hermitage Ave' else '' end as address,
  case k when 3 then 'Soho ' || n else '' end as neighborhood,
  case k when 0 then 'Springfield' when 1 then 'Chicago' when 2 then 'Boston' when 3 then 'London' when 4 then 'Cook ' || n when 5 then 'Chicago' when 6 then 'Town ' || n else '' end as city,
  case k when 4 then 'Cook ' || n || ' County' else '' end as county,
  case when k in (0, 1, 4, 5) then 'Illinois' when k = 2 then 'Massachusetts' else '' end as state,
  case when k in (0, 1, 4, 5) then 'IL' when k = 2 then 'MA' else '' end as state_code,
  case k when 3 then 'GB' when 6 then 'GE' else 'US' end as country,
  case k when 0 then '62701' when 3 then 'W1D 3QF' when 6 then n else '' end as postal_code
from c
""")
def location_components(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LOCATION} as location", f"{_KIND} as kind")
    return located(rows).select("c_custkey", "components.*")
