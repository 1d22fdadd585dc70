"""The registered queries as plain SQL over the driver's tables.

Written apart from the DataFrame code: window counts, semi-joins and self-joins where the
engine aggregates, so that agreement means something.
"""

from __future__ import annotations

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

# The codes that the model names, by p_partkey % 40; the first eight have texts
# entered by hand.
_NAMED = """(values
  (0, 'HS', '11364', 'M'), (1, 'HS', '11377', 'M'), (2, 'VC', '12500(A)', 'I'),
  (3, 'PC', '484(A)&490.2', 'M'), (4, 'PC', '594(A)', 'M'), (5, 'VC', '16028(A)', 'I'),
  (6, 'HS', '11350', 'M'), (7, 'HS', '11377', 'F'), (8, 'HS', '11550(A)', 'M'),
  (9, 'VC', '23152(A)', 'M'), (10, 'VC', '14601.1(A)', 'M'), (11, 'PC', '485&490.2', 'M'),
  (12, 'PC', '422', 'F'), (13, 'PC', '592.2', 'M'), (14, 'PC', '485', 'M'), (15, 'PC', '490.2', 'M'),
  (16, 'PC', '245(A)(4)', 'F'))"""

# Texts entered by hand, and the short texts of the diversion figure.
_HAND_ENTERED = """(values
  ('HS_11364_M', 'misd. paraphernalia -- HS_11364_M'),
  ('HS_11377_M', 'misd. cont. sub. poss. -- HS_11377_M'),
  ('VC_12500(A)_I', 'infr. drive w/o license -- VC_12500(A)_I'),
  ('PC_484(A)&490.2_M', 'misd. petty theft: - $950 -- PC_484(A)&490.2_M'),
  ('PC_594(A)_M', 'misd. vandalism property -- PC_594(A)_M'),
  ('VC_16028(A)_I', 'infr. driving w/o insurance -- VC_16028(A)_I'),
  ('HS_11350_M', 'broadly misd. possession (narcotic, MECLOQUALONE/METHAQUALONE/ETC) -- HS_11350_M'),
  ('HS_11377_F', 'fel. possess controlled subst. HS_11377_F'))"""
_SHORT_TEXTS = """(values
  ('misd. cont. sub. poss. -- HS_11377_M', concat('Possess controlled substance ', chr(10), ' HS 11377')),
  ('misd. paraphernalia -- HS_11364_M', concat('Paraphernalia possession ', chr(10), ' HS 11364')),
  ('broadly misd. possession (narcotic, MECLOQUALONE/METHAQUALONE/ETC) -- HS_11350_M',
   concat('Possess narcotic ', chr(10), ' HS 11350')),
  ('use/under influence of controlled substance -- HS_11550(A)_M',
   concat('Use of a controlled substance ', chr(10), ' HS 11550(a)')),
  ('dui alcohol -- VC_23152(A)_M', concat('DUI ', chr(10), ' VC 23152(a)')))"""

# Fixed values in it: plea codes and texts, result texts, part names, texts of two codes.
_BASE = f"""
with named(k, code, section, level) as (select * from {_NAMED}),
parts as (
  select p_partkey, p_name, coalesce(n.code, p_type) as p_code,
    coalesce(n.section, concat(cast(p_size % 5 as varchar), '(',
      substr('ABC', cast(p_partkey % 3 as int) + 1, 1), ')')) as p_section,
    coalesce(n.level, case when p_size <= 30 then 'M' when p_size <= 46 then 'F' else 'I' end) as p_level
  from part left join named n on p_partkey % 40 = n.k),
raw as (
  select {_ORDER},
    case l_orderkey % 5 when 0 then 'part1' when 1 then 'part3' when 2 then 'part4'
                        when 3 then 'part5' else 'part6' end as part_tag,
    cast(l_orderkey as varchar) as masked_case_no,
    cast(l_suppkey % 2 + 1 as varchar) as defendant_no,
    case when o_orderstatus = 'F' then 'F' else 'M' end as case_level,
    cast(case when o_custkey % 97 = 0 then null else 5 + o_custkey % 90 end as integer)
      as age_at_time_of_crime,
    case when p_partkey % 397 = 0 then null else p_level end as charge_level,
    case when p_partkey % 211 = 0 then null else p_code end as code,
    p_section as section,
    case o_custkey % 3 when 0 then 'M' when 1 then 'F' end as sex,
    case when l_orderkey % 5 <> 0 then 'criminal' end as case_type,
    case when l_orderkey % 5 = 0 then 'motion' end as case_category_description,
    cast(l_linenumber as integer) as count_no,
    concat(l_returnflag, l_linestatus) as result, cast(l_shipdate as timestamp) as result_date,
    case (l_linenumber + l_partkey) % 9 when 0 then 'DA' when 1 then 'IN' when 2 then 'NC'
      when 3 then 'NE' when 4 then 'NG' when 5 then 'NI' when 6 then 'PG' when 7 then 'XX' end as plea,
    case when l_returnflag = 'R' then 'Dismissed'
         when l_returnflag = 'A' and l_linestatus = 'F' then 'Convicted'
         when l_returnflag = 'A' then 'Held To Answer in Superior Court'
         when l_quantity <= 2 then 'Diversion'
         when l_quantity <= 10 then null else 'Acquitted' end as result_description,
    case when l_linenumber = 7 then 'CITY' end as charge_city,
    case when o_custkey % 5 < 2 then null
         else concat(cast(90000 + o_custkey % 1000 as varchar), '-1234') end as full_zip
  from lineitem join orders on l_orderkey = o_orderkey join parts on l_partkey = p_partkey),
keyed as (
  select *, concat(coalesce(code, 'NA'), '_', section) as code_section,
    concat(substr(part_tag, 5, 1), '_', masked_case_no) as case_id,
    concat(substr(part_tag, 5, 1), '_', masked_case_no, '_', defendant_no) as person_id,
    substr(full_zip, 1, 5) as minor_zip_code,
    case part_tag when 'part1' then 'juvenile_motion_to_transfer'
      when 'part3' then 'juvenile_misdemeanors' when 'part4' then 'juvenile_felonies'
      when 'part5' then 'adult_misdemeanors' else 'adult_felonies' end as data_part,
    -- fixed values: plea texts
    case plea when 'DA' then 'Denies allegations' when 'IN' then 'Not guilty by reason of insanity'
      when 'NC' then 'Nolo contendere' when 'NE' then 'Not guilty entered by court'
      when 'NG' then 'Not guilty' when 'NI' then 'Not guilty and not guilty by reason of insanity'
      when 'PG' then 'Plead guilty' else plea end as plea_description,
    case when age_at_time_of_crime between 11 and 17 then 'minor_11-17'
         when age_at_time_of_crime between 18 and 25 then 'young_adult_18-25'
         when age_at_time_of_crime between 26 and 90 then 'adult_26-90'
         else 'other_or_missing' end as age_group
  from raw),
all_untagged as (
  select *, concat(coalesce(charge_level, 'NA'), '_', code_section) as code_section_m_f,
    concat(person_id, '_', code_section) as charge_id,
    concat(code_section, '_', coalesce(charge_level, 'NA')) as key
  from keyed),
wobblers(charge) as (values ('PROMO_0(A)'), ('LARGE_1(B)'), ('SMALL_3(C)'), ('NA_2(A)')),
serious(code_section) as (values ('F_PROMO_0(A)'), ('F_STANDARD_2(B)'), ('F_ECONOMY_4(C)')),
rules(charge, include, match_type) as (values
  ('PROMO_1(A)', 'Include', 'Exact'), ('SMALL_2(C)', 'Include', 'Exact'),
  ('SMALL_2', 'Include', 'Partial'), ('STANDARD_.', 'Include', 'Partial'),
  ('LARGE_3(B)', 'Include', 'Partial'), ('SMALL_2(C)', 'Exclude', 'Exact'),
  ('STANDARD_4', 'Exclude', 'Partial'), ('STANDARD_0(A)', 'Exclude', 'Partial')),
code_tags as (
  select code_section,
    (exists (select 1 from rules r where r.include = 'Include' and
        (r.match_type = 'Exact' and r.charge = c.code_section
         or r.match_type = 'Partial' and regexp_matches(c.code_section, r.charge)))
      -- fixed values: the added patterns and code
      or regexp_matches(c.code_section, '14601|485|422|592.2|490.2')
      or c.code_section = 'PC_485&490.2')
    and not exists (select 1 from rules r where r.include = 'Exclude' and
        (r.match_type = 'Exact' and r.charge = c.code_section
         or r.match_type = 'Partial' and regexp_matches(c.code_section, r.charge))) as low_level,
    code_section in (select charge from wobblers) as wobbler
  from (select distinct code_section from all_untagged) c),
all_charges as (
  select a.*, t.low_level, t.wobbler,
    a.code_section_m_f in (select s.code_section from serious s) as svf
  from all_untagged a join code_tags t on a.code_section = t.code_section),
counted as (
  select *, count(*) over (partition by charge_id) as charge_rows,
    count(*) filter (where result_description = 'Held To Answer in Superior Court')
      over (partition by charge_id) as interim_rows
  from all_charges),
charges as (
  select * from counted
  where not (coalesce(result_description = 'Held To Answer in Superior Court', false)
             and charge_rows > 1)),
code_table as (
  select min(p_partkey) as row_order,
    concat(p_code, '_', p_section, '_', p_level) as key,
    case p_section when '11550(A)' then 'use/under influence of controlled substance'
      when '23152(A)' then 'dui alcohol' else lower(p_name) end as text
  from parts where p_partkey % 40 >= 8 group by 2, 3),
texts as (
  select key, concat(string_agg(text, ' and/or ' order by row_order), ' -- ', key) as text
  from code_table group by key),
offences as (
  select c.key, coalesce(h.text, t.text, c.key) as offense_description
  from (select distinct key from all_charges) c left join texts t on c.key = t.key
  left join {_HAND_ENTERED} h(key, text) on c.key = h.key),
described as (
  select c.*, o.offense_description from charges c join offences o on c.key = o.key),
persons as (
  select person_id, count(*) as num_charges,
    count(*) filter (where result_description = 'Diversion') as diverted,
    count(*) filter (where result_description = 'Dismissed') as dismissed,
    count(*) filter (where result_description is null) as missing
  from charges group by person_id),
case_firsts as (
  select case_id, case_level from (
    select case_id, case_level,
      row_number() over (partition by case_id order by {_ORDER}) as rn from charges)
  where rn = 1)
"""

_TOTAL = "(select count(*) from charges)"

_DECLINABLE_CODE = """(contains(code_section, 'PROMO_1') or contains(code_section, 'LARGE_0')
  or contains(code_section, 'SMALL_3') or code_section_m_f = 'M_ECONOMY_4(A)')"""

_TARGETS = "('M_PROMO_1(A)', 'M_SMALL_2(C)', 'M_LARGE_0(B)')"


def _freq(key: str, source: str = "charges", where: str = "true") -> str:
    return f"""select {key}, count(*) as n, count(*) / sum(count(*)) over () * 100 as pct
from {source} where {where} group by {key}"""


def _share(condition: str) -> str:
    return f"select count(*) filter (where {condition}) / count(*) as share from charges"


def _percent_text(n: str, total: str) -> str:
    tenths = f"((2000 * {n} + {total}) // (2 * {total}))"
    return f"concat(cast({tenths} // 10 as varchar), '.', cast({tenths} % 10 as varchar))"


def _label(n: str, total: str, noun: str) -> str:
    return f"""concat({_percent_text(n, total)}, '% ', chr(10), ' (',
    format('{{:,}}', cast({n} as bigint)), ' {noun}) ')"""


_TYPES = """types as (
  select 1 as sort_order, 'felonies' as type, 'Felonies' as label, 'A' as colour_group,
    count(*) filter (where charge_level = 'F') as n, count(*) as total from charges
  union all
  select 2, 'misdemeanors', 'Misdemeanors', 'A',
    count(*) filter (where charge_level = 'M'), count(*) from charges
  union all
  select 3, 'infractions', 'Infractions', 'A',
    count(*) filter (where charge_level = 'I'), count(*) from charges
  union all
  select 4, 'serious_or_violent', concat('Serious or Violent Felonies ', chr(10), ' (adults only)'),
    'B', count(*) filter (where svf), count(*) from charges where part_tag in ('part5', 'part6')
  union all
  select 5, 'low_level', concat('Decline to charge or ', chr(10), ' pre-plea diversion  '), 'B',
    count(*) filter (where low_level), count(*) from charges)"""

_OUTCOMES = """outcomes as (
  select result_simple, count(*) as n, count(*) / sum(count(*)) over () * 100 as pct,
    case when result_simple = 'Dismissed' then 1 when result_simple = 'Convicted' then 2
         when result_simple = 'Other' then 3 when result_simple = 'Diversion' then 5 else 4 end
      as sort_order
  from (select case when result_description in ('Dismissed', 'Convicted', 'Diversion')
                    then result_description
                    when result_description = 'Held To Answer in Superior Court'
                    then concat('Held To Answer ', chr(10), ' in Superior Court')
                    else 'Other' end as result_simple from charges)
  group by result_simple)"""

_DIVERTED = f"""diverted_offences as (
  select coalesce(s.short, offense_description) as offense_description, diverted, total,
    diverted / total as pct_diverted
  from (select offense_description, count(*) as diverted from described
        where result_description = 'Diversion' group by offense_description)
  join (select offense_description, count(*) as total from described group by offense_description)
    using (offense_description)
  left join {_SHORT_TEXTS} s(long, short) on offense_description = s.long
  order by diverted desc, coalesce(s.long, offense_description) limit 5)"""


_MANY_RULES = """, many(charge, include) as (
  select case when k = 4990 then '^[A-Z]{5}_[0-9][(]C[)]$'
      when k % 3 = 0 then concat('^', place)
      when k % 3 = 1 then concat('(?:x|y)?', place, '[)]*')
      else concat(place, '|no such code', cast(k as varchar)) end,
    case when k % 7 = 0 then 'Exclude' else 'Include' end
  from (select k, concat(list_extract(['ECONOMY', 'LARGE', 'PROMO', 'SMALL', 'STANDARD'], k % 5 + 1), '_',
      cast(k // 5 % 5 as varchar), '[(]', substr('ABC', cast(k // 25 % 3 + 1 as int), 1),
      case when k < 90 then '' else concat('rule', cast(k as varchar)) end) as place
    from range(5000) r(k)))
select code_section, n,
  (exists (select 1 from many where include = 'Include' and regexp_matches(c.code_section, charge))
   or regexp_matches(c.code_section, '14601|485|422|592.2|490.2') or c.code_section = 'PC_485&490.2')
  and not exists (select 1 from many where include = 'Exclude' and regexp_matches(c.code_section, charge))
    as low_level
from (select code_section, count(*) as n from all_charges group by code_section) c"""


def _rule_tags(partial: str) -> str:
    return f"""select code_section, n,
  (exists (select 1 from rules r where r.include = 'Include' and
     (r.match_type = 'Exact' and r.charge = c.code_section
      or r.match_type = 'Partial' and {partial}))
   or regexp_matches(c.code_section, '14601|485|422|592.2|490.2') or c.code_section = 'PC_485&490.2')
  and not exists (select 1 from rules r where r.include = 'Exclude' and
     (r.match_type = 'Exact' and r.charge = c.code_section
      or r.match_type = 'Partial' and {partial})) as low_level
from (select code_section, count(*) as n from all_charges group by code_section) c"""


_REMAINING = "l_orderkey, l_linenumber, l_partkey, l_suppkey, charge_id, result_description"

_SELECTS: dict[str, str] = {
    "charge_count": "select count(*) as n from charges",
    "share_by_level": _share("charge_level = 'M'"),
    "share_low_level": _share("low_level"),
    "share_svf": _share("svf"),
    "share_dismissed": _share("result_description = 'Dismissed'"),
    "share_diverted": _share("result_description = 'Diversion'"),
    "missing_rates": """select
  count(*) filter (where charge_city is null) / count(*) as charge_city_missing,
  count(*) filter (where minor_zip_code is null) / count(*) as minor_zip_code_missing
from charges""",
    "figure1_types": f", {_TYPES} select *, n / total as pct from types",
    "low_level_mix": _freq("charge_level", where="low_level"),
    "wobbler_level_mix": _freq("charge_level", where="wobbler"),
    "pattern_level_mix": _freq("charge_level", where="regexp_matches(code_section, 'SMALL_2')"),
    "exact_level_mix": _freq("charge_level", where="code_section = 'PROMO_0(A)'"),
    "low_level_freq": _freq("low_level"),
    "low_level_results": _freq("result_description", where="low_level"),
    "result_freq": _freq("result_description"),
    "results_top6": _freq("result_description")
    + " order by n desc, result_description nulls last limit 6",
    "top10_low_level": f"""select offense_description, count(*) as n,
  count(*) / {_TOTAL} * 100 as pct_chrgs
from described where low_level group by offense_description
order by n desc, offense_description limit 10""",
    "results_within_level": """select charge_level, result_description, count(*) as n,
  count(*) / sum(count(*)) over (partition by charge_level) * 100 as pct
from charges group by charge_level, result_description""",
    "dismissed_within_level": """select * from (
  select charge_level, result_description, count(*) as n,
    count(*) / sum(count(*)) over (partition by charge_level) * 100 as pct
  from charges group by charge_level, result_description)
where result_description = 'Dismissed'""",
    "all_dismissed_persons": """select
  count(*) filter (where missing = 0 and dismissed = num_charges) as persons,
  count(*) filter (where missing = 0 and dismissed = num_charges) / count(*) as share
from persons""",
    "half_dismissed_persons": """select
  count(*) filter (where missing = 0 and 2 * dismissed >= num_charges) as persons,
  count(*) filter (where missing = 0 and 2 * dismissed >= num_charges) / count(*) as share
from persons""",
    "top10_dismissed_of_top50": """select code_section_m_f, result_description, n, pct from (
  select code_section_m_f, result_description, count(*) as n,
    count(*) / sum(count(*)) over (partition by code_section_m_f) as pct
  from charges group by code_section_m_f, result_description)
where result_description = 'Dismissed' and code_section_m_f in (
  select code_section_m_f from charges group by code_section_m_f
  order by count(*) desc, code_section_m_f limit 50)
order by pct desc, code_section_m_f limit 10""",
    "case_severity": """, wide as (
  select count(*) filter (where case_level = 'F') as f,
    count(*) filter (where case_level = 'M') as m, count(*) as n from case_firsts)
select 'felonies' as type, f / n as pct from wide
union all select 'misdemeanors', m / n from wide
union all select 'n', cast(n as double) from wide""",
    "misd_cases": "select count(*) as n from case_firsts where case_level = 'M'",
    "misd_defendants": f"""select count(*) as n from (
  select case_level, row_number() over (partition by case_id, defendant_no order by {_ORDER}) as rn
  from charges) where rn = 1 and case_level = 'M'""",
    "top3_misd": _freq("offense_description", "described", "charge_level = 'M'")
    + " order by n desc, offense_description limit 3",
    "top3_misd_pct_total": """select
  cast(sum(n) as bigint) / (select count(*) from charges where charge_level = 'M') * 100 as pct_total
from (select count(*) as n from described where charge_level = 'M'
      group by offense_description order by n desc limit 3)""",
    "target_share_distribution": f"""select target_share, pct from (
  select target_share, count(*) as n, count(*) / sum(count(*)) over () * 100 as pct
  from (select person_id,
          count(*) filter (where code_section_m_f in {_TARGETS}) / count(*) as target_share
        from charges
        where person_id in (select person_id from charges where code_section_m_f in {_TARGETS})
        group by person_id)
  group by target_share)
order by n desc, target_share limit 2""",
    "rank_22_23": f"""select offense_description, n, pct from (
  select *, row_number() over (order by n desc, offense_description) as rn
  from ({_freq("offense_description", "described")}))
where rn between 22 and 23""",
    "text_match_count": """select count(*) as n from described
where regexp_matches(offense_description, 'ring')""",
    "declinable_total": f"""select count(*) as num_charges,
  count(*) / {_TOTAL} as pct_of_all_charges
from charges where charge_level <> 'F' and {_DECLINABLE_CODE}""",
    "declinable_results": _freq(
        "result_description", where=f"charge_level <> 'F' and {_DECLINABLE_CODE}"
    )
    + " order by n desc, result_description nulls last limit 5",
    "only_declinable_persons": f"""select count(*) as n from (
  select person_id from charges
  where person_id in (select person_id from charges
                      where charge_level <> 'F' and {_DECLINABLE_CODE})
  group by person_id having count(*) filter (where {_DECLINABLE_CODE}) = count(*))""",
    "folded_results": f", {_OUTCOMES} select * from outcomes",
    "any_diverted_persons": """select
  count(distinct person_id) filter (where result_description = 'Diversion')
    / count(distinct person_id) as share,
  count(distinct person_id) filter (where result_description = 'Diversion') as diverted_persons,
  count(distinct person_id) as persons
from charges""",
    "any_diverted_persons_pre_dedup": """select
  (select count(*) from persons where diverted > 0) / count(distinct person_id) as share
from all_charges""",
    "one_diverted_persons": """, total as (select count(distinct person_id) as persons from all_charges),
hits as (select count(*) filter (where diverted = 1) as one_diverted,
    count(*) filter (where diverted = num_charges) as all_diverted from persons)
select one_diverted, one_diverted / persons as one_diverted_share,
  all_diverted, all_diverted / persons as all_diverted_share
from hits, total""",
    "top5_diverted_rate": f", {_DIVERTED} select * from diverted_offences",
    "external_ratio": "select 971 / count(distinct person_id) as share from charges",
    "low_level_code_string": f"""select string_agg(code_section_m_f, ' -- ' order by rn) as code_section_m_f
from (select code_section_m_f, min(rn) as rn from (
        select code_section_m_f, row_number() over (order by {_ORDER}) as rn
        from charges where low_level)
      group by code_section_m_f)""",
    "figure_labels": f""", {_TYPES}, {_OUTCOMES}, {_DIVERTED},
cases as (
  select 'felonies' as category, 'F' as level union all select 'misdemeanors', 'M')
select 'charge_types' as figure, label as category, {_label("n", "total", "charges")} as bar_label
from types
union all
select 'case_severity', category, {_label("n", "total", "cases")} from (
  select category, (select count(*) from case_firsts where case_level = level) as n,
    (select count(*) from case_firsts) as total from cases)
union all
select 'outcomes', result_simple, {_label("n", "(select count(*) from charges)", "charges")}
from outcomes
union all
select 'diverted_offences', offense_description,
  concat({_percent_text("diverted", "total")}, '% (', cast(diverted as varchar), ' diverted)')
from diverted_offences""",
    "parts_reconciled": """, part_order(data_part, place) as (
  values ('juvenile_misdemeanors', 1), ('juvenile_felonies', 2), ('adult_misdemeanors', 3),
    ('adult_felonies', 4), ('juvenile_motion_to_transfer', 5)),
numbered as (select data_part, row_number() over (order by place, l_orderkey) as rn from all_charges join part_order using (data_part)),
kept as (select data_part, count(*) as n from charges group by data_part)
select p.data_part, coalesce(count(rn), 0) as rows_in, coalesce(count(rn), 0) as rows_out, coalesce(max(n), 0) as rows_kept,
  min(rn) as first_number, max(rn) as last_number, true as complete
from part_order p left join numbered using (data_part) left join kept using (data_part) group by p.data_part""",
    "union_parts": """select part_tag as data_part, masked_case_no, defendant_no,
  case when part_tag = 'part1' then null else 'criminal' end as case_type,
  case when part_tag = 'part1' then 'F' else case_level end as case_level,
  case when part_tag = 'part1' then 'F' else charge_level end as charge_level,
  code, section, plea, result_description,
  case when part_tag = 'part1' then null else charge_city end as charge_city,
  full_zip as minor_zip_code, cast(null as varchar) as case_category_description
from all_charges""",
    "row_ids": f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, charge_id, rn as row_order,
  printf('%06d', rn) as unique_id
from (select *, row_number() over (order by {_ORDER}) as rn from all_charges)""",
    "composite_ids": """select code_section, code_section_m_f, charge_id, person_id, case_id,
  minor_zip_code from all_charges""",
    "person_counts": """select count(distinct person_id) as persons,
  (select count(distinct person_id) from all_charges) as persons_before_removal
from charges""",
    "distinct_codes": """select
  count(distinct code) + max(case when code is null then 1 else 0 end) as codes
from all_charges""",
    "age_bands": _freq("age_at_time_of_crime, age_group", "all_charges"),
    "relabel_parts": """select data_part, plea, plea_description, count(*) as n,
  count(*) / sum(count(*)) over (partition by data_part) * 100 as pct
from all_charges group by data_part, plea, plea_description""",
    "exact_tags": """select code_section, charge_level, wobbler, svf, count(*) as n
from charges group by all""",
    "rule_tags_regex": _rule_tags("regexp_matches(c.code_section, r.charge)"),
    "rule_tags_literal": _rule_tags("contains(c.code_section, r.charge)"),
    "rule_tags_many": _MANY_RULES,
    "code_dictionary": "select key, text as offense_description from texts",
    "enriched_descriptions": """select key, offense_description, count(*) as n,
  count(*) / sum(count(*)) over () * 100 as pct
from described group by key, offense_description""",
    "fact_table": f"""select data_part, masked_case_no, defendant_no, case_type, case_level, sex,
  age_at_time_of_crime, charge_level, count_no, code, section, plea, result, result_description,
  result_date, charge_city, minor_zip_code, case_category_description,
  (select printf('%06d', rn) from (select {_ORDER}, row_number() over (order by {_ORDER}) as rn from all_charges) r
   where (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_shipdate, r.l_extendedprice)
     = (d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey, d.l_shipdate, d.l_extendedprice)) as unique_id,
  code_section, code_section_m_f, age_group, charge_id, person_id, case_id,
  plea_description, wobbler, low_level, svf, key, offense_description
from described d""",
    "drop_superseded": f"select {_REMAINING} from charges",
    "drop_superseded_keep_one": f"""select {_REMAINING} from (
  select *, row_number() over (partition by charge_id order by {_ORDER}) as rn from counted)
where not (coalesce(result_description = 'Held To Answer in Superior Court', false)
           and charge_rows > 1)
  or (interim_rows = charge_rows and rn = 1)""",
}

ORACLE_SQL = {
    name: _BASE + (sql if sql.lstrip().startswith(",") else "\n" + sql)
    for name, sql in _SELECTS.items()
}
