"""SQL twins of the registered operator queries (DuckDB)."""
ORACLES: dict[str, str] = {}

ORACLES["op9_url_filter"] = """
with parts as (
    select page_id,
           translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
    from pages
), rules(rule_host, rule_path, rule_verdict) as (
    values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits as (
    select page_id, rule_host || rule_path as rule, rule_verdict,
           row_number() over (partition by page_id order by length(rule_host) desc, length(rule_path) desc) as place
    from parts join rules
      on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path)
)
select page_id, host, path, rule,
       coalesce(rule_verdict, case when host = '' then 'block' else 'allow' end) as verdict
from parts left join (select * from fits where place = 1) using (page_id)
"""

ORACLES["op12_fill_middle"] = """
with drawn as (
    select doc_id, coalesce(text, '') as body, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as digest,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
    from documents
), draws as (
    select *, len(units) as n,
           cast('0x' || substr(digest, 1, 8) as bigint) as h1, cast('0x' || substr(digest, 9, 8) as bigint) as h2,
           cast('0x' || substr(digest, 17, 8) as bigint) as h3, cast('0x' || substr(digest, 25, 8) as bigint) as h4
    from drawn
), cuts as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
           case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 90 then 'plain'
                when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from draws
), parts as (
    select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle,
           array_to_string(units[b + 1:], '') as suffix
    from cuts
)
select doc_id, n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else body end) as output_sha256,
       sha256(body) as restored_sha256
from parts
"""
