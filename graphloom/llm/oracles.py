"""DuckDB SQL of the training-data queries that SQL can express."""

_DOMAIN = "case when s < 5 then 'web' when s < 10 then 'forum' when s < 15 then 'books' else 'code' end"

#: Target weights of domains, and of languages within a domain.
_WEIGHTS = "case domain when 'web' then 4.0 when 'forum' then 1.0 when 'books' then 3.0 else 2.0 end::double w0, case domain || ' ' || lang when 'web en' then 3.0 when 'web de' then 0.5 when 'books fr' then 2.0 when 'code es' then 0.0 else 1.0 end::double w1"


def _fill(name: str, parents: list[str], given: str) -> str:
    """Water filling of one level; ``{name}n`` has parents, child, weight, cap, given."""
    by = f"partition by {', '.join(parents)}" if parents else ""
    return f"""
{name}n as ({given}),
{name}r as (select *, case when weight > 0 then cap / weight else 'infinity'::double end ratio from {name}n),
{name}l as (select *, (given - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(weight) over (w rows between current row and unbounded following), 0) lam
  from {name}r window w as ({by} order by ratio, {name})),
{name}g as (select *, case when weight > 0 then least(cap, coalesce(weight * arg_min(case when ratio > lam then lam end, struct_pack(a := ratio, b := {name})) filter (ratio > lam) over ({by}), cap)) else 0 end got from {name}l)"""


OP6 = f"""
with s0 as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source, try_cast(regexp_extract(source, '(\\d+)', 1) as int) s,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) tokens, lang l0, source s1 from documents),
slim as (select *, {_DOMAIN} domain from s0),
leaves as (select *, case when w0 > 0 and w1 > 0 then tokens::double * 4 else 0 end cap from (select domain, lang, source, {_WEIGHTS}, sum(tokens) tokens from slim group by all)),
budget as (select least(sum(tokens) * 4, sum(tokens))::double b from leaves),
{_fill("domain", [], "select domain, any_value(w0) weight, sum(cap) cap, any_value(b) given from leaves, budget group by domain").lstrip()},
{_fill("lang", ["domain"], "select l.domain, lang, any_value(l.w1) weight, sum(l.cap) cap, any_value(g.got) given from leaves l join domaing g using (domain) group by all").lstrip()},
{_fill("source", ["domain", "lang"], "select l.domain, l.lang, l.source, 1.0::double weight, sum(l.cap) cap, any_value(g.got) given from leaves l join langg g using (domain, lang) group by all").lstrip()},
plan as (select l.domain, l.lang, l.source, l.tokens, floor(g.got + 1e-6) target, case when l.tokens > 0 then floor(floor(g.got + 1e-6) / l.tokens) else 0 end::int whole
  from leaves l join sourceg g using (domain, lang, source)),
placed as (select s.*, p.whole, target - whole * p.tokens rest, md5('mix|' || whole || '|' || coalesce(doc_id::varchar, '')) h from slim s join plan p using (domain, lang, source)),
summed as (select *, sum(tokens) over (partition by domain, lang, source order by h range between unbounded preceding and current row) upto from placed),
times as (select *, whole + case when rest > 0 and upto <= rest then 1 else 0 end n from summed)
select doc_id, l0 lang, s1 source, unnest(range(n))::int epoch from times where n > 0
"""

OP9 = r"""
with base as (select conv_id c, turn t, coalesce(role, 'unknown') r, coalesce(text, '') x from conversations),
placed as (select *, row_number() over (partition by c order by t nulls first, r, x) - 1 k from base),
speakers as (select distinct c, r p from base where r <> 'system'),
seen as (select placed.*, p, k // 64 chunk, case when r = p then '<|assistant|>' || chr(10) when r = 'system' then '<|system|>' || chr(10) else '<|user name=' || replace(replace(replace(r, '<|', '<\|'), '|>', '\|>'), chr(10), ' ') || '|>' || chr(10) end head, replace(x, '<|', '<\|') || '<|end|>' || chr(10) body
  from placed join speakers on placed.c is not distinct from speakers.c),
ends as (select *, sum(length(head) + length(body)) over (partition by c, p, chunk order by k) upto from seen)
select c conv_id, p perspective, chunk::bigint chunk, count(*) n_turns, string_agg(head || body, '' order by k) rendered,
  coalesce(string_agg(case when r = p then (upto - length(body))::bigint || '-' || upto::bigint end, ',' order by k), '') mask, sum(case when r = p then length(body) else 0 end)::bigint n_trained
from ends group by c, p, chunk
"""

OP4 = r"""
with docs as (select distinct doc_id, text from documents),
lines as (select doc_id, text, unnest(string_split(text, chr(10))) v, generate_subscripts(string_split(text, chr(10)), 1) p from docs),
pairs as (select doc_id, p, v || chr(10) || w run from (select *, lead(v) over (partition by doc_id, text order by p) w from lines) where w is not null),
later as (select doc_id, p from (select *, row_number() over (partition by run order by doc_id, p) n from pairs) where n > 1),
long as (select doc_id, p from (select *, row_number() over (partition by v order by doc_id, p) n from lines) where n > 1 and len(regexp_extract_all(v, '[^\x20\x09-\x0D]+')) > 50),
gone as (select distinct doc_id, p from (select doc_id, p from later union all select doc_id, p + 1 from later union all select doc_id, p from long)),
kept as (select l.doc_id, v, l.p, g.p is not null dropped from lines l left join gone g on l.doc_id = g.doc_id and l.p = g.p),
marked as (select *, dropped and not coalesce(lag(dropped) over (partition by doc_id order by p), false) starts from kept)
select doc_id, count(*) n_lines, count(*) filter (dropped) n_removed, count(*) filter (starts) n_runs, md5(coalesce(string_agg(v, chr(10) order by p) filter (not dropped), '')) kept_md5 from marked group by doc_id
"""

OP12 = r"""
with d as (select coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t, row_number() over () r from documents),
w as (select lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
kept as (select lang, term, count(*) al from w group by all having count(distinct r) >= 30),
langs as (select lang, count(*) v, sum(al) ln from kept group by lang),
grp as (select distinct lang, source from d),
cnt as (select lang, source, term, count(*) c from w join kept using (lang, term) group by all),
full_ as (select g.lang, g.source, k.term, coalesce(c, 0) c, k.al from grp g join kept k on k.lang = g.lang left join cnt on cnt.lang = g.lang and cnt.source = g.source and cnt.term = k.term),
tot as (select lang, source, sum(c) n from full_ group by all),
p as (select f.lang, f.source, f.term, f.c, 1 + (1000000000::hugeint * (c + 5)) // (n + 5 * v) p, 1 + (1000000000::hugeint * (al + 5)) // (ln + 5 * v) q from full_ f join tot on tot.lang = f.lang and tot.source = f.source join langs on langs.lang = f.lang),
far as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) v from p a join p b on a.lang = b.lang and a.term = b.term where a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(far.v, 0)::bigint as "value" from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint as "value" from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by "value" desc, item)::int as "rank" from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or "rank" <= 50
"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _level(i: int) -> str:
    """One level of the template tree: from nodes n{i} to n{i + 1}."""
    return f"""
e{i} as (select *, shape[{i + 1}] || case when len(shape) = {i + 1} then '' else '/' end seg from n{i} where len(shape) > {i}),
a{i} as (select node, purity, seg, sum(pages) pages, sum(good) good, sum(labelled) labelled from e{i} group by all),
k{i} as (select *, case when pages >= 5 and pages::double >= 0.01::double * sum(pages) over (partition by node)::double then seg else '*' end s2 from a{i}),
f{i} as (select node, purity, s2, sum(good) good, sum(labelled) labelled from k{i} group by all),
p{i} as (select *, (good::double + 10::double * purity) / (labelled::double + 10::double) p, labelled::double + 10::double m from f{i}),
l{i} as (select *, lag(p) over w p0, lag(m) over w m0 from p{i} window w as (partition by node order by p, s2)),
o{i} as (select *, (p * m + p0 * m0) / (m + m0) b from l{i}),
b{i} as (select *, sum(case when (p - p0) * (p - p0) > 3.841459::double * (b * (1::double - b)) * (1::double / m + 1::double / m0) then 1 else 0 end) over (partition by node order by p, s2) merged from o{i}),
c{i} as (select node, purity, merged, sum(good) good, sum(labelled) labelled, list_sort(list(s2)) names from b{i} group by all),
d{i} as (select node, merged, node || '/' || case when len(names) > 1 then '{{' || array_to_string(names, '|') || '}}' else names[1] end child, (good::double + 10::double * purity) / (labelled::double + 10::double) cp from c{i}),
n{i + 1} as (select e.host, e.shape, e.pages, e.good, e.labelled, d.child node, d.cp purity from e{i} e join k{i} k on k.node = e.node and k.seg = e.seg join b{i} b on b.node = k.node and b.s2 = k.s2 join d{i} d on d.node = b.node and d.merged = b.merged)"""


OP11 = f"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select *, regexp_extract(rest, '^[^/?#]*') raw from u),
s as (select page_id, translate(raw, {_UPPER}) host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') "path" from h),
slim as (select *, list_transform(list_filter(string_split("path", '/'), lambda x: x <> '')[1:6], lambda x: case when regexp_matches(x, '^[0-9a-fA-F-]{{16,}}\\z') then '<hex>' else regexp_replace(x, '[0-9]+', '<num>', 'g') end) shape from s),
known as (select doc_id k, sum(case when quality = 1 then 1 else 0 end) good, count(*) labelled from labels where quality is not null group by 1),
paths as (select host, shape, count(*) pages, coalesce(sum(good), 0) good, coalesce(sum(labelled), 0) labelled from slim left join known on k = page_id group by all),
root as (select (sum(good)::double + 1::double) / (sum(labelled)::double + 2::double) r from paths),
n0 as (select p.*, host node, purity from paths p join (select host, (sum(good)::double + 10::double * any_value(r)) / (sum(labelled)::double + 10::double) purity from paths, root group by host) using (host)),
{",".join(_level(i) for i in range(6)).lstrip()},
done as ({" union all ".join(f"select host, shape, node, purity from n{i} where len(shape) = {i}" for i in range(6))} union all select host, shape, node, purity from n6),
j as (select *, case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with("path", '/en/') then 'www.example.com/en/' when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with("path", '/en/') then 'example.com/en/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with("path", '/es/') then 'net/es/' when (host = 'net' or ends_with(host, '.net')) and starts_with("path", '/fr/') then 'net/fr/' when (host = 'com' or ends_with(host, '.com')) and starts_with("path", '/') then 'com/' end as "rule" from slim)
select page_id, j.host, "path", "rule", case when "rule" in ('com/', 'www.example.com/en/') then 'allow' when "rule" is not null then 'block' when purity < 0.75 then 'block' else 'allow' end verdict, node template from j join done on done.host = j.host and done.shape = j.shape
"""

OP13 = """
with r as (select row_number() over () n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end "label", embedding v from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select n, vec_id, "label", list_transform(v, lambda x: floor(256::double * x::double)) v from r),
s as (select a.n, a.vec_id anchor_id, a."label" al, b.vec_id id, b."label" bl, list_inner_product(a.v, b.v)::bigint sc from e a join e b on a.n <> b.n where a.vec_id % 100 = 0),
pos as (select * from (select *, row_number() over (partition by n order by sc desc, id) k from s where al = bl) where k <= 5),
neg as (select p.n, p.anchor_id, p.id positive_id, p.k, p.sc ps, s.id negative_id, s.sc ns, row_number() over (partition by p.n, p.k order by s.sc desc, s.id)::int as "rank" from pos p join s on s.n = p.n and s.al <> s.bl and 30 * p.sc <= 100 * s.sc and 100 * s.sc <= 90 * p.sc)
select anchor_id, positive_id, "rank", negative_id, ps positive_score, ns negative_score from neg where "rank" <= 10
"""

ORACLES = {"op4_line_dedup": OP4, "op6_mixing": OP6, "op9_chat": OP9, "op11_url_filter": OP11, "op12_divergence": OP12, "op13_hard_negatives": OP13}
