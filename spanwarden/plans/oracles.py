"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from spanwarden.functions.catalog import COLUMNS, RULES
from spanwarden.operators import audit, detect, files
from spanwarden.sources.marked import DOCUMENT_SQL, PAGE_SQL, PATH_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


DOCS = f"docs as (select {PATH_SQL.replace('as string', 'as varchar')} as path, {DOCUMENT_SQL} as text, doc_id, n_chars from documents)"
PAGES = f"pg as (select concat('pages/', cast(page_id as varchar), '.html') as path, {PAGE_SQL} as text, page_id from pages)"
RULE_ROWS = "rules as (select * from (values " + ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in RULES) + f") as t({', '.join(COLUMNS)}))"


def hit_rows(source: str, pattern: str) -> str:
    """path, text, hit, start, finish, chars (code points before)."""
    return f"""select path, text, h[k] as hit,
      (coalesce(list_sum(list_transform(g[1:k], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: strlen(x))), 0))::bigint as start,
      (coalesce(list_sum(list_transform(g[1:k], lambda x: strlen(x))), 0) + coalesce(list_sum(list_transform(h[1:k], lambda x: strlen(x))), 0))::bigint as finish,
      (coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0))::bigint as chars
      from (select path, text, g, h, unnest(generate_series(1, len(h))) as k from (select path, text, string_split_regex(text, {q(pattern)}) as g, regexp_extract_all(text, {q(pattern)}) as h from {source}) where len(h) > 0)"""


def clip(x: str, most: int) -> str:
    """At most so many bytes; a code point that is cut becomes U+FFFD."""
    whole = f"list_max(list_filter(generate_series(0, {most}), lambda k: strlen(substr({x}, 1, k::int)) <= {most}))::int"
    return f"(case when strlen({x}) <= {most} then {x} else substr({x}, 1, {whole}) || case when strlen(substr({x}, 1, {whole})) < {most} then chr(65533) else '' end end)"


#: Text detectors leave these out.
PAYLOAD = "not regexp_matches(lower(path), '[.](png|jpg|jpeg|webp|pdf|docx|odt)$')"


def found(source: str, pattern: str, rule: str, evidence: str = clip("hit", 80), where: str = "true") -> str:
    return f"select path, {q(rule)} as rule_id, start, finish as \"end\", {evidence} as evidence, '' as replacement, null::varchar as clean from ({hit_rows(source, pattern)}) where {where}"


def _matches(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def unicode_sql(aggressive: bool = False, source: str = "docs") -> str:
    pattern = detect.EVERY if not aggressive else detect.EVERY[:-1] + "".join(detect.CONFUSABLE) + "]"
    one = lambda chars: _matches("hit", f"^[{chars}]$")
    emoji = lambda x: _matches(x, f"^[{detect.EMOJI}]$")
    yes = "true" if aggressive else "false"
    cases = [f"when hit = {q(detect.INVISIBLE['zwsp'])} then 'unicode.zwsp'"]
    cases.append(f"when hit = {q(detect.INVISIBLE['zwnj'])} then case when not {yes} and prev > chr(127) and {_matches('prev', '^[\\pL]$')} then null else 'unicode.zwnj' end")
    cases.append(f"when hit = {q(detect.INVISIBLE['zwj'])} then case when {emoji('prev')} and {emoji('nxt')} then null else 'unicode.zwj' end")
    cases += [f"when hit = {q(detect.INVISIBLE[n])} then 'unicode.{n}'" for n in ("word_joiner", "bom", "soft_hyphen")]
    cases += [f"when hit = {q(c)} then 'unicode.{n}'" for n, c in detect.SPACES.items()]
    cases.append(f"when {one(detect.BIDI)} then 'unicode.bidi'")
    cases.append(f"when {one(detect.VARIATION)} then case when not {yes} and {one(chr(0xFE0E) + chr(0xFE0F))} and {emoji('prev')} then null else 'unicode.vs' end")
    cases.append(f"when {one(detect.SUPPLEMENT)} then 'unicode.vs_supplement'")
    cases.append(f"when {one(detect.TAGS)} then case when not {yes} and {emoji('right(before, 1)')} then null else 'unicode.tags' end")
    cases += [f"when {one(detect.MORE_SPACES)} then 'unicode.space_homoglyph'", f"when {one(detect.FORMAT)} then 'unicode.format'", f"when {one(detect.OTHER_CF)} then 'unicode.other_cf'"]
    near = "case when regexp_extract(before, '(\\pL)\\PL*\\z', 1) <> '' then regexp_extract(before, '(\\pL)\\PL*\\z', 1) else regexp_extract(after, '^\\PL*(\\pL)', 1) end"
    cases.append(f"when {_matches(near, '\\p{Latin}')} then 'unicode.confusable'")
    spaces = one("".join(detect.SPACES.values()) + detect.MORE_SPACES)
    confusable = f"translate(hit, {q(''.join(detect.CONFUSABLE))}, {q(''.join(detect.CONFUSABLE.values()))})"
    replacement = f"case when rule_id = 'unicode.confusable' then {confusable} when {spaces} then ' ' else '' end"
    rtl = _matches("text", "[\\p{Hebrew}\\p{Arabic}\\p{Syriac}]")
    return f"""select path, rule_id, start, finish as "end", concat('U+', lpad(upper(format('{{:x}}', ord(hit))), greatest(4, length(format('{{:x}}', ord(hit))))::integer, '0')) as evidence, {replacement} as replacement,
      case when rule_id = 'unicode.bidi' and ({yes} or not {rtl}) then 'strip' end as clean
      from (select *, case {' '.join(cases)} end as rule_id from (select *, regexp_extract(before, '(?s)(.)[{detect.SKIPPED}]*\\z', 1) as prev, regexp_extract(after, '(?s)^[{detect.SKIPPED}]*(.)', 1) as nxt
      from (select *, substr(text, 1, chars) as before, substr(text, chars + 2) as after from ({hit_rows(source, pattern)})))) where rule_id is not null"""


def c2pa_sql(source: str = "docs") -> str:
    parts = [found(source, p, r) for r, p in detect.C2PA.items()]
    parts.append(found(source, detect.VS_RUN, "c2pa.unstructured", "'variation selector run'"))
    return " union all ".join(parts)


LINES = "lines as (select path, text, k - 1 as number, k = len(a) as last, a[k] as line, (coalesce(list_sum(list_transform(a[1:k-1], lambda x: strlen(x) + 1)), 0))::bigint as off from (select path, text, a, unnest(generate_series(1, len(a))) as k from (select path, text, string_split(text, chr(10)) as a from docs)))"
_region = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, {q(p)}, 1), '')" for p in detect.COMMENTS) + ")"
REGIONS = f"regions as (select *, {_region} as region from lines)"


def stamp_sql() -> str:
    allow = "(?i)code generated by (protoc|easyjson|stringer|mockgen|wire|sqlc|oapi-codegen)|Code generated .* DO NOT EDIT"
    arms = " union all ".join(f"select *, {q(r)} as rule_id from regions where region is not null and {_matches('region', p)}" for r, p in detect.STAMPS.items())
    return f"""select path, rule_id, off + strlen(line) - strlen(region) as start, off + strlen(line) + case when off + strlen(line) + 1 >= strlen(text) then 0 else 1 end as "end",
      {clip("trim(region, chr(9) || chr(10) || chr(13) || ' ')", 120)} as evidence, '' as replacement, null::varchar as clean from ({arms}) where not (rule_id in ('stamp.generated_by_ai', 'stamp.ai_generated') and {_matches('substr(text, 1, 2048)', allow)})"""


def origin_sql() -> str:
    scanned = "coalesce(region, case when regexp_replace(line, '[\\t\\n\\r\\f ]+', '', 'g') <> '' and not regexp_matches(line, '^[\\t ]*[{\\[]') then line end)"
    arms = " union all ".join(f"select *, {q(r)} as rule_id, {n} as most from s where scanned is not null and {_matches('scanned', p)}" for r, (p, n) in detect.ORIGINS.items())
    return f"""select path, rule_id, off + strlen(line) - strlen(scanned) as start, off + strlen(line) as "end", case when strlen(scanned) > 120 then {clip('scanned', 117)} || '...' else scanned end as evidence, '' as replacement, null::varchar as clean
      from (select *, row_number() over (partition by path, rule_id order by number) as place from (with s as (select *, {scanned} as scanned from regions) {arms})) where place <= most"""


def html_sql(source: str = "pg") -> str:
    any_ = lambda needles: "(" + " or ".join(f"contains(lower(hit), {q(n)})" for n in needles) + ")"
    value = lambda name: "lower(concat(" + ", ".join(f"regexp_extract(hit, {q(f'(?is)[\\t\\n\\v\\f\\r ]{name}\\s*=\\s*(?:\"([^\"]*)\"|' + chr(39) + '([^' + chr(39) + ']*)' + chr(39) + '|([^\\s>\"' + chr(39) + ']+))')}, {i})" for i in (1, 2, 3)) + "))"
    name = f"coalesce(nullif({value('name')}, ''), {value('property')})"
    system = f"({name} = 'generator' and not {_matches('hit', detect.GENERATOR)})"
    meta = found(source, detect.META_TAG, "container.html_meta", where=f"not {system} and ({any_(('contentcredential', *detect.AI_NEEDLES))} or {_matches('hit', detect.META_NAME)})")
    ld = found(source, detect.JSON_LD, "container.html_meta", "'json-ld provenance'", f"{_matches('hit', detect.META_NAME)} or {any_(('digitalsourcetype', 'trainedalgorithmicmedia', 'softwareagent', 'c2pa'))}")
    return " union all ".join((meta, ld, found(source, detect.DATA_AI, "container.html_meta")))


SVG = "sv as (select concat('p/', cast(page_id as varchar), '.svg') as path, concat(case page_id % 5 when 0 then '<svg><metadata>made by OpenAI</metadata></svg>' when 1 then '<svg><!-- claude --></svg>' when 2 then '<svg generator=\"Midjourney\"></svg>' when 3 then '<svg generator=\"Midjourney\"><!-- gemini --></svg>' else '<svg><metadata>plain</metadata></svg>' end, html) as text from pages)"


def svg_sql() -> str:
    any_ = "(" + " or ".join(f"contains(lower(hit), {q(n)})" for n in ("rdf:", "xmp", *detect.AI_NEEDLES)) + f" or {_matches('hit', detect.META_NAME)})"
    first = " union all ".join([*[found("sv", p, "container.svg_metadata", where=any_) for p in detect.SVG_BLOCKS], found("sv", detect.SVG_COMMENT, "container.svg_metadata", "'svg comment'", _matches("hit", detect.META_NAME))])
    rest = found("sv", detect.SVG_GENERATOR, "container.svg_metadata", where=f"{_matches('hit', detect.GENERATOR)} or {_matches('hit', detect.META_NAME)}")
    return f"with {SVG}, f as ({first}) select path, rule_id, start, \"end\", evidence from f union all select path, rule_id, start, \"end\", evidence from ({rest}) where path not in (select path from f)"


def all_sql(aggressive: bool = False) -> str:
    """CTEs up to raw (findings of all text detectors) and merged."""
    parts = " union all ".join(f"select *, {q(n)} as detector, {i} as detector_order from ({s})" for i, (n, s) in enumerate((("unicode", unicode_sql(aggressive)), ("c2pa", c2pa_sql()), ("stamp", stamp_sql()), ("origin", origin_sql()))))
    ruled = "ruled as (select f.path, f.rule_id, f.start, f.\"end\", f.evidence, f.replacement, f.detector, f.detector_order, coalesce(f.clean, r.clean) as clean, r.family, r.severity, r.confidence, r.description as message from raw f left join rules r on f.rule_id = r.id)"
    one = "merged as (select * exclude (n) from (select *, row_number() over (partition by path, start, \"end\", rule_id order by detector_order) as n from ruled where start >= 0 and \"end\" > start) where n = 1)"
    return f"with recursive {DOCS}, {LINES}, {REGIONS}, {RULE_ROWS}, raw as (select * from ({parts}) where {PAYLOAD}), {ruled}, {one}"


COLS = 'path, rule_id, start, "end", evidence'
BASE = f"with {DOCS}, {LINES}, {REGIONS} "
ALL = all_sql()
_weight_base = "case family " + " ".join(f"when '{f}' then {n}" for f, n in audit.BASE.items()) + " else 4 end"
WEIGHT = f"case confidence when 'certain' then {_weight_base} when 'likely' then greatest(3, {_weight_base} * 6 // 10) else greatest(1, {_weight_base} * 3 // 10) end"
CAP = "case family " + " ".join(f"when '{f}' then {n}" for f, n in audit.CAPS.items()) + " end"
SUMS = f"sums as (select family, sum({WEIGHT})::bigint as raw_, coalesce(least(sum({WEIGHT}), any_value({CAP})), sum({WEIGHT}))::bigint as capped from merged where not starts_with(rule_id, 'statwm.') group by family)"
_agent = "case " + " ".join(f"when {_matches("concat_ws(' ', evidence, message, rule_id)", f'(?i)\\b({p})\\b')} then '{n}'" for n, _, p in audit.AGENTS) + " end"
_hard = "family in ('stamp', 'c2pa', 'metadata')"
_points = f"case when {_hard} then case when confidence = 'certain' then 10 else 3 end when starts_with(rule_id, 'origin.named.') then 4 else 2 end"
VOTES = f"votes as (select agent, sum(case when h then p else 0 end)::bigint as hard, sum(case when h then 0 else p end)::bigint as soft from (select {_agent} as agent, {_hard} as h, {_points} as p from merged where ({_hard} or family = 'heuristic') and not starts_with(rule_id, 'statwm.')) where agent is not null group by agent)"
_order = "case agent " + " ".join(f"when '{n}' then {i}" for i, (n, _, _) in enumerate(audit.AGENTS)) + " end"
_title = "case agent " + " ".join(f"when '{n}' then '{t}'" for n, t, _ in audit.AGENTS) + " end"
LAYER = "case when starts_with(rule_id, 'statwm.') then 'B' when starts_with(rule_id, 'container.') or family in ('c2pa', 'metadata') then 'Files' else 'A' end"
_can = "(clean = 'strip' or (clean = 'normalize' and replacement <> ''))"
GREEDY = f"""ranked as (select path, start, "end", rule_id, replacement, row_number() over (partition by path order by start, "end" desc, rule_id) as n from merged where {_can}),
 walk as (select path, n, start, "end", rule_id, replacement, true as taken, "end" as last_end from ranked where n = 1 union all
 select r.path, r.n, r.start, r."end", r.rule_id, r.replacement, r.start >= w.last_end, case when r.start >= w.last_end then r."end" else w.last_end end from walk w join ranked r on r.path = w.path and r.n = w.n + 1),
 taken as (select path, start, "end", rule_id, replacement, row_number() over (partition by path order by start) as m, lag("end", 1, 0) over (partition by path order by start) as before, lead(start) over (partition by path order by start) as after from walk where taken)"""

PIECES = "pieces as (select t.path, t.m, decode(encode(d.text)[t.before + 1:t.start]) || t.replacement || case when t.after is null then decode(encode(d.text)[t.\"end\" + 1:strlen(d.text)]) else '' end as piece from taken t join docs d using (path))"


def divergence_sql(source: str) -> str:
    """From (…, a_text, b_text): adds d."""
    return f"""(select *, case when len(a) = 0 and len(b) = 0 then 0.0 when len(a) = 0 or len(b) = 0 then 1.0 else 1 - len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end as d
      from (select *, case when len(x) < 2 then [] else list_distinct(list_transform(list_zip(x[1:len(x)-1], x[2:]), lambda p: p[1] || ' ' || p[2])) end as a, case when len(y) < 2 then [] else list_distinct(list_transform(list_zip(y[1:len(y)-1], y[2:]), lambda p: p[1] || ' ' || p[2])) end as b
      from (select *, regexp_extract_all(lower(a_text), '[A-Za-z0-9]+') as x, regexp_extract_all(lower(b_text), '[A-Za-z0-9]+') as y from {source})))"""


def _fails(name: str) -> str:
    least = {"any": 0, **audit.RANKS}.get(name, 0)
    rank = "case confidence when 'certain' then 3 when 'likely' then 2 when 'heuristic' then 1 else 0 end"
    return "false" if name == "none" else f"coalesce(bool_or({rank} >= {least}), false)"


_ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_language = "case " + " ".join(f"when {_ext} in {in_(e)} then '{n}'" for n, e in reversed(files.LANGUAGES.items())) + " else 'text' end"
_secret = "text"
for _p in audit.SECRETS:
    _secret = f"regexp_replace({_secret}, {q(_p)}, '[REDACTED]', 'g')"
_host = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_scheme = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1))"
_origin = f"case when {_scheme} in ('http', 'https') and {_host} <> '' and not contains({_host}, '@') then {_scheme} || '://' || regexp_replace(regexp_replace(lower({_host}), ':[0-9]*$', ''), '\\.$', '') || ':' || coalesce(nullif(regexp_extract({_host}, ':([0-9]+)$', 1), ''), case when {_scheme} = 'https' then '443' else '80' end) end"
_body = "regexp_replace(region, '^(//|#)+', '')"
_long = f"(length(region) >= 80 and not regexp_matches(ltrim({_body}), '^(go:|nolint|export |spdx-)') and not starts_with(lower(ltrim({_body})), 'copyright'))"
_folders, _names = ("src", ".git", "vendor/x", "docs/deep", "testdata/a/b"), ("LICENSE", "go.sum", "a_test.go", "main.go", "note.md", "license.txt", "x.YAML")
_case = lambda values, n: f"case doc_id % {n} " + " ".join(f"when {i} then {q(v)}" for i, v in enumerate(values)) + " end"
_path_kind = "lower(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#](?s:.*)$', ''))"
_guess = "case when page_id % 4 = 0 then 'html' when page_id % 4 = 1 then 'png' when page_id % 4 = 3 then 'text' " + " ".join(f"when ends_with({_path_kind}, '{e}') then '{k}'" for e, k in files.SUFFIX_KINDS) + " when starts_with(html, '%PDF') then 'pdf' when contains(lower(substr(html, 1, 500)), 'svg') and starts_with(ltrim(html, ' ' || chr(9) || chr(10) || chr(13)), '<') then 'svg' when contains(lower(substr(html, 1, 500)), '<html') or starts_with(ltrim(html, ' ' || chr(9) || chr(10) || chr(13)), '<') then 'html' else 'text' end"
_hangs = "regexp_matches(x, '(?s)^([ \\t-]|\\s*\\z|\\s*#)')"


def front_sql(source: str = "docs") -> str:
    """CTEs up to fx: front matter lines, and whether each goes."""
    head = "(?s)\\A---\\r?\\n(.*?)\\r?\\n---\\r?\\n?"
    named = f"(lower(key) in {in_(detect.FRONT_KEYS)} or {_matches('key', detect.META_NAME)} or {_matches('val', detect.META_NAME)})"
    return f"""fm as (select path, regexp_extract(text, {q(head)}, 0) as head, string_split(regexp_extract(text, {q(head)}, 1), chr(10)) as a from {source} where regexp_extract(text, {q(head)}, 0) <> ''),
 fl as (select path, head, k, a[k] as x, regexp_extract(a[k], '^([A-Za-z0-9_.-]+)\\s*:', 1) as key, regexp_extract(a[k], '(?s)^[A-Za-z0-9_.-]+\\s*:(.*)', 1) as val from (select path, head, a, unnest(generate_series(1, len(a))) as k from fm)),
 fd as (select path, head, k, x, key, {_hangs} as hangs, case when {_hangs} then null else key <> '' and {named} end as own from fl),
 fx as (select path, head, k, x, key, hangs, coalesce(last_value(own ignore nulls) over (partition by path order by k rows between unbounded preceding and current row), false) as gone from fd)"""


_front = front_sql()
FRONT_MARKS = """select path, 'container.md_front_matter' as rule_id, 0::bigint as start, strlen(head)::bigint as "end", dropped as evidence, case when regexp_matches(kept, '\\S') then '---' || chr(10) || kept || chr(10) || '---' || chr(10) else '' end as replacement, null::varchar as clean
 from (select path, head, trim(coalesce(string_agg(x, chr(10) order by k) filter (not gone), ''), chr(10)) as kept, string_agg(key, ', ' order by k) filter (gone and not hangs) as dropped from fx group by path, head) where dropped is not null"""
_unseen = "[\\p{Cf}" + "".join(chr(x) for x in (0x200B, 0x2060, 0xFEFF, 0xAD, 0xA0, 0x202F, 0x2002, 0x2003, 0x2007, 0x2009, 0x200A)) + chr(0xFE00) + "-" + chr(0xFE0F) + chr(0xE0100) + "-" + chr(0xE01EF) + "]"


def shown(line: str) -> str:
    """A line as a snippet."""
    one = f"case when c = chr(9) then '\\t' when {_matches('c', '^' + _unseen + '$')} then '<U+' || upper(case when ord(c) <= 65535 then format('{{:04x}}', ord(c)) else format('{{:06x}}', ord(c)) end) || '>' else c end"
    return f"regexp_replace(array_to_string(list_transform(string_split(substr({line}, 1, 120), ''), lambda c: {one}), '') || case when length({line}) > 120 then '...' else '' end, '[ \\t]+$', '')"


_evidence_symbol = "case when strlen(evidence) <= 64 and evidence <> '' and not regexp_matches(evidence, '[ \\t\\n]') then 'symbol ' || evidence end"

ORACLES: dict[str, str] = {
    "rule_catalog": f"with {RULE_ROWS} select * from rules",
    "rule_explain": f"with {RULE_ROWS} select a.asked, r.id is not null as known, coalesce(r.family, 'unicode') as family, coalesce(r.severity, 'warning') as severity, coalesce(r.confidence, 'certain') as confidence, coalesce(r.clean, 'strip') as clean from (values ('unicode.zwsp'), ('unicode.bidi'), ('no.such.rule')) a(asked) left join rules r on r.id = a.asked",
    "findings_by_rule": f"with recursive u as (with {DOCS}, {PAGES} select path, text from docs union all select path, text from pg), docs as (select path, text from u where {PAYLOAD}), hx as (select * from u where regexp_matches(lower(path), '[.]html?$')), mx as (select * from u where ends_with(path, '.md')), {LINES}, {REGIONS}, {RULE_ROWS}, {front_sql('mx')}, raw as (" + " union all ".join((unicode_sql(), c2pa_sql(), stamp_sql(), origin_sql(), html_sql("hx"), FRONT_MARKS)) + ") select f.rule_id, r.family, r.severity, count(*) as hits, count(distinct path) as files from raw f join rules r on f.rule_id = r.id group by all",
    "container_dispatch": f"with u as (with {DOCS}, {PAGES} select path, text from docs union all select path, text from pg), hx as (select * from u where regexp_matches(lower(path), '[.]html?$')), mx as (select * from u where ends_with(path, '.md')), {front_sql('mx')} select {COLS}, replacement from (" + html_sql("hx") + " union all " + FRONT_MARKS + ")",
    "walk_filter": f"select rel_path, length from (select {_case(_folders, 5)} as f, {_case(_names, 7)} as n, concat_ws('/', {_case(_folders, 5)}, cast(doc_id as varchar), {_case(_names, 7)}) as rel_path, n_chars * 1000 as length from documents) where f in ('src', 'docs/deep', 'testdata/a/b') and lower(n) not in ('license', 'go.sum', 'license.txt') and length <= {files.MAX_BYTES} and (ends_with(n, '.go') or ends_with(n, '.md') or starts_with(rel_path, 'testdata/')) and n <> 'a_test.go'",
    "classify_language": f"with {DOCS} select path, {_language} as language from docs",
    "classify_kind": f"with {DOCS} select path, case when {_ext} in {in_(files.LANGUAGES['image'])} or doc_id % 4 = 3 then 'image' when {_ext} in {in_(files.LANGUAGES['container'])} or doc_id % 4 = 1 then 'container' when doc_id % 4 = 2 then null else 'text' end as kind from docs",
    "comment_regions": BASE + "select path, number, region, strlen(line) - strlen(region) as region_offset from regions where region is not null",
    "unicode_findings": BASE + f"select {COLS} from ({unicode_sql()})",
    "unicode_aggressive": BASE + f"select {COLS} from ({unicode_sql(True)})",
    "unicode_cleaning": BASE + f", {RULE_ROWS} select rule_id, coalesce(f.clean, r.clean) as clean, replacement, count(*) as n from ({unicode_sql()}) f join rules r on f.rule_id = r.id group by all",
    "finding_positions": BASE + f"select path, rule_id, start, 1 + length(b) - length(replace(b, chr(10), '')) as line, 1 + length(regexp_extract(b, '([^\\n]*)$', 1)) as col from (select f.*, decode(encode(text)[1:start]) as b from ({unicode_sql()}) f join docs using (path))",
    "c2pa_findings": BASE + f"select {COLS} from ({c2pa_sql()})",
    "c2pa_page_findings": f"with {PAGES} select {COLS} from ({c2pa_sql('pg')})",
    "stamp_findings": BASE + f"select {COLS} from ({stamp_sql()})",
    "origin_findings": BASE + f"select {COLS} from ({origin_sql()})",
    "html_findings": f"with {PAGES} select {COLS} from ({html_sql()})",
    "svg_findings": svg_sql(),
    "front_matter_keys": f"with {DOCS}, {_front} select path, coalesce(string_agg(x, chr(10) order by k) filter (not gone), '') as kept, string_agg(key, ',' order by k) filter (gone and not hangs) as dropped from fx group by path having count(*) filter (gone and not hangs) > 0",
    "merge_dedup": ALL + " select path, start, \"end\", rule_id, detector_order::bigint as detector_order from merged where rule_id <> 'unicode.nbsp'",
    "merge_protect": ALL + " select path, start, \"end\", rule_id, case when p then 'report_only' else clean end as clean, p as protected, case when p then 'string' end as reason from (select *, start < 9 and 3 < \"end\" and family not in ('c2pa', 'metadata') and rule_id not in ('unicode.tags', 'unicode.vs_supplement') as p from merged)",
    "detector_hits": ALL + " select detector, count(*) as hits from raw group by detector",
    "layer_counts": ALL + f", hx as (select * from docs where ends_with(path, '.html')), mx as (select * from docs where ends_with(path, '.md')), {front_sql('mx')} select 'A' as layer, (select count(*) from raw where detector in ('unicode', 'stamp', 'c2pa')) as n union all select 'Files', (select count(*) from ({html_sql('hx')} union all {FRONT_MARKS}))",
    "layer_tags": ALL + f", hx as (select * from docs where ends_with(path, '.html')), mx as (select * from docs where ends_with(path, '.md')), {front_sql('mx')}, tagged as (select {LAYER} as layer from merged union all select 'Files' from ({html_sql('hx')} union all {FRONT_MARKS})) select layer, count(*) as n from tagged group by 1",
    "confidence_histogram": ALL + " select case when confidence in ('certain', 'likely') then confidence else 'heuristic' end as confidence, count(*) as n from merged group by 1",
    "fail_on": ALL + " select " + ", ".join(f"{_fails(n)} as fail_{n}" for n in ("none", "any", "certain", "likely", "heuristic", "unheard")) + " , family from merged group by family",
    "score_family_caps": ALL + f", {SUMS} select family, raw_ as raw, capped from sums",
    "score_percent": ALL + f", {SUMS} select case when f = 0 then 0 else least(100, p + least(15, f * 15 // greatest((select count(*) from documents), 1))) end::bigint as percent from (select coalesce(sum(capped), 0) as p from sums), (select count(distinct path) as f from merged where not starts_with(rule_id, 'statwm.'))",
    "score_agent_votes": ALL + f", {VOTES} select * from votes",
    "score_agent_pick": ALL + f", {VOTES} select first(agent order by n desc, o) as agent, string_agg(t, ', ' order by n desc, o) as label, case when (select max(hard) from votes) > 0 then 'likely' else 'heuristic' end as confidence from (select agent, {_order} as o, {_title} as t, case when (select max(hard) from votes) > 0 then hard else soft end as n from votes) where n > 0",
    "clean_greedy": ALL + f", {GREEDY} select path, start, \"end\", rule_id from taken",
    "clean_text": ALL + f", {GREEDY}, pieces as (select t.path, t.m, decode(encode(d.text)[t.before + 1:t.start]) || t.replacement || case when t.after is null then decode(encode(d.text)[t.\"end\" + 1:strlen(d.text)]) else '' end as piece from taken t join docs d using (path)) select path, md5(c) as digest from (select path, string_agg(piece, '' order by m) as c from pieces group by path) join docs using (path) where c <> text",
    "redact_secrets": f"select doc_id, md5(r) as digest from (select doc_id, text, {_secret} as r from documents) where r <> text",
    "snippet_escape": f"with {DOCS}, {LINES} select * from (select path, number, {shown('line')} as snippet from lines) where contains(snippet, '<U+') or contains(snippet, '\\t')",
    "layerb_survey": ALL + f", marked as (select distinct path from merged where family in ('stamp', 'c2pa', 'unicode', 'metadata', 'heuristic')), noted as (select distinct path from regions where region is not null and {_long}) select path, path in (select path from marked) as recommended from docs where (regexp_matches(lower(path), '\\.(md|txt|html|htm|rst|adoc)$') and length(text) >= 280) or path in (select path from noted)",
    "lexical_divergence": f"select conv_id, turn, round(d, 6) as divergence from {divergence_sql('(select conv_id, turn, text as a_text, lead(text) over (partition by conv_id order by turn) as b_text from conversations)')} where b_text is not null",
    "select_candidate": f"with c as (select *, row_number() over (partition by conv_id order by turn, role, text) as k from conversations) select conv_id, turn as chosen, score from (select *, row_number() over (partition by conv_id order by score desc, k) as n from (select conv_id, turn, k, round(d - case when strlen(b_text)::double / greatest(strlen(a_text), 1) > 2 or strlen(b_text)::double / greatest(strlen(a_text), 1) < 0.5 then 0.15 else 0.0 end, 6) as score from {divergence_sql('(select c.conv_id, c.turn, c.k, f.text as a_text, c.text as b_text from c join c f on f.conv_id = c.conv_id and f.k = 1 where c.k > 1)')})) where n = 1",
    "guess_kind": f"select page_id, {_guess} as kind from pages",
    "origin_allowed": f"select page_id, o as origin, coalesce(o = p or o = case when starts_with(p, 'http:') and ends_with(p, ':80') then 'https' || regexp_replace(substr(p, 5), ':80$', ':443') end, false) as from_http, coalesce(p = o or p = case when starts_with(o, 'http:') and ends_with(o, ':80') then 'https' || regexp_replace(substr(o, 5), ':80$', ':443') end, false) as to_http from (select page_id, {_origin} as o, (select any_value(x) from (select 'http://' || regexp_replace(regexp_replace(lower({_host}), ':[0-9]*$', ''), '\\.$', '') || ':' || coalesce(nullif(regexp_extract({_host}, ':([0-9]+)$', 1), ''), '80') as x)) as p from pages)",
    "parse_sitemap": "select page_id, k as place, case k when 0 then trim(url) else 'https://a.example/i.png' end as loc from pages, (values (0::bigint), (1::bigint)) t(k)",
    "binary_metadata": "select 'f/' || doc_id || '.' || k as path, 'container.' || k || '_metadata' as rule_id, case k when 'png' then 'tEXt' when 'jpeg' then 'COM' when 'webp' then 'XMP' when 'pdf' then 'Producer' else 'dc:creator' end as evidence from (select doc_id, case doc_id % 6 when 0 then 'png' when 1 then 'jpeg' when 2 then 'webp' when 3 then 'pdf' when 4 then 'docx' else 'odt' end as k from documents where doc_id // 6 % 2 = 1)",
    "comment_bodies": BASE + "select path, number, body from (select path, number, regexp_replace(region, '^[ \\t\\r]*(?:<!--|//+|/\\*+|--|#+|\\*+)[ \\t\\r]*|[ \\t\\r]*(?:-->|\\*/)?[ \\t\\r]*$', '', 'g') as body from regions where region is not null) where strlen(body) >= 20",
    "clean_verify": ALL + f", {GREEDY}, {PIECES}, cl as (select path, coalesce(c, text) as text from docs left join (select path, string_agg(piece, '' order by m) as c from pieces group by path) using (path)) select rule_id, coalesce(f.clean, r.clean) as clean, count(*) as n from ({unicode_sql(source='cl')}) f join rules r on f.rule_id = r.id group by all",
    "scrub_text": ALL + f", {GREEDY.replace('from merged', chr(39).join(('from (select * from merged where detector = ', 'unicode', ') as own')))}, {PIECES} select path, md5(c) as digest, removed from (select path, string_agg(piece, '' order by m) as c, count(*) as removed from pieces group by path) join docs using (path) where c <> text",
    "sarif_rows": ALL + f" select path, rule_id, case severity when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, start as byte_offset, \"end\" - start as byte_length, concat_ws(' {chr(0xB7)} ', {_evidence_symbol}, message) as message from merged",
    "aggressive_clean": all_sql(True) + " select rule_id, clean, replacement, count(*) as n from merged where family = 'unicode' group by all",
    "nfkc": "select doc_id, md5('file A ' || text) as digest from documents",
    "mixed_script": f"with {DOCS} select path, word from (select path, unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) as word from docs) where regexp_matches(word, '\\p{{Latin}}') and regexp_matches(word, '[\\p{{Cyrillic}}\\p{{Greek}}]')",
    "score_agent_fallback": "select * from (values ('marks', 'unknown', 'unknown (forensic marks)', 'likely'), ('mentions', 'generic', 'likely AI-generated', 'heuristic'), ('nothing', 'none', 'none', 'none')) t(given, agent, label, confidence)",
    "score_evidence": ALL + f" select row_number() over (order by path, start, \"end\" desc, rule_id) as place, case when evidence <> '' then rule_id || ': ' || case when strlen(s) > 80 then {clip('s', 77)} || '...' else s end else rule_id end as evidence from (select *, trim(evidence, ' ' || chr(9) || chr(10) || chr(13)) as s from merged where ({_hard} or family = 'heuristic') and {_agent} is not null order by path, start, \"end\" desc, rule_id limit 5)",
    "decode_units": f"with {DOCS} select path, case when k is null then 'text' else k end as kind, case when k in ('image', 'container') then k else {_language} end as language, case when k = 'text' and doc_id % 7 = 4 then 'unknown' else 'utf-8' end as charset, (doc_id % 7 = 3 or (doc_id % 16 = 2 and doc_id % 7 not in (2, 4))) as has_bom, k is null as skipped from (select *, case when {_ext} in {in_(files.LANGUAGES['image'])} then 'image' when {_ext} in {in_(files.LANGUAGES['container'])} then 'container' when doc_id % 7 = 2 then null else 'text' end as k from docs)",
    "file_counters": f"with {DOCS} select count(*) filter (k is not null) as scanned, count(*) filter (k is null) as skipped, count(*) filter (k = 'text') as texts, count(*) filter (k = 'image') as images, count(*) filter (k = 'container') as docs from (select case when {_ext} in {in_(files.LANGUAGES['image'])} then 'image' when {_ext} in {in_(files.LANGUAGES['container'])} then 'container' when doc_id % 7 = 2 then null else 'text' end as k from docs)",
    "file_counters_forced": "select count(*) as scanned, 0::bigint as skipped, 0::bigint as texts, 0::bigint as images, count(*) as docs from documents",
    "finding_snippets": ALL + f" select path, rule_id, start, \"end\", {shown('shown_line')} as snippet, case when strlen(evidence) <= 64 and evidence <> '' and not regexp_matches(evidence, '[ \\t\\n]') then evidence end as symbol from (select m.*, regexp_extract(decode(encode(text)[1:start]), '([^\\n]*)$', 1) || decode(encode(text)[start + 1:\"end\"]) || regexp_extract(decode(encode(text)[\"end\" + 1:strlen(text)]), '^[^\\n\\r]*', 0) as shown_line from merged m join docs using (path))",
    "finding_order": ALL + " select path, start, \"end\", rule_id, row_number() over (partition by path order by start, \"end\" desc, rule_id) as place from merged",
    "kind_suffix": f"select page_id, case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in files.KIND_SUFFIX.items()) + f" else '.txt' end as suffix from (select page_id, {_guess} as kind from pages)",
    "resolve_url": "select page_id, case page_id % 4 when 0 then 'https://h.example/a/b?q=1' when 1 then 'https://x.example/y' when 2 then 'https://h.example/dir/p' || page_id else 'https://h.example/dir/p' || page_id || '#part' end as resolved from pages",
    "public_addresses": "select page_id, page_id % 9 in (6, 7) as public from pages",
    "layerb_plan": ALL + f", marked as (select distinct path from merged where family in ('stamp', 'c2pa', 'unicode', 'metadata', 'heuristic')), own as (select *, regexp_matches(lower(path), '\\.(md|txt|html|htm|rst|adoc)$') and length(text) >= 280 as prose from docs where {PAYLOAD} and path in (select path from marked)) select path, 'statwm.layer_b_prose' as rule_id, 0::bigint as start, strlen(text)::bigint as \"end\" from own where prose union all select path, 'statwm.layer_b_comment', off + strlen(line) - strlen(region), off + strlen(line) from regions where region is not null and {_long} and path in (select path from own where not prose)",
    "model_answers": "select conv_id, turn, regexp_extract(text, '[A-Za-z]+', 0) as answer from conversations",
    "go_findings": "select * from (select rule_id, evidence, replacement, clean, protected, reason, sum(k)::bigint as n from (select doc_id, unnest([{'rule_id': 'unicode.zwsp', 'evidence': 'U+200B', 'replacement': '', 'clean': case when ok then 'report_only' else 'strip' end, 'protected': ok, 'reason': case when ok then 'string_literal' end, 'k': 1}, {'rule_id': 'unicode.zwsp', 'evidence': 'U+200B', 'replacement': '', 'clean': 'strip', 'protected': false, 'reason': null, 'k': 1}, {'rule_id': 'stamp.generated_by_ai', 'evidence': '// Generated with Claude', 'replacement': '', 'clean': 'strip', 'protected': false, 'reason': null, 'k': 1}, {'rule_id': 'stamp.generated_by_ai', 'evidence': '# Generated with Claude', 'replacement': '', 'clean': 'strip', 'protected': false, 'reason': null, 'k': case when ok then 0 else 1 end}, {'rule_id': 'homoglyph.ident', 'evidence': 'sc' || chr(1072) || 'n', 'replacement': case when doc_id % 2 = 0 then 'scan3' else 'scan' end, 'clean': 'normalize', 'protected': false, 'reason': null, 'k': case when ok then 2 else 0 end}], recursive := true) from (select doc_id, doc_id % 5 <> 0 as ok from documents)) group by all) where n > 0",
}
