"""Expected results as DuckDB SQL over the same tables, computed without any operator of this package."""

from __future__ import annotations

from pageframe.functions.constants import (
    API_PATTERNS,
    BINARY_TYPES,
    BROWSER_CHECK_PHRASES,
    CHALLENGE_PHRASES,
    DYNAMIC_PATTERNS,
    DYNAMIC_URL_WORDS,
    EXTENSION_CATEGORIES,
    MIME_EXTENSIONS,
    SECRET_PATTERNS,
)
from pageframe.functions.html_tree import SPACE_CHARS
from pageframe.plans import recipes as X

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def either(test, values) -> str:
    return "(" + " or ".join(test(v) for v in values) + ")"


def unescape(x: str) -> str:
    """The character references that occur, with or without the semicolon where both are read."""
    pairs = [("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&#39;?", "'"), ("&#x27;?", "'"), ("&nbsp;?", " "),
             ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")]
    for entity, char in pairs:
        x = f"regexp_replace({x}, {lit(entity)}, {lit(char)}, 'g')"
    return x


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}]+', ' ', 'g')"


def no_blocks(x: str) -> str:
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '<{tag}.*?</{tag}>', '', 'gs')"
    return x


def tree_text(x: str) -> str:
    """Text of well-formed markup: blocks, comments and tags cut, entities resolved."""
    bare = f"regexp_replace({no_blocks(x)}, '<!--.*?-->', '', 'gs')"
    return unescape(f"regexp_replace({bare}, '<[^>]+>', '', 'g')")


def cleaned(x: str) -> str:
    plain = unescape(f"regexp_replace({no_blocks(x)}, '<[^>]+>', ' ', 'g')")
    return strip(f"regexp_replace({collapse(plain)}, '[^{WORD}{SPACE}.,!?;:''\"()-]', '', 'g')")


def title_of(html: str) -> str:
    return unescape(f"regexp_extract({html}, '<title>(.*?)</title>', 1)")


HREFS = r"regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
URL_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
AUTHORITY = "regexp_extract(url, '//([^/?#]*)', 1)"
RAW_EXT = f"lower(regexp_extract({URL_PATH}, '[^/.][^/]*\\.([^/.]*)$', 1))"
EXT = f"(case when {RAW_EXT} = 'mdc' then 'md' else {RAW_EXT} end)"
PARTS = f"(select p_partkey as page_id, {X.PART_URL} as url from part)"
LOG = (
    f"(select event_id, ts, {X.HOST} as host, {X.LOG_URL} as url, {X.LOG_STATUS} as status, {X.LOG_OK} as ok, "
    "value / 10 as rt from events)"
)
EVENTS = (
    f"(select event_id, ts, {X.EVENT_NAME} as event, {X.LOG_URL} as url, {X.EVENT_STATUS} as status, "
    "cast(event_id % 3 as int) as retries, event_id * 3 as bytes, sha256(cast(event_id as varchar)) as sha256 from events)"
)
AS_OF = "timestamp '2024-01-15 00:00:00'"
KEYWORD_LIST = "list_sort(list_distinct(" + "regexp_extract_all(text, '(?i)ation') || regexp_extract_all(text, '(?i)qu[ae]')" \
    " || regexp_extract_all(text, '(?i)sch') || (case when contains(text, '7') then ['7'] else [] end)))"  # fmt: skip

ORACLES: dict[str, str] = {}

# --- sources --------------------------------------------------------------------

ORACLES["page_scan"] = "select page_id, url, length(html) as n_chars from pages where html is not null and trim(html) <> ''"
ORACLES["line_list"] = f"""
with l as (select {strip("unnest(string_split(text, chr(10)))")} as line from documents)
select line, count(*) as n from l where line <> '' and contains(line, '.') group by line"""
ORACLES["artifact_scan"] = "select doc_id, sha256(text) as sha256, strlen(text) as bytes from documents"
ORACLES["event_scan"] = f"select epoch_us(ts) as ts_us, event, url, status, retries, bytes, sha256 from {EVENTS}"
ORACLES["charset_decode"] = "select doc_id, md5(text) as text_md5, length(text) as n_chars from documents"

# --- pages ----------------------------------------------------------------------

ORACLES["nodes_tag_counts"] = f"""
with t as (select unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) as tag from pages)
select tag, count(*) as n from t group by tag"""
ORACLES["page_title"] = f"select page_id, {title_of('html')} as title from pages"
ORACLES["page_text"] = f"select page_id, trim({collapse(tree_text('html'))}) as text from pages"
ORACLES["clean_text"] = f"select page_id, {cleaned('html')} as text from pages"
ORACLES["headings"] = "select doc_id as page_id, 'h' || (doc_id % 6 + 1) as level, 0 as pos, 'Doc ' || doc_id as heading from documents"
_SUPPLIER = "supplier join nation on s_nationkey = n_nationkey"
ORACLES["meta_map"] = f"""
select s_suppkey as page_id, unnest(['description', 'og:title', 'og:locality', 'twitter:card', 'rank']) as key,
       unnest(['About ' || s_name, s_name, n_name, n_name, cast(s_suppkey as varchar)]) as value from {_SUPPLIER}"""
ORACLES["open_graph"] = f"""
select s_suppkey as page_id, unnest(['og:title', 'og:locality']) as key, unnest([s_name, n_name]) as value from {_SUPPLIER}"""
ORACLES["twitter_card"] = f"select s_suppkey as page_id, 'twitter:card' as key, n_name as value from {_SUPPLIER}"
ORACLES["json_ld"] = "select s_suppkey as page_id, s_name as name, s_suppkey as id from supplier"
_PAGE = "cast(floor(p_partkey / 40) as bigint)"
ORACLES["products"] = f"""
select {_PAGE} as page_id, row_number() over (partition by {_PAGE} order by p_partkey) - 1 as card_no, p_name as title,
       '$' || cast(round(p_retailprice * 100) as bigint) as price, p_type || ' ' || p_brand || ' part' as description,
       case when p_partkey % 2 = 0 then p_size || ' reviews' end as reviews, '/i/' || p_partkey || '.png' as image,
       '/p/' || p_partkey as url, '{X.SITE}/list/' || {_PAGE} as source_url,
       cast(round(p_retailprice * 100) as bigint) as price_num from part"""
_BLOCK = "cast(floor(o_orderkey / 20) as bigint)"
_ORDER_CELLS = "[cast(o_orderkey as varchar), o_orderstatus, cast(cast(round(o_totalprice * 100) as bigint) as varchar)]"
_ORDER_TABLES = f"""
with c as (select {_BLOCK} as page_id, o_orderkey, {_ORDER_CELLS} as cells,
                  row_number() over (partition by {_BLOCK} order by o_orderkey) as n from orders),
t as (select page_id, ['key', 'status', 'cents'] || flatten(list(cells order by n)) as cells,
             list(cells order by n) as rows from c group by page_id)"""
ORACLES["html_tables"] = f"""{_ORDER_TABLES}
select page_id, array_to_string(cells, '|') as headers, 'key|status|cents' as header_row,
       array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), '/') as rows from t"""
ORACLES["table_cells"] = f"""{_ORDER_TABLES}
select page_id, 0 as table_no, n - 1 as row_no, unnest([0, 1, 2]) as col_no, unnest(cells) as cell from c"""
ORACLES["structured_data"] = """
select s_suppkey as page_id, 1 as n_json_ld, 2 as n_open_graph, 1 as n_twitter_card,
       case when s_suppkey % 2 = 0 then s_name end as product_title,
       case when s_suppkey % 3 = 0 then cast(s_suppkey as varchar) end as first_cell from supplier"""
_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
ORACLES["main_markdown"] = f"""
with b as (select doc_id, list_filter(list_transform({_LINES}, lambda x, i:
             case when {strip('x')} = '' then '' when i % 3 = 0 then '- ' || {strip('x')} || chr(10)
                  else {strip('x')} || chr(10) || chr(10) end), lambda x: x <> '') as blocks from documents)
select doc_id as page_id, {strip("'# T' || doc_id || chr(10) || chr(10) || 'D' || doc_id || chr(10) || chr(10) || repeat('#', cast(doc_id % 6 + 1 as int)) || ' Doc ' || doc_id || chr(10) || chr(10) || coalesce(array_to_string(blocks, ''), '')")} as markdown from b"""
_RECORDS = f"""
with t as (select page_id, url, html, {tree_text('html')} as raw from pages),
r as (select page_id, url, html, {cleaned('raw')} as text, {title_of('html')} as title,
        list_sort(list_distinct(list_transform({HREFS}, lambda h: {ORIGIN} || h))) as links from t)"""
ORACLES["page_records"] = f"""{_RECORDS}
select page_id, url, title, text, array_to_string({KEYWORD_LIST}, '|') as keywords, array_to_string(links, '|') as links,
       0 as n_metadata, {strip(unescape("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')"))} as h1,
       0 as n_apis, 0 as n_json_ld, 0 as n_products, 0 as n_tables from r"""
ORACLES["record_structure"] = f"""
select s_suppkey as page_id, s_name as title, 5 as n_metadata, s_name as description, 1 as n_json_ld, n_name as locality,
       case when s_suppkey % 2 = 0 then s_name end as product_title,
       case when s_suppkey % 3 = 0 then cast(s_suppkey as varchar) end as first_cell from {_SUPPLIER}"""
ORACLES["keyword_matches"] = f"select doc_id, array_to_string({KEYWORD_LIST}, '|') as keywords from documents"
_KIND = f"coalesce({X.DOC_TYPE}, '')"
_IS_BINARY = either(lambda b: f"contains({_KIND}, {lit(b)})", BINARY_TYPES)
ORACLES["binary_split"] = f"""
select {X.DOC_URL} as url, case when {_IS_BINARY} then 'binary' else 'html' end as type, {X.DOC_TYPE} as content_type,
       case when {_IS_BINARY} then strlen(text) else 0 end as size from documents"""
ORACLES["flat_binaries"] = f"""
select {X.DOC_URL} as url, doc_id * 1000000 as ts_us, 'binary' as type, strlen(text) as size from documents where {_IS_BINARY}"""
_FOUND = f"""
with f as (select {X.BARE_URL} as url, doc_id, {_KIND} as content_type, {_IS_BINARY} as bin,
                  strlen('<title>T ' || doc_id || ' &amp; more</title>' || text) as size from documents)"""
ORACLES["discovered_files"] = f"""{_FOUND}
select url, {URL_PATH} as path, content_type, size, case when not bin then 'T ' || doc_id || ' & more' end as title,
       case when bin then 'binary' else 'html' end as type, wanted, doc_id * 1000000 as ts_us
from f, (select unnest(['pdf', 'all']) as wanted) w where wanted = 'all' or ends_with(lower(url), '.pdf')"""
ORACLES["script_join"] = f"""
with p as (select p_partkey // 4 as doc_id, count(*) as n_pages, min(p_partkey) as first_page_id from part group by 1)
select '{X.SITE}/x/script/' || doc_id as url, n_pages, first_page_id, length(text) as n_chars from p join documents using (doc_id)"""
ORACLES["download_candidates"] = f"""
select p_partkey as page_id, '{X.SITE}' || case p_partkey % 7 when 3 then '/f/' || p_partkey || '.pdf' when 4 then '/f/' || p_partkey || '.pdf?x=1'
         when 5 then '/DownLoad/' || p_partkey else '/f/' || p_partkey end as url,
       case p_partkey % 7 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 1 when 4 then 2 else 4 end as strategy,
       2 as position from part where p_partkey % 7 < 6"""
ORACLES["inline_payloads"] = """
select doc_id as page_id, 'doc_' || doc_id || '.txt' as file_name, md5(text) as content_md5,
       length('blob:doc_' || doc_id || '.txt:') + length(base64(encode(text))) as uri_chars from documents where trim(text) <> ''"""
ORACLES["next_page"] = "select p_partkey as page_id, case when p_partkey % 6 < 5 then '/n/' || p_partkey end as href from part"

# --- links ----------------------------------------------------------------------

ORACLES["links_resolved"] = "with p as (select p_partkey as k from part) " + " union all ".join(
    f"select k as page_id, {url} as url from p" for url in X.RELATIVE_FORMS.values()
)
ORACLES["links_anchor"] = f"""
with h as (select page_id, {ORIGIN} || unnest({HREFS}) as url from pages) select distinct page_id, url from h"""
_LINK_KINDS = ["anchor", "onclick", "data_attr", "link_tag", "iframe", "srcset", "img", "script", "media", "refresh", "base"]


def _link_rows(kind: str) -> str:
    key = "p_partkey // 4" if kind == "script" else "p_partkey"
    return f"select p_partkey as page_id, '{kind}' as link_kind, '{X.SITE}/x/{kind}/' || ({key}) as url from part"


for _name, _link_kind in {
    "links_onclick": "onclick", "links_data_attr": "data_attr", "links_linktag": "link_tag", "links_iframe": "iframe",
    "links_srcset": "srcset", "links_img": "img", "links_script": "script", "links_media": "media",
    "links_refresh": "refresh", "links_base": "base", "links_inline_js": "inline_js",
}.items():
    ORACLES[_name] = _link_rows(_link_kind)
ORACLES["links_all"] = " union all ".join(_link_rows(kind) for kind in [*_LINK_KINDS, "inline_js"])

# --- URL filters ----------------------------------------------------------------

ORACLES["url_parts"] = f"""
select page_id, url, regexp_extract(url, '^([a-z]+):', 1) as scheme, {AUTHORITY} as authority, {URL_PATH} as path,
       regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment, {EXT} as ext from pages"""
ORACLES["crawlable_links"] = f"""
select page_id, url from {PARTS} p where {AUTHORITY} = 'h1.example.com' and not contains(url, '.js')
  and (contains(url, '/d1/') or contains(url, '/d2/') or contains(url, '/f3')) and url not like '%.html'"""
ORACLES["valid_urls"] = f"""
with u as (select page_id, url, lower({URL_PATH}) as path, {AUTHORITY} as host,
        ends_with(lower(url), '.png') or ends_with(lower(url), '.zip') as wanted from {PARTS} p),
v as (select *, ends_with(path, '.png') or ends_with(path, '.zip') as wanted_path, starts_with(path, '/d2') as below from u
      where not contains(url, '#') and host = 'h3.example.com'
        and (wanted or not regexp_matches(url, '(?i)\\.(css|js)$|\\.(jpg|jpeg|png|gif|bmp|svg|webp)$')))
select page_id, url from v where (not below and wanted_path)
   or (below and url not like '%/f3%' and (not contains(path, '.') or regexp_extract(path, '([^.]*)$', 1) in ('png', 'zip')))"""
ORACLES["downloadable_links"] = f"select page_id, url from {PARTS} p where {EXT} in ('pdf', 'md', 'gz')"
_MIME = "(values " + ", ".join(f"({lit(m)}, {lit(e)})" for m, e in MIME_EXTENSIONS.items()) + ") m(mime, mime_ext)"
ORACLES["mime_ext_join"] = f"""
with b as (select doc_id, {X.BARE_URL} as url, {X.DOC_TYPE} as ct from documents),
e as (select *, split_part(ct, ';', 1) as mime from b where {EXT} = '')
select doc_id, url, mime_ext, coalesce(mime_ext in ('pdf', 'png', 'txt'), false)
       or coalesce(e.mime = 'application/octet-stream' and regexp_matches({URL_PATH}, '/download|/file|/attachment'), false) as is_file
from e left join {_MIME} on e.mime = m.mime"""
_TARGET = f"{EXT} in ('pdf', 'md', 'png', 'gz')"
ORACLES["target_files"] = f"""
with f as (select page_id, url, {_TARGET} as t from {PARTS} p)
select page_id, url, true as has_targets, 1 as n_targets from f where t
union all select cast(floor(page_id / 3) as bigint), '', bool_or(t), count(*) filter (t) from f group by 1"""
_OWNED: dict[str, str] = {}
for _category, _names in EXTENSION_CATEGORIES.items():
    for _ext in _names:
        _OWNED.setdefault(_ext, _category)
_CATEGORIES = "(values " + ", ".join(f"({lit(e)}, {lit(c)})" for e, c in _OWNED.items()) + ") c(ext, category)"
ORACLES["ext_category_counts"] = f"""
with u as (select {EXT} as ext from {PARTS} p) select u.ext, category, count(*) as n from u left join {_CATEGORIES} on u.ext = c.ext group by 1, 2"""
ORACLES["display_url"] = """
select page_id, case when starts_with(url, 'http://spam-farm.example.org/en') then
    case when url = 'http://spam-farm.example.org/en' then '/' else substr(url, length('http://spam-farm.example.org/en') + 1) end
    when replace(url, 'http://spam-farm.example.org', '') = '' then '/'
    else replace(url, 'http://spam-farm.example.org', '') end as shown from pages"""
ORACLES["site_folder"] = f"""
with f as (select page_id, {AUTHORITY} as a, trim({URL_PATH}, '/') as p from pages)
select page_id, trim(regexp_replace(case when p = '' then a else a || '_' || p end, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g'), '_') as folder from f"""
ORACLES["artifact_names"] = f"""
with b as (select doc_id, {X.BARE_URL} as url, coalesce({X.DOC_TYPE}, '') as ct from documents),
n as (select doc_id, ct, regexp_extract({URL_PATH}, '([^/]*)$', 1) as base from b)
select doc_id, case when doc_id % 5 = 0 then 'Myfile' || doc_id || '.md' when contains(base, '.') then base
       when contains(ct, 'text/plain') then base || '.md' else base || '.bin' end as name from n"""
ORACLES["artifact_paths"] = f"""
with s as (select url from {PARTS} p union select replace(url, '.html', '_1.html') from {PARTS} p where url like '%/f%.html'),
u as (select distinct url, trim({URL_PATH}, '/') as t from s),
l as (select url, regexp_replace(t, '[^/]*$', '') || case when contains(regexp_extract(t, '([^/]*)$', 1), '.') then regexp_extract(t, '([^/]*)$', 1)
        else regexp_extract(t, '([^/]*)$', 1) || '.html' end as path from u),
n as (select *, row_number() over (partition by path order by md5(url), url) - 1 as r, regexp_extract(path, '(\\.[^./]*)$', 1) as ext from l),
c as (select path, left(path, length(path) - length(ext)) as stem, ext, max(r) as m from n group by 1, 2, 3),
f as (select path, stem, ext, unnest(range(1, m + 1 + (select count(*) from c))) as k from c where m > 0),
g as (select path, stem || '_' || k || ext as made, row_number() over (partition by path order by k) as r
      from f where stem || '_' || k || ext not in (select path from c))
select n.url, coalesce(made, n.path) as stored_path from n left join g on n.path = g.path and n.r = g.r"""
ORACLES["url_key"] = "select page_id, md5(url) as key from pages"

# --- signals --------------------------------------------------------------------


def _re2(pattern: str) -> str:
    return pattern.replace(r"\w", WORD)


def _api_list(text: str) -> str:
    plain = [p for p in API_PATTERNS if not p.startswith(r"\.")]
    found = " || ".join(f"regexp_extract_all({text}, {lit('(?i)' + _re2(p))})" for p in plain)
    suffixed = [p for p in API_PATTERNS if p.startswith(r"\.")]
    whole = " || ".join(f"regexp_extract_all({text}, {lit(f'(?i)[{WORD}./:?-]*?' + p)})" for p in suffixed)
    return f"list_distinct({found} || {whole})"


_API = f"""
with t as (select o_orderkey as page_id, {X.API_PAGE} as url, {X.API_TEXT} as html from orders),
m as (select page_id, {ORIGIN} as origin, unnest({_api_list('html')}) as hit from t),
a as (select distinct page_id, case when hit like 'ws%' then hit when right(hit, 1) = '?' then origin || left(hit, length(hit) - 1)
        else origin || hit end as api_url from m)"""
ORACLES["api_paths"] = f"{_API} select api_url, min(page_id) as first_page_id, count(*) as n_pages from a group by api_url"


ORACLES["script_scan"] = f"""
with k as (select p_partkey // 4 as o_orderkey, min(p_partkey) as page_id from part group by 1),
t as (select page_id, {X.API_TEXT} as html from k join orders using (o_orderkey)),
m as (select page_id, '{X.SITE}' as origin, unnest({_api_list('html')}) as hit from t),
a as (select distinct page_id, case when hit like 'ws%' then hit when right(hit, 1) = '?' then origin || left(hit, length(hit) - 1)
        else origin || hit end as api_url from m)
select api_url, min(page_id) as first_page_id, count(*) as n_pages from a group by api_url"""


def _secret(p: str) -> str:
    return p.replace(r"\s", r"[\s\p{Z}]")


_SECRETS = " union all ".join(
    f"select doc_id, {lit(name)} as pattern_id, unnest(regexp_extract_all(text, {lit(f'(?i){_secret(lead)}({value})')}, 1)) as v from documents"
    for name, lead, value in SECRET_PATTERNS
)
ORACLES["secret_findings"] = f"""
with f as ({_SECRETS})
select sha256(v) as sha256, length(v) as length, left(v, 4) as prefix, min(pattern_id) as pattern_id, min(doc_id) as first_id
from f where length(v) >= 20 group by v"""
_REDACTED = "text"
for _, _lead, _value in SECRET_PATTERNS:
    _REDACTED = f"regexp_replace({_REDACTED}, {lit(f'(?i)({_secret(_lead)}){_value}')}, '\\1[REDACTED]', 'g')"
ORACLES["redact_secrets"] = f"select doc_id, md5({_REDACTED}) as text_md5 from documents"
_RENDER = f"(select page_id, url, html || {X.RENDER_EXTRA} as html from pages)"
_CHALLENGE = either(lambda p: f"contains(lower(html), {lit(p)})", CHALLENGE_PHRASES)
ORACLES["render_class"] = f"""
with p as (select page_id, page_id % 8 = 0 as framework_script, page_id % 8 = 1 as app_root, false as little_text,
             page_id % 8 = 2 as hydration, {_CHALLENGE} as challenge, page_id % 8 = 4 as generator from {_RENDER} r
  union all select -page_id - 1, false, false, 5 * (page_id % 80) - 1 < 200 and page_id % 7 > 3, false, {_CHALLENGE}, false from pages)
select *, framework_script or app_root or little_text or hydration or challenge or generator as needs_render from p"""
_SCORE = " + ".join(f"cast(regexp_matches(lower(html), {lit('(?is)' + p)}) as int)" for p in DYNAMIC_PATTERNS)
_URL_SAYS = either(lambda w: f"contains(lower(url), {lit(w)})", DYNAMIC_URL_WORDS)
ORACLES["dynamic_score"] = f"""
with s as (select page_id, {_SCORE} as score, {_URL_SAYS} as says, length({strip('html')}) < 500 as short from {_RENDER} r)
select page_id, score, (says or score >= 3 or (short and score > 0)) and page_id % 16 <> 5 as needs_dynamic from s"""
_ANY_CHALLENGE = either(lambda p: f"contains(lower(html), {lit(p)})", CHALLENGE_PHRASES + BROWSER_CHECK_PHRASES)
ORACLES["challenge_pages"] = f"select page_id, {_ANY_CHALLENGE} as is_challenge from {_RENDER} r"

# --- dataflow -------------------------------------------------------------------

ORACLES["visited_dedup"] = f"select url, min(page_id % 4) as depth from {PARTS} p group by url"
ORACLES["crawl_frontier"] = f"""
with recursive e as (select '/p/' || p_partkey as src, {X.EDGE_TARGET} as dst
  from part, (select unnest([3, 7, 11]) as k), (select count(*) as n from part)),
u as (select src, dst from e where not contains(dst, '/p/13')),
w as (select '/p/1' as url, 0 as depth union select dst, depth + 1 from w join u on w.url = u.src where depth < 4)
select url, min(depth) as depth from w group by url"""
ORACLES["route_links"] = f"""
with l as (select cast(floor(page_id / 25) as bigint) as page_id, case when {_TARGET} then 'download'
             when not contains(url, '/d1/') and page_id % 5 < 3 then 'enqueue' else 'drop' end as route from {PARTS} p)
select page_id, count(*) filter (route = 'download') as download, count(*) filter (route = 'enqueue') as enqueue,
       count(*) filter (route = 'drop') as "drop" from l group by page_id"""
ORACLES["download_dedup"] = f"""
select page_id as seq, url, case when row_number() over (partition by url order by page_id) = 1 then 'start' else 'duplicate' end as status from {PARTS} p"""
ORACLES["ordered_distinct"] = f"select cast(floor(page_id / 500) as bigint) as page_id, url, min(page_id) as pos from {PARTS} p group by 1, 2"
ORACLES["keep_newest"] = f"""
with s as (select url, min(ts) as f, max(ts) as l from {LOG} g group by url)
(select url, 'first' as kept_by, epoch_us(f) as seen_us from s order by f desc, url desc limit 100)
union all (select url, 'last', epoch_us(l) from s order by l desc, url desc limit 100)"""
ORACLES["union_pages"] = """
select page_id, url, null::varchar as lang from pages union all select doc_id, null, lang from documents"""
ORACLES["first_match"] = f"""
with h as (select cast(floor(page_id / 10) as bigint) as page_id, page_id % 3 as rank, page_id as node_id, url from {PARTS} p)
select page_id, url, rank from h qualify row_number() over (partition by page_id order by rank, node_id) = 1"""
ORACLES["needs_render"] = f"""
with l as (select cast(floor(page_id / 2) as bigint) as page_id, {EXT} in ('pdf', 'md') as t from {PARTS} p)
select page_id from l group by page_id having not bool_or(t)"""
_PORT = "((c_custkey * 37) % 70000)"
_ENDPOINTS = f"""
select distinct (case when c_custkey % 13 = 0 then 'ab' else 'h' || (case when c_custkey % 10 = 0 then 10 else c_custkey end) || 'x' end) || ':' || {_PORT} as endpoint,
  case c_custkey % 6 when 1 then 'https' when 2 then 'socks4' when 3 then 'socks5' when 4 then 'socks5' else 'http' end as kind, {_PORT} as port
from customer where c_custkey % 13 <> 0 and {_PORT} between 1 and 65535"""
ORACLES["clean_endpoints"] = f"select endpoint, kind from ({_ENDPOINTS})"
ORACLES["top_k_latency"] = f"select event_id, host, round(rt, 6) as rt from {LOG} g order by round(rt, 6), event_id limit 50"

# --- host log -------------------------------------------------------------------


def _runs(source: str) -> str:
    """Rows with the number of failures in a row up to and including them."""
    return f"""
o as (select *, sum(case when ok then 1 else 0 end) over (partition by host order by ts, event_id rows unbounded preceding) as island from {source} g),
r as (select *, cast(sum(case when ok then 0 else 1 end) over (partition by host, island order by ts, event_id rows unbounded preceding) as bigint) as streak from o)"""


_POINTS = "case when ok then 10 - rt * 0.5::double when status in (408, 504) then -20 else -15 end"
_SEEN = f"(select * from {LOG} where ts <= {AS_OF})"
_CURRENT = "arg_max(streak, (ts, event_id)) as current_streak, max(streak) as longest_streak"
ORACLES["retryable"] = f"select event_id, host, status from {LOG} g where status in (408, 425, 429, 500, 502, 503, 504)"
_FIB = "[0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89]"
ORACLES["retry_plan"] = f"""
with l as (select *, event_id % 12 as attempt, case event_id % 4 when 0 then 7000 when 1 then 60000 else 0 end as asked from {LOG} g where status in (408, 425, 429, 500, 502, 503, 504)),
d as (select *, least(30000, 250 * cast(pow(2, attempt) as bigint)) as backoff from l)
select event_id, greatest(backoff, asked) as delay_ms, greatest(50, cast(floor(backoff * 0.2::double) as bigint)) as jitter_bound_ms,
       least(60000, 250 * {_FIB}[attempt + 1]) as fibonacci_ms, least(60000, 7000 * (attempt + 1)) as linear_ms,
       epoch_us(ts) + greatest(backoff, asked) * 1000 as retry_at_us from d"""
ORACLES["host_totals"] = f"""
select host, count(*) filter (ok) as successes, count(*) filter (not ok) as failures, count(*) as total,
       round(avg(cast(ok as double)), 6) as success_rate from {LOG} g group by host"""
_EWMA = "list_reduce(list(rt order by ts, event_id) filter (ok), lambda a, v: a * 0.7::double + v * 0.3::double)"
ORACLES["host_ewma"] = f"select host, round({_EWMA}, 6) as ewma from {LOG} g group by host having count(*) filter (ok) > 0"
ORACLES["host_streaks"] = f"""
with {_runs(LOG)} select host, {_CURRENT}, epoch_us(max(ts) filter (not ok)) as last_failure from r group by host"""
ORACLES["host_marked"] = f"""
with {_runs(LOG)}, m as (select host, count(*) filter (not ok) as failures, max(streak) as longest_streak from r group by host)
select host, failures, longest_streak from m where longest_streak >= 6 or failures >= 220"""
ORACLES["host_health"] = f"""
select event_id, host, round(sum({_POINTS}) over (partition by host order by ts, event_id rows unbounded preceding), 6) as health from {LOG} g"""
_HEALTHY = f"""
{_runs(_SEEN)}, h as (select host, round(sum({_POINTS}), 6) as health, {_CURRENT}, max(ts) filter (not ok) as last_failure from r group by host)"""
ORACLES["host_healthy"] = f"""
with {_HEALTHY} select host, health, current_streak,
  health >= -300 and not (current_streak >= 2 and coalesce(epoch_us({AS_OF}) - epoch_us(last_failure) < 40000 * 1000000::bigint, false)) as healthy from h"""
ORACLES["top_hosts"] = f"""
with {_HEALTHY} select host, health from h
where not (current_streak >= 5 and coalesce(epoch_us({AS_OF}) - epoch_us(last_failure) < 300 * 1000000::bigint, false)) order by health desc, host limit 3"""
ORACLES["host_healthy_at"] = f"""
with l as (select *, case when ok then 10 - rt * 0.5::double when status in (408, 504) then -20 else -15 end as points from {LOG} g),
r as (select host, ts, ok, row_number() over w as n, sum(points) over w as health from l window w as (partition by host order by ts, event_id rows unbounded preceding)),
e as (select host, ts, max_by(n, n) as n, max_by(health, n) as health from r group by host, ts),
o as (select host, ts, max(n) as n_ok from r where ok group by host, ts),
f as (select distinct host, ts, ts as last_failure from r where not ok),
i as (select distinct host, date_trunc('hour', ts) + interval 1 hour as ts from l),
j as (select i.host, i.ts, coalesce(e.health, 0) as health, coalesce(e.n - coalesce(o.n_ok, 0), 0) as streak, f.last_failure
  from i asof left join e on i.host = e.host and i.ts >= e.ts asof left join o on i.host = o.host and i.ts >= o.ts
  asof left join f on i.host = f.host and i.ts >= f.ts)
select host, epoch_us(ts) as at_us, round(health, 6) as health, streak::bigint as current_streak,
  health >= -300 and not (streak >= 2 and coalesce(epoch_us(ts) - epoch_us(last_failure) < 40000000000, false)) as healthy from j"""
ORACLES["host_rank"] = f"""
with {_runs(_SEEN)}, f as (select host, count(*) as total, count(*) filter (ok) as s, count(*) filter (not ok) as fl, {_CURRENT}, max(ts) as used, {_EWMA} as ewma from r group by host),
p as (select host, round(least(coalesce(ewma, 5) / 5, 2) * 0.4::double
   + (1 - greatest(0, least(1, case when total > 10 then (s - fl * 0.5::double) / total else s / total end))) * 2 * 0.4::double
   + greatest(0, (30 - (epoch_us({AS_OF}) - epoch_us(used)) / 1e6) / 30) * 0.1::double + least(current_streak / 3, 1) * 0.1::double, 6) as penalty from f)
select host, penalty, rank() over (order by penalty) as rank from p"""
ORACLES["breaker_timeline"] = f"""
with recursive n as (select *, epoch_us(ts) as ts_us, row_number() over (partition by host order by ts, event_id) as i from {LOG} g),
b as (select host, i, event_id, ts_us, case when ok then 0 else 1 end as streak, null::bigint as opened, false as probed, false as opens, false as closes from n where i = 1
  union all select n.host, n.i, n.event_id, n.ts_us, case when n.ok then 0 else b.streak + 1 end,
    case when n.ok then null when b.opened is null and b.streak + 1 >= 3 then n.ts_us
         when n.ts_us - b.opened >= 1800000000 then n.ts_us else b.opened end,
    coalesce(n.ts_us - b.opened >= 1800000000, false),
    not n.ok and ((b.opened is null and b.streak + 1 >= 3) or coalesce(n.ts_us - b.opened >= 1800000000, false)),
    n.ok and b.opened is not null
  from b join n on n.host = b.host and n.i = b.i + 1)
select host, event_id, ts_us, 0 as step, 'half_open' as state from b where probed
union all select host, event_id, ts_us, cast(probed as int), 'open' from b where opens
union all select host, event_id, ts_us, cast(probed as int), 'closed' from b where closes"""
ORACLES["stream_breaker"] = ORACLES["breaker_timeline"]
ORACLES["host_delay"] = f"""
with w as (select host, ts, event_id, status, count(*) over last as n, avg(rt) over last as mean from {LOG} g
           window last as (partition by host order by ts, event_id rows 9 preceding)),
f as (select host, list(case when status = 429 then 2 when status >= 500 then 1.5::double when n = 10 and mean < 0.5 then 0.9::double
        when n = 10 and mean > 2 then 1.1::double else 1 end order by ts, event_id) as steps from w group by host)
select host, round(list_reduce(steps, lambda d, x: case when x = 1 then d when x < 1 then greatest(d * x, 0.1::double) else least(d * x, 10) end, 1::double), 6) as delay from f"""
ORACLES["cooldown"] = f"""
with g as (select event_id, host, epoch_us(ts) - lag(epoch_us(ts)) over (partition by host order by ts, event_id) as gap_us from {LOG} l)
select event_id, host, gap_us from g where gap_us < 300000000"""

# --- reports --------------------------------------------------------------------

ORACLES["file_inventory"] = f"""
with f as (select coalesce({X.DOC_TYPE}, 'unknown') as content_type, n_chars from documents)
select coalesce(content_type, '(all)') as content_type, count(*) as files, cast(sum(n_chars) as bigint) as bytes from f group by rollup (content_type)"""
ORACLES["discovery_summary"] = f"""
{_API}, f as ({_SECRETS})
select 'endpoint' as kind, count(distinct api_url) as total from a
union all select 'secret', count(distinct v) from f where length(v) >= 20"""
ORACLES["crawl_summary"] = f"""
select count(distinct url) filter (event = 'fetch_start') as visited, count(distinct url) filter (event = 'download_complete') as discovered,
       count(distinct url) filter (event = 'download_complete' and status = 'ok') as downloaded from {EVENTS} e"""
ORACLES["flat_pages"] = f"""{_RECORDS}
select url, title, left(text, 1000) as text, array_to_string({KEYWORD_LIST}, ', ') as keywords, len(links) as num_links, '' as api_endpoints from r"""
ORACLES["progress"] = f"""
with x as (select ts, event, status from {EVENTS} e
   union all select ts - interval 5 hour, 'enqueue', status from {EVENTS} e where event = 'fetch_start'
   union all select ts, 'api_found', status from {EVENTS} e where event = 'retry'
   union all select min(ts), 'first_start', null from {EVENTS} e where event = 'fetch_start' group by url),
h as (select time_bucket(interval 1 hour, ts) + interval 1 hour as until, count(*) filter (event = 'fetch_start') as s, count(*) filter (event = 'first_start') as v,
   count(*) filter (event = 'enqueue') as q, count(*) filter (event = 'api_found') as a,
   count(*) filter (event = 'fetch_ok') as o, count(*) filter (event = 'fetch_fail') as f,
   count(*) filter (event = 'download_complete' and status = 'ok') as d from x group by 1),
t as (select until, sum(q) over w as q, sum(a) over w as a, sum(s) over w as s, sum(o) over w as o, sum(f) over w as f, sum(d) over w as d, sum(v) over w as v from h window w as (order by until))
select epoch_us(until) as until_us, cast(v as bigint) as visited, cast(f as bigint) as failed, cast(s - o - f as bigint) as active, cast(greatest(q - s, 0) as bigint) as queued, cast(d as bigint) as files, cast(a as bigint) as apis from t"""

# --- streams --------------------------------------------------------------------

ORACLES["stream_ingest"] = f"select event_id, epoch_us(ts) as ts_us, event, url from {EVENTS} e"


def _window_counts(starts: str, hours: int) -> str:
    return f"""
with w as (select {starts} as start, event from {EVENTS} e)
select epoch_us(start) as start_us, epoch_us(start + interval {hours} hour) as end_us, event, count(*) as n from w
group by 1, 2, 3, start"""


ORACLES["stream_progress"] = _window_counts("time_bucket(interval 1 hour, ts)", 1)
ORACLES["stream_progress_sliding"] = _window_counts(
    "unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour])", 2
)
ORACLES["stream_sessions"] = f"""
with e as (select url, ts, case when ts - lag(ts) over (partition by url order by ts) < interval 6 hour then 0 else 1 end as new from {EVENTS} x),
s as (select *, sum(new) over (partition by url order by ts rows unbounded preceding) as session from e),
g as (select url, session, min(ts) as a, max(ts) + interval 6 hour as b, count(*) as n from s group by url, session)
select url, epoch_us(a) as start_us, epoch_us(b) as end_us, n from g"""
ORACLES["stream_enrich"] = f"""
with m as (select url, ts + to_minutes((event_id % 40)::int) as ts, 'files/' || md5(url) as path, 'text/html' as content_type from {EVENTS} l
           where event = 'download_complete' and event_id % 500 % 2 = 0)
select event_id, e.url, status, path, content_type from {EVENTS} e
left join m on e.url = m.url and m.ts between e.ts and e.ts + interval 30 minute where event = 'download_complete'"""
ORACLES["stream_event_sink"] = f"""
select url, 'downloads/' || md5(url) as path, sha256, bytes from {EVENTS} e where event = 'download_complete' and status = 'ok'"""

# --- sinks ----------------------------------------------------------------------

ORACLES["sink_json"] = f"""{_RECORDS}
select page_id, url, title, md5(text) as text_md5, array_to_string(links, '|') as links from r"""
ORACLES["sink_csv"] = f"{_RECORDS} select url, title, left(text, 1000) as text, len(links) as num_links from r"
ORACLES["sink_products"] = f"""
select '/p/' || p_partkey as url, p_name as title, '$' || cast(round(p_retailprice * 100) as bigint) as price,
       '{X.SITE}/list/' || {_PAGE} as source_url, '2024-02-01 00:00:00' as extracted_at, 'run1' as run_id, 2 as copies from part"""
ORACLES["sink_tables"] = f"""{_ORDER_TABLES}
select page_id, '{X.SITE}/orders/' || page_id as source_url, array_to_string(cells, '|') as headers, len(rows) as n_rows from t"""
ORACLES["sink_discoveries"] = f"""
select name, n, bytes from (select api_url as name, count(*) as n, 0 as bytes from ({_API} select * from a) group by 1)
union all select coalesce(content_type, '(all)'), count(*), cast(sum(size) as bigint) from ({_FOUND} select * from f) group by rollup (content_type)"""
ORACLES["sink_manifest"] = f"""
select {X.DOC_URL} as url, 'files/' || doc_id || '.txt' as path, sha256(text) as sha256, strlen(text) as bytes, 'text/plain' as content_type from documents"""
ORACLES["sink_events"] = f"select event_id, epoch_us(ts) as ts_us, event, status, bytes from {EVENTS} e"
ORACLES["sink_ranked"] = f"""
select endpoint || ' ' || format('{{:.3f}}', port / 1000) || 's ' || kind as line from ({_ENDPOINTS}) order by port, endpoint limit 50"""
ORACLES["decode_payloads"] = """
select doc_id, 'doc' || doc_id || '.md' as file_name, sha256(text) as sha256, strlen(text) as bytes from documents"""
ORACLES["custom_extractor"] = """
select page_id, len(regexp_extract_all(html, '<a ')) as n_links, length(html) as n_chars from pages"""
