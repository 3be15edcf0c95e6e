"""DuckDB SQL for queries of the core, written against the same tables."""

from __future__ import annotations

from pagemill.functions.tables import CATEGORIES, DEFAULT_EXCLUDES, EMAIL, EMBEDS, POOR_ALTS
from pagemill.operators.nested import NODE_TYPES
from pagemill.plans import oracle_html

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Pages without redelivered rows.
P = "WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY loaded_at) AS rn FROM page_data) WHERE rn = 1)"


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def part(u: str, k: int) -> str:
    return f"regexp_extract({u}, {q(_URL)}, {k})"


def valid(u: str) -> str:
    return f"(regexp_matches({u}, {q(_URL)}) AND {part(u, 2)} <> '')"


def host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower({part(u, 2)}), '^.*@', ''), ':[0-9]*$', '')"


def path(u: str) -> str:
    return f"(CASE WHEN {valid(u)} THEN CASE WHEN {part(u, 3)} = '' THEN '/' ELSE {part(u, 3)} END END)"


def any_of(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def canonical(u: str) -> str:
    s, a = f"lower({part(u, 1)})", f"lower({part(u, 2)})"
    a = f"(CASE {s} WHEN 'http' THEN regexp_replace({a}, ':(80)?$', '') WHEN 'https' THEN regexp_replace({a}, ':(443)?$', '') ELSE {a} END)"
    t = f"regexp_replace({part(u, 3)}, '/+$', '')"
    track = "utm_.*|fbclid|gclid|msclkid|ref|ref_src|mc_.*"
    pairs = f"list_filter(string_split({part(u, 4)}, '&'), lambda x: x <> '' AND NOT regexp_full_match(lower(split_part(x, '=', 1)), '{track}'))"
    pairs = f"list_transform({pairs}, lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '+', '%20'))"
    return f"(CASE WHEN {valid(u)} THEN {s} || '://' || {a} || (CASE WHEN {t} = '' THEN '/' ELSE {t} END) || (CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END) ELSE {u} END)"


def slug(u: str) -> str:
    f = f"regexp_replace(regexp_replace(regexp_replace(coalesce({path(u)}, '/'), '[^A-Za-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
    return f"(CASE WHEN {u} IS NULL THEN NULL WHEN {f} = '' THEN 'home' ELSE left({f}, 80) END)"


def host_slug(u: str) -> str:
    h = f"regexp_replace({host(u)}, '^www\\.', '')"
    f = f"regexp_replace(regexp_replace(regexp_replace({h}, '[^A-Za-z0-9-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    return f"(CASE WHEN {u} IS NULL THEN NULL WHEN {f} = '' THEN 'site' ELSE {f} END)"


def priority(u: str) -> str:
    p = f"lower({path(u)})"
    late = ("/account/", "/cart", "/checkout", "/login", "/signup", "/register", "/password", "/forgot", "/sign-in", "/sign-up", "/api/")
    return (
        f"(CASE WHEN {p} IS NULL THEN 100 WHEN {p} = '/' THEN 0 WHEN {any_of(p, ('/contact', '/kontakt'))} OR {p} LIKE '%/get-in-touch' THEN 1 WHEN contains({p}, '/about') THEN 2 "
        f"WHEN {any_of(p, ('/imprint', '/impressum', '/legal', '/privacy', '/terms'))} THEN 3 WHEN {any_of(p, late)} OR {p} LIKE '/search%' THEN 200 ELSE 100 END)"
    )


def texts(kind: str, field: str = '"text"') -> str:
    return f"list_transform(list_filter(content_blocks, lambda b: b.type = '{kind}'), lambda b: b.{field})"


def _words(text: str) -> str:
    spaces = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"coalesce(len(list_filter(regexp_split_to_array({text}, {q(spaces)}), lambda w: w <> '')), 0)"


_LISTS = """flatten(list_transform(coalesce(content_blocks, []), lambda b: CASE WHEN b.type IN ('heading', 'paragraph', 'code', 'quote') THEN [b."text"] WHEN b.type = 'list' THEN coalesce(b.items, [])
  WHEN b.type = 'table' THEN list_concat([b.caption], coalesce(b.headers, []), flatten(coalesce(b."rows", []))) WHEN b.type = 'definitionlist' THEN list_concat(list_transform(b.definitions, lambda d: d.term), list_transform(b.definitions, lambda d: d.description)) ELSE [] END))"""
TOTAL_WORDS = f"coalesce(list_sum(list_transform({_LISTS}, lambda t: {_words('t')})), 0)::BIGINT"
PLAIN = """coalesce(regexp_replace(array_to_string(list_filter(flatten(list_transform(coalesce(content_blocks, []), lambda b: CASE WHEN b.type IN ('heading', 'paragraph') THEN [b."text"] WHEN b.type = 'list' THEN coalesce(b.items, []) ELSE [] END)), lambda t: t IS NOT NULL AND t <> ''), chr(10)), '\\s+$', ''), '')"""
SIGNATURE = """coalesce(array_to_string(list_transform(content_blocks, lambda b: CASE b.type WHEN 'heading' THEN 'h' || b.level WHEN 'paragraph' THEN 'p' WHEN 'image' THEN 'img' WHEN 'list' THEN 'ul' WHEN 'media' THEN b.kind WHEN 'definitionlist' THEN 'dl' ELSE b.type END), ','), '')"""


def category() -> str:
    p, u = f"lower(coalesce({path('url')}, ''))", "lower(url)"
    hay = f"concat_ws(chr(10), {p}, {u}, lower(coalesce(title, '')), lower(coalesce({texts('heading')}[1], '')))"
    out = f"CASE WHEN {p} IN ('', '/') THEN 'home'"
    for name, needles in CATEGORIES:
        hit = any_of(hay, needles)
        if name == "blog-index":
            hit += f" OR {p} = '/blog' OR {p} LIKE '%/blog/'"
        if name == "product":
            out += f" WHEN {p} LIKE '/blog/%' AND {p} <> '/blog/' THEN 'blog-post'"
            hit += " OR len(list_filter(coalesce(structured_data, []), lambda s: coalesce(lower(CASE WHEN json_valid(s) THEN json_extract_string(s, '$.\"@type\"') END), '') = 'product')) > 0"
        out += f" WHEN {hit} THEN '{name}'"
    return out + " ELSE 'page' END"


def flags() -> str:
    h1 = "len(list_filter(coalesce(content_blocks, []), lambda b: b.type = 'heading' AND b.level = 1))"
    n = "len(coalesce(content_blocks, []))"
    alts = "list_transform(list_filter(coalesce(content_blocks, []), lambda b: b.type = 'image'), lambda b: coalesce(b.alt_text, ''))"
    poor = f"len(list_filter({alts}, lambda a: a <> '' AND (trim(lower(a)) IN ({', '.join(q(x) for x in POOR_ALTS)}) OR regexp_matches(trim(lower(a)), '\\.(jpg|jpeg|png|gif|webp|svg)$') OR regexp_full_match(trim(a), '[0-9_-]*'))))"
    missing = f"len(list_filter({alts}, lambda a: a = ''))"
    d, t, r = "strlen(coalesce(meta_description, ''))", "coalesce(title, '')", "coalesce(meta_robots, '')"
    embeds = "list_filter(coalesce(content_blocks, []), lambda b: b.type = 'embed')"
    parked = f"(words = 0 AND {n} > 0 AND len({embeds}) = {n} AND len(list_filter({embeds}, lambda b: b.provider = 'iframe')) > 0)"
    return (
        f"[CASE WHEN {n} > 0 AND {h1} = 0 THEN 'no_h1' END, CASE WHEN {h1} > 1 THEN 'multiple_h1:' || {h1} END, CASE WHEN {d} = 0 THEN 'no_meta_description' WHEN {d} > 160 THEN 'meta_description_too_long' WHEN {d} < 50 THEN 'meta_description_too_short' END, "
        f"CASE WHEN {t} IN ('', 'No title') THEN 'no_title' WHEN strlen({t}) > 70 THEN 'title_too_long' END, CASE WHEN canonical_url IS NULL THEN 'no_canonical' END, CASE WHEN contains({r}, 'noindex') OR contains({r}, 'none') THEN 'meta_robots_noindex' END, "
        f"CASE WHEN contains({r}, 'nofollow') THEN 'meta_robots_nofollow' END, CASE WHEN {missing} > 0 THEN 'images_missing_alt:' || {missing} END, CASE WHEN {poor} > 0 THEN 'images_low_quality_alt:' || {poor} END, CASE WHEN {n} > 0 AND words < 100 THEN 'thin_content' END, CASE WHEN {parked} THEN 'parked_domain' END]"
    )


_WORDS = f"{P}, w AS (SELECT *, {TOTAL_WORDS} AS words FROM p)"
_SIG = f"{P}, s AS (SELECT site, url, page_id, {SIGNATURE} AS signature FROM p)"
_HREF = r"<a [^>]*href=""[^""]*"""
_EXCLUDED = any_of("url", DEFAULT_EXCLUDES)
_MAILS = f"WITH c AS (SELECT doc_id, source, unnest(regexp_extract_all(text, {q(EMAIL)})) AS email FROM documents)"
_EDGE = "WITH e AS (SELECT DISTINCT site, src_url, dst_url FROM link_edges WHERE {same})"

_CHILDREN = "CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: '.' || k) WHEN 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: '[' || i || ']') ELSE [] END"
_ENTRIES = "SELECT page_id, '{column}[' || i || '].{field}[' || (k - 1) || ']' AS node_path, '{column}[' || i || ']' AS parent_path FROM (SELECT page_id, i, e, unnest(range(1, len(e) + 1)) AS k FROM (SELECT page_id, i - 1 AS i, content_blocks[i].{field} AS e FROM b)) WHERE e[k] IS NOT NULL"

_MARKS = "list_transform(content_blocks[i].{field}, lambda e: CASE WHEN e IS NULL THEN 'null' ELSE '{{}}' END)"
_BLOCK_JSON = "'{' || array_to_string(list_filter([" + ", ".join(f"""CASE WHEN len(content_blocks[i].{f}) > 0 THEN '"{f}":[' || array_to_string({_MARKS.format(field=f)}, ',') || ']' END""" for f in ("fields", "definitions")) + "], lambda x: x IS NOT NULL), ',') || '}'"
#: Nodes with interval labels: a node's place among all objects and arrays of its page, which stand in the order of their paths' positions, and
#: as many places less in post-order as it has ancestors, as many more as it holds nodes.
_NODES = (
    P.replace("WITH", "WITH RECURSIVE", 1)
    + f""", t AS (SELECT page_id, 'structured_data[' || (i - 1) || ']' AS path, structured_data[i]::JSON AS j, [0, i] AS key, NULL::VARCHAR AS kind FROM (SELECT page_id, structured_data, unnest(range(1, len(structured_data) + 1)) AS i FROM p) WHERE json_valid(structured_data[i])
      UNION ALL SELECT page_id, 'content_blocks[' || (i - 1) || ']', ({_BLOCK_JSON})::JSON, [1, i], content_blocks[i].type FROM (SELECT page_id, content_blocks, unnest(range(1, len(content_blocks) + 1)) AS i FROM p) WHERE content_blocks[i].type IS NOT NULL),
    r AS (SELECT page_id, path, j, '' AS parent, key, kind, 0 AS depth, '' AS name FROM t
      UNION ALL SELECT page_id, path || c, json_extract(j, '$' || CASE WHEN starts_with(c, '.') THEN '."' || substr(c, 2) || '"' ELSE c END), CASE WHEN json_type(j) = 'OBJECT' THEN path ELSE parent END, list_append(key, k), NULL::VARCHAR, depth + 1, CASE WHEN json_type(j) = 'OBJECT' THEN substr(c, 2) ELSE name || c END
        FROM (SELECT *, ch[k] AS c FROM (SELECT *, unnest(range(1, len(ch) + 1)) AS k FROM (SELECT *, {_CHILDREN} AS ch FROM r)))),
    o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY key) - 1 AS pre FROM r WHERE json_type(j) IN ('OBJECT', 'ARRAY')),
    s AS (SELECT a.page_id, a.pre, count(b.pre) AS inside FROM o a LEFT JOIN o b ON a.page_id = b.page_id AND len(b.key) > len(a.key) AND b.key[:len(a.key)] = a.key GROUP BY 1, 2),
    n AS (SELECT o.page_id, o.pre, o.pre - o.depth + s.inside AS post, o.depth, coalesce(o.kind, CASE WHEN json_type(o.j, '$."@type"') = 'VARCHAR' THEN json_extract_string(o.j, '$."@type"') END, 'object') AS node_type, o.path AS node_path, o.parent AS parent_path FROM o JOIN s ON s.page_id = o.page_id AND s.pre = o.pre WHERE json_type(o.j) = 'OBJECT')"""
)
_LABELS = "CAST(n.pre AS INT) AS pre, CAST(n.post AS INT) AS post, CAST(n.depth AS INT) AS depth, n.node_type, n.node_path, CAST(coalesce(u.pre, -1) AS INT) AS parent_pre, n.parent_path FROM n LEFT JOIN n u ON u.page_id = n.page_id AND u.node_path = n.parent_path"

_STRINGS = ("type", "text", "original_url", "local_path", "alt_text", "action", "method", "submit_text", "purpose", "provider", "src", "title", "caption", "language", "cite", "kind", "poster")
_FIELD_STRINGS, _ENTRY_STRINGS = ("field_type", "name", "label", "placeholder"), ("term", "description")


def _scalar(source: str, path: str, name: str, value: str, kind: str) -> str:
    return f"SELECT page_id, {path} AS path, {name} AS name, CASE WHEN {value} IS NULL THEN 'null' ELSE '{kind}' END AS kind, CAST({value} AS VARCHAR) AS value FROM {source}"


def _block_values() -> str:
    """The values of blocks and of their entries, by path of their owner."""
    block, entry = "'content_blocks[' || i || ']'", "'content_blocks[' || i || '].{f}[' || (k - 1) || ']'"
    out = [_scalar("b WHERE x.%s IS NOT NULL" % c, block, f"'{c}'", f'x."{c}"', "string") for c in _STRINGS] + [_scalar("b WHERE x.level IS NOT NULL", block, "'level'", "x.level", "number")]
    out += [_scalar(f"(SELECT page_id, i, x.{c} AS y, unnest(range(1, len(x.{c}) + 1)) AS k FROM b)", block, f"'{c}[' || (k - 1) || ']'", "y[k]", "string") for c in ("items", "headers")]
    out.append(_scalar("(SELECT *, unnest(range(1, len(r) + 1)) AS m FROM (SELECT *, y[k] AS r FROM (SELECT page_id, i, x.\"rows\" AS y, unnest(range(1, len(x.\"rows\") + 1)) AS k FROM b)))", block, "'rows[' || (k - 1) || '][' || (m - 1) || ']'", "r[m]", "string"))
    for f, names in (("fields", _FIELD_STRINGS), ("definitions", _ENTRY_STRINGS)):
        source = f"(SELECT *, y[k] AS e FROM (SELECT page_id, i, x.{f} AS y, unnest(range(1, len(x.{f}) + 1)) AS k FROM b))"
        out += [_scalar(f"{source} WHERE e.{c} IS NOT NULL", entry.format(f=f), f"'{c}'", f"e.{c}", "string") for c in names]
        if f == "fields":
            out.append(_scalar(f"{source} WHERE e.required IS NOT NULL", entry.format(f=f), "'required'", "e.required", "bool"))
            out.append(_scalar(f"(SELECT *, e.options AS o, unnest(range(1, len(e.options) + 1)) AS m FROM {source})", entry.format(f=f), "'options[' || (m - 1) || ']'", "o[m]", "string"))
    return " UNION ALL ".join(out)


SQL = {
    "p2_block_attributes": f"{_NODES}, b AS (SELECT page_id, i - 1 AS i, content_blocks[i] AS x FROM (SELECT page_id, content_blocks, unnest(range(1, len(content_blocks) + 1)) AS i FROM p)), v AS ({_block_values()}) SELECT v.page_id, CAST(n.pre AS INT) AS owner_pre, v.name, v.kind, v.value FROM v JOIN n ON n.page_id = v.page_id AND n.node_path = v.path",
    "page_compact": f"{P} SELECT page_id, site, url, title, {category()} AS category, meta_description, {texts('heading')}[1] AS primary_heading, {TOTAL_WORDS} AS word_count, CAST(len(list_filter(coalesce(content_blocks, []), lambda b: b.type = 'image')) AS INT) AS image_count, len(list_filter(coalesce(content_blocks, []), lambda b: b.type = 'form')) > 0 AS has_form, "
    f"CAST(coalesce(len(internal_links_out), 0) AS INT) AS internal_links_out, coalesce(array_to_string({texts('heading')}[:20], '|'), '') AS headings FROM p",
    "p2_nodes": f"{_NODES} SELECT n.page_id, {_LABELS}",
    **{f"p2_nodes_{t.lower()}": f"{_NODES} SELECT n.page_id, {_LABELS} WHERE n.node_type = '{t}'" for t in NODE_TYPES},
    "p2_nodes_other": f"{_NODES} SELECT n.page_id, {_LABELS} WHERE n.node_type NOT IN ({', '.join(q(t) for t in NODE_TYPES)})",
    "p2_attributes": f"{_NODES}, v AS (SELECT page_id, parent, key, CASE json_type(j) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, CASE json_type(j) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(j, '$') ELSE j::VARCHAR END AS value, name FROM r WHERE json_type(j) NOT IN ('OBJECT', 'ARRAY') AND starts_with(path, 'structured_data') AND parent <> '')"
    " SELECT v.page_id, CAST(n.pre AS INT) AS owner_pre, v.name, v.kind, v.value FROM v JOIN n ON n.page_id = v.page_id AND n.node_path = v.parent",
    "p2_enclosed": f"{_NODES} SELECT a.page_id, CAST(a.pre AS INT) AS inner_pre, CAST(b.pre AS INT) AS outer_pre FROM n a JOIN n b ON a.page_id = b.page_id AND b.pre < a.pre AND b.post > a.post WHERE a.node_type = 'Offer' AND b.node_type = 'Product'",
    **oracle_html.SQL,
    "category_summary": f"WITH {oracle_html.CAPTURED} SELECT site, {category()} AS category, count(*) AS pages, round(avg({TOTAL_WORDS}), 2) AS mean_words FROM p GROUP BY 1, 2",
    "page_derived": f"WITH {oracle_html.CAPTURED}, w AS (SELECT *, {TOTAL_WORDS} AS words, {PLAIN} AS t FROM p) SELECT page_id, words AS total_words, CASE WHEN t = '' THEN '' ELSE left(sha256(t), 16) END AS content_hash, length(t) // 4 AS token_estimate, "
    f"coalesce(trim(left(coalesce(nullif(meta_description, ''), nullif({texts('paragraph')}[1], ''), {texts('heading')}[1], ''), 200)), '') AS summary, {category()} AS category, {SIGNATURE} AS signature, array_to_string(list_filter({flags()}, lambda f: f IS NOT NULL), ',') AS quality_flags FROM w",
    "p2_found": P.replace("WITH", "WITH RECURSIVE", 1)
    + f""", b AS (SELECT page_id, content_blocks, unnest(range(1, len(content_blocks) + 1)) AS i FROM p),
    r AS (SELECT page_id, 'structured_data[' || (i - 1) || ']' AS path, structured_data[i]::JSON AS j, '' AS parent FROM (SELECT page_id, structured_data, unnest(range(1, len(structured_data) + 1)) AS i FROM p) WHERE json_valid(structured_data[i])
      UNION ALL SELECT page_id, path || c, json_extract(j, '$' || CASE WHEN starts_with(c, '.') THEN '."' || substr(c, 2) || '"' ELSE c END), CASE WHEN json_type(j) = 'OBJECT' THEN path ELSE parent END FROM (SELECT *, unnest({_CHILDREN}) AS c FROM r))
    SELECT page_id, path AS node_path, parent AS parent_path FROM r WHERE json_type(j) = 'OBJECT'
    UNION ALL SELECT page_id, 'content_blocks[' || (i - 1) || ']', '' FROM b WHERE content_blocks[i].type IS NOT NULL
    UNION ALL {_ENTRIES.format(column="content_blocks", field="fields")} UNION ALL {_ENTRIES.format(column="content_blocks", field="definitions")}""",
    "url_canonical": f"SELECT page_id, url, {canonical('url')} AS canonical FROM page_data GROUP BY ALL",
    "url_slug": f"SELECT page_id, {slug('url')} AS slug, {host_slug('url')} AS host_slug FROM page_data GROUP BY ALL",
    "url_priority": f"SELECT page_id, {priority('url')} AS priority FROM page_data GROUP BY ALL",
    "url_filter": f"SELECT page_id, url FROM page_data WHERE NOT {_EXCLUDED} GROUP BY ALL",
    "url_plan": f"WITH l AS (SELECT site, url, min(page_id) AS ord FROM page_data GROUP BY 1, 2), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {priority('url')}, ord, url) AS k FROM l) WHERE k <= 50), d AS (SELECT site, {canonical('url')} AS url, min(ord) AS ord FROM c GROUP BY 1, 2) SELECT site, url, ord FROM d WHERE NOT {_EXCLUDED}",
    "url_images": f"{P}, i AS (SELECT page_id, unnest(list_transform(list_filter(content_blocks, lambda b: b.type = 'image'), lambda b: b.original_url)) AS url FROM p) SELECT DISTINCT page_id, url, 'images/' || left(sha256(url), 16) || '.' || regexp_extract(lower(url), '\\.(svg|png|webp|gif|avif|bmp|ico|jpg)', 1) AS asset FROM i",
    "embed_providers": f"{P}, b AS (SELECT page_id, unnest(content_blocks) AS b FROM p) SELECT DISTINCT page_id, b.src AS src, CASE " + " ".join(f"WHEN {any_of('lower(b.src)', marks)} THEN '{name}'" for name, marks in EMBEDS) + " ELSE 'iframe' END AS provider FROM b WHERE b.type = 'embed'",
    "page_words": f"{P} SELECT page_id, {TOTAL_WORDS} AS words FROM p",
    "page_text": f"{P}, t AS (SELECT page_id, {PLAIN} AS t FROM p) SELECT page_id, CASE WHEN t = '' THEN '' ELSE left(sha256(t), 16) END AS content_hash, length(t) // 4 AS token_estimate FROM t",
    "page_summary_text": f"""{P} SELECT page_id, trim(left(coalesce(nullif(meta_description, ''), nullif({texts('paragraph')}[1], ''), {texts('heading')}[1], ''), 200)) AS summary FROM p""",
    "page_category": f"{P} SELECT page_id, {category()} AS category FROM p",
    "page_signature": f"{_SIG} SELECT page_id, signature FROM s",
    "category_counts": f"{P} SELECT site, {category()} AS category, count(*) AS pages, round(avg({TOTAL_WORDS}), 2) AS mean_words FROM p GROUP BY 1, 2",
    "quality_flags": f"{_WORDS} SELECT page_id, array_to_string(list_filter({flags()}, lambda f: f IS NOT NULL), ',') AS flags FROM w",
    "quality_flag_counts": f"{_WORDS}, f AS (SELECT site, unnest(list_filter({flags()}, lambda f: f IS NOT NULL)) AS flag FROM w) SELECT site, split_part(flag, ':', 1) AS flag, count(*) AS pages FROM f GROUP BY 1, 2",
    "templates": f"{_SIG} SELECT site, 'tpl_' || left(sha256(signature), 8) AS template_id, signature AS block_pattern, count(*) AS page_count, min(url) AS sample_page FROM s WHERE signature <> '' GROUP BY site, signature HAVING count(*) >= 2",
    "template_pages": f"{_SIG}, m AS (SELECT *, count(*) OVER (PARTITION BY site, signature) AS k FROM s WHERE signature <> '') SELECT site, 'tpl_' || left(sha256(signature), 8) AS template_id, url FROM m WHERE k >= 2",
    "hreflang_urls": f"{P} SELECT DISTINCT site, h.lang AS lang, h.url AS url FROM (SELECT site, unnest(hreflang_alternates) AS h FROM p)",
    "link_inbound": f"{P}, t AS (SELECT site, unnest(list_distinct(internal_links_out)) AS target FROM p) SELECT site AS link_site, target, count(*) AS internal_links_in FROM t GROUP BY 1, 2",
    "edge_inbound": "WITH e AS (SELECT DISTINCT site, src_url, dst_url FROM link_edges WHERE src_url <> dst_url) SELECT site, dst_url, count(*) AS sources FROM e GROUP BY 1, 2",
    "page_summaries": f"{P}, t AS (SELECT site, target, count(*) AS k FROM (SELECT site, unnest(list_distinct(internal_links_out)) AS target FROM p) GROUP BY 1, 2) SELECT p.page_id, p.site, p.url, {category()} AS category, {TOTAL_WORDS} AS word_count, CAST(len(coalesce(content_blocks, [])) AS INT) AS block_count, CAST(len(coalesce({texts('image')}, [])) AS INT) AS image_count, len(coalesce({texts('form')}, [])) > 0 AS has_form, {texts('heading')}[1] AS primary_heading, CAST(len(coalesce(internal_links_out, [])) AS INT) AS internal_links_out, coalesce(t.k, 0) AS internal_links_in FROM p LEFT JOIN t ON t.site IS NOT DISTINCT FROM p.site AND t.target = p.url",
    "site_firsts": f"{P} SELECT site, arg_min(language, page_id) FILTER (language IS NOT NULL) AS language, array_to_string(list_transform(arg_min(nav_links, page_id) FILTER (len(nav_links) > 0), lambda n: n.text), '|') AS primary_nav, count(*) AS total_pages FROM p GROUP BY 1",
    "outcome_counts": "WITH u AS (SELECT site, url, max(ok) AS ok FROM (SELECT site, url, 1 AS ok FROM page_data UNION ALL SELECT site, url, 0 FROM skipped_pages) GROUP BY 1, 2) SELECT site, CAST(sum(ok) AS BIGINT) AS captured, CAST(sum(1 - ok) AS BIGINT) AS skipped, count(*) AS attempted FROM u GROUP BY 1",
    "skip_reasons": "SELECT site, coalesce(reason, 'render_failed') AS reason, count(DISTINCT url) AS pages FROM skipped_pages GROUP BY 1, 2",
    "document_emails": f"{_MAILS} SELECT doc_id, email, count(*) AS k FROM c GROUP BY 1, 2",
    "crawl_depths": f"WITH RECURSIVE e AS (SELECT DISTINCT site, src_url, regexp_replace(dst_url, '#.*$', '') AS dst_url FROM link_edges WHERE {host('dst_url')} = {host('src_url')} AND NOT {any_of('dst_url', DEFAULT_EXCLUDES)}), s AS (SELECT site, min(src_url) AS url FROM link_edges WHERE site IS NOT NULL GROUP BY 1), c AS (SELECT site, url, 0 AS depth FROM s UNION SELECT e.site, e.dst_url, c.depth + 1 FROM c JOIN e ON e.site = c.site AND e.src_url = c.url WHERE c.depth < 3) SELECT site, url, min(depth) AS depth FROM c GROUP BY 1, 2",
    "robots_allowed": f"SELECT DISTINCT site, url FROM page_data WHERE site IS NOT NULL AND NOT ({path('url')} LIKE '/shop/%' OR {path('url')} LIKE '/legal%' OR {path('url')} = '/blog')",
    "sitemap_pages": "SELECT DISTINCT site, url FROM page_data WHERE site IS NOT NULL AND url IS NOT NULL AND NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(xml|txt|md|json)$')",
    "css_colours": "WITH r AS (SELECT source AS site, unnest(regexp_extract_all(lower(text), '#(?:[0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3})\\b')) AS value FROM documents WHERE regexp_matches(text, '\\{[^{}]*[a-z-]+\\s*:[^{}]*\\}')) SELECT site, value, count(*) AS count FROM r WHERE value NOT IN ('#fff', '#ffffff', '#000', '#000000', '#00000000') AND NOT (length(value) = 9 AND value LIKE '%00') GROUP BY 1, 2",
    "page_title": "SELECT page_id, coalesce(nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')), ''), CASE WHEN regexp_matches(html, '(?i)<title>') THEN '' ELSE 'No title' END) AS title FROM pages",
    "page_language": "SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1), '') AS language FROM pages",
}
