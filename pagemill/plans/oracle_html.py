"""DuckDB SQL that reads the raw pages' HTML by patterns, for the queries on captured pages.

The markup of the test tables is flat (no block inside another), so that a page's main part can be cut before each opening
tag of a block; what the general parser does with nested markup is tested on fixtures.
"""

from __future__ import annotations

from pagemill.functions.tables import EMBEDS, UTILITY_LABELS

_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_OPEN = "h[1-6]|p|ul|ol|blockquote|pre|dl|table|img|iframe|form|video|audio"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decoded(x: str) -> str:
    """A text with its entities undone."""
    for code, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{code}', {char})"
    return x


def text_of(x: str) -> str:
    """The text of markup, with single spaces."""
    return f"trim(regexp_replace({decoded(f'''regexp_replace({x}, '<[^>]*>', ' ', 'g')''')}, {_q(_SPACE)}, ' ', 'g'))"


def attribute(x: str, name: str) -> str:
    """An attribute of the first tag of markup, or null."""
    return f"(CASE WHEN regexp_matches({x}, '^<[^>]* {name}=\"') THEN {decoded(f'''regexp_extract({x}, '^<[^>]* {name}=\"([^\"]*)\"', 1)''')} END)"


def _parts(x: str, tag: str) -> str:
    """The texts of the elements of one kind in markup, which end where the next begins or at their own end."""
    return f"list_transform(string_split(regexp_replace({x}, '<{tag}[^>]*>', chr(2), 'g'), chr(2))[2:], lambda y: {text_of(f'''regexp_replace(y, '(?s)</{tag}>.*$|</?(ul|dl|tr|table|dt|dd)>.*$', '')''')})"


_JSON = """array_to_string(list_filter(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1), lambda s: json_valid(s)), chr(10))"""
#: Tables: h (page_id, url, html), c (pieces of main parts), b (blocks in order).
BLOCKS = f"""h AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<main>(.*)</main>', 1) AS main FROM pages),
c AS (SELECT page_id, url, i, x, regexp_extract(x, '^<([a-z0-9]+)', 1) AS tag FROM (SELECT page_id, url, i, parts[i] AS x FROM (SELECT page_id, url, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT page_id, url, string_split(regexp_replace(main, '<({_OPEN})([ >])', chr(1) || '<\\1\\2', 'g'), chr(1)) AS parts FROM h)))),
d AS (SELECT page_id, i, x, tag, CASE WHEN tag LIKE 'h_' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag IN ('ul', 'ol') THEN 'list' WHEN tag = 'blockquote' THEN 'quote' WHEN tag = 'pre' THEN 'code' WHEN tag = 'dl' THEN 'definitionlist' WHEN tag = 'img' THEN 'image' WHEN tag = 'iframe' THEN 'embed' WHEN tag IN ('video', 'audio') THEN 'media' ELSE tag END AS type,
  CASE WHEN tag LIKE 'h_' THEN CAST(tag[2] AS INT) END AS level,
  CASE WHEN tag LIKE 'h_' OR tag IN ('p', 'blockquote') THEN {text_of("regexp_replace(regexp_replace(x, '^<[^>]*>', ''), '(?s)</(h[1-6]|p|blockquote)>.*$', '')")} WHEN tag = 'pre' THEN rtrim({decoded("regexp_extract(x, '(?s)<code[^>]*>(.*?)</code>', 1)")}, ' ' || chr(10) || chr(9) || chr(13)) END AS text,
  CASE WHEN tag IN ('ul', 'ol') THEN list_filter({_parts("x", "li")}, lambda y: y <> '') END AS items,
  CASE WHEN tag = 'table' THEN {_parts("x", "th")} END AS headers,
  CASE WHEN tag = 'table' THEN list_filter(list_transform(string_split(x, '<tr>')[2:], lambda r: {_parts("r", "td")}), lambda r: len(r) > 0) END AS "rows",
  CASE WHEN tag = 'dl' THEN list_filter(list_transform(list_zip({_parts("x", "dt")}, {_parts("x", "dd")}), lambda z: {{'term': z[1], 'description': z[2]}}), lambda z: z.term <> '' AND z.description <> '') END AS definitions,
  CASE WHEN tag IN ('img', 'iframe', 'video', 'audio') THEN {attribute("x", "src")} END AS src, CASE WHEN tag = 'img' THEN coalesce({attribute("x", "alt")}, '') END AS alt,
  CASE WHEN tag = 'pre' THEN nullif(regexp_extract(x, 'class="lang(?:uage)?-([^ "]*)', 1), '') END AS language,
  CASE WHEN tag = 'form' THEN list_transform(string_split(x, '<input ')[2:], lambda f: coalesce(nullif(regexp_extract(f, 'type="([^"]*)"', 1), ''), 'input') || ':' || regexp_extract(f, 'name="([^"]*)"', 1)) END AS fields,
  CASE WHEN tag = 'form' THEN upper({attribute("x", "method")}) || ' ' || CASE WHEN starts_with({attribute("x", "action")}, '/') THEN regexp_extract(url, '^https?://[^/?#]*') ELSE '' END || coalesce({attribute("x", "action")}, '') END AS target FROM c),
e AS (SELECT * FROM d WHERE CASE type WHEN 'heading' THEN text <> '' WHEN 'paragraph' THEN strlen(text) > 20 WHEN 'quote' THEN strlen(text) >= 8 WHEN 'code' THEN strlen(trim(text)) >= 4 WHEN 'list' THEN len(items) > 0 WHEN 'table' THEN len("rows") > 1 OR len("rows") = 1 AND (len("rows"[1]) > 1 OR len(headers) > 0)
  WHEN 'definitionlist' THEN len(definitions) > 0 WHEN 'image' THEN src <> '' AND NOT contains(src, '1x1') AND NOT contains(src, 'placeholder') AND NOT starts_with(src, 'data:') WHEN 'embed' THEN src <> '' AND NOT starts_with(src, 'about:') WHEN 'media' THEN src IS NOT NULL ELSE true END),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, type, src ORDER BY i) AS nth FROM e),
g AS (SELECT *, lag({{'t': type, 'l': level, 'x': text}}) OVER (PARTITION BY page_id ORDER BY i) AS before FROM f WHERE type <> 'image' OR nth = 1),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS block_idx FROM g WHERE NOT coalesce(type IN ('heading', 'paragraph') AND strlen(text) > 30 AND before.t = type AND before.l IS NOT DISTINCT FROM level AND before.x = text, false))"""
_PROVIDER = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(src), {_q(m)})" for m in marks) + f" THEN '{name}'" for name, marks in EMBEDS) + " ELSE 'iframe' END"
DETAIL = f"""CASE type WHEN 'list' THEN array_to_string(items, '|') WHEN 'table' THEN array_to_string(headers, '|') || ' / ' || array_to_string(list_transform("rows", lambda r: array_to_string(r, '|')), ' / ') WHEN 'definitionlist' THEN array_to_string(list_transform(definitions, lambda z: z.term || '=' || z.description), '|')
  WHEN 'image' THEN src || ' ' || alt WHEN 'embed' THEN {_PROVIDER} || ' ' || src WHEN 'media' THEN tag || ' ' || src WHEN 'code' THEN coalesce(language, '') WHEN 'form' THEN target || ' ' || array_to_string(fields, '|') ELSE '' END"""
_TITLE = f"coalesce(nullif({text_of('''regexp_extract(html, '(?is)<title>(.*?)</title>', 1)''')}, ''), CASE WHEN regexp_matches(html, '(?i)<title>') THEN '' ELSE 'No title' END)"
_META = f"coalesce({decoded('''nullif(regexp_extract(html, '<meta name=\"description\" content=\"([^\"]*)\"', 1), '')''')}, '')"
_CANONICAL = f"nullif({decoded('''regexp_extract(html, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)''')}, '')"
#: Captured pages with the columns that other SQL of pages reads; ``p``.
CAPTURED = f"""{BLOCKS}, k AS (SELECT page_id, list({{'type': type, 'level': level, 'text': text, 'items': items, 'caption': NULL::VARCHAR, 'headers': headers, 'rows': "rows", 'definitions': definitions, 'alt_text': alt, 'provider': CASE WHEN type = 'embed' THEN {_PROVIDER} END, 'kind': CASE WHEN type = 'media' THEN tag END}} ORDER BY block_idx) AS content_blocks FROM b GROUP BY page_id),
p AS (SELECT h.page_id, h.url, regexp_replace(regexp_extract(lower(h.url), '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '') AS site, {_TITLE} AS title, {_META} AS meta_description, {_CANONICAL} AS canonical_url, NULL::VARCHAR AS meta_robots, coalesce(k.content_blocks, []) AS content_blocks,
  list_filter(regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1), lambda s: json_valid(s)) AS structured_data FROM h LEFT JOIN k USING (page_id))"""
_ANCHORS = "a AS (SELECT page_id, url, i, parts[i] AS x FROM (SELECT page_id, url, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT page_id, url, string_split({zone}, '<a ') AS parts FROM pages)))"
_HREF = decoded("""regexp_extract(x, '^[^>]*href="([^"]*)"', 1)""")
_LABEL = text_of("regexp_replace(regexp_replace(x, '^[^>]*>', ''), '(?s)</a>.*$', '')")

SQL = {
    "page_blocks": f"WITH {BLOCKS} SELECT page_id, block_idx, type, level, text, {DETAIL} AS detail FROM b",
    "page_meta": f"SELECT page_id, {_TITLE} AS title, {_TITLE} AS meta_title, {_META} AS meta_description, NULL::VARCHAR AS og_image_url, NULL::VARCHAR AS twitter_card, NULL::VARCHAR AS meta_robots, {_CANONICAL} AS canonical_url, NULL::VARCHAR AS favicon_url, nullif(regexp_extract({_JSON}, '\"@type\": \"(?:Organization|LocalBusiness|WebSite)\"(?:[^{{}}]|\\{{[^{{}}]*\\}})*?\"logo\": (?:\\{{[^{{}}]*\"url\": )?\"([^\"]*)\"', 1), '') AS logo_url FROM pages",
    "page_nav": f"WITH {_ANCHORS.format(zone='''regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)''')}, l AS (SELECT page_id, i, {_LABEL} AS text, {_HREF} AS href FROM a), u AS (SELECT *, row_number() OVER (PARTITION BY page_id, text, href ORDER BY i) AS nth FROM l WHERE text <> '' AND href <> '')"
    f" SELECT page_id, text, href, NULL::VARCHAR AS description, CASE WHEN lower(text) IN ({', '.join(_q(x) for x in UTILITY_LABELS)}) THEN 'utility' ELSE 'header' END AS role FROM u WHERE nth = 1",
    "page_footer": f"WITH s AS (SELECT page_id, i, parts[i] AS x FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT page_id, string_split(regexp_replace(regexp_extract(html, '(?s)<footer>(.*?)(</footer>|$)', 1), '<(h[1-6]|p)([ >])', chr(1) || '<\\1\\2', 'g'), chr(1)) AS parts FROM pages))),"
    f" t AS (SELECT page_id, i, CASE WHEN x LIKE '<p%' THEN 'paragraph' ELSE 'heading' END AS type, {text_of('''regexp_replace(x, '(?s)</(h[1-6]|p)>.*$', '')''')} AS text FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY i) AS nth FROM t WHERE text <> '' AND (type = 'heading' OR strlen(text) > 5)) SELECT page_id, type, text FROM n WHERE nth = 1",
    "page_links": f"WITH {_ANCHORS.format(zone='html')}, l AS (SELECT page_id, i, url, regexp_replace({_HREF}, '#.*$', '') AS href FROM a), m AS (SELECT page_id, href, min(i) AS i FROM l WHERE regexp_extract(href, '^https?://([^/?#]*)', 1) = regexp_extract(url, '^https?://([^/?#]*)', 1) AND href <> '' GROUP BY 1, 2) SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS link_pos, href AS url FROM m",
}
