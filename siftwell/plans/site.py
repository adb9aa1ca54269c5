"""Queries over captured pages."""

from pyspark.sql import functions as F

from ..operators import extract, filters, frontier, urls, verdicts
from ._book import Book, literal

B = Book()
QUERIES, ORACLE_SQL = B.queries, B.sql


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, '{PARTS}', {n})"


VARIABLE = r"(regexp_matches(s, '^\d+$') OR regexp_matches(s, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') OR regexp_matches(s, '^\d{4}([-/]\d{1,2}){0,2}$') OR regexp_matches(s, '^[0-9a-fA-F]{8,}$') OR (strlen(s) >= 12 AND regexp_matches(s, '[0-9]')))"
TEMPLATE = f"""{part('url', 2)} || array_to_string(list_transform(string_split({part('url', 3)}, '/'), lambda s: CASE WHEN {VARIABLE} THEN '{{}}' ELSE s END), '/') ||
  CASE WHEN {part('url', 4)} <> '' THEN '?' || array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({part('url', 4)}, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1)))), '&') ELSE '' END"""
EXT = f"regexp_extract(lower(regexp_extract({part('url', 3)}, '[^/]*$')), '(\\.[^.]*)$', 1)"
RICH = "(" + ", ".join(literal("." + x) for x in urls.RICH) + ")"
PAGE = "(" + ", ".join(literal("." + x) for x in urls.PAGES) + ")"
SCORE = f"CASE WHEN {EXT} IN {RICH} THEN 100 WHEN regexp_matches({part('url', 3)}, {literal(urls.API_PATH)}) THEN 90 WHEN {EXT} = '' THEN 70 WHEN {EXT} IN {PAGE} THEN 40 ELSE 50 END"
LEVELS = f"list_transform(range(0, len(p) + 1), lambda i: CASE WHEN i = 0 THEN '/' ELSE '/' || array_to_string(p[1:i], '/') || '/' END)"
SEGMENTS = f"list_filter(string_split(regexp_replace({part('url', 3)}, '[^/]*$', ''), '/'), lambda x: x <> '')"
RESOLVED = f"""CASE WHEN {part('ref', 1)} <> '' THEN ref WHEN starts_with(ref, '//') THEN {part('url', 1)} || ':' || ref WHEN starts_with(ref, '/') THEN {part('url', 1)} || '://' || {part('url', 2)} || ref
  ELSE {part('url', 1)} || '://' || {part('url', 2)} || regexp_replace(CASE WHEN {part('url', 3)} = '' THEN '/' ELSE {part('url', 3)} END, '[^/]*$', '') || ref END"""
LINKS = f"""raw AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, {literal(extract.ATTRIBUTE)}, 1))) AS r FROM pages),
  refs AS (SELECT DISTINCT url, regexp_replace(replace(r, '&amp;', '&'), '#.*$', '') AS ref, r FROM raw WHERE NOT starts_with(r, '#') AND NOT regexp_matches(lower(r), '^(?:javascript|mailto|tel|data|blob|about|sms|callto):') AND NOT regexp_matches(r, '[{{}}<>]')),
  links AS (SELECT DISTINCT url AS source, {RESOLVED} AS value FROM refs WHERE ref <> ''),
  web AS (SELECT * FROM links WHERE regexp_matches(value, '^https?://[^/?#]'))"""


@B.add("page_links", f"WITH {LINKS} SELECT source, value FROM web")
def page_links(spark, sf_dir):
    return extract.page_links(_pages(spark, sf_dir))


@B.add("page_inline_scripts", f"SELECT page_id, unnest(regexp_extract_all(html, {literal(extract.SCRIPT)}, 1)) AS script FROM pages")
def page_inline_scripts(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(extract.inline_scripts(F.col("html"))).alias("script"))


@B.add("page_url_template", f"SELECT page_id, {TEMPLATE} AS template FROM pages")
def page_url_template(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.template_key(F.col("url")).alias("template"))


@B.add("template_sample", f"WITH t AS (SELECT page_id, {TEMPLATE} AS template FROM pages) SELECT page_id, template, CAST(row_number() OVER (PARTITION BY template ORDER BY page_id) AS BIGINT) AS rank FROM t QUALIFY rank <= 3")
def template_sample(spark, sf_dir):
    return frontier.template_sample(_pages(spark, sf_dir), ["page_id"]).select("page_id", "template", F.col("rank").cast("long"))


SIGNATURE = "'200|' || len(list_filter(string_split_regex(html, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) || '|' || (length(html) - length(replace(html, chr(10), '')) + 1)"


@B.add("page_signature", f"SELECT page_id, {SIGNATURE} AS signature FROM pages")
def page_signature(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", verdicts.page_signature(F.lit(200), F.col("html")).alias("signature"))


STRUCTURE = """t AS (SELECT page_id, url, html, unnest(CASE WHEN len(regexp_extract_all(html, '(?i)<([a-z][a-z0-9]*)', 1)) > 0 THEN list_transform(regexp_extract_all(html, '(?i)<([a-z][a-z0-9]*)', 1), lambda x: lower(x)) ELSE [NULL] END) AS tag FROM pages),
  c AS (SELECT page_id, url, tag, count(*) AS n, any_value(strlen(html)) AS size FROM t GROUP BY page_id, url, tag),
  g AS (SELECT page_id, url, coalesce(string_agg(tag || ':' || length(bin(n)), ';' ORDER BY tag), 'len:' || length(bin(any_value(size)))) AS signature FROM c GROUP BY page_id, url)"""


@B.add("page_structural_sig", f"WITH {STRUCTURE} SELECT page_id, signature FROM g")
def page_structural_sig(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", verdicts.structural_signature(F.col("html")).alias("signature"))


@B.add("structural_cap", f"WITH {STRUCTURE} SELECT page_id, signature FROM g QUALIFY row_number() OVER (PARTITION BY {part('url', 2)}, signature ORDER BY page_id) <= 3")
def structural_cap(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("host", urls.authority(F.col("url")))
    return verdicts.structural_cap(p, "host", "html", "page_id").select("page_id", "signature")


@B.add("target_score", f"SELECT page_id, {SCORE} AS score FROM pages")
def target_score(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.target_score(F.col("url")).alias("score"))


@B.add("frontier_order", f"SELECT page_id, score FROM (SELECT page_id, page_id % 3 AS depth, {SCORE} AS score FROM pages) ORDER BY page_id = 0 DESC, depth, score DESC, page_id")
def frontier_order(spark, sf_dir):
    return frontier.ordered(_targets(spark, sf_dir)).select(F.col("seq").alias("page_id"), "score")


def _targets(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("url", (F.col("page_id") % 3).alias("depth"), (F.col("page_id") == 0).alias("seed"), F.lit(False).alias("permuted"), F.lit("").alias("passive_source"), F.col("page_id").alias("seq"))


@B.add("frontier_order_whole", f"SELECT page_id, score, row_number() OVER (ORDER BY page_id = 0 DESC, depth, score DESC, page_id) AS place FROM (SELECT page_id, page_id % 3 AS depth, {SCORE} AS score FROM pages)")
def frontier_order_whole(spark, sf_dir):
    return frontier.placed(_targets(spark, sf_dir)).select(F.col("seq").alias("page_id"), "score", "place")


@B.add("levels_with_ancestors", f"WITH s AS (SELECT page_id, {SEGMENTS} AS p FROM pages) SELECT page_id, unnest({LEVELS}) AS level FROM s")
def levels_with_ancestors(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(urls.levels(F.col("url"))).alias("level"))


# the variants of a path and their scores, by the rules of the blueprint: see permutation_cases for written-out values
PERMUTED = f"""o AS (SELECT DISTINCT {part('url', 1)} || '://' || {part('url', 2)} AS origin, regexp_replace(url, '#.*', '') AS url, {part('url', 4)} AS query, substr({part('url', 3)}, 2) AS pp, {SEGMENTS} AS p, {SCORE} AS score FROM pages),
  k AS (SELECT * FROM o WHERE origin IN (SELECT origin FROM o GROUP BY origin HAVING count(*) > 1)),
  q AS (SELECT *, string_split(regexp_replace(pp, '/$', ''), '/') AS s, CASE WHEN ends_with(pp, '/') THEN '/' ELSE '' END AS e FROM k WHERE pp <> ''),
  lv AS (SELECT DISTINCT origin, unnest({LEVELS}) AS level FROM k),
  v AS (SELECT origin, query, pp AS path, 0 AS t, false AS mount FROM q
    UNION ALL SELECT origin, query, array_to_string(s[2:], '/') || e, 1, true FROM q WHERE len(s) > 1 AND regexp_matches(lower(s[1]), '^(api|rest|rpc|legacy|old|public|private|static|assets|asset|scripts|script|js|src|dist|build|app|web|v[0-9]+)$')
    UNION ALL SELECT origin, query, array_to_string(s[-2:], '/') || e, len(s) - 2, false FROM q WHERE len(s) > 2
    UNION ALL SELECT origin, query, s[-1] || e, len(s) - 1, false FROM q WHERE len(s) > 1 AND score IN (100, 90)),
  w AS (SELECT DISTINCT ON (origin, path, query) * FROM v WHERE path <> '' ORDER BY origin, path, query, (CASE WHEN mount THEN 500 ELSE 0 END - 150 * t) DESC),
  made AS (SELECT lv.origin || level || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url, level, path, t, mount FROM lv JOIN w USING (origin)),
  scored AS (SELECT url, max({SCORE} * 100 - 150 * t - 5 * (length(path) - length(replace(path, '/', ''))) + CASE WHEN mount THEN 500 ELSE 0 END
    + CASE WHEN level = '/' THEN -50 WHEN lower(regexp_extract(level, '([^/]*)/$', 1)) = lower(string_split(trim(path, '/'), '/')[1]) THEN -3000 ELSE 200 END) AS score
    FROM made WHERE lower(regexp_extract(regexp_extract({part('url', 3)}, '[^/]*$'), '\\.([^.]*)$', 1)) NOT IN ({', '.join(map(literal, filters.ASSETS))}) GROUP BY url)"""


@B.add("permute_candidates", f"WITH {PERMUTED} SELECT url, score FROM scored WHERE url NOT IN (SELECT url FROM o)")
def permute_candidates(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return frontier.permuted(p, p)


@B.add("permute_best", f"WITH {PERMUTED} SELECT url, score FROM scored WHERE url NOT IN (SELECT url FROM o) ORDER BY score DESC, url LIMIT 25")
def permute_best(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return frontier.best(frontier.permuted(p, p), 25, once=True)


@B.add("scope_filter", f"WITH h AS (SELECT page_id, regexp_replace(lower({part('url', 2)}), '^www\\.', '') AS h FROM pages), b AS (SELECT h AS b FROM h WHERE page_id = 0) SELECT page_id FROM h, b WHERE h = b OR ends_with(h, '.' || b)")
def scope_filter(spark, sf_dir):
    p = _pages(spark, sf_dir)
    base = p.where("page_id = 0").select(urls.host(F.col("url")).alias("base"))  # one row, or none where there is no such page
    return p.join(F.broadcast(base), filters.same_scope(F.col("base"), urls.host(F.col("url")))).select("page_id")


@B.add("allowlist_anti", "SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('1'), ('7')) s(x) WHERE ends_with(p.url, s.x))")
def allowlist_anti(spark, sf_dir):
    p = _pages(spark, sf_dir).withColumn("source", F.col("url"))
    return frontier.without_listed(p, spark.createDataFrame([("1",), ("7",)], "suffix string")).select("page_id")


@B.add("crawl_reachability", f"WITH RECURSIVE {LINKS}, walk(url, depth) AS (SELECT url, 0 FROM pages WHERE page_id = 0 UNION SELECT w.value, walk.depth + 1 FROM walk JOIN web w ON w.source = walk.url WHERE walk.depth < 3) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url")
def crawl_reachability(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return frontier.reached(spark, extract.page_links(p), p.where("page_id = 0").select("url"), 3)


@B.add("crawlable_links", f"WITH {LINKS} SELECT DISTINCT value FROM web WHERE lower(regexp_extract(regexp_extract({part('value', 3)}, '[^/]*$'), '\\.([^.]*)$', 1)) NOT IN ({', '.join(map(literal, filters.ASSETS))})")
def crawlable_links(spark, sf_dir):
    return extract.page_links(_pages(spark, sf_dir)).where(filters.crawlable(urls.path(F.col("value")))).select("value").distinct()


@B.add("valid_link_hosts", f"WITH {LINKS}, h AS (SELECT DISTINCT value, lower(regexp_replace({part('value', 2)}, ':[0-9]*$', '')) AS h FROM web) SELECT value FROM h WHERE regexp_matches(h, '^(?:[a-z0-9-]+\\.)+[a-z]{{2,}}$') AND NOT ends_with(h, '.local') AND NOT contains(value, '...') AND NOT regexp_matches(h, '(?:^|\\.)(?:{'|'.join(n.replace('.', chr(92) + '.') for n in filters.NOISE_HOSTS)})$')")
def valid_link_hosts(spark, sf_dir):
    return extract.page_links(_pages(spark, sf_dir)).where(filters.endpoint_url(F.col("value"))).select("value").distinct()


@B.add("page_endpoints", f"SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, {literal(extract.QUOTED)}, 1), lambda v: v <> ''))) AS value FROM pages")
def page_endpoints(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.explode(extract.endpoints(F.col("html"))).alias("value"))
