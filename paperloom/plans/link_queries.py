"""Reference linking between pages."""

from __future__ import annotations

from paperloom.functions import text as tx
from paperloom.functions import urls
from paperloom.operators import links as ops
from paperloom.plans.catalog import query
from paperloom.plans.sql import entities_decoded

U = urls.REFERENCE


def parts_sql(column: str, prefix: str) -> str:
    return ", ".join(f"regexp_extract({column}, '{U}', {group}) AS {prefix}_{name}" for name, group in urls.PARTS.items())


def dots_sql(path: str) -> str:
    """``.`` and ``..`` segments resolved."""
    named = f"(CASE WHEN starts_with({path}, '/') THEN string_split({path}, '/')[2:] ELSE string_split({path}, '/') END)"
    kept = f"""list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({named}, lambda s: [s])),
        lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN list_slice(a, 1, len(a) - 1) ELSE list_concat(a, x) END)"""
    tail = f"CASE WHEN string_split({path}, '/')[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END"
    return f"(CASE WHEN starts_with({path}, '/') THEN '/' ELSE '' END || coalesce(array_to_string(list_concat({kept}, {tail}), '/'), ''))"


def canonical_sql(url: str) -> str:
    """One statement that gives ``canonical`` of a URL column, from its parts."""
    scheme, authority, path, asked = (f"regexp_extract({url}, '{U}', {urls.PARTS[p]})" for p in ("scheme", "authority", "path", "query"))
    user = f"regexp_extract({authority}, '^(//.*@)?', 0)"
    host = f"lower(substr({authority}, length({user}) + 1))"
    for name, port in urls.DEFAULT_PORTS.items():
        host = f"CASE WHEN lower({scheme}) = '{name}' THEN regexp_replace({host}, ':{port}$', '') ELSE {host} END"
    return (
        f"(lower({scheme}) || {user} || regexp_replace({host}, ':$', '') || "
        f"CASE WHEN {authority} <> '' AND {path} = '' THEN '/' ELSE {dots_sql(path)} END || {asked})"
    )


LINKS = f"""
WITH found AS MATERIALIZED (
  SELECT page_id, o - 1 AS position, link, {parts_sql('url', 'b')}, {parts_sql(f"trim({entities_decoded('link')})", 'r')}
  FROM pages, unnest(regexp_extract_all(html, '{tx.HREF}', 1)) WITH ORDINALITY u(link, o)),
placed AS MATERIALIZED (
  SELECT page_id, position, link, r_fragment,
         CASE WHEN r_scheme <> '' THEN r_scheme ELSE b_scheme END AS scheme,
         CASE WHEN r_scheme <> '' OR r_authority <> '' THEN r_authority ELSE b_authority END AS authority,
         CASE WHEN r_scheme <> '' OR r_authority <> '' OR starts_with(r_path, '/') THEN r_path WHEN r_path = '' THEN b_path
              WHEN b_authority <> '' AND b_path = '' THEN '/' || r_path ELSE regexp_extract(b_path, '^(.*/)?', 0) || r_path END AS path,
         CASE WHEN r_scheme <> '' OR r_authority <> '' OR r_path <> '' OR r_query <> '' THEN r_query ELSE b_query END AS asked FROM found),
linked AS MATERIALIZED (
  SELECT page_id, position, link, {canonical_sql(f"(scheme || authority || {dots_sql('path')} || asked)")} AS target, substr(r_fragment, 2) AS fragment FROM placed),
known AS MATERIALIZED (SELECT {canonical_sql('url')} AS target, min(page_id) AS target_page_id FROM pages GROUP BY 1),
links AS MATERIALIZED (
  SELECT l.*, k.target_page_id, CASE WHEN k.target_page_id IS NOT NULL THEN 'page' WHEN l.target LIKE 'http:%' OR l.target LIKE 'https:%' THEN 'outside' ELSE 'other' END AS kind
  FROM linked l LEFT JOIN known k USING (target))
"""


@query("link_table", LINKS + "SELECT page_id, position, link, target, fragment, target_page_id, kind FROM links")
def link_table(t):
    """Every link of every page with the page it leads to, or outside."""
    return ops.link_table(t.pages)


@query(
    "link_degrees",
    LINKS
    + """SELECT p.page_id, coalesce(o.n, 0) AS out_links, coalesce(o.d, 0) AS out_targets, coalesce(i.n, 0) AS in_links, coalesce(i.d, 0) AS in_pages FROM pages p
         LEFT JOIN (SELECT page_id, count(*) AS n, count(DISTINCT target) AS d FROM links GROUP BY 1) o USING (page_id)
         LEFT JOIN (SELECT target_page_id AS page_id, count(*) AS n, count(DISTINCT page_id) AS d FROM links WHERE target_page_id IS NOT NULL GROUP BY 1) i USING (page_id)""",
)
def link_degrees(t):
    return ops.link_degrees(t.pages, ops.link_table(t.pages))


@query(
    "link_hosts",
    LINKS
    + f"""SELECT lower(substr(regexp_extract(target, '{U}', 3), 3)) AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM links GROUP BY 1""",
)
def link_hosts(t):
    return ops.target_hosts(ops.resolved_links(t.pages))
