"""DuckDB oracle SQL: the fixture views of FIXTURES.md §3 as CTEs, prepended to each oracle query on demand.

The driver registers only the base tables in DuckDB, so :func:`with_views` inlines every fixture view a query
mentions (plus their dependencies, in dependency order) as a ``WITH`` clause.
"""

from __future__ import annotations

import re

# The fixture view definitions (FIXTURES.md §3), written as portable SQL.
FIXTURE_VIEWS: dict[str, str] = {
    "agencies": """SELECT s.s_suppkey AS agency_id, s.s_name AS name, r.r_name AS state, n.n_name AS county,
 CAST(NULL AS VARCHAR) AS locality
 FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey JOIN region r ON n.n_regionkey=r.r_regionkey""",
    "batches": """SELECT o_orderkey AS id,
 CASE o_orderkey % 8 WHEN 0 THEN 'example' WHEN 1 THEN 'auto_googler' WHEN 2 THEN 'common_crawler'
  WHEN 3 THEN 'muckrock_simple_search' WHEN 4 THEN 'muckrock_county_search' WHEN 5 THEN 'muckrock_all_search'
  WHEN 6 THEN 'ckan' ELSE 'manual' END AS strategy,
 CASE o_orderstatus WHEN 'F' THEN 'ready to label' WHEN 'O' THEN 'in-process' ELSE 'error' END AS status,
 o_custkey AS user_id, o_orderdate AS date_generated, o_totalprice AS compute_time FROM orders""",
    "collected": """SELECT l_suppkey*10000000+l_partkey AS url_id,
 CONCAT('https://s', CAST(l_suppkey AS VARCHAR), '.example.org/p/', CAST(l_partkey AS VARCHAR)) AS url,
 l_orderkey AS batch_id, l_suppkey, l_partkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, l_discount,
 l_tax, l_returnflag, l_linestatus FROM lineitem""",
    "ranked": """SELECT *, ROW_NUMBER() OVER (PARTITION BY url_id
 ORDER BY batch_id, l_linenumber, l_shipdate, l_extendedprice, l_quantity) AS rn FROM collected""",
    "urls": """SELECT url_id AS id, url, l_shipdate AS created_at,
 CASE (l_partkey + 3*l_suppkey) % 10 WHEN 4 THEN 'submitted' WHEN 5 THEN 'validated' WHEN 6 THEN 'not relevant'
  WHEN 7 THEN 'error' WHEN 8 THEN '404 not found' WHEN 9 THEN 'individual record' ELSE 'pending' END AS outcome
 FROM ranked WHERE rn=1""",
    "link_batch_urls": "SELECT batch_id, url_id FROM ranked WHERE rn=1",
    "duplicates": "SELECT batch_id, url_id AS original_url_id FROM ranked WHERE rn>1",
    "user_relevant_suggestions": """SELECT c.url_id, o.o_custkey AS user_id,
 MIN(CASE CAST(l_quantity AS INT) % 8 WHEN 2 THEN 'not relevant' WHEN 6 THEN 'individual record' ELSE 'relevant' END)
  AS suggested_status
 FROM collected c JOIN orders o ON c.batch_id=o.o_orderkey WHERE CAST(l_quantity AS INT) % 2 = 0
 GROUP BY c.url_id, o.o_custkey""",
    "user_record_type_suggestions": """SELECT c.url_id, o.o_custkey AS user_id, MIN(p.p_type) AS record_type
 FROM collected c JOIN orders o ON c.batch_id=o.o_orderkey JOIN part p ON c.l_partkey=p.p_partkey
 WHERE CAST(l_quantity AS INT) % 3 = 0 GROUP BY c.url_id, o.o_custkey""",
    "user_url_agency_suggestions": """SELECT c.url_id, o.o_custkey AS user_id,
 MIN(CASE WHEN l_linenumber<>7 THEN l_suppkey END) AS agency_id, MIN(l_linenumber)=7 AS is_new
 FROM collected c JOIN orders o ON c.batch_id=o.o_orderkey WHERE CAST(l_quantity AS INT) % 5 = 0
 GROUP BY c.url_id, o.o_custkey""",
    "auto_relevant_suggestions": """SELECT url_id, MAX(l_discount) < 0.05 AS relevant,
 1 - MIN(l_discount) AS confidence, 'fixture' AS model_name FROM collected WHERE l_tax >= 0.04 GROUP BY url_id""",
    "auto_record_type_suggestions": """SELECT c.url_id, MIN(p.p_type) AS record_type
 FROM collected c JOIN part p ON c.l_partkey=p.p_partkey WHERE l_linenumber<=2 GROUP BY c.url_id""",
    "automated_url_agency_suggestions": """SELECT DISTINCT url_id,
 CASE WHEN l_returnflag<>'N' THEN l_suppkey END AS agency_id, l_returnflag='N' AS is_unknown
 FROM collected WHERE l_linestatus='O'""",
    "confirmed_url_agency": """SELECT DISTINCT url_id, l_suppkey AS agency_id FROM collected
 WHERE l_returnflag='A' AND l_linestatus='F'""",
    "tasks": """SELECT event_id AS id,
 CASE event_type WHEN 'click' THEN 'HTML' WHEN 'view' THEN 'Relevancy' WHEN 'purchase' THEN 'Record Type'
  WHEN 'signup' THEN 'Agency Identification' ELSE 'Duplicate Detection' END AS task_type,
 CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'in-process' WHEN 2 THEN 'aborted' ELSE 'ready to label' END
  AS task_status, ts AS updated_at FROM events""",
    "link_task_urls": "SELECT DISTINCT batch_id % 1000 AS task_id, url_id FROM collected",
    "url_error_info": """SELECT DISTINCT u.id AS url_id, c.batch_id % 1000 AS task_id,
 CONCAT('error ', CAST(c.l_linenumber AS VARCHAR)) AS error
 FROM urls u JOIN collected c ON c.url_id=u.id WHERE u.outcome='error' AND c.l_linenumber=1""",
    "url_data_sources": "SELECT id AS url_id, id AS data_source_id, created_at FROM urls WHERE outcome='submitted'",
    "backlog_snapshot": """SELECT o_orderkey AS id, o_orderdate AS created_at,
 CAST(FLOOR(o_totalprice) AS INT) AS count_pending_total FROM orders""",
    "logs": "SELECT event_id AS id, user_id AS batch_id, event_type AS log, ts AS created_at FROM events",
    "url_checked_for_duplicate": "SELECT id AS url_id, created_at FROM urls WHERE id % 3 = 0",
    "url_probed_for_404": "SELECT id AS url_id, created_at AS last_probed_at FROM urls WHERE id % 4 = 0",
    "url_html_content": """SELECT DISTINCT url_id, CASE WHEN l_linenumber=3 THEN 'Title' ELSE 'Description' END AS content_type,
 CONCAT(CASE WHEN l_linenumber=3 THEN 'Title ' ELSE 'About ' END, url) AS content FROM collected WHERE l_linenumber IN (3, 4)""",
    "url_compressed_html": """SELECT DISTINCT url_id,
 CONCAT('<html><head><title>', url, '</title></head><body><div>', url, '</div></body></html>') AS html
 FROM collected WHERE l_linenumber=3""",
    "url_optional_data_source_metadata": """SELECT id AS url_id, ['HTML text'] AS record_formats,
 CASE WHEN id % 2 = 0 THEN 'CKAN' END AS data_portal_type, CAST(NULL AS VARCHAR) AS supplying_entity FROM urls WHERE id % 5 = 0""",
    "reviewing_user_url": """SELECT u.id AS url_id, o.o_custkey AS user_id, u.created_at FROM urls u
 JOIN link_batch_urls l ON l.url_id=u.id JOIN orders o ON o.o_orderkey=l.batch_id
 WHERE u.outcome IN ('validated', 'submitted', 'not relevant')""",
    "web_pages": "SELECT page_id AS url_id, url, html, 'text/html' AS content_type FROM pages",
}


def _refs(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql))
    return [v for v in FIXTURE_VIEWS if v in words]


def with_views(sql: str, extra_ctes: str | None = None) -> str:
    """Prefix ``sql`` with the fixture views it (transitively) references, dependencies first.

    ``extra_ctes`` — more ``name AS (...)`` definitions (comma separated) appended after the fixture views."""
    needed: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in needed or name in stack:
            return
        for dep in _refs(FIXTURE_VIEWS[name]):
            if dep != name:
                visit(dep, stack + (name,))
        needed.append(name)

    for v in _refs(sql + (extra_ctes or "")):
        visit(v)
    parts = [f"{n} AS (\n{FIXTURE_VIEWS[n]}\n)" for n in needed]
    if extra_ctes:
        parts.append(extra_ctes)
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
