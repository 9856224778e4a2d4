"""Repository-shaped views over the sample tables, one SQL text per view for Spark and DuckDB alike.

{name} is another view or a table; @ms(x) is a timestamp in epoch milliseconds; `a div b` is integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from basalt.functions.staging import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "g_objects": """
        SELECT sha1(CAST(l_partkey AS STRING)) AS sha, l_orderkey AS pack_id, idx, CAST(coalesce(sum(len) OVER
          (PARTITION BY l_orderkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, len, kind, size
        FROM (SELECT l_orderkey, l_partkey, CAST(100 * l_quantity AS BIGINT) AS len, CAST(1 + l_linenumber % 4 AS INT) AS kind,
          CAST(floor(l_extendedprice) AS BIGINT) AS size, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
          l_extendedprice, l_shipdate) - 1 AS BIGINT) AS idx FROM {lineitem}) t""",
    "g_packs": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'dead' ELSE 'ingesting' END AS state, o_custkey AS push_id,
          @ms(o_orderdate) AS created_at, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 946684799000 WHEN 1 THEN 946681199999 ELSE @ms(o_orderdate) END END AS dead_at, coalesce(n, 0) AS count, coalesce(b, 0) AS bytes
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(100 * l_quantity AS BIGINT)) AS BIGINT) AS b FROM {lineitem} GROUP BY l_orderkey) t
          ON o_orderkey = l_orderkey""",
    "g_commit_parents": """
        SELECT CAST(o_orderkey AS STRING) AS sha, 0 AS n, CAST(o_orderkey div 2 AS STRING) AS parent FROM {orders} WHERE o_orderkey > 0
        UNION ALL SELECT CAST(o_orderkey AS STRING), 1, CAST(o_orderkey div 3 AS STRING) FROM {orders} WHERE o_orderkey % 5 = 0 AND o_orderkey > 2
        UNION ALL SELECT CAST(o_orderkey AS STRING), -1, NULL FROM {orders} WHERE o_orderkey % 97 <> 0 OR o_orderkey = 0""",
    "g_links": """
        SELECT sha AS src, parent AS dst FROM {g_commit_parents} WHERE n >= 0
        UNION SELECT CAST(l_orderkey AS STRING), sha1(CAST(l_partkey AS STRING)) FROM {lineitem}""",
    "g_refs": """
        SELECT concat('refs/heads/', lower(n_name)) AS name, CAST((n_nationkey * 577) % 1500 AS STRING) AS target FROM {nation}
        UNION ALL SELECT concat('refs/tags/', lower(r_name)), CAST(r_regionkey * 240 + 20 AS STRING) FROM {region}""",
    "g_reflog": """
        SELECT event_id AS id, concat('refs/heads/u', CAST(user_id AS STRING)) AS name, CASE WHEN event_type = 'error' THEN NULL ELSE sha1(props) END AS new,
          event_id div 10 AS push_id, @ms(ts) AS at FROM {events}""",
    "g_commands": """
        SELECT id AS seq, name, push_id, new, CASE WHEN id % 3 = 0 THEN lag(new) OVER (PARTITION BY name ORDER BY id)
          WHEN id % 3 = 1 THEN lag(new, 2) OVER (PARTITION BY name ORDER BY id) ELSE NULL END AS old FROM {g_reflog}""",
    "g_tokens": """
        SELECT c_custkey AS id, sha1(c_name) AS hash, CASE WHEN c_custkey % 3 = 0 THEN 'write' ELSE 'read' END AS level,
          CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'refs/*' WHEN 2 THEN 'refs/heads/*, refs/tags/*' WHEN 3 THEN ' ' ELSE concat('refs/heads/u', CAST(c_custkey % 50 AS STRING)) END AS scope,
          CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey * 1000 AS BIGINT) END AS expires_at FROM {customer}""",
    "g_jobs": """
        SELECT event_id AS id, event_type AS kind, @ms(ts) AS run_at, CAST(event_id % 10 AS INT) AS attempts,
          CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'dead' ELSE 'done' END AS state, @ms(ts) + (event_id % 120) * 1000 AS started_at,
          CAST(event_id % 66 AS INT) AS strands FROM {events}""",
    "g_tree_a": "SELECT concat(source, '/', lang, '/', CAST(doc_id AS STRING)) AS path, sha1(text) AS oid FROM {documents} WHERE doc_id % 7 <> 0",
    "g_tree_b": "SELECT concat(source, '/', lang, '/', CAST(doc_id AS STRING)) AS path, sha1(CASE WHEN doc_id % 5 = 0 THEN concat(text, 'b') ELSE text END) AS oid FROM {documents} WHERE doc_id % 11 <> 0",
    "g_tree_base": "SELECT concat(source, '/', lang, '/', CAST(doc_id AS STRING)) AS path, sha1(CASE WHEN doc_id % 3 = 0 THEN concat(text, 'a') ELSE text END) AS oid FROM {documents} WHERE doc_id % 13 <> 0",
    "g_deltas": """
        SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN CAST(o_orderkey AS STRING) ELSE CAST(o_orderkey div 2 AS STRING) END AS base
        FROM {orders}""",
}


def view(spark: SparkSession, sf_dir: str, name: str, **dealt: str) -> DataFrame:
    """A view, or a table, as a DataFrame; nothing is registered in the session. dealt: tables that are spread by a column before the view reads them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"@ms\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", VIEWS[name])
    used = {n: view(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{(\w+)\}", text)))}
    used |= {n: spread(used[n], column) for n, column in dealt.items()}
    return spark.sql(text, **used)


def duck(sql: str) -> str:
    """DuckDB text of a query over {views}: their definitions become CTEs."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    own, recursive = sql.strip(), "RECURSIVE " if order and sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if own.upper().startswith("WITH"):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", own, flags=re.I)
        recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE", own, re.I) else ""
        text = f"WITH {recursive}" + (f"{text}, " if text else "") + rest
    else:
        text = (f"WITH {text} " if text else "") + own
    text = re.sub(r"@ms\((\w+)\)", r"(epoch_us(\1) div 1000)", text)
    text = re.sub(r"\bdiv\b", "//", text)
    text = re.sub(r"\b(at|offset)\b", r'"\1"', text)  # reserved words there
    return re.sub(r"\{(\w+)\}", r"\1", text)
