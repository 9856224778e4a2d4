"""Administration and shallow-history operators over the views, with their SQL; same form as plans.queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import admin, graph, history, refs
from basalt.plans.fixtures import duck
from basalt.plans.queries import _COHORT, _LIVE, _PUSHES, _ROOTS, _TIMES, _TIPS, _UP, Views, _ids_of

_ASKS = """(SELECT c_nationkey AS repo, c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN NULL WHEN 2 THEN 'read' ELSE 'write' END AS level, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'heads/x' ELSE ' refs/heads/* ' END AS scope, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST((c_custkey % 40) * 864000 AS BIGINT) END AS ttl_s FROM {customer})"""
_HELD = "(SELECT s_nationkey AS repo, s_suppkey AS id FROM {supplier})"
_BEGUN = "(SELECT c_custkey AS id, CAST(c_custkey * 2 AS BIGINT) AS token, c_custkey % 9 = 0 AS admin, CASE c_custkey % 6 WHEN 0 THEN ' admin ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE CAST(c_custkey AS STRING) END AS auth FROM {customer})"
_PIN_ASKS = "(SELECT o_orderkey AS seq, concat('refs/heads/', lower(n_name)) AS name, CAST(o_orderkey AS STRING) AS sha FROM {orders} JOIN {nation} ON n_nationkey = o_orderkey % 25)"
_PINS = "(SELECT concat('refs/heads/', lower(n_name)) AS name, 'old' AS sha FROM {nation} WHERE n_regionkey = 1)"
_IMPORTS = """(SELECT id, id % 150 + 1 AS push, id % 90 AS pack, CASE id % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'resolve' ELSE 'index' END AS phase, CAST(id % 50 AS BIGINT) AS total, state, attempts
  FROM {g_jobs} WHERE kind = 'signup')"""
_CHAINS = "(SELECT CAST(n_nationkey AS BIGINT) AS chain, CASE n_nationkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'gone' END AS kind FROM {nation})"
_CHAIN_JOBS = "(SELECT kind, id % 40 AS chain, state FROM {g_jobs} WHERE id % 5 = 0)"
_OPENED = "(SELECT pack_id, idx, offset FROM {g_objects})"
_KEPT = "(SELECT pack_id, idx FROM {g_objects} WHERE idx % 3 <> 1)"
_TAGREFS = "(SELECT name, target, CASE WHEN length(name) % 2 = 0 THEN CAST(CAST(target AS BIGINT) div 2 AS STRING) END AS peeled FROM {g_refs})"
_TAGS = "(SELECT CAST(o_orderkey AS STRING) AS sha, CAST(o_orderkey div 2 AS STRING) AS target FROM {orders} WHERE o_orderkey % 2 = 1 AND o_orderkey > 0)"
_LEASES = "(SELECT name, id, push_id AS holder, at + (id % 7) * 86400000 AS until FROM {g_reflog})"
_FAILURES = "(SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN 'protocol' WHEN 1 THEN 'limit' WHEN 2 THEN 'busy' WHEN 3 THEN 'ratelimit' WHEN 4 THEN 'gone' WHEN 5 THEN 'storage' WHEN 6 THEN 'budget' ELSE 'new' END AS kind, event_id % 3 = 0 AS transient, CAST(event_id % 5 AS INT) AS seconds FROM {events})"

QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str]] = {
    "token_mint": (
        lambda v: admin.minted(v.sql(f"SELECT * FROM {_ASKS} t"), v.sql(f"SELECT * FROM {_HELD} t"), 1000, most=5),
        f"""WITH a AS (SELECT repo, id, ttl_s, CASE WHEN trim(coalesce(scope, '')) = '' THEN 'refs/*' ELSE trim(scope) END AS scope, CASE WHEN level IS NULL OR level = 'owner' THEN 'level' WHEN name = '' THEN 'name'
              WHEN scope = 'heads/x' THEN 'scope' WHEN ttl_s IS NOT NULL AND ttl_s NOT BETWEEN 1 AND 31622400 THEN 'ttl' END AS wrong FROM {_ASKS} t),
            b AS (SELECT a.*, coalesce(wrong, CASE WHEN row_number() OVER (PARTITION BY a.repo, wrong IS NULL ORDER BY id) + coalesce(held, 0) > 5 THEN 'too many' END) AS reason
              FROM a LEFT JOIN (SELECT repo, count(*) AS held FROM {_HELD} h GROUP BY repo) h ON h.repo = a.repo)
            SELECT id, CASE WHEN reason IS NULL THEN scope END AS scope, CASE WHEN reason IS NULL THEN 1000 + ttl_s * 1000 END AS expires_at, reason FROM b""",
    ),
    "token_list": (lambda v: admin.listed(v.g_tokens.withColumn("created_at", F.col("id") % 10)), "SELECT id, level, scope, expires_at, id % 10 AS created_at FROM {g_tokens}"),
    "token_revoke": (lambda v: admin.revoked(v.g_tokens, v.sql("SELECT id FROM {g_tokens} WHERE id % 3 = 0")).select("id"), "SELECT id FROM {g_tokens} WHERE id % 3 <> 0"),
    "push_scope": (
        lambda v: admin.captured_scopes(v.sql(f"SELECT id, token, admin FROM {_BEGUN} t"), v.g_tokens),
        f"""SELECT p.id, CASE WHEN admin THEN 'refs/*' WHEN level = 'write' AND trim(scope) <> '' THEN trim(scope) END AS scope,
            CASE WHEN admin THEN NULL WHEN t.id IS NULL THEN 'auth' WHEN level <> 'write' OR trim(coalesce(scope, '')) = '' THEN 'forbidden' END AS reason FROM {_BEGUN} p LEFT JOIN {{g_tokens}} t ON t.id = p.token""",
    ),
    "commit_reauth": (
        lambda v: admin.recommitted_scopes(v.sql(f"SELECT id, auth FROM {_BEGUN} t"), v.g_tokens.withColumn("id", F.col("id").cast("string"))),
        f"""SELECT p.id, coalesce(trim(auth) = 'admin', false) OR coalesce(level = 'write' AND trim(scope) <> '', false) AS allowed, CASE WHEN level = 'write' AND trim(scope) <> '' THEN trim(scope) END AS scope
            FROM {_BEGUN} p LEFT JOIN {{g_tokens}} t ON CAST(t.id AS STRING) = trim(p.auth)""",
    ),
    "credential_admit": (
        lambda v: v.g_tokens.select("id", admin.admitted(F.when(F.col("id") % 4 == 0, "anonymous").otherwise(F.col("level")), F.when(F.col("id") % 2 == 0, "write").otherwise("read")).alias("refusal")),
        "SELECT id, CASE WHEN id % 2 = 1 THEN NULL WHEN id % 4 = 0 THEN 'auth' WHEN level = 'read' THEN 'forbidden' END AS refusal FROM {g_tokens}",
    ),
    "protect_match": (
        lambda v: v.g_refs.select("name", admin.covered(F.col("name"), ["refs/heads/c*", "refs/tags/asia"]).alias("protected")),
        "SELECT name, name LIKE 'refs/heads/c%' OR name = 'refs/tags/asia' AS protected FROM {g_refs}",
    ),
    "pin_refs": (
        lambda v: admin.pinned(v.sql(f"SELECT * FROM {_PIN_ASKS} t"), v.g_refs, v.sql(f"SELECT * FROM {_PINS} t")),
        f"""SELECT coalesce(g.name, p.name) AS name, coalesce(g.sha, p.sha) AS sha FROM {_PINS} p FULL JOIN (SELECT DISTINCT a.name, a.sha FROM {_PIN_ASKS} a JOIN {{g_refs}} r ON r.name = a.name AND r.target = a.sha) g ON g.name = p.name""",
    ),
    "format_pin": (
        lambda v: admin.first_format(v.sql("SELECT o_custkey AS repo, o_orderkey AS id, o_orderstatus AS format FROM {orders}")),
        "SELECT o_orderkey AS id, first_value(o_orderstatus) OVER w AS fixed, o_orderstatus <> first_value(o_orderstatus) OVER w AS refused FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "import_status": (
        lambda v: admin.import_status(v.pushes, v.sql(f"SELECT * FROM {_IMPORTS} t"), v.g_objects),
        f"""SELECT p.id AS push, p.state AS push_state, j.state AS job_state, j.phase AS job_phase, j.attempts, coalesce(n, 0) AS objects_done, j.total AS objects_total FROM {_PUSHES} p
            LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY push ORDER BY id DESC) AS r FROM {_IMPORTS} t) u WHERE r = 1) j ON j.push = p.id
            LEFT JOIN (SELECT pack_id, count(*) AS n FROM {{g_objects}} GROUP BY pack_id) o ON o.pack_id = j.pack""",
    ),
    "finish_push": (
        lambda v: admin.results(v.sql("SELECT push_id, name, CASE WHEN id % 4 = 0 THEN 'ng' ELSE concat('ok ', CAST(id AS STRING)) END AS status FROM {g_reflog}")),
        """SELECT push_id, concat('[', string_agg(concat('{"name":"', name, '","status":"', status, '"}'), ',' ORDER BY name, status), ']') AS result
           FROM (SELECT push_id, name, CASE WHEN id % 4 = 0 THEN 'ng' ELSE concat('ok ', CAST(id AS STRING)) END AS status FROM {g_reflog}) t GROUP BY push_id""",
    ),
    "large_file_batch": (
        lambda v: admin.large_files(v.sql("SELECT sha2(p_name, 256) AS oid, p_size AS size FROM {part} WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_brand, p_size FROM {part} WHERE p_partkey % 10 = 0"), v.sql("SELECT sha2(p_name, 256) AS oid FROM {part} WHERE p_partkey % 3 = 0"), False),
        """SELECT oid, size, CASE WHEN stored THEN 'download' END AS action, CAST(CASE WHEN bad THEN 422 WHEN NOT stored THEN 404 END AS INT) AS error FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE sha256(p_name) END AS oid, p_size AS size,
           p_partkey % 10 = 0 AS bad, p_partkey % 10 <> 0 AND p_name IN (SELECT p_name FROM {part} WHERE p_partkey % 3 = 0) AS stored FROM {part}) t""",
    ),
    "http_status": (
        lambda v: v.sql(f"SELECT * FROM {_FAILURES} t").select("id", admin.http_status(F.col("kind"), F.col("transient")).alias("status"), admin.retry_after(F.col("kind"), F.col("transient"), F.col("seconds")).alias("wait")),
        f"""SELECT id, CAST(CASE kind WHEN 'protocol' THEN 400 WHEN 'limit' THEN CASE WHEN transient THEN 503 ELSE 413 END WHEN 'busy' THEN 503 WHEN 'ratelimit' THEN 429 WHEN 'gone' THEN 410 WHEN 'budget' THEN 413 ELSE 500 END AS INT) AS status,
            CAST(CASE WHEN kind IN ('busy', 'ratelimit') THEN greatest(seconds, 1) WHEN kind = 'limit' AND transient THEN 60 END AS INT) AS wait FROM {_FAILURES} t""",
    ),
    "ref_advertisement": (
        lambda v: admin.advertised(v.sql(f"SELECT * FROM {_TAGREFS} t")),
        f"SELECT name, CASE WHEN peeled IS NULL THEN concat(target, ' ', name) ELSE concat(target, ' ', name, ' peeled:', peeled) END AS line FROM {_TAGREFS} t",
    ),
    "orphan_chains": (
        lambda v: admin.orphan_chains(v.sql(f"SELECT * FROM {_CHAINS} t"), v.sql(f"SELECT * FROM {_CHAIN_JOBS} t")),
        f"SELECT chain, kind FROM {_CHAINS} c WHERE NOT EXISTS (SELECT 1 FROM {_CHAIN_JOBS} j WHERE j.kind = c.kind AND j.state IN ('queued', 'running') AND coalesce(j.chain, c.chain) = c.chain)",
    ),
    "cohort_live": (
        lambda v: admin.cohort_live(v.sql("SELECT o_custkey AS chain, o_orderkey AS id FROM {orders} WHERE o_orderkey % 4 = 0"), v.g_packs),
        "SELECT o_custkey AS chain, min(CAST(o_orderstatus = 'O' AS INT)) = 1 AS all_live FROM {orders} WHERE o_orderkey % 4 = 0 GROUP BY o_custkey",
    ),
    "compaction_swap": (
        lambda v: admin.swapped(v.g_packs, v.cohort, 7),
        f"""SELECT id, CASE WHEN id = 7 THEN 'live' WHEN id IN (SELECT id FROM {_COHORT} c) THEN 'dead' ELSE state END AS state,
            CASE WHEN id = 7 THEN (SELECT max(created_at) FROM {{g_packs}} WHERE id IN (SELECT id FROM {_COHORT} c)) ELSE created_at END AS created_at FROM {{g_packs}}""",
    ),
    "extent_check": (
        lambda v: admin.extents(v.g_objects, v.sql("SELECT id, bytes - id % 3 AS bytes FROM {g_packs} WHERE id % 5 <> 0")),
        """SELECT sha, pack_id, idx, CASE WHEN pack_id % 5 = 0 THEN 'missing' ELSE 'corrupt' END AS fault FROM {g_objects} JOIN {g_packs} ON id = pack_id WHERE pack_id % 5 = 0 OR offset + len > bytes - id % 3""",
    ),
    "lost_writes": (
        lambda v: admin.lost_writes(v.sql(f"SELECT * FROM {_OPENED} t"), v.sql(f"SELECT * FROM {_KEPT} t"), 9000),
        f"""SELECT o.pack_id, o.idx, o.offset, (SELECT min(n.offset) FROM {_OPENED} n WHERE n.pack_id = o.pack_id AND n.offset > o.offset) AS next
            FROM {_OPENED} o LEFT JOIN {_KEPT} k ON k.pack_id = o.pack_id AND k.idx = o.idx WHERE o.offset <= 9000 AND k.idx IS NULL""",
    ),
    "missing_delta_bases": (
        lambda v: admin.missing_bases(v.g_deltas.where("cast(id as bigint) % 3 <> 0"), v.g_deltas.where("cast(id as bigint) % 6 = 0").withColumnRenamed("id", "sha")),
        "SELECT DISTINCT base AS sha, CAST(base AS BIGINT) % 6 = 0 AS live FROM {g_deltas} WHERE CAST(id AS BIGINT) % 3 <> 0 AND base IS NOT NULL AND base NOT IN (SELECT id FROM {g_deltas} WHERE CAST(id AS BIGINT) % 3 <> 0)",
    ),
    "epoch_guard": (
        lambda v: admin.moved_epochs(v.sql("SELECT o_orderkey AS id, o_custkey AS repo, o_orderkey % 3 AS gc_epoch FROM {orders}"), v.sql("SELECT c_custkey AS repo, c_custkey % 3 AS epoch FROM {customer} WHERE c_custkey % 10 <> 0")),
        "SELECT o_orderkey AS id, o_custkey AS repo FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey AND c_custkey % 10 <> 0 WHERE o_orderkey % 3 IS DISTINCT FROM c_custkey % 3",
    ),
    "upsert_min": (
        lambda v: admin.upsert_least(v.sql("SELECT sha, kind AS gen FROM {g_objects} WHERE idx % 2 = 0"), v.sql("SELECT sha, kind AS gen FROM {g_objects} WHERE idx % 2 = 1")),
        "SELECT sha, min(kind) AS gen FROM {g_objects} GROUP BY sha",
    ),
    "ref_leases": (
        lambda v: admin.held_leases(v.sql(f"SELECT * FROM {_LEASES} t"), 1_706_000_000_000),
        f"SELECT name, holder, until FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id DESC) AS r FROM {_LEASES} t WHERE until > 1706000000000) u WHERE r = 1",
    ),
    "policy_cascade_full": (
        lambda v: refs.refusal(
            v.g_commands.withColumn("forward", F.when(F.col("seq") % 3 > 0, F.col("seq") % 3 == 1)), refs.as_of(v.g_reflog, 10**15), v.g_reflog.select(F.col("new").alias("sha")).where("sha < 'c'"), "refs/heads/u1*",
            pins=v.sql("SELECT 'refs/heads/u10' AS name"), head="refs/heads/u11", protected=["refs/heads/u12*"], full=True,
        ),
        """SELECT c.seq, c.name, CASE WHEN c.name NOT LIKE 'refs/heads/u1%' THEN 'out of scope' WHEN c.old IS NULL AND c.new IS NULL THEN 'nothing to do' WHEN c.name = 'refs/heads/u10' THEN 'pinned'
             WHEN c.new IS NULL AND c.name = 'refs/heads/u11' THEN 'current branch' WHEN c.name LIKE 'refs/heads/u12%' AND c.new IS NULL THEN 'protected: refuse'
             WHEN c.name LIKE 'refs/heads/u12%' AND c.old IS NOT NULL AND c.seq % 3 = 0 THEN 'protected: unknown' WHEN c.name LIKE 'refs/heads/u12%' AND c.old IS NOT NULL AND c.seq % 3 = 2 THEN 'protected: refuse'
             WHEN c.new IS NOT NULL AND NOT (c.new < 'c') THEN 'missing object' WHEN c.new IS NOT NULL AND c.old IS NULL THEN 'too many refs' WHEN c.old IS DISTINCT FROM r.target THEN 'stale' END AS reason
           FROM {g_commands} c LEFT JOIN (SELECT name, target FROM (SELECT name, new AS target, row_number() OVER (PARTITION BY name ORDER BY at DESC, id DESC) AS n FROM {g_reflog}) t WHERE n = 1) r ON r.name = c.name""",
    ),
    "head_fallback": (
        lambda v: admin.heads(v.sql("SELECT r_regionkey AS repo, CASE WHEN r_regionkey % 2 = 0 THEN 'refs/heads/main' ELSE concat('refs/heads/', CAST(r_regionkey + 5 AS STRING)) END AS head FROM {region}"), v.sql("SELECT n_regionkey AS repo, concat('refs/heads/', CAST(n_nationkey AS STRING)) AS name FROM {nation}")),
        """SELECT r_regionkey AS repo, CASE WHEN r_regionkey % 2 = 1 AND EXISTS (SELECT 1 FROM {nation} WHERE n_regionkey = r_regionkey AND n_nationkey = r_regionkey + 5) THEN concat('refs/heads/', CAST(r_regionkey + 5 AS STRING))
           ELSE (SELECT min(concat('refs/heads/', CAST(n_nationkey AS STRING))) FROM {nation} WHERE n_regionkey = r_regionkey) END AS head FROM {region}""",
    ),
    "purge": (
        lambda v: admin.purged(v.sql("SELECT o_custkey AS repo, o_orderkey AS id FROM {orders}"), v.sql("SELECT c_custkey AS repo, c_custkey % 5 = 0 AS deleted, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS expires_at FROM {customer}"), 50),
        "SELECT o_custkey AS repo, o_orderkey AS id FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 5 = 0 OR (c_custkey % 2 = 0 AND c_custkey <= 50))",
    ),
    "gossip_dedup": (
        lambda v: admin.gossiped(v.sql("SELECT push_id % 10 AS origin, push_id AS seq, CAST(id % 9 AS INT) AS hop, name AS body FROM {g_reflog}"), 5),
        """SELECT origin, seq, hop, body FROM (SELECT push_id % 10 AS origin, push_id AS seq, CAST(id % 9 AS INT) AS hop, name AS body, row_number() OVER (PARTITION BY push_id ORDER BY id % 9, name) AS r FROM {g_reflog} WHERE id % 9 <= 5) t WHERE r = 1""",
    ),
    "hook_outer_join": (
        lambda v: admin.hook_outcomes(v.sql("SELECT o_orderkey AS id, o_custkey AS repo FROM {orders}"), v.sql("SELECT c_custkey AS repo, c_name AS url FROM {customer} WHERE c_custkey % 4 = 0")),
        "SELECT o_orderkey AS id, o_custkey AS repo, c_name AS url FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey AND c_custkey % 4 = 0",
    ),
    "path_lookup": (
        lambda v: admin.inclusion_paths(
            v.sql("SELECT DISTINCT 'root' AS folder, source AS name, source AS oid FROM {documents} UNION SELECT source, lang, concat(source, lang) FROM {documents} UNION SELECT concat(source, lang), CAST(doc_id AS STRING), sha1(text) FROM {documents}"),
            v.sql("SELECT 'root' AS root, concat(source, '/', lang, '/', CAST(doc_id + doc_id % 2 AS STRING)) AS path FROM {documents}"),
        ),
        """SELECT 'root' AS root, concat(d.source, '/', d.lang, '/', CAST(d.doc_id + d.doc_id % 2 AS STRING)) AS path, sha1(e.text) AS oid FROM {documents} d LEFT JOIN {documents} e ON e.doc_id = d.doc_id + d.doc_id % 2 AND e.source = d.source AND e.lang = d.lang""",
    ),
    "row_digest": (
        lambda v: admin.set_digest(v.g_refs, ["name", "target"]),
        "SELECT count(*) AS n, CAST(CAST(sum(CAST(concat('0x', substr(sha1(concat_ws('|', name, target)), 1, 15)) AS HUGEINT)) AS HUGEINT) AS STRING) AS digest FROM {g_refs}",
    ),
    "ref_exclusion": (
        lambda v: history.without(_ids_of(v, [1440, 1296]), v.g_commit_parents, v.sql("SELECT '360' AS sha UNION ALL SELECT 'nowhere'")),
        f"""WITH RECURSIVE x AS (SELECT '360' AS sha UNION SELECT l.dst FROM x JOIN {_UP} l ON l.src = x.sha), d AS (SELECT sha FROM {_TIPS} t UNION SELECT l.dst FROM d JOIN {_UP} l ON l.src = d.sha WHERE l.dst NOT IN (SELECT sha FROM x))
            SELECT sha FROM d WHERE sha NOT IN (SELECT sha FROM x)""",
    ),
    "tag_peel": (
        lambda v: history.peeled(v.sql(f"SELECT * FROM {_TAGS} t"), v.sql(f"SELECT sha FROM {_TAGS} t")),
        f"""WITH RECURSIVE p AS (SELECT sha, target AS peeled, 1 AS nesting FROM {_TAGS} t UNION ALL SELECT p.sha, t.target, p.nesting + 1 FROM p JOIN {_TAGS} t ON t.sha = p.peeled)
            SELECT sha, peeled, nesting FROM p WHERE peeled NOT IN (SELECT sha FROM {_TAGS} t)""",
    ),
    "tag_ride_along": (
        lambda v: history.riding_tags(v.sql(f"SELECT * FROM {_TAGREFS} t"), v.sql("SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders} WHERE o_orderkey % 7 <> 3")),
        f"SELECT DISTINCT target AS sha FROM {_TAGREFS} t WHERE name LIKE 'refs/tags/%' AND peeled IS NOT NULL AND CAST(peeled AS BIGINT) % 7 <> 3",
    ),
    "sparse_tree_diff": (
        lambda v: history.sparse_new(v.g_tree_b, v.g_tree_a),
        """SELECT DISTINCT b.oid FROM {g_tree_b} b WHERE NOT EXISTS (SELECT 1 FROM {g_tree_a} a WHERE a.oid = b.oid AND regexp_replace(a.path, '[^/]*$', '') = regexp_replace(b.path, '[^/]*$', ''))""",
    ),
    "history_horizon": (
        lambda v: history.horizon(_ids_of(v, [1440, 1296]), v.g_commit_parents, v.times, 830_000_000_000),
        f"""WITH RECURSIVE d AS (SELECT sha FROM {_TIPS} t WHERE sha NOT IN (SELECT sha FROM {_TIMES} x WHERE at < 830000000000) UNION SELECT l.dst FROM d JOIN {_UP} l ON l.src = d.sha WHERE l.dst NOT IN (SELECT sha FROM {_TIMES} x WHERE at < 830000000000))
            SELECT DISTINCT l.dst AS sha FROM d JOIN {_UP} l ON l.src = d.sha WHERE l.dst IN (SELECT sha FROM {_TIMES} x WHERE at < 830000000000)""",
    ),
    "mark_oracle": (
        lambda v: history.unmarked(v.g_objects, v.g_packs, v.sql("SELECT id FROM {g_packs} WHERE state = 'live' AND id % 50 <> 0"), v.g_objects.where("size % 97 = 0").select("sha"), v.roots, v.sql("SELECT '100' AS sha"), v.g_links),
        f"""WITH RECURSIVE r AS (SELECT sha FROM {_ROOTS} t UNION SELECT l.dst FROM r JOIN {{g_links}} l ON l.src = r.sha), f AS (SELECT '100' AS sha UNION SELECT l.dst FROM f JOIN {{g_links}} l ON l.src = f.sha)
            SELECT sha FROM {_LIVE} o WHERE sha IN (SELECT sha FROM r) AND sha NOT IN (SELECT sha FROM f) AND sha NOT IN (SELECT sha FROM {{g_objects}} WHERE size % 97 = 0)
            GROUP BY sha HAVING max(CASE WHEN pack_id % 50 <> 0 THEN 0 ELSE 1 END) = 0""",
    ),
}

#: Which visit of a commit counts depends on the walk so far, which one recursive query cannot say; tests compare with a plain walk.
#: all_generation_numbers is generation_numbers without the bound that its SQL has; a test compares it with brute force.
UNSPOKEN: dict[str, Callable[[Views], DataFrame]] = {
    "all_generation_numbers": lambda v: graph.generations(v.g_commit_parents, v.sql("SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders}")),
    "relative_depth": lambda v: history.deepened(_ids_of(v, [1440, 1296]), v.g_commit_parents, _ids_of(v, [360, 162, 144]), 2, relative=True, acks=_ids_of(v, [720])),
    "deepen_shallow": lambda v: history.deepened(_ids_of(v, [1440, 1296]), v.g_commit_parents, _ids_of(v, [360, 162, 144]), 5, acks=_ids_of(v, [720])),
}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {name: f for name, (f, _) in QUERIES.items()} | UNSPOKEN
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in every.items()}


def duck_queries() -> dict[str, str]:
    return {name: duck(sql) for name, (_, sql) in QUERIES.items()}
