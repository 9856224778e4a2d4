"""Every operator applied to the repository-shaped views, and the same in DuckDB SQL.

A query is `name: (function of a view loader and Spark, SQL)`. SQL names views in braces; fixtures.duck() turns them into CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import admin, bitmaps, catalog, content, graph, jobs, packs, refs
from basalt.plans.fixtures import duck, view

NOW = 946_684_800_000
_LIVE = "(SELECT o.* FROM {g_objects} o JOIN {g_packs} p ON p.id = o.pack_id WHERE p.state = 'live')"
_IDS = "(SELECT DISTINCT sha1(CAST(p_partkey AS STRING)) AS sha FROM {part} UNION ALL SELECT sha1(concat('missing-', CAST(r_regionkey AS STRING))) FROM {region})"
_PUSHES = "(SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'rejected' WHEN 2 THEN 'expired' ELSE 'committed' END AS state FROM {customer})"
_COHORT = "(SELECT id FROM {g_packs} WHERE state = 'live' AND id % 3 = 0)"
_ROOTS = "(SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders} WHERE o_orderkey IN (1440, 1296, 1458, 960))"
_UP = "(SELECT sha AS src, parent AS dst FROM {g_commit_parents} WHERE n >= 0)"
_TIMES = "(SELECT CAST(o_orderkey AS STRING) AS sha, @ms(o_orderdate) AS at FROM {orders})"
_EXTRA = {"ids": _IDS, "pushes": _PUSHES, "cohort": _COHORT, "roots": _ROOTS, "times": _TIMES}


class Views:
    """Loads views by attribute: v.g_packs, v.orders, v.ids."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        import re

        text = re.sub(r"@ms\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))", text)
        return self._spark.sql(text, **{n: view(self._spark, self._dir, n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def objects_by_pack(self) -> DataFrame:
        """g_objects, whose window over packs then sorts a bounded part in each task."""
        return view(self._spark, self._dir, "g_objects", lineitem="l_orderkey")

    def __getattr__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {_EXTRA[name]} t") if name in _EXTRA else view(self._spark, self._dir, name)


_CLOSURE = "reach AS (SELECT sha FROM {roots} t UNION SELECT l.dst FROM reach JOIN {links} l ON l.src = reach.sha)".replace("{roots}", _ROOTS)
_UPREACH = _CLOSURE.replace("{links}", _UP)
_TIPS = "(SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders} WHERE o_orderkey IN (1440, 1296))"
_HAVES = "(SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders} WHERE o_orderkey IN (720, 480, 100))"
_PAIRS = """(SELECT CAST(a.o_orderkey AS STRING) AS new, CAST(b.o_orderkey AS STRING) AS old FROM {orders} a JOIN {orders} b ON b.o_orderkey IN (1, 3, 7, 180, 360, 97, 1440)
  WHERE a.o_orderkey IN (1440, 1458, 1296, 776, 5))"""


def _ids_of(v: Views, keys: list[int]) -> DataFrame:
    return v.orders.where(F.col("o_orderkey").isin(keys)).select(F.col("o_orderkey").cast("string").alias("sha"))


def _touches(v: Views) -> DataFrame:
    return v.g_reflog.select(F.col("name").alias("key"), "at", (F.substring("name", 13, 20).cast("long") % 5 * 100).alias("size"))


_NAMES = "(SELECT concat(CASE user_id % 6 WHEN 0 THEN 'refs/heads/' WHEN 1 THEN 'refs/tags/' WHEN 2 THEN 'heads/' WHEN 3 THEN 'refs/heads/a..' WHEN 4 THEN 'refs//' ELSE 'refs/a b' END, CAST(user_id AS STRING)) AS name FROM {events})"

_CLAIMS = "(SELECT event_id AS id, sha1(concat('a', CAST(event_id AS STRING))) AS lease, event_id % 5 AS at FROM {events} UNION ALL SELECT event_id, sha1(concat('b', CAST(event_id AS STRING))), event_id % 3 FROM {events})"
_BEATS = "(SELECT event_id AS id, sha1(CAST(event_id - event_id % 3 AS STRING)) AS lease, event_id * 10 AS at FROM {events})"
_OUTCOMES = """(SELECT event_id AS id, sha1(CASE WHEN event_id % 5 = 0 THEN 'other' ELSE CAST(event_id AS STRING) END) AS lease, CASE event_id % 7 WHEN 0 THEN 'done' WHEN 1 THEN 'continue' WHEN 2 THEN 'reschedule' ELSE 'error' END AS kind,
  event_id * 100 AS run_at FROM {events})"""
_BEGIN_ASKS = "(SELECT o_orderkey AS seq, (o_orderkey * 7) % 400 AS push_id, concat('p', CAST(o_orderkey % 3 AS STRING)) AS principal, CAST(o_orderkey % 2 AS STRING) AS auth FROM {orders})"
_BEGIN_HELD = "(SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'rejected' ELSE 'open' END AS state, concat('p', CAST(c_custkey % 3 AS STRING)) AS principal, CAST(c_custkey % 2 AS STRING) AS auth FROM {customer})"

QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str]] = {
    "live_lookup": (
        lambda v: catalog.live_lookup(v.ids, v.objects_by_pack(), v.g_packs),
        f"""SELECT i.sha, l.pack_id, l.idx, l.offset, l.len FROM {_IDS} i LEFT JOIN (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY sha ORDER BY pack_id, idx) AS r
            FROM {_LIVE} o) t WHERE r = 1) l ON l.sha = i.sha""",
    ),
    "scan_live_objects": (lambda v: catalog.live_objects(v.g_objects, v.g_packs).select("sha", "pack_id", "idx"), f"SELECT sha, pack_id, idx FROM {_LIVE} o"),
    "scan_live_packs": (lambda v: v.g_packs.where("state = 'live'").select("id", "count", "bytes", "created_at"), "SELECT id, count, bytes, created_at FROM {g_packs} WHERE state = 'live'"),
    "list_refs": (lambda v: v.g_refs.orderBy("name"), "SELECT name, target FROM {g_refs} ORDER BY name"),
    "page_keyset": (
        lambda v: catalog.keyset_page(v.g_packs.select("id", "state"), "id", 500, 200),
        "SELECT id, state FROM {g_packs} WHERE id > 500 ORDER BY id LIMIT 200",
    ),
    "lookup_in_pack": (
        lambda v: catalog.lookup_in_pack(v.ids, v.g_objects, v.g_packs, 2),
        f"""SELECT i.sha, coalesce(l.pack_id, w.pack_id) AS pack_id FROM {_IDS} i LEFT JOIN (SELECT sha, min(pack_id) AS pack_id FROM {_LIVE} o GROUP BY sha) l ON l.sha = i.sha
            LEFT JOIN (SELECT DISTINCT sha, pack_id FROM {{g_objects}} WHERE pack_id = 2) w ON w.sha = i.sha""",
    ),
    "connectivity_check": (
        lambda v: catalog.missing_links(v.g_links, v.g_objects, v.g_packs, v.sql("SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders} WHERE o_orderkey % 2 = 0")),
        f"""SELECT DISTINCT dst AS sha FROM {{g_links}} WHERE dst NOT IN (SELECT sha FROM {_LIVE} o) AND dst NOT IN (SELECT CAST(o_orderkey AS STRING) FROM {{orders}} WHERE o_orderkey % 2 = 0)""",
    ),
    "acks": (lambda v: catalog.known_ids(v.ids, v.g_objects, v.g_packs), f"SELECT sha FROM {_IDS} i WHERE sha IN (SELECT sha FROM {_LIVE} o)"),
    "not_our_ref": (lambda v: catalog.unknown_ids(v.ids, v.g_objects, v.g_packs), f"SELECT sha FROM {_IDS} i WHERE sha NOT IN (SELECT sha FROM {_LIVE} o)"),
    "in_pack_coverage": (
        lambda v: catalog.pack_coverage(v.g_objects.where("pack_id = 4").select("sha"), v.g_objects, v.g_packs),
        f"""SELECT pack_id, count(DISTINCT sha) AS held, count(DISTINCT sha) = (SELECT count(DISTINCT sha) FROM {{g_objects}} WHERE pack_id = 4) AS covers_all
            FROM {_LIVE} o WHERE sha IN (SELECT sha FROM {{g_objects}} WHERE pack_id = 4) GROUP BY pack_id""",
    ),
    "orphan_packs": (
        lambda v: catalog.orphan_packs(v.g_packs, v.pushes, NOW),
        f"SELECT id, push_id FROM {{g_packs}} WHERE state = 'ingesting' AND created_at < {NOW} - 3600000 AND push_id NOT IN (SELECT id FROM {_PUSHES} u WHERE state = 'open')",
    ),
    "rejected_push_packs": (
        lambda v: catalog.rejected_push_packs(v.g_packs, v.pushes),
        f"SELECT p.id, p.push_id, u.state AS push_state FROM {{g_packs}} p JOIN {_PUSHES} u ON u.id = p.push_id WHERE p.state = 'ingesting' AND u.state IN ('rejected', 'expired')",
    ),
    "deletable_packs": (
        lambda v: catalog.deletable_packs(v.g_packs, v.g_objects, NOW),
        f"SELECT id FROM {{g_packs}} WHERE state = 'dead' AND dead_at < {NOW} - 3600000 AND id NOT IN (SELECT pack_id FROM {{g_objects}})",
    ),
    "retirable_entries": (
        lambda v: catalog.retirable_entries(v.g_objects, v.g_packs, v.cohort),
        f"""SELECT sha, pack_id, idx, sha IN (SELECT sha FROM {_LIVE} o WHERE pack_id NOT IN (SELECT id FROM {_COHORT} c)) AS elsewhere
            FROM {{g_objects}} WHERE pack_id IN (SELECT id FROM {_COHORT} c)""",
    ),
    "storage_totals": (
        lambda v: catalog.storage_totals(v.g_packs, 7),
        "SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS objects, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM {g_packs} WHERE state = 'live' OR (state = 'ingesting' AND push_id = 7)",
    ),
    "state_counts": (lambda v: catalog.state_counts(v.g_packs), "SELECT state, count(*) AS n FROM {g_packs} GROUP BY state"),
    "dead_gauge": (lambda v: v.g_jobs.agg(F.count_if(F.col("state") == "dead").alias("dead")), "SELECT count(*) AS dead FROM {g_jobs} WHERE state = 'dead'"),
    "pack_self_check": (
        lambda v: catalog.pack_self_check(v.g_objects, v.g_packs),
        """SELECT id, coalesce(r, 0) AS n_rows, coalesce(d, 0) AS n_distinct, coalesce(r, 0) = count AS complete, coalesce(d, 0) < coalesce(r, 0) AS repeats FROM {g_packs}
           LEFT JOIN (SELECT pack_id, count(*) AS r, count(DISTINCT sha) AS d FROM {g_objects} GROUP BY pack_id) t ON pack_id = id""",
    ),
    "corruption_gate": (
        lambda v: catalog.over_declared(v.g_objects, v.sql("SELECT id, count - id % 2 AS declared FROM {g_packs}"), "declared"),
        "SELECT id, n AS n_rows, 2 AS strikes FROM (SELECT pack_id, count(*) AS n FROM {g_objects} GROUP BY pack_id) t JOIN (SELECT id, count - id % 2 AS declared FROM {g_packs}) p ON id = pack_id WHERE n > declared",
    ),
    "commit_bounds": (
        lambda v: catalog.commit_bounds(v.g_objects),
        "SELECT pack_id, min(offset) AS commit_lo, max(offset + len) AS commit_hi FROM {g_objects} WHERE kind = 1 GROUP BY pack_id",
    ),
    "first_copy_dedup": (
        lambda v: catalog.first_copies(v.g_objects, v.g_packs),
        f"SELECT sha, pack_id, idx, offset, len, kind, size FROM (SELECT o.*, row_number() OVER (PARTITION BY sha ORDER BY pack_id, idx) AS r FROM {_LIVE} o) t WHERE r = 1",
    ),
    "cohort_dedup": (
        lambda v: catalog.cohort_first_copies(v.g_objects, v.cohort),
        f"SELECT sha, pack_id, idx FROM (SELECT o.*, row_number() OVER (PARTITION BY sha ORDER BY pack_id, idx) AS r FROM {{g_objects}} o WHERE pack_id IN (SELECT id FROM {_COHORT} c)) t WHERE r = 1",
    ),
    "quota_checks": (
        lambda v: catalog.over_quota(v.g_packs, 20, 40_000),
        """SELECT push_id, count(*) AS packs, CAST(sum(count) AS BIGINT) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes FROM {g_packs} WHERE state = 'live' GROUP BY push_id
           HAVING sum(count) > 20 OR sum(bytes) > 40000""",
    ),
    "region_prefetch": (
        lambda v: catalog.region_commits(v.g_objects, v.sql("SELECT id AS pack_id, 3000 AS lo, 5000 AS hi FROM {g_packs} WHERE id % 10 = 0"), 1000),
        "SELECT sha, pack_id, offset FROM {g_objects} WHERE kind = 1 AND pack_id % 10 = 0 AND offset >= 2000 AND offset < 6000",
    ),
    "global_dedup": (
        lambda v: catalog.global_duplicates(v.g_objects),
        "SELECT count(*) AS objects, CAST(sum(c) AS BIGINT) AS copies, CAST(sum(t - o) AS BIGINT) AS saved FROM (SELECT sum(len) AS t, max(len) AS o, count(*) AS c FROM {g_objects} GROUP BY sha) x",
    ),
    "lossless_sets": (
        lambda v: catalog.same_set(catalog.live_objects(v.g_objects, v.g_packs), catalog.first_copies(v.g_objects, v.g_packs)),
        f"SELECT count(DISTINCT sha) AS n_a, count(DISTINCT sha) AS n_b, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b FROM {_LIVE} o",
    ),
    "hot_set": (
        lambda v: catalog.ranked_prefix(v.g_packs.where("state = 'live'"), [F.desc("created_at"), "id"], "bytes", 20_000, "push_id").select("id", "push_id", "running"),
        """SELECT id, push_id, running FROM (SELECT id, push_id, CAST(sum(bytes) OVER (PARTITION BY push_id ORDER BY created_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running
           FROM {g_packs} WHERE state = 'live') t WHERE running <= 20000""",
    ),
    "ref_prefix_filter": (
        lambda v: v.g_refs.where(refs.has_prefix(F.col("name"), ["refs/tags/", "refs/heads/c"])),
        "SELECT name, target FROM {g_refs} WHERE name LIKE 'refs/tags/%' OR name LIKE 'refs/heads/c%'",
    ),
    "scope_match": (
        lambda v: v.g_tokens.select("id", refs.in_scope(F.col("scope"), F.lit("refs/heads/u7")).alias("allowed")),
        """SELECT id, coalesce(scope LIKE 'refs/*%' OR scope LIKE '%refs/heads/*%' OR scope = 'refs/heads/u7', false) AS allowed FROM {g_tokens}""",
    ),
    "scope_grammar": (
        lambda v: v.g_tokens.select("id", refs.scope_valid(F.col("scope")).alias("valid")),
        "SELECT id, coalesce(trim(scope) <> '', false) AS valid FROM {g_tokens}",
    ),
    "two_scopes": (
        lambda v: v.g_tokens.select("id", (refs.in_scope(F.col("scope"), F.lit("refs/tags/a")) & refs.in_scope(F.lit("refs/tags/*"), F.lit("refs/tags/a"))).alias("allowed")),
        "SELECT id, coalesce(scope LIKE 'refs/*%' OR scope LIKE '%refs/tags/*%', false) AS allowed FROM {g_tokens}",
    ),
    "token_liveness": (
        lambda v: v.g_tokens.where("expires_at is null or expires_at > 100000").select("id", "hash", "level"),
        "SELECT id, hash, level FROM {g_tokens} WHERE expires_at IS NULL OR 100000 < expires_at",
    ),
    "auth_lookup": (
        lambda v: v.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("asked"), F.sha1("c_name").alias("hash")).join(v.g_tokens.where("expires_at is null or expires_at > 100000"), "hash").select("asked", "level"),
        "SELECT c_custkey AS asked, level FROM {customer} JOIN {g_tokens} ON hash = sha1(c_name) WHERE c_custkey % 2 = 0 AND (expires_at IS NULL OR expires_at > 100000)",
    ),
    "blob_filter": (
        lambda v: catalog.first_copies(v.g_objects, v.g_packs).where("not (kind = 3 and size > 30000) or pack_id = 0").select("sha", "kind", "size"),
        f"""SELECT sha, kind, size FROM (SELECT o.*, row_number() OVER (PARTITION BY sha ORDER BY pack_id, idx) AS r FROM {_LIVE} o) t WHERE r = 1 AND (NOT (kind = 3 AND size > 30000) OR pack_id = 0)""",
    ),
    "ref_name_check": (
        lambda v: v.sql(f"SELECT DISTINCT name FROM {_NAMES} t").select("name", refs.ref_name_valid(F.col("name")).alias("valid"), refs.printable(F.col("name")).alias("shown")),
        f"SELECT DISTINCT name, name LIKE 'refs/%' AND name NOT LIKE '%..%' AND name NOT LIKE '%//%' AND name NOT LIKE '% %' AS valid, replace(name, ' ', '?') AS shown FROM {_NAMES} t",
    ),
    "ref_candidates": (
        lambda v: refs.ref_candidates(v.sql("SELECT lower(n_name) AS short FROM {nation} UNION ALL SELECT lower(r_name) FROM {region} UNION ALL SELECT 'none'"), v.g_refs),
        """SELECT short, name, target FROM (SELECT s.short, r.name, r.target, row_number() OVER (PARTITION BY s.short ORDER BY CASE WHEN r.name LIKE 'refs/tags/%' THEN 0 ELSE 1 END) AS n
           FROM (SELECT lower(n_name) AS short FROM {nation} UNION ALL SELECT lower(r_name) FROM {region} UNION ALL SELECT 'none') s
           LEFT JOIN {g_refs} r ON r.name IN (concat('refs/tags/', s.short), concat('refs/heads/', s.short))) t WHERE n = 1""",
    ),
    "eligible_packs": (
        lambda v: packs.eligible(v.g_packs, NOW, v.sql("SELECT id FROM {g_packs} WHERE id % 7 = 0")).select("id"),
        f"SELECT id FROM {{g_packs}} WHERE state = 'live' AND count BETWEEN 1 AND 50000 AND bytes < 67108864 AND created_at <= {NOW} AND id % 7 <> 0",
    ),
    "range_read_plan": (
        lambda v: packs.merged_reads(v.g_objects.where("kind <> 2"), 1500),
        """SELECT pack_id, min(offset) AS lo, max(e) AS hi, count(*) AS entries FROM (SELECT *, sum(fresh) OVER (PARTITION BY pack_id ORDER BY offset, len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
           FROM (SELECT pack_id, offset, len, offset + len AS e, CASE WHEN lag(offset + len) OVER (PARTITION BY pack_id ORDER BY offset, len) IS NULL OR offset - lag(offset + len) OVER (PARTITION BY pack_id ORDER BY offset, len) >= 1500
           THEN 1 ELSE 0 END AS fresh FROM {g_objects} WHERE kind <> 2) t) u GROUP BY pack_id, island""",
    ),
    "capped_read_plan": (
        lambda v: packs.capped_reads(v.g_objects, 1500, 6000),
        """WITH RECURSIVE e AS (SELECT pack_id, offset AS lo, offset + len AS hi, row_number() OVER (PARTITION BY pack_id ORDER BY offset) AS r FROM {g_objects}),
           f AS (SELECT pack_id, r, lo, lo AS from_, hi AS to_ FROM e WHERE r = 1
             UNION ALL SELECT e.pack_id, e.r, e.lo, CASE WHEN e.hi - f.from_ <= 6000 THEN f.from_ ELSE e.lo END, e.hi FROM f JOIN e ON e.pack_id = f.pack_id AND e.r = f.r + 1)
           SELECT pack_id, from_ AS lo, max(to_) AS hi FROM f GROUP BY pack_id, from_""",
    ),
    "cohort_select": (
        lambda v: packs.cohort(packs.eligible(v.g_packs, NOW), 8, 60, 150_000),
        f"""WITH t AS (SELECT id, created_at, count, bytes, CASE WHEN count < 8 THEN 0 WHEN count < 128 THEN 1 WHEN count < 2048 THEN 2 WHEN count < 32768 THEN 3 ELSE 4 END AS tier
              FROM {{g_packs}} WHERE state = 'live' AND count BETWEEN 1 AND 50000 AND bytes < 67108864 AND created_at <= {NOW}),
            best AS (SELECT tier FROM t GROUP BY tier HAVING count(*) >= 8 ORDER BY count(*) DESC, tier LIMIT 1),
            r AS (SELECT t.*, row_number() OVER w AS n, sum(count) OVER w AS c, sum(bytes) OVER w AS b FROM t JOIN best USING (tier) WINDOW w AS (ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT id, tier, count, bytes FROM r WHERE n <= 16 AND c <= 60 AND b <= 150000 AND (SELECT count(*) FROM r WHERE n <= 16 AND c <= 60 AND b <= 150000) >= 2""",
    ),
    "next_wake": (
        lambda v: packs.next_wake(packs.eligible(v.g_packs, NOW), 8, 1000),
        f"""SELECT min(created_at) + 1000 AS wake_at FROM (SELECT created_at, row_number() OVER (PARTITION BY CASE WHEN count < 8 THEN 0 WHEN count < 128 THEN 1 WHEN count < 2048 THEN 2 WHEN count < 32768 THEN 3 ELSE 4 END ORDER BY created_at, id) AS n
            FROM {{g_packs}} WHERE state = 'live' AND count BETWEEN 1 AND 50000 AND bytes < 67108864 AND created_at <= {NOW}) t WHERE n = 8""",
    ),
    "consolidate_plan": (
        lambda v: packs.consolidated(v.objects_by_pack(), v.cohort, v.g_objects.where("size % 2 = 0").select("sha").distinct()),
        f"""SELECT sha, pack_id, idx, CAST(coalesce(sum(len) OVER (ORDER BY pack_id, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset FROM {{g_objects}}
            WHERE pack_id IN (SELECT id FROM {_COHORT} c) AND sha IN (SELECT sha FROM {{g_objects}} WHERE size % 2 = 0)""",
    ),
    "retire_swap": (
        lambda v: packs.swap_stats(v.g_objects, v.g_objects.where("pack_id % 2 = 0").select("sha")),
        """SELECT count(*) FILTER (WHERE n = b) AS retired, count(*) FILTER (WHERE n <> b) AS kept, CAST(coalesce(sum(s) FILTER (WHERE n = b), 0) AS BIGINT) AS retired_bytes,
           CAST(coalesce(sum(s) FILTER (WHERE n <> b), 0) AS BIGINT) AS kept_bytes, count(*) FILTER (WHERE n <> b AND b > 0) AS lossy FROM (SELECT pack_id, count(*) AS n,
           count(*) FILTER (WHERE sha IN (SELECT sha FROM {g_objects} WHERE pack_id % 2 = 0)) AS b, sum(len) AS s FROM {g_objects} GROUP BY pack_id) t""",
    ),
    "next_start": (
        lambda v: packs.next_starts(v.g_objects),
        "SELECT pack_id, idx, offset + len AS until, lead(offset) OVER (PARTITION BY pack_id ORDER BY offset, idx) AS next FROM {g_objects}",
    ),
    "reachable_set": (lambda v: graph.reachable(v.roots, v.g_links), f"WITH RECURSIVE {_CLOSURE.replace('{links}', '{g_links}')} SELECT sha FROM reach"),
    "ff_ancestor": (
        lambda v: graph.fast_forward(v.sql(f"SELECT * FROM {_PAIRS} t"), v.g_commit_parents),
        f"""WITH RECURSIVE reach AS (SELECT old, new, new AS sha FROM {_PAIRS} p UNION SELECT r.old, r.new, l.dst FROM reach r JOIN {_UP} l ON l.src = r.sha WHERE r.sha <> r.old)
            SELECT old, new, CASE WHEN max(CAST(sha = old AS INT)) = 1 THEN true WHEN count(*) FILTER (WHERE sha NOT IN (SELECT sha FROM {{g_commit_parents}} WHERE n = -1)) > 0 THEN NULL ELSE false END AS is_ff
            FROM reach GROUP BY old, new""",
    ),
    "send_set": (
        lambda v: graph.send_set(v.roots, _ids_of(v, [720, 480, 100]), v.g_links),
        f"""WITH RECURSIVE {_CLOSURE.replace("{links}", "{g_links}")}, h AS (SELECT sha FROM {_HAVES} t UNION SELECT l.dst FROM h JOIN {{g_links}} l ON l.src = h.sha)
            SELECT sha FROM reach WHERE sha NOT IN (SELECT sha FROM h)""",
    ),
    "depth_cut": (
        lambda v: graph.depth_cut(_ids_of(v, [1440, 1296]), v.g_commit_parents, 4),
        f"""WITH RECURSIVE d AS (SELECT sha, 1 AS depth FROM {_TIPS} t UNION SELECT l.dst, d.depth + 1 FROM d JOIN {_UP} l ON l.src = d.sha WHERE d.depth < 4),
            s AS (SELECT sha, min(depth) AS depth FROM d GROUP BY sha)
            SELECT sha, depth, EXISTS (SELECT 1 FROM {_UP} l WHERE l.src = s.sha AND l.dst NOT IN (SELECT sha FROM s)) AS shallow FROM s""",
    ),
    "time_cut": (
        lambda v: graph.time_cut(_ids_of(v, [1440, 1296]), v.g_commit_parents, v.times, 830_000_000_000),
        f"""WITH RECURSIVE d AS (SELECT sha FROM {_TIPS} t UNION SELECT l.dst FROM d JOIN {_UP} l ON l.src = d.sha WHERE l.dst NOT IN (SELECT sha FROM {_TIMES} x WHERE at < 830000000000)) SELECT sha FROM d""",
    ),
    "garbage_set": (
        lambda v: graph.garbage(v.g_objects, v.g_packs, v.roots, v.g_links, 820_000_000_000),
        f"""WITH RECURSIVE live AS (SELECT o.*, p.created_at FROM {{g_objects}} o JOIN {{g_packs}} p ON p.id = o.pack_id WHERE p.state = 'live'),
            reach AS (SELECT sha FROM (SELECT sha FROM {_ROOTS} t UNION SELECT sha FROM live WHERE created_at >= 820000000000 AND kind <> 3) z UNION SELECT l.dst FROM reach JOIN {{g_links}} l ON l.src = reach.sha)
            SELECT sha, pack_id, idx FROM live WHERE created_at < 820000000000 AND sha NOT IN (SELECT sha FROM reach)""",
    ),
    "integrity_check": (
        lambda v: graph.integrity(v.roots, v.g_links, v.g_objects.where("pack_id % 2 = 0")),
        f"WITH RECURSIVE {_CLOSURE.replace('{links}', '{g_links}')} SELECT sha FROM reach WHERE sha NOT IN (SELECT sha FROM {{g_objects}} WHERE pack_id % 2 = 0)",
    ),
    "generation_numbers": (
        lambda v: graph.generations(v.g_commit_parents, v.sql("SELECT CAST(o_orderkey AS STRING) AS sha FROM {orders}")),
        """WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) AS k, 1 AS gen UNION SELECT o.o_orderkey, g.gen + 1 FROM g JOIN (SELECT o_orderkey, o_orderkey div 2 AS p FROM {orders} WHERE o_orderkey > 0
            UNION ALL SELECT o_orderkey, o_orderkey div 3 FROM {orders} WHERE o_orderkey % 5 = 0 AND o_orderkey > 2) o ON o.p = g.k) SELECT CAST(k AS STRING) AS sha, max(gen) AS gen FROM g GROUP BY k""",
    ),
    "merge_base": (
        lambda v: graph.merge_base(_ids_of(v, [1440]), _ids_of(v, [1296]), v.g_commit_parents),
        f"""WITH RECURSIVE a AS (SELECT '1440' AS sha UNION SELECT l.dst FROM a JOIN {_UP} l ON l.src = a.sha), b AS (SELECT '1296' AS sha UNION SELECT l.dst FROM b JOIN {_UP} l ON l.src = b.sha),
            c AS (SELECT sha FROM a WHERE sha IN (SELECT sha FROM b)) SELECT sha FROM c WHERE sha NOT IN (SELECT l.dst FROM {_UP} l JOIN c ON c.sha = l.src)""",
    ),
    "first_parent_chain": (
        lambda v: graph.first_parents(_ids_of(v, [1440]), v.g_commit_parents),
        """WITH RECURSIVE c AS (SELECT CAST(1440 AS BIGINT) AS k, 0 AS pos UNION ALL SELECT k div 2, pos + 1 FROM c WHERE k > 0) SELECT CAST(k AS STRING) AS sha, pos FROM c""",
    ),
    "bisect_probes": (
        lambda v: graph.evenly_spaced(graph.first_parents(_ids_of(v, [1440]), v.g_commit_parents), 3),
        """WITH RECURSIVE c AS (SELECT CAST(1440 AS BIGINT) AS k, 0 AS pos UNION ALL SELECT k div 2, pos + 1 FROM c WHERE k > 0)
           SELECT CAST(k AS STRING) AS sha, pos FROM c WHERE pos IN (SELECT (i * (SELECT max(pos) FROM c)) div 4 FROM (VALUES (1), (2), (3)) v(i))""",
    ),
    "delta_resolve": (
        lambda v: graph.delta_levels(v.g_deltas),
        """WITH RECURSIVE d AS (SELECT id, 0 AS level FROM {g_deltas} WHERE base IS NULL UNION ALL SELECT g.id, d.level + 1 FROM d JOIN {g_deltas} g ON g.base = d.id WHERE d.level < 64)
           SELECT g.id, d.level FROM {g_deltas} g LEFT JOIN d ON d.id = g.id""",
    ),
    "tree_diff": (
        lambda v: graph.tree_diff(v.g_tree_a, v.g_tree_b),
        "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.oid IS NULL THEN 'A' WHEN b.oid IS NULL THEN 'D' ELSE 'M' END AS change FROM {g_tree_a} a FULL JOIN {g_tree_b} b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid",
    ),
    "three_way_merge": (
        lambda v: graph.three_way_merge(v.g_tree_base, v.g_tree_a, v.g_tree_b),
        """SELECT path, CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o WHEN o IS NOT DISTINCT FROM b THEN t END AS oid,
           CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b OR o IS NOT DISTINCT FROM b THEN 'merged' ELSE 'conflict' END AS outcome
           FROM (SELECT path, max(b) AS b, max(o) AS o, max(t) AS t FROM (SELECT path, oid AS b, NULL AS o, NULL AS t FROM {g_tree_base} UNION ALL SELECT path, NULL, oid, NULL FROM {g_tree_a}
           UNION ALL SELECT path, NULL, NULL, oid FROM {g_tree_b}) x GROUP BY path) y""",
    ),
    "ref_cas_fold": (
        lambda v: refs.cas_fold(v.g_commands),
        """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS r FROM {g_commands}),
           f AS (SELECT name, r, seq, old IS NULL AS accepted, CASE WHEN old IS NULL THEN new END AS now FROM c WHERE r = 1
             UNION ALL SELECT c.name, c.r, c.seq, f.now IS NOT DISTINCT FROM c.old, CASE WHEN f.now IS NOT DISTINCT FROM c.old THEN c.new ELSE f.now END FROM f JOIN c ON c.name = f.name AND c.r = f.r + 1)
           SELECT name, seq, accepted FROM f""",
    ),
    "policy_cascade": (
        lambda v: refs.refusal(v.g_commands, refs.as_of(v.g_reflog, 10**15), v.g_reflog.select(F.col("new").alias("sha")).where("sha < 'c'"), "refs/heads/u1*"),
        """SELECT c.seq, c.name, CASE WHEN c.name NOT LIKE 'refs/heads/u1%' THEN 'out of scope' WHEN c.old IS NULL AND c.new IS NULL THEN 'nothing to do'
             WHEN c.new IS NOT NULL AND NOT (c.new < 'c') THEN 'missing object' WHEN c.old IS DISTINCT FROM r.target THEN 'stale' END AS reason
           FROM {g_commands} c LEFT JOIN (SELECT name, target FROM (SELECT name, new AS target, row_number() OVER (PARTITION BY name ORDER BY at DESC, id DESC) AS n FROM {g_reflog}) t WHERE n = 1) r ON r.name = c.name""",
    ),
    "protected_verdict": (
        lambda v: v.g_commands.select("seq", refs.protected_verdict(F.col("old"), F.col("new"), F.when(F.col("seq") % 3 > 0, F.col("seq") % 3 == 1)).alias("verdict")),
        "SELECT seq, CASE WHEN new IS NULL THEN 'refuse' WHEN old IS NULL THEN 'allow' WHEN seq % 3 = 0 THEN 'unknown' WHEN seq % 3 = 1 THEN 'allow' ELSE 'refuse' END AS verdict FROM {g_commands}",
    ),
    "atomic_push": (
        lambda v: refs.all_or_nothing(v.g_commands.select("push_id", "seq", (F.col("seq") % 37 > 0).alias("accepted"))),
        """SELECT push_id, seq, ok AS committed, CASE WHEN ok THEN 'ok' WHEN seq % 37 = 0 THEN 'failed' ELSE 'atomic push failed' END AS status
           FROM (SELECT push_id, seq, min(CAST(seq % 37 > 0 AS INT)) OVER (PARTITION BY push_id) = 1 AS ok FROM {g_commands}) t""",
    ),
    "refs_version": (
        lambda v: refs.version_bumps(v.g_commands.groupBy("push_id").agg((F.max(F.col("seq") % 11) == 10).alias("any_ok"), (F.max("push_id") % 4 == 0).alias("went_live"))),
        """SELECT push_id, CAST(sum(CASE WHEN m = 10 OR push_id % 4 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY push_id) AS BIGINT) AS refs_version FROM (SELECT push_id, max(seq % 11) AS m FROM {g_commands} GROUP BY push_id) t""",
    ),
    "as_of_refs": (
        lambda v: refs.as_of(v.g_reflog, 1_705_000_000_000),
        "SELECT name, target FROM (SELECT name, new AS target, row_number() OVER (PARTITION BY name ORDER BY at DESC, id DESC) AS n FROM {g_reflog} WHERE at < 1705000000000) t WHERE n = 1 AND target IS NOT NULL",
    ),
    "reflog_retention": (
        lambda v: refs.retained(v.g_reflog, 1_705_000_000_000),
        "SELECT id, name, at FROM (SELECT *, max(id) OVER (PARTITION BY name) AS newest FROM {g_reflog}) t WHERE at >= 1705000000000 OR id = newest",
    ),
    "monotonic_at": (
        lambda v: refs.monotonic(v.g_reflog.withColumn("at", F.col("at") - (F.col("id") % 13) * 10**8)),
        """SELECT id, name, max(at - i) OVER (PARTITION BY name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i AS at
           FROM (SELECT id, name, at - (id % 13) * 100000000 AS at, row_number() OVER (PARTITION BY name ORDER BY id) AS i FROM {g_reflog}) t""",
    ),
    "hash_chain": (
        lambda v: refs.hash_chain(v.g_reflog),
        """WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM {g_reflog}),
           f AS (SELECT name, id, r, sha256(concat_ws('|', CAST(id AS STRING), coalesce(new, ''), '')) AS hash FROM c WHERE r = 1
             UNION ALL SELECT c.name, c.id, c.r, sha256(concat_ws('|', CAST(c.id AS STRING), coalesce(c.new, ''), f.hash)) FROM f JOIN c ON c.name = f.name AND c.r = f.r + 1) SELECT name, id, hash FROM f""",
    ),
    "last_writer_wins": (
        lambda v: refs.last_writer(v.g_reflog.select(F.col("name").alias("path"), (F.col("id") % 50).alias("lamport"), F.col("id").alias("actor"), F.col("new").alias("blob"))),
        "SELECT path, blob FROM (SELECT name AS path, new AS blob, row_number() OVER (PARTITION BY name ORDER BY id % 50 DESC, id DESC) AS n FROM {g_reflog}) t WHERE n = 1 AND blob IS NOT NULL",
    ),
    "due_job_top1": (
        lambda v: jobs.due_job(v.g_jobs, 10**13),
        "SELECT id, kind, run_at FROM {g_jobs} WHERE state = 'queued' AND run_at <= 10000000000000 ORDER BY run_at, id LIMIT 1",
    ),
    "next_alarm": (lambda v: jobs.next_alarm(v.g_jobs), "SELECT min(run_at) AS alarm_at FROM {g_jobs} WHERE state = 'queued'"),
    "job_backoff": (
        lambda v: jobs.after_failure(v.g_jobs, NOW),
        f"""SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'queued' END AS state,
            CASE WHEN attempts + 1 < 8 THEN {NOW} + least(30000 * CAST(pow(2, attempts + 1) AS BIGINT), 3600000) END AS run_at FROM {{g_jobs}}""",
    ),
    "stranded_repair": (
        lambda v: jobs.repaired(v.g_jobs, 1_705_000_000_000),
        """SELECT id, CASE WHEN s AND strands >= 64 THEN 'dead' WHEN s THEN 'queued' ELSE state END AS state, CASE WHEN s AND strands < 64 THEN 1705000000000 ELSE run_at END AS run_at,
           CASE WHEN s AND strands < 64 THEN strands + 1 ELSE strands END AS strands FROM (SELECT *, state = 'running' AND started_at < 1705000000000 - 60000 AS s FROM {g_jobs}) t""",
    ),
    "enqueue_dedup": (lambda v: jobs.one_per_kind(v.g_jobs), "SELECT kind, min(id) AS id FROM {g_jobs} WHERE state = 'queued' GROUP BY kind"),
    "quarantine_strikes": (
        lambda v: jobs.quarantined(v.g_reflog.select((F.col("id") % 700).alias("id"), (F.col("id") % 3).alias("strikes")), live=v.g_packs.where("state = 'live'")),
        """SELECT id % 700 AS id, CAST(sum(id % 3) AS BIGINT) AS strikes FROM {g_reflog} WHERE id % 700 IN (SELECT id FROM {g_packs} WHERE state = 'live') GROUP BY id % 700
           HAVING sum(id % 3) >= 2 ORDER BY id LIMIT 256""",
    ),
    "rate_window": (
        lambda v: jobs.rate_refusals(v.g_reflog.select((F.col("id") % 3).alias("bucket"), "id", "at"), 3, 3_600_000),
        """SELECT t.bucket, t.id, t.n + coalesce(p.prev, 0) * (1 - (t.at % 3600000) / 3600000.0) > 3 AS refused FROM (SELECT id % 3 AS bucket, id, at, at div 3600000 AS win,
           row_number() OVER (PARTITION BY id % 3, at div 3600000 ORDER BY at, id) AS n FROM {g_reflog}) t
           LEFT JOIN (SELECT id % 3 AS bucket, at div 3600000 + 1 AS win, count(*) AS prev FROM {g_reflog} GROUP BY ALL) p ON p.bucket = t.bucket AND p.win = t.win""",
    ),
    "in_order_drain": (
        lambda v: jobs.drained(v.g_reflog.select("name", F.col("id").alias("seq"), F.col("new").isNull().alias("failed")).withColumnRenamed("name", "lane")),
        "SELECT name AS lane, id AS seq FROM (SELECT *, min(CASE WHEN new IS NULL THEN id END) OVER (PARTITION BY name) AS stop FROM {g_reflog}) t WHERE stop IS NULL OR id < stop",
    ),
    "outbox_bound": (
        lambda v: jobs.bounded_outbox(v.g_reflog.select(F.col("name").alias("lane"), F.col("id").alias("seq")), 30),
        "SELECT name AS lane, least(count(*), 30) AS stored, greatest(count(*) - 30, 0) AS dropped FROM {g_reflog} GROUP BY name",
    ),
    "stage_gating": (
        lambda v: jobs.next_stage(v.conversations.select(F.col("conv_id").alias("run"), F.col("turn").alias("seq"), F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, "done").otherwise("queued").alias("state"))),
        "SELECT conv_id AS run, min(turn) AS seq FROM {conversations} WHERE (turn + conv_id) % 3 <> 0 GROUP BY conv_id",
    ),
    "storage_tiers": (
        lambda v: jobs.tiers(_touches(v), 1_706_000_000_000, 86_400_000, 864_000_000, 200, 200),
        """SELECT name AS key, CASE WHEN max(at) >= 1706000000000 - 86400000 AND s <= 200 THEN 'hot' WHEN max(at) < 1706000000000 - 864000000 AND s >= 200 THEN 'cold' ELSE 'warm' END AS tier
           FROM (SELECT *, CAST(substring(name, 13) AS BIGINT) % 5 * 100 AS s FROM {g_reflog}) t GROUP BY name, s""",
    ),
    "popularity_top8": (
        lambda v: jobs.popular(_touches(v), 1_704_500_000_000),
        "SELECT name AS key, count(*) AS n FROM {g_reflog} WHERE at >= 1704500000000 GROUP BY name ORDER BY n DESC, key LIMIT 8",
    ),
    "object_ids": (
        lambda v: v.documents.select("doc_id", content.object_id("blob", F.col("text")).alias("oid")),
        "SELECT doc_id, sha1(encode(concat('blob ', CAST(octet_length(encode(text)) AS STRING))) || '\\x00'::BLOB || encode(text)) AS oid FROM {documents}",
    ),
    "pkt_lines": (
        lambda v: v.g_refs.select(content.pkt_line(F.concat_ws(" ", "target", "name")).alias("line")),
        "SELECT concat(lpad(lower(to_hex(length(concat_ws(' ', target, name)) + 4)), 4, '0'), concat_ws(' ', target, name)) AS line FROM {g_refs}",
    ),
    "search_bm25": (
        lambda v: content.bm25(v.documents, ["license", "work", "public"], 20),
        """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM {documents}), s AS (SELECT doc_id, len(ws) AS n, ws FROM w), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM s),
           t AS (SELECT doc_id, n, u.term, count(*) AS tf FROM s, unnest(ws) u(term) WHERE u.term IN ('license', 'work', 'public') GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
           SELECT doc_id AS id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM t JOIN d USING (term), a GROUP BY doc_id ORDER BY score DESC, id LIMIT 20""",
    ),
    "vector_topk": (
        lambda v: content.nearest(v.embeddings, [float(i % 7 - 3) for i in range(64)], 10),
        "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: CAST(i % 7 - 3 AS DOUBLE))), 9) AS score FROM {embeddings} ORDER BY score DESC, id LIMIT 10",
    ),
    "job_claim": (
        lambda v: jobs.claimed(v.g_jobs, v.sql(f"SELECT * FROM {_CLAIMS} t")),
        f"""SELECT id, 'running' AS state, at AS started_at, lease FROM (SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY at, lease) AS n FROM {_CLAIMS} c JOIN {{g_jobs}} j ON j.id = c.id
            WHERE j.state = 'queued') t WHERE n = 1""",
    ),
    "job_heartbeat": (
        lambda v: jobs.heartbeats(v.g_jobs.withColumn("lease", F.sha1(F.col("id").cast("string"))), v.sql(f"SELECT * FROM {_BEATS} t")),
        f"SELECT b.id, b.lease, b.at, coalesce(j.state = 'running' AND b.lease = sha1(CAST(j.id AS STRING)), false) AS counts FROM {_BEATS} b LEFT JOIN {{g_jobs}} j ON j.id = b.id",
    ),
    "job_outcomes": (
        lambda v: jobs.landed(v.g_jobs.withColumn("lease", F.sha1(F.col("id").cast("string"))), v.sql(f"SELECT * FROM {_OUTCOMES} t"), NOW),
        f"""SELECT id, CASE WHEN NOT mine THEN 'stale' WHEN kind = 'error' AND attempts + 1 >= 8 THEN 'dead' WHEN kind = 'error' THEN 'retry' ELSE kind END AS outcome,
            CASE WHEN NOT mine OR kind = 'done' THEN NULL WHEN kind = 'error' AND attempts + 1 >= 8 THEN 'dead' ELSE 'queued' END AS state,
            CASE WHEN NOT mine THEN NULL WHEN kind = 'continue' THEN {NOW} WHEN kind = 'reschedule' THEN at
                 WHEN kind = 'error' AND attempts + 1 < 8 THEN {NOW} + least(3600000, 60000 * CAST(pow(2, attempts) AS BIGINT)) END AS run_at
            FROM (SELECT o.id, o.kind, o.run_at AS at, j.attempts, j.state = 'running' AND o.lease = sha1(CAST(j.id AS STRING)) AS mine FROM {_OUTCOMES} o JOIN {{g_jobs}} j ON j.id = o.id) t""",
    ),
    "mark_bitmaps": (
        lambda v: bitmaps.bitmaps(v.g_packs.where("count > 0"), v.sql("SELECT pack_id AS id, idx FROM {g_objects} WHERE size % 3 > 0")).select("id", F.lower(F.hex("bitmap")).alias("bitmap")),
        """SELECT id, string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY byte) AS bitmap FROM (SELECT pack_id AS id, idx div 8 AS byte,
           CAST(sum(CASE WHEN size % 3 > 0 THEN CAST(pow(2, idx % 8) AS BIGINT) ELSE 0 END) AS BIGINT) AS b FROM {g_objects} GROUP BY ALL) t GROUP BY id""",
    ),
    "bitmap_entries": (
        lambda v: bitmaps.entries(bitmaps.bitmaps(v.g_packs.where("count > 0"), v.sql("SELECT pack_id AS id, idx FROM {g_objects} WHERE size % 3 > 0"))),
        "SELECT pack_id AS id, idx FROM {g_objects} WHERE size % 3 > 0",
    ),
    "bitmap_compare": (
        lambda v: bitmaps.compared(v.g_packs.where("count > 0"), v.sql("SELECT pack_id AS id, idx FROM {g_objects} WHERE size % 3 > 0"), v.sql("SELECT pack_id AS id, idx FROM {g_objects} WHERE size % 7 > 0")),
        """SELECT pack_id AS id, count(*) FILTER (WHERE size % 3 > 0) AS marked, count(*) FILTER (WHERE size % 7 > 0) AS built, count(*) FILTER (WHERE size % 3 = 0) = 0 AS all_set,
           count(*) FILTER (WHERE size % 3 > 0 AND size % 7 = 0) = 0 AS subset, count(*) FILTER (WHERE size % 3 > 0 AND size % 7 = 0) > 0 AS lossy FROM {g_objects} GROUP BY pack_id""",
    ),
    "chain_verify": (
        lambda v: refs.chain_breaks(refs.hash_chain(v.g_reflog).join(v.g_reflog.select("name", "id", F.when(F.col("id") % 211 == 5, "forged").otherwise(F.col("new")).alias("new")), ["name", "id"])),
        "SELECT name, id FROM {g_reflog} WHERE id % 211 = 5",
    ),
    "push_begin": (
        lambda v: admin.begun_pushes(v.sql(f"SELECT * FROM {_BEGIN_ASKS} t"), v.sql(f"SELECT * FROM {_BEGIN_HELD} t"), v.g_packs.where("id < 0"), 100, 10_000_000),
        f"""SELECT a.push_id, CASE WHEN h.id IS NULL THEN 'open' WHEN h.state = 'open' AND h.principal = a.principal AND h.auth = a.auth THEN 'again' WHEN h.state = 'open' THEN 'forbidden'
            ELSE concat('conflict: ', h.state) END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY push_id ORDER BY seq) AS n FROM {_BEGIN_ASKS} t) a LEFT JOIN {_BEGIN_HELD} h ON h.id = a.push_id WHERE n = 1""",
    ),
    "push_admission": (
        lambda v: admin.begun_pushes(v.sql(f"SELECT * FROM {_BEGIN_ASKS} t"), v.sql(f"SELECT * FROM {_BEGIN_HELD} t WHERE id < 40"), v.g_packs, 1_000_000_000, 30),
        f"""WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY push_id ORDER BY seq) AS n FROM {_BEGIN_ASKS} t) x WHERE n = 1), h AS (SELECT * FROM {_BEGIN_HELD} t WHERE id < 40),
            r AS (SELECT push_id, row_number() OVER (ORDER BY seq, push_id) AS place FROM a WHERE push_id NOT IN (SELECT id FROM h))
            SELECT a.push_id, CASE WHEN h.state = 'open' AND h.principal = a.principal AND h.auth = a.auth THEN 'again' WHEN h.state = 'open' THEN 'forbidden' WHEN h.id IS NOT NULL THEN concat('conflict: ', h.state)
            WHEN place + (SELECT count(*) FROM h WHERE state = 'open') > 30 THEN 'too many open pushes' ELSE 'open' END AS verdict FROM a LEFT JOIN h ON h.id = a.push_id LEFT JOIN r ON r.push_id = a.push_id""",
    ),
    "review_sequence": (
        lambda v: content.numbered(v.conversations.select("conv_id", "turn", "role"), "conv_id", ["turn", "role"]).select("conv_id", "turn", "seq"),
        "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INT) AS seq FROM {conversations}",
    ),
}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def duck_queries() -> dict[str, str]:
    return {name: duck(sql) for name, (_, sql) in QUERIES.items()}
