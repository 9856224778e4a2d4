"""Walks of shallow and tagged histories, by whole-level frontiers over commit parents(sha, n, parent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.staging import staged
from basalt.operators.graph import levels, parent_links, reachable


def _marks(ids: DataFrame, name: str) -> DataFrame:
    return ids.select("sha").distinct().withColumn(name, F.lit(True))


def deepened(tips: DataFrame, parents: DataFrame, shallow: DataFrame, depth: int, relative: bool = False, acks: DataFrame | None = None) -> DataFrame:
    """The walk of a client that already holds shallow(sha) commits, its boundary at `depth`.

    Returns every visited (sha, depth, outcome): `send`, `shallow` (sent, with a parent that the client will lack), `unshallow` (a held
    boundary whose parents are now all held), `held`. Depths count from the tips (1), or, if relative, from below the client's boundary,
    commits above it being free. A commit that a level reaches in several ways counts as the boundary-counted one, then as the shallowest.
    """
    links, own = staged(parent_links(parents)), _marks(shallow, "own")
    has = _marks(acks, "ack") if acks is not None else own.limit(0).withColumnRenamed("own", "ack")
    frontier, found = tips.select("sha", F.lit(1).alias("depth"), F.lit(not relative).alias("counted")), []
    while True:
        one = frontier.groupBy("sha").agg(F.min(F.struct((~F.col("counted")).alias("free"), "depth")).alias("v")).select("sha", "v.depth", "v.free")
        if found:
            one = one.join(reduce(DataFrame.unionAll, [f.select("sha") for f in found]), "sha", "left_anti")
        level = one.join(own, "sha", "left").join(has, "sha", "left")
        edge = ~F.col("free") & (F.col("depth") >= depth)
        passes = F.col("own").isNotNull() & (F.lit(relative) | (F.col("depth") < depth))
        level = level.select("sha", "depth", "free", F.col("own").isNotNull().alias("own"), F.col("ack").isNotNull().alias("ack"), edge.alias("edge"), passes.alias("passes"))
        level = staged(level)
        if level.isEmpty():
            break
        found.append(level)
        deeper = F.when(F.col("passes") & F.lit(relative), F.lit(1)).otherwise(F.col("depth") + 1)
        onward = level.where("passes or not (own or edge)").select(F.col("sha").alias("src"), deeper.alias("depth"), (F.col("passes") | ~F.col("free")).alias("counted"))
        frontier = onward.join(links, "src").select(F.col("dst").alias("sha"), "depth", "counted")
        if len(found) % 8 == 0:
            found = [staged(reduce(DataFrame.unionAll, found))]
    if not found:
        return tips.select("sha", F.lit(1).alias("depth"), F.lit("send").alias("outcome")).limit(0)
    seen = reduce(DataFrame.unionAll, found)
    client = seen.where("not own and not ack").select("sha").unionAll(own.select("sha")).unionAll(has.select("sha"))
    lacking = seen.select(F.col("sha").alias("src")).join(links, "src").join(client.select(F.col("sha").alias("dst")), "dst", "left_anti")
    rows = seen.join(lacking.select(F.col("src").alias("sha")).distinct().withColumn("lacks", F.lit(True)), "sha", "left")
    free = ~(F.col("own") | F.col("ack"))
    outcome = F.when(free & F.col("lacks").isNotNull(), "shallow").when(free, "send").when(F.col("passes") & F.col("lacks").isNull(), "unshallow").otherwise("held")
    return rows.select("sha", "depth", outcome.alias("outcome"))


def without(tips: DataFrame, parents: DataFrame, excluded: DataFrame) -> DataFrame:
    """Commits of tips outside the whole history of excluded(sha); an excluded id without a recorded commit excludes nothing."""
    links = parent_links(parents)
    known = excluded.join(parents.select("sha"), "sha", "left_semi")
    return levels(tips, links, stop=reachable(known, links)).select("sha")


def peeled(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(sha) followed through tags(sha, target) to what is no tag: (sha, peeled, nesting). Cycles of tags have no row."""
    at, found = staged(ids.select("sha", F.col("sha").alias("peeled")).distinct()), []
    links, nesting, most = staged(tags.select(F.col("sha").alias("peeled"), "target")), 0, None
    while not at.isEmpty():
        found.append(at.join(links, "peeled", "left_anti").select("sha", "peeled", F.lit(nesting).alias("nesting")))
        most = links.count() if most is None else most
        nesting += 1
        if nesting > most:  # longer than all tags: a cycle
            break
        at = staged(at.join(links, "peeled").select("sha", F.col("target").alias("peeled")))
    return reduce(DataFrame.unionAll, found) if found else at.withColumn("nesting", F.lit(0))


def riding_tags(refs: DataFrame, held: DataFrame) -> DataFrame:
    """refs(name, target, peeled): tag objects whose peeled target the client will hold."""
    tags = refs.where(F.col("name").startswith("refs/tags/") & F.col("peeled").isNotNull())
    return tags.join(held.select(F.col("sha").alias("peeled")).distinct(), "peeled", "left_semi").select(F.col("target").alias("sha")).distinct()


def sparse_new(new: DataFrame, base: DataFrame) -> DataFrame:
    """Entries (path, oid) of a tree that no entry of the counterpart folder of a base tree holds, under any name: distinct oids.

    The counterpart is the folder of the same path; what moved between folders is sent again, as the sparse edge allows.
    """
    folder = F.regexp_replace("path", "[^/]*$", "")
    left, right = new.select(folder.alias("folder"), "oid").distinct(), base.select(folder.alias("folder"), "oid").distinct()
    return left.join(right, ["folder", "oid"], "left_anti").select("oid").distinct()


def horizon(tips: DataFrame, parents: DataFrame, times: DataFrame, since: int) -> DataFrame:
    """Commits before a time that a newer commit of the walk has as parent: where a boxed history ends."""
    links = parent_links(parents)
    old = staged(times.where(F.col("at") < since).select("sha"))
    inside = levels(tips.join(old, "sha", "left_anti"), links, stop=old).select(F.col("sha").alias("src"))
    return inside.join(links, "src").select(F.col("dst").alias("sha")).distinct().join(old, "sha", "left_semi")


def unmarked(objects: DataFrame, packs: DataFrame, cohort: DataFrame, marked: DataFrame, roots: DataFrame, frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Reachable ids whose every live copy is an unmarked entry of the cohort and which the frontier does not reach: a marking that loses nothing has none."""
    # what is reached is mostly far less than all objects: the rest is dropped before anything is moved
    reached = staged(reachable(roots, links).join(reachable(frontier, links), "sha", "left_anti"))
    wanted = staged(objects.select("sha", "pack_id").join(reached, "sha", "left_semi"))
    live = wanted.join(packs.where("state = 'live'").select(F.col("id").alias("pack_id")), "pack_id", "left_semi")
    mine, marks = cohort.select(F.col("id").alias("pack_id"), F.lit(True).alias("mine")).distinct(), _marks(marked.join(reached, "sha", "left_semi"), "marked")
    open_ = live.join(mine, "pack_id", "left").join(marks, "sha", "left").groupBy("sha").agg(F.bool_and(F.col("mine").isNotNull() & F.col("marked").isNull()).alias("open"))
    return open_.where("open").select("sha")
