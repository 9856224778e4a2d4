"""Reachability over links(src, dst) and commit parents(sha, n, parent), in a number of rounds that grows with the logarithm of depth.

Shallow graphs are walked level by level: each round takes the frontier's links, drops what was seen, and writes the new
level; while a frontier is small, it is sent to the links and to what was seen, neither of which moves. What is left after PLAIN rounds is deep, and is reached by doubling: tables of the nodes at distance 1, 2, 4, .. of each node,
each the join of the last with itself, then every distance as a sum of those. A table has as many rows as there are nodes times
the nodes at one distance, which is the number of branches side by side, not the history's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.staging import filed_by, staged


PLAIN = 24
#: Rows of a frontier that is sent to the links in place of moving them.
SMALL = 100_000


def jumps(links: DataFrame, nodes: int) -> list[DataFrame]:
    """Tables (src, dst) of nodes at distance 1, 2, 4, .., up to the longest path or, where links make a cycle, the number of nodes."""
    tables = [links]
    while 2 ** len(tables) <= nodes:
        last = tables[-1]
        far = staged(last.join(last.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct())
        if far.isEmpty():
            break
        tables.append(far)
    return tables


def deep_levels(start: DataFrame, links: DataFrame, most: int | None, keys: list[str]) -> DataFrame:
    """(*keys, sha, depth) of start and all beyond it, at its least depth; each distance is a sum of powers of two."""
    nodes = links.select("src").distinct().count() + 1
    found = start
    for k, table in reversed(list(enumerate(jumps(links, nodes)))):
        ahead = found.withColumnRenamed("sha", "src").join(table, "src").select(*keys, F.col("dst").alias("sha"), (F.col("depth") + 2**k).alias("depth"))
        both = found.select(*keys, "sha", "depth").unionAll(ahead if most is None else ahead.where(F.col("depth") <= most))
        found = staged(both.groupBy(*keys, "sha").agg(F.min("depth").alias("depth")))
    return found


class Steps:
    """links(src, dst), one step at a time: a small frontier picks its links where they are derived, so that only these move; the first
    large one that leads on has the links filed by source, once."""

    def __init__(self, links: DataFrame):
        self.links, self.filed, self.sources = links, None, None

    def leading(self, frontier: DataFrame, n: int) -> tuple[DataFrame, int]:
        """The rows of a frontier of n rows that are the source of a link, if it is large; a leaf needs no join with the links."""
        if n <= SMALL or self.filed is not None:
            return frontier, n
        if self.sources is None:
            self.sources = staged(self.links.select(F.col("src").alias("sha")).distinct())
        frontier = staged(frontier.join(self.sources, "sha", "left_semi"))
        return frontier, frontier.count()

    def beyond(self, frontier: DataFrame, n: int, keys: list[str]) -> DataFrame:
        """(*keys, sha) one link beyond a frontier(*keys, sha) of n rows."""
        frontier, n = self.leading(frontier.select(*keys, "sha"), n)
        if n > SMALL and self.filed is None:
            self.filed = filed_by(self.links, "src")
        links, at = self.filed or self.links, frontier.withColumnRenamed("sha", "src")
        if n <= SMALL:
            links = links.join(F.broadcast(at.select("src").distinct()), "src", "left_semi")
            at = F.broadcast(at)
        found = at.join(links, "src") if keys else links if n <= SMALL else links.join(at, "src", "left_semi")
        return found.select(*keys, F.col("dst").alias("sha")).distinct()


def fresh(new: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """Written rows of new that seen does not have; the many rows of seen stay where they are while new is small."""
    new = staged(new)
    if new.count() > SMALL:
        return staged(new.join(seen, on, "left_anti"))
    again = seen.select(*on).join(F.broadcast(new.select(*on)), on, "left_semi").distinct()
    return staged(new.join(again, on, "left_anti"))


def levels(roots: DataFrame, links: DataFrame, most: int | None = None, stop: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, sha, depth) of everything reachable from roots(*keys, sha), depth 1 first; ids in stop(sha) are not entered."""
    keys = list(keys)
    start, links = roots.select(*keys, "sha").distinct(), links.select("src", "dst")
    if stop is not None:
        stop = staged(stop.select("sha").distinct())
        start = start.join(stop, "sha", "left_anti").select(*keys, "sha")
    steps = Steps(links)
    found, depth = [staged(start.withColumn("depth", F.lit(1)))], 1
    while (n := found[-1].count()) and (most is None or depth < most):
        if depth >= PLAIN:
            deep = links if stop is None else links.join(stop.select(F.col("sha").alias("dst")), "dst", "left_anti").select("src", "dst")
            beyond = deep_levels(found[-1], staged(deep), most, keys)
            every = reduce(DataFrame.unionAll, [*found[:-1], beyond.select(*found[0].columns)])
            return every.groupBy(*keys, "sha").agg(F.min("depth").alias("depth"))
        depth += 1
        new = steps.beyond(found[-1], n, keys)
        if stop is not None:
            new = fresh(new, stop, ["sha"]).select(*keys, "sha")
        seen = reduce(DataFrame.unionAll, [x.select(*keys, "sha") for x in found])
        found.append(fresh(new, seen, [*keys, "sha"]).select(*keys, "sha").withColumn("depth", F.lit(depth)))
        if len(found) % 8 == 0:  # few large tables in place of many small ones
            found = [staged(reduce(DataFrame.unionAll, found[:-1])), found[-1]]
    return reduce(DataFrame.unionAll, found)


def parent_links(parents: DataFrame) -> DataFrame:
    return parents.where("n >= 0").select(F.col("sha").alias("src"), F.col("parent").alias("dst"))


def reachable(roots: DataFrame, links: DataFrame) -> DataFrame:
    return levels(roots, links).select("sha")


#: Commits that one fast-forward test may see.
MOST_SEEN = 200_000


def fast_forward(pairs: DataFrame, parents: DataFrame, most: int = MOST_SEEN) -> DataFrame:
    """pairs(old, new) -> is_ff: true if old is an ancestor of new or new itself; null if an unrecorded commit was met or `most` commits were seen; else false."""
    seen = levels(pairs.select("old", "new", F.col("new").alias("sha")), parent_links(parents), keys=("old", "new"))
    recorded = parents.where("n = -1").select("sha", F.lit(1).alias("recorded")).distinct()
    hit, gap = F.max(F.col("sha") == F.col("old")), F.max(F.col("recorded").isNull()) | (F.count(F.lit(1)) >= most)
    return seen.join(recorded, "sha", "left").groupBy("old", "new").agg(F.when(hit, F.lit(True)).when(~gap, F.lit(False)).alias("is_ff"))


def garbage(objects: DataFrame, packs: DataFrame, roots: DataFrame, links: DataFrame, before: int) -> DataFrame:
    """Entries of live packs older than `before` that nothing reaches, younger live packs' objects being roots too."""
    live = objects.join(packs.where("state = 'live'").select(F.col("id").alias("pack_id"), "created_at"), "pack_id")
    live = staged(live.select("sha", "pack_id", "idx", (F.col("created_at") >= before).alias("young"), (F.col("kind") != 3).alias("root")))
    young = live.where("young and root").select("sha").distinct()
    held = reachable(roots.select("sha").unionAll(young), links)
    return live.where("not young").join(held, "sha", "left_anti").select("sha", "pack_id", "idx")


def send_set(wants: DataFrame, haves: DataFrame, links: DataFrame) -> DataFrame:
    """What wants reach and haves do not."""
    return levels(wants, links, stop=reachable(haves, links)).select("sha")


def depth_cut(tips: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """Commits within a depth of the tips (tips are 1), with `shallow`: some parent is not sent."""
    links = parent_links(parents)
    sent = staged(levels(tips, links, most=depth))
    missing = sent.join(links, F.col("sha") == F.col("src")).join(sent.select(F.col("sha").alias("dst")), "dst", "left_anti").select("sha").distinct().withColumn("shallow", F.lit(True))
    return sent.join(missing, "sha", "left").select("sha", "depth", F.coalesce("shallow", F.lit(False)).alias("shallow"))


def time_cut(tips: DataFrame, parents: DataFrame, times: DataFrame, since: int) -> DataFrame:
    """Commits reached through commits at or after a time only; tips are always sent."""
    walls = times.where(F.col("at") < since).select("sha").join(tips.select("sha"), "sha", "left_anti")
    return levels(tips, parent_links(parents), stop=walls).select("sha")


#: Rounds in which generations() goes from parents to children before it doubles distances.
LAYERS = 40


def generations(parents: DataFrame, commits: DataFrame) -> DataFrame:
    """gen = 1 + largest parent gen: one more than the longest path to a commit without known parents.

    Layer n holds the ends of paths of n commits, so a commit's generation is its last layer; a round reads the links once and writes its layer
    alone. Links are filed by parent, so that a round moves its layer and not the links. Histories of over LAYERS generations are numbered by doubling.
    """
    sha, links = commits.select("sha").distinct(), parent_links(parents).distinct()
    links = links.join(sha.withColumnRenamed("sha", "dst"), "dst", "left_semi").join(sha.withColumnRenamed("sha", "src"), "src", "left_semi")
    links = filed_by(links.select("src", "dst"), "dst")
    roots = sha.join(links.select(F.col("src").alias("sha")), "sha", "left_anti")
    found = [staged(roots.withColumn("gen", F.lit(1)))]
    while not found[-1].isEmpty():
        if len(found) >= LAYERS:
            return deep_generations(links, sha)
        ahead = found[-1].select(F.col("sha").alias("dst")).join(links, "dst").select(F.col("src").alias("sha")).distinct()
        found.append(staged(ahead.withColumn("gen", F.lit(len(found) + 1))))
    return reduce(DataFrame.unionAll, found).groupBy("sha").agg(F.max("gen").alias("gen"))


def deep_generations(links: DataFrame, commits: DataFrame) -> DataFrame:
    """The longest path's length is read off bit by bit, the highest first: a commit steps 2**k on where some node at its place has one that far away."""
    at = staged(commits.select("sha", F.col("sha").alias("src"), F.lit(1).alias("gen")))
    for k, table in reversed(list(enumerate(jumps(links, commits.count())))):
        ahead = at.join(table, "src").select("sha", F.col("dst").alias("src"), (F.col("gen") + 2**k).alias("gen")).distinct()
        ahead = staged(ahead)
        at = staged(ahead.unionAll(at.join(ahead.select("sha").distinct(), "sha", "left_anti").select("sha", "src", "gen")))
    return at.groupBy("sha").agg(F.max("gen").alias("gen"))


def merge_base(a: DataFrame, b: DataFrame, parents: DataFrame) -> DataFrame:
    """Common ancestors that are not ancestors of another common ancestor."""
    links = parent_links(parents)
    common = staged(reachable(a, links).join(reachable(b, links), "sha", "left_semi"))
    dominated = common.select(F.col("sha").alias("src")).join(links, "src").select(F.col("dst").alias("sha"))
    return common.join(dominated, "sha", "left_anti")


def first_parents(tip: DataFrame, parents: DataFrame) -> DataFrame:
    """The chain of first parents with positions from 0."""
    return levels(tip, parents.where("n = 0").select(F.col("sha").alias("src"), F.col("parent").alias("dst"))).select("sha", (F.col("depth") - 1).alias("pos"))


def delta_levels(entries: DataFrame, most: int = 64) -> DataFrame:
    """entries(id, base) -> (id, level): full entries are 0, a delta one above its base; null for missing bases, cycles and long chains."""
    level = staged(entries.where("base is null").select("id", F.lit(0).alias("level")))
    deltas, found, n = staged(entries.where("base is not null").select("id", "base")), [level], 0
    while not found[-1].isEmpty() and n < most:
        n += 1
        found.append(staged(deltas.join(found[-1].select(F.col("id").alias("base")), "base", "left_semi").select("id", F.lit(n).alias("level"))))
    return entries.select("id").join(reduce(DataFrame.unionAll, found), "id", "left").select("id", "level")


def integrity(roots: DataFrame, links: DataFrame, objects: DataFrame) -> DataFrame:
    """Reachable ids that no object row holds."""
    return reachable(roots, links).join(objects.select("sha"), "sha", "left_anti")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trees (path, oid) compared: A, M or D per path."""
    both = old.select("path", F.col("oid").alias("o")).join(new.select("path", F.col("oid").alias("n")), "path", "full").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("path", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M").alias("change"))


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per path of any tree: the side that changed wins; equal changes agree; else a conflict. A null oid with outcome `merged` is a deletion."""
    name = lambda t, c: t.select("path", F.col("oid").alias(c))
    all3 = name(base, "b").join(name(ours, "o"), "path", "full").join(name(theirs, "t"), "path", "full")
    o, t, b = F.col("o"), F.col("t"), F.col("b")
    return all3.select(
        "path", F.when(o.eqNullSafe(t) | t.eqNullSafe(b), o).when(o.eqNullSafe(b), t).alias("oid"),
        F.when(o.eqNullSafe(t) | t.eqNullSafe(b) | o.eqNullSafe(b), "merged").otherwise("conflict").alias("outcome"),
    )


def evenly_spaced(chain: DataFrame, k: int) -> DataFrame:
    """k probes of a chain (sha, pos) that cut it into equal parts."""
    n = chain.agg(F.max("pos").alias("last"))
    probes = n.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"), "last").select(F.floor(F.col("i") * F.col("last") / (k + 1)).cast("int").alias("pos")).distinct()
    return chain.join(F.broadcast(probes), "pos").select("sha", "pos")


