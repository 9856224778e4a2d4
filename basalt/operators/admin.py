"""Administration as relations: tokens, scopes, pins, imports, large files, chains and swaps. Every row names its repository or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.refs import in_scope, scope_valid

#: Fixed values of the service: rows a repository may hold, and the longest life of a token in seconds.
MOST_TOKENS, MOST_PINS, MOST_PATTERNS, LONGEST_TTL = 256, 256, 64, 366 * 24 * 3600
#: Failure class to HTTP status.
STATUS = {
    "protocol": 400, "auth": 401, "forbidden": 403, "notfound": 404, "conflict": 409, "gone": 410, "budget": 413, "limit": 413,
    "ratelimit": 429, "busy": 503, "unpack": 500, "storage": 500, "internal": 500,
}


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def minted(asks: DataFrame, tokens: DataFrame, now: int, most: int = MOST_TOKENS) -> DataFrame:
    """asks(repo, id, level, name, scope, ttl_s) and tokens(repo, id) -> (id, scope, expires_at, reason); reason is null where granted.

    A lifetime out of range is refused, not clamped. Granted asks fill a repository's free places in order of id; the rank filter is
    pruned before the shuffle, so a hot repository sends `most` rows a partition.
    """
    scope = F.when(_blank(F.col("scope")), F.lit("refs/*")).otherwise(F.trim("scope"))
    wrong = F.coalesce(
        F.when(~F.coalesce(F.col("level").isin("read", "write"), F.lit(False)), "level"),
        F.when(~F.coalesce(F.octet_length("name").between(1, 128), F.lit(False)), "name"),
        F.when(~scope_valid(scope), "scope"), F.when(F.col("ttl_s").isNotNull() & ~F.col("ttl_s").between(1, LONGEST_TTL), "ttl"),
    )
    asked = asks.select("repo", "id", scope.alias("scope"), "ttl_s", wrong.alias("wrong"))
    ranked = asked.where("wrong is null").select("repo", "id", F.row_number().over(Window.partitionBy("repo").orderBy("id")).alias("place")).where(F.col("place") <= most)
    held = tokens.groupBy("repo").agg(F.count(F.lit(1)).alias("held"))
    fits = ranked.join(held, "repo", "left").where(F.col("place") + F.coalesce("held", F.lit(0)) <= most).select("repo", "id", F.lit(True).alias("fits"))
    reason = F.coalesce("wrong", F.when(F.col("fits").isNull(), "too many"))
    return asked.join(fits, ["repo", "id"], "left").select(
        "id", F.when(reason.isNull(), F.col("scope")).alias("scope"), F.when(reason.isNull(), F.lit(now) + F.col("ttl_s") * 1000).alias("expires_at"), reason.alias("reason")
    )


def listed(tokens: DataFrame) -> DataFrame:
    """What a listing shows: never hashes."""
    return tokens.orderBy("created_at", "id").drop("hash")


def revoked(tokens: DataFrame, ids: DataFrame) -> DataFrame:
    return tokens.join(ids.select("id"), "id", "left_anti")


def captured_scopes(pushes: DataFrame, tokens: DataFrame) -> DataFrame:
    """pushes(id, token, admin) and live tokens(id, level, scope) -> (id, scope, reason): the scope that a push starts with, or why none."""
    row = tokens.select(F.col("id").alias("token"), "level", F.col("scope").alias("granted"), F.lit(True).alias("found"))
    seen = pushes.join(row, "token", "left")
    reason = F.when(F.col("admin"), None).when(F.col("found").isNull(), "auth").when(~F.col("level").eqNullSafe(F.lit("write")) | _blank(F.col("granted")), "forbidden")
    return seen.select("id", F.when(F.col("admin"), "refs/*").when(reason.isNull(), F.trim("granted")).alias("scope"), reason.alias("reason"))


def recommitted_scopes(pushes: DataFrame, tokens: DataFrame) -> DataFrame:
    """pushes(id, auth) at commit: (id, allowed, scope). `admin` passes unscoped; a blank mark, a lost or weaker token is denied."""
    row = tokens.select(F.col("id").alias("auth"), "level", F.col("scope").alias("granted"))
    admin = F.coalesce(F.trim("auth") == "admin", F.lit(False))
    held = F.coalesce((F.col("level") == "write") & ~_blank(F.col("granted")), F.lit(False))
    return pushes.withColumn("auth", F.trim("auth")).join(row, "auth", "left").select("id", (admin | held).alias("allowed"), F.when(~admin & held, F.trim("granted")).alias("scope"))


def admitted(grant: Column, need: Column) -> Column:
    """Reading needs any grant; writing a write grant, else `forbidden`, or `auth` for nobody. Null where admitted."""
    return F.when((need == "write") & (grant == "read"), "forbidden").when((need == "write") & (grant == "anonymous"), "auth")


def covered(name: Column, patterns: list[str]) -> Column:
    """True if a protected pattern fits; at most 64 patterns, as the service allows."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"at most {MOST_PATTERNS} patterns")
    return in_scope(F.lit(",".join(patterns)), name)


def pinned(asks: DataFrame, refs: DataFrame, pins: DataFrame) -> DataFrame:
    """asks(seq, name, sha) applied to pins(name, sha): a pin needs its ref to be there now; the last good ask of a name wins.

    At most MOST_PINS names are pinned: new names are taken in the order of their first good ask while there is room.
    """
    good = asks.join(refs.select("name", F.col("target").alias("sha")).distinct(), ["name", "sha"], "left_semi")
    held = pins.select("name", "sha").groupBy("name").agg(F.min("sha").alias("sha"))
    fresh = good.join(held, "name", "left_anti").groupBy("name").agg(F.min("seq").alias("seq")).orderBy("seq", "name").limit(MOST_PINS)
    room = fresh.withColumn("n", F.row_number().over(Window.orderBy("seq", "name"))).join(F.broadcast(held.agg(F.count(F.lit(1)).alias("there")))).where(F.col("n") + F.col("there") <= MOST_PINS)
    every = held.select("name", F.lit(None).cast("long").alias("seq"), "sha").unionAll(
        good.join(room.select("name").unionAll(held.select("name")), "name", "left_semi").select("name", F.col("seq").cast("long"), "sha")
    )
    return every.groupBy("name").agg(F.max(F.struct("seq", "sha")).alias("p")).select("name", "p.sha")


def unpinned(pins: DataFrame, names: DataFrame) -> DataFrame:
    """pins without names(name)."""
    return pins.join(names.select("name"), "name", "left_anti")


def begun_pushes(asks: DataFrame, pushes: DataFrame, packs: DataFrame, most_packs: int, most_open: int = 64) -> DataFrame:
    """asks(seq, push_id, principal, auth) to begin, judged against pushes(id, state, principal, auth) and packs as they are: `open` for a new push,
    `again` for an open one of the same owner and credential, else the refusal: `busy` (packs at their cap), `forbidden`, `conflict: <state>`, or
    `too many open pushes`. The first ask of a push counts; new pushes are admitted in their order while there is room."""
    first = asks.groupBy("push_id").agg(F.min(F.struct("seq", "principal", "auth")).alias("ask")).select("push_id", "ask.*")
    have = pushes.select(F.col("id").alias("push_id"), "state", F.col("principal").alias("owner"), F.col("auth").alias("held"))
    seen = first.join(have, "push_id", "left")
    counts = pushes.agg(F.count_if(F.col("state") == "open").alias("opened")).join(packs.agg(F.count_if(F.col("state").isin("live", "ingesting")).alias("there")))
    # only `most_open` new pushes can be admitted: their ranks need no window over all asks
    ranked = seen.where("state is null").orderBy("seq", "push_id").limit(most_open).select("push_id", F.row_number().over(Window.orderBy("seq", "push_id")).alias("n"))
    own = (F.col("owner") == F.col("principal")) & F.col("held").eqNullSafe(F.col("auth"))
    verdict = (
        F.when((F.col("state") == "open") & own, "again").when(F.col("state") == "open", "forbidden").when(F.col("state").isNotNull(), F.concat(F.lit("conflict: "), F.col("state")))
        .when(F.col("there") >= most_packs, "busy").when(F.col("n").isNull() | (F.col("n") + F.col("opened") > most_open), "too many open pushes").otherwise("open")
    )
    return seen.join(ranked, "push_id", "left").join(F.broadcast(counts)).select("push_id", verdict.alias("verdict"))


def first_format(pushes: DataFrame) -> DataFrame:
    """pushes(repo, id, format): the first writer fixes a repository's format; later ones of another are refused."""
    fixed = pushes.groupBy("repo").agg(F.min(F.struct("id", "format")).alias("f")).select("repo", F.col("f.format").alias("fixed"))
    return pushes.join(fixed, "repo").select("id", "fixed", (~F.col("format").eqNullSafe(F.col("fixed"))).alias("refused"))


def import_status(pushes: DataFrame, jobs: DataFrame, objects: DataFrame) -> DataFrame:
    """pushes(id, state, result), import jobs(id, push, pack, phase, total, state, attempts) -> the newest job of each push and its progress."""
    newest = jobs.groupBy("push").agg(F.max(F.struct("id", "state", "phase", "attempts", "pack", "total")).alias("j"))
    done = objects.groupBy(F.col("pack_id").alias("pack")).agg(F.count(F.lit(1)).alias("done"))
    rows = pushes.select(F.col("id").alias("push"), F.col("state").alias("push_state")).join(newest, "push", "left").withColumn("pack", F.col("j.pack")).join(done, "pack", "left")
    return rows.select("push", "push_state", F.col("j.state").alias("job_state"), F.col("j.phase").alias("job_phase"), F.col("j.attempts").alias("attempts"), F.coalesce("done", F.lit(0)).alias("objects_done"), F.col("j.total").alias("objects_total"))


def results(verdicts: DataFrame) -> DataFrame:
    """verdicts(push_id, name, status) -> one JSON list a push, by name. A push holds at most 65,536 commands."""
    return verdicts.groupBy("push_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "status")))).alias("result"))


def large_files(asks: DataFrame, stored: DataFrame, upload: bool) -> DataFrame:
    """asks(oid, size) against stored(oid): the action or the error code of each; a stored upload needs neither."""
    have = stored.select("oid", F.lit(True).alias("have")).distinct()
    bad, held = ~F.coalesce(F.col("oid").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), F.col("have").isNotNull()
    action = F.when(bad, None).when(~held if upload else held, F.lit("upload" if upload else "download"))
    error = F.when(bad, 422) if upload else F.when(bad, 422).when(~held, 404)
    return asks.join(have, "oid", "left").select("oid", "size", action.alias("action"), error.alias("error"))


def http_status(kind: Column, transient: Column) -> Column:
    """Status of a failure class; a limit that passes by waiting is 503. Unknown classes are 500."""
    table = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when((kind == "limit") & transient, 503).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit(500)))


def retry_after(kind: Column, transient: Column, seconds: Column) -> Column:
    return F.when(kind.isin("ratelimit", "busy"), F.greatest(seconds, F.lit(1))).when((kind == "limit") & transient, 60)


def advertised(refs: DataFrame) -> DataFrame:
    """refs(name, target, peeled) -> (name, line)."""
    return refs.select("name", F.concat(F.concat_ws(" ", "target", "name"), F.coalesce(F.concat(F.lit(" peeled:"), "peeled"), F.lit(""))).alias("line"))


def orphan_chains(chains: DataFrame, jobs: DataFrame) -> DataFrame:
    """chains(chain, kind) that no queued or running job(kind, chain, state) of their kind owns; a job without a chain owns any."""
    busy = jobs.where(F.col("state").isin("queued", "running"))
    named = busy.where("chain is not null").select("kind", "chain").distinct()
    return chains.join(named, ["kind", "chain"], "left_anti").join(busy.where("chain is null").select("kind").distinct(), "kind", "left_anti").select("chain", "kind")


def cohort_live(cohort: DataFrame, packs: DataFrame) -> DataFrame:
    """cohort(chain, id): whether every pack of a chain is still live."""
    live = packs.where("state = 'live'").select("id", F.lit(True).alias("live"))
    return cohort.join(live, "id", "left").groupBy("chain").agg(F.bool_and(F.coalesce("live", F.lit(False))).alias("all_live"))


def swapped(packs: DataFrame, cohort: DataFrame, output: int) -> DataFrame:
    """State after compaction: the output is live and as old as its newest member, the cohort is dead."""
    mine = cohort.select("id").distinct().withColumn("member", F.lit(True))
    newest = packs.join(mine, "id", "left_semi").agg(F.max("created_at").alias("newest")).withColumn("id", F.lit(output).cast("long"))
    rows = packs.join(mine, "id", "left").join(newest, "id", "left")
    out = F.col("id") == output
    return rows.select("id", F.when(out, "live").when(F.col("member"), "dead").otherwise(F.col("state")).alias("state"), F.when(out, F.coalesce("newest", "created_at")).otherwise(F.col("created_at")).alias("created_at"))


def extents(objects: DataFrame, packs: DataFrame) -> DataFrame:
    """Index rows whose pack is missing, or whose extent ends past it."""
    rows = objects.join(packs.select(F.col("id").alias("pack_id"), F.col("bytes").alias("held")), "pack_id", "left")
    fault = F.when(F.col("held").isNull(), "missing").when(F.col("offset") + F.col("len") > F.col("held"), "corrupt")
    return rows.select("sha", "pack_id", "idx", fault.alias("fault")).where("fault is not null")


def lost_writes(opened: DataFrame, objects: DataFrame, durable: int) -> DataFrame:
    """opened(pack_id, idx, offset) up to a durable offset without an index row, each with the next start of its pack."""
    starts = opened.withColumn("next", F.lead("offset").over(Window.partitionBy("pack_id").orderBy("offset", "idx")))
    return starts.where(F.col("offset") <= durable).join(objects.select("pack_id", "idx"), ["pack_id", "idx"], "left_anti").select("pack_id", "idx", "offset", "next")


def missing_bases(entries: DataFrame, live: DataFrame) -> DataFrame:
    """entries(id, base): bases that are not entries, with whether a live object can stand in."""
    asked = entries.where("base is not null").select(F.col("base").alias("sha")).distinct().join(entries.select(F.col("id").alias("sha")), "sha", "left_anti")
    return asked.join(live.select("sha").distinct().withColumn("found", F.lit(True)), "sha", "left").select("sha", F.coalesce("found", F.lit(False)).alias("live"))


def moved_epochs(pushes: DataFrame, epochs: DataFrame) -> DataFrame:
    """pushes(id, repo, gc_epoch) whose repository's epoch has moved since they began."""
    return pushes.join(epochs.select("repo", F.col("epoch").alias("now")), "repo", "left").where(~F.col("gc_epoch").eqNullSafe(F.col("now"))).select("id", "repo")


def upsert_least(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sha, gen) merged, the smaller gen staying."""
    return old.select("sha", "gen").unionAll(new.select("sha", "gen")).groupBy("sha").agg(F.min("gen").alias("gen"))


def held_leases(leases: DataFrame, now: int) -> DataFrame:
    """leases(name, id, holder, until): the newest unexpired lease of each name."""
    return leases.where(F.col("until") > now).groupBy("name").agg(F.max(F.struct("id", "holder", "until")).alias("l")).select("name", "l.holder", "l.until")


def heads(repos: DataFrame, refs: DataFrame) -> DataFrame:
    """repos(repo, head) and refs(repo, name): the head, or the first branch where it names nothing."""
    first = refs.where(F.startswith("name", F.lit("refs/heads/"))).groupBy("repo").agg(F.min("name").alias("first"))
    real = refs.select("repo", F.col("name").alias("head"), F.lit(True).alias("real")).distinct()
    return repos.join(real, ["repo", "head"], "left").join(first, "repo", "left").select("repo", F.when(F.col("real"), F.col("head")).otherwise(F.col("first")).alias("head"))


def purged(rows: DataFrame, repos: DataFrame, now: int) -> DataFrame:
    """rows(repo, ..) of repositories that are neither deleted nor expired."""
    gone = repos.where(F.coalesce("deleted", F.lit(False)) | F.coalesce(F.col("expires_at") <= now, F.lit(False))).select("repo")
    return rows.join(gone, "repo", "left_anti")


def gossiped(events: DataFrame, hops: int) -> DataFrame:
    """events(origin, seq, hop, body): each event once, by its shortest way, within a hop limit."""
    return events.where(F.col("hop") <= hops).groupBy("origin", "seq").agg(F.min(F.struct("hop", "body")).alias("e")).select("origin", "seq", "e.hop", "e.body")


def hook_outcomes(outbox: DataFrame, hooks: DataFrame) -> DataFrame:
    """outbox(id, repo) with each hook(repo, url) of its repository, or null where it has none."""
    return outbox.join(hooks.select("repo", "url"), "repo", "left").select("id", "repo", "url")


def inclusion_paths(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """entries(folder, name, oid) and wanted(root, path): the object at a path, one join per level of the deepest path; null if none.

    A path's length is bounded by the name rules, so the levels are few.
    """
    at = wanted.select("root", "path", F.col("root").alias("oid"), F.split("path", "/").alias("parts"))
    deepest = wanted.agg(F.max(F.size(F.split("path", "/"))).alias("n")).first()["n"] or 0
    step = entries.select(F.col("folder").alias("oid"), F.col("name").alias("part"), F.col("oid").alias("below"))
    for i in range(deepest):
        here = at.withColumn("part", F.get("parts", F.lit(i)))
        moved = here.join(step, ["oid", "part"], "left")
        at = moved.select("root", "path", F.when(F.col("part").isNull(), F.col("oid")).otherwise(F.col("below")).alias("oid"), "parts")
    return at.select("root", "path", "oid")


def set_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free digest: the sum of 60-bit row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))
