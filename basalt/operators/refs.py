"""Names, scopes, compare-and-swap logs and their history."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.folds import running_total, streamed_fold


def has_prefix(name: Column, prefixes: list[str]) -> Column:
    """True if name starts with any prefix; no prefixes match all."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(name, p)) if prefixes else F.lit(True)


def in_scope(scope: Column, name: Column) -> Column:
    """Comma-separated patterns, a trailing * for prefixes; null and blank scopes deny."""
    parts = F.filter(F.transform(F.split(scope, ","), lambda p: F.trim(p)), lambda p: p != "")
    hit = F.exists(parts, lambda p: F.when(F.endswith(p, F.lit("*")), F.startswith(name, F.regexp_replace(p, r"\*$", ""))).otherwise(name == p))
    return F.coalesce(hit, F.lit(False))


def scope_valid(scope: Column) -> Column:
    """Every pattern is refs/.., with * only at its end; 256 bytes at most."""
    parts = F.transform(F.split(scope, ","), lambda p: F.trim(p))
    return F.coalesce(F.forall(parts, lambda p: p.rlike(r"^refs/[^*]*\*?$")) & (F.octet_length(scope) <= 256), F.lit(False))


def ref_name_valid(name: Column) -> Column:
    """refs/.. without empty, dotted or .lock parts, `..`, `@{`, blanks, control characters or any of ~^:?*[\\ ."""
    bad = r"(\.\.|@\{|//|/\.|\.lock(/|$)|[\x00-\x20\x7f~^:?*\[\\]|/$|\.$)"
    return F.coalesce(name.rlike(r"^refs/.+") & ~name.rlike(bad), F.lit(False))


def printable(name: Column) -> Column:
    return F.regexp_replace(name, "[^!-~]", "?")


def protected_verdict(old: Column, new: Column, forward: Column) -> Column:
    """Deletion is refused, creation allowed; an update needs a proof: yes, no, or unknown."""
    return (
        F.when(new.isNull(), F.lit("refuse")).when(old.isNull(), F.lit("allow")).when(forward.isNull(), F.lit("unknown")).when(forward, F.lit("allow")).otherwise(F.lit("refuse"))
    )


def ref_candidates(names: DataFrame, refs: DataFrame) -> DataFrame:
    """Short names(short) to the first existing full name, in the usual order of six."""
    forms = [F.col("short"), *[F.concat(F.lit(p), F.col("short")) for p in ("refs/", "refs/tags/", "refs/heads/", "refs/remotes/")], F.concat(F.lit("refs/remotes/"), F.col("short"), F.lit("/HEAD"))]
    tried = names.select("short", F.posexplode(F.array(*forms)).alias("pos", "name"))
    found = tried.join(refs, "name").groupBy("short").agg(F.min(F.struct("pos", "name", "target")).alias("hit"))
    return names.join(found, "short", "left").select("short", "hit.name", "hit.target")


def cas_fold(commands: DataFrame) -> DataFrame:
    """commands(seq, name, old, new) -> each with `accepted`: in order per name, accepted iff old equals the current target.

    Null is absence: creation needs absence, deletion gives it. A name's commands stream through one fold.
    """

    def target():
        now = [None]

        def step(c):
            ok = now[0] == c.old
            now[0] = c.new if ok else now[0]
            return [(c.name, c.seq, ok)]

        return step

    return streamed_fold(commands.select("name", "seq", "old", "new"), "name", ["seq"], target, "name string, seq long, accepted boolean")


def refusal(
    commands: DataFrame, refs: DataFrame, known: DataFrame, scope: str, pins: DataFrame | None = None, head: str | None = None, protected: list[str] | None = None, full: bool = False
) -> DataFrame:
    """First reason that refuses each command, in the fixed order, or null: name, scope, nothing to do, pinned, head deletion, protected,
    missing object, too many refs (where the table is full), stale.

    protected: patterns; commands then have `forward`, the proof that an update keeps the old commit (null: unknown).
    """
    now = refs.select("name", F.col("target").alias("now"))
    have = known.select(F.col("sha").alias("new")).distinct().withColumn("have", F.lit(True))
    seen = commands.join(now, "name", "left").join(have, "new", "left")
    old, new, name = F.col("old"), F.col("new"), F.col("name")
    reasons = [F.when(~ref_name_valid(name), "bad name"), F.when(~in_scope(F.lit(scope), name), "out of scope"), F.when(old.isNull() & new.isNull(), "nothing to do")]
    if pins is not None:
        seen = seen.join(pins.select("name", F.lit(True).alias("pin")).distinct(), "name", "left")
        reasons.append(F.when(F.col("pin"), "pinned"))
    if head is not None:
        reasons.append(F.when(new.isNull() & (name == head), "current branch"))
    if protected:
        verdict = protected_verdict(old, new, F.col("forward"))
        reasons.append(F.when(in_scope(F.lit(",".join(protected)), name) & (verdict != "allow"), F.concat(F.lit("protected: "), verdict)))
    reasons.append(F.when(new.isNotNull() & F.col("have").isNull(), "missing object"))
    if full:
        reasons.append(F.when(new.isNotNull() & old.isNull(), "too many refs"))
    reasons.append(F.when(~old.eqNullSafe(F.col("now")), "stale"))
    return seen.select("seq", "name", F.coalesce(*reasons).alias("reason"))


def all_or_nothing(verdicts: DataFrame) -> DataFrame:
    """verdicts(push_id, seq, accepted): one failure fails its push."""
    ok = F.min(F.col("accepted").cast("int")).over(Window.partitionBy("push_id")) == 1
    return verdicts.select("push_id", "seq", ok.alias("committed"), F.when(ok, F.lit("ok")).when(~F.col("accepted"), F.lit("failed")).otherwise(F.lit("atomic push failed")).alias("status"))


def as_of(reflog: DataFrame, at: int) -> DataFrame:
    """State of every ref strictly before a time; deleted refs are absent."""
    return reflog.where(F.col("at") < at).groupBy("name").agg(F.max(F.struct("at", "id", "new")).alias("last")).where("last.new is not null").select("name", F.col("last.new").alias("target"))


def retained(reflog: DataFrame, since: int) -> DataFrame:
    """Rows since a time and the newest row of every name."""
    newest = reflog.groupBy("name").agg(F.max("id").alias("newest"))
    return reflog.join(newest, "name").where((F.col("at") >= since) | (F.col("id") == F.col("newest"))).select("id", "name", "at")


def monotonic(reflog: DataFrame) -> DataFrame:
    """Per name, times raised so that each is at least one above the last: max(at_i - i) + i."""
    w = Window.partitionBy("name").orderBy("id")
    i = F.row_number().over(w)
    return reflog.withColumn("i", i.cast("long")).select("id", "name", (F.max(F.col("at") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")).alias("at"))


def hash_chain(reflog: DataFrame) -> DataFrame:
    """Per name, entry hash = sha256(id | new | previous hash); a name's entries stream through one fold."""

    def chain():
        last = [""]

        def step(e):
            last[0] = sha256(f"{e.id}|{e.new or ''}|{last[0]}".encode()).hexdigest()
            return [(e.name, e.id, last[0])]

        return step

    return streamed_fold(reflog.select("name", "id", "new"), "name", ["id"], chain, "name string, id long, hash string")


def chain_breaks(chain: DataFrame) -> DataFrame:
    """chain(name, id, new, hash) -> entries whose hash does not follow from the one before: changed, removed or put in later."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("name").orderBy("id")), F.lit(""))
    want = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("new", F.lit("")), before), 256)
    return chain.withColumn("want", want).where(~F.col("want").eqNullSafe(F.col("hash"))).select("name", "id")


def version_bumps(outcomes: DataFrame) -> DataFrame:
    """outcomes(push_id, any_ok, went_live): refs_version after each push. It rises if a ref landed or if a pack went live without one."""
    steps = outcomes.withColumn("up", (F.col("any_ok") | F.col("went_live")).cast("long"))
    return running_total(steps, "push_id", "up").select("push_id", (F.col("before") + F.col("up")).alias("refs_version"))


def last_writer(ops: DataFrame) -> DataFrame:
    """ops(path, lamport, actor, blob): the write of largest (lamport, actor) wins; a null blob deletes."""
    return ops.groupBy("path").agg(F.max(F.struct("lamport", "actor", "blob")).alias("w")).where("w.blob is not null").select("path", F.col("w.blob").alias("blob"))
