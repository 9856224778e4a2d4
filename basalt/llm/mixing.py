"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The corpus is a tree domain > language > source. A token budget flows down it: each node's budget is split among its children
in proportion to their weights, no child gets more than its subtree can supply (its tokens times max_epochs), and what a
child cannot use goes to its siblings; only what all of them cannot use stays unspent at their parent, whose own limit
has already sent it to the parent's siblings. A leaf spends its budget on whole epochs and then on a token-prefix of one
more epoch. An epoch orders the leaf's documents by the MD5 of seed, epoch and document id; the prefix ends before the
first document that does not fit.

Prefixes are found by radix descent: token sums per 12 bits of the order key, a cumulative sum over at most 4096 bins per
leaf, then the same inside the one bin where the budget ends. No window ever holds a leaf's documents, so a leaf
with a third of all rows costs no more per task than others.

Defined cases: tokens are words (runs of bytes other than ASCII blanks), and a null or blank text has 1, so that every document
has a place; null language or source is its own node, named ''; a source missing from `domains` belongs to `other`; nodes
without a weight weigh 1; repeated rows are counted and chosen together with their id and text (rows of one id are one
step of the order); null ids order as ''; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import WORD, cut

SEED, MAX_EPOCHS = 42, 4
#: Budget as a share of the corpus's tokens.
BUDGET_SHARE = 0.8
DOMAINS = {f"src{i}": d for i, d in enumerate(["web"] * 8 + ["news"] * 6 + ["books"] * 4 + ["code"] * 2)}
DOMAIN_WEIGHTS = {"web": 0.5, "news": 0.25, "books": 0.2, "code": 0.05}
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
LEVELS = ["domain", "lang_node", "source_node"]
_BITS = 3  # hex digits of the order key in a radix step
_STEPS = 6


def lookup(column: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default)) if pairs else F.lit(default)


def water_fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget` to siblings with weight, cap and the parent's `total`: min(cap, level * weight), levels raised to spend all.

    Siblings ordered by cap / weight: those below the level are full, the others share what is left by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "node").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), "node").rowsBetween(0, Window.unboundedFollowing)
    filled = nodes.withColumn("spent", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("rest", F.sum("weight").over(below))
    share = (F.col("total") - F.col("spent")) * F.col("weight") / F.col("rest")
    # a sibling is full if its share, were all before it full, reaches its cap; the first that is not sets the level
    filled = filled.withColumn("full", share >= F.col("cap")).withColumn("level", share / F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("node"), F.col("level")))).over(Window.partitionBy(*parent))
    return filled.withColumn("level", level["level"]).withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))


def leaf_budgets(supply: DataFrame, share: float, max_epochs: int, domain_weights: dict, language_weights: dict, source_weights: dict) -> DataFrame:
    """(domain, lang_node, source_node, tokens) per leaf -> the same with `budget`, a whole number of tokens."""
    weights = {"domain": domain_weights, "lang_node": language_weights, "source_node": source_weights}
    above = supply.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("double").alias("total")).withColumn("root", F.lit(0))
    parent = ["root"]
    leaves = supply.withColumn("root", F.lit(0))
    for i, name in enumerate(LEVELS):
        nodes = leaves.groupBy(*parent, name).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap"))
        nodes = nodes.withColumn("node", F.col(name)).withColumn("weight", lookup(F.col(name), weights[name], 1.0).cast("double")).where("weight > 0")
        parent_key = parent
        filled = water_fill(nodes.join(above, parent_key), parent_key)
        parent = [*parent, name]
        above = filled.select(*parent, F.col("budget").alias("total"))
    return leaves.join(above, parent).select(*LEVELS, "tokens", F.floor(F.col("total") + 1e-6).cast("long").alias("budget"))


def chosen_prefix(items: DataFrame, leaves: DataFrame) -> DataFrame:
    """items (leaf, key, tokens), leaves (leaf, left) -> (leaf, last): the largest key whose prefix fits `left` tokens, '' for none.

    key is hexadecimal; equal keys of a leaf are one step.
    """
    state = leaves.where("left > 0").select("leaf", "left", F.lit("").alias("head"), F.lit("").alias("last"))
    for step in range(_STEPS):
        at, final = 1 + step * _BITS, step == _STEPS - 1
        inside = items.join(state, "leaf").where(F.substring("key", 1, step * _BITS) == F.col("head")) if step else items.join(state, "leaf")
        digit = F.substring("key", at, 64 if final else _BITS)
        bins = inside.groupBy("leaf", digit.alias("bin")).agg(F.sum("tokens").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        fits = bins.join(state.select("leaf", "left"), "leaf").groupBy("leaf").agg(
            F.max(F.when(F.col("upto") <= F.col("left"), F.struct("bin", "upto"))).alias("got"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bin"))).alias("next"),
        )
        state = state.join(fits, "leaf", "left").select(
            "leaf",
            (F.col("left") - F.coalesce(F.col("got.upto"), F.lit(0))).alias("left"),
            F.when(F.col("next").isNotNull(), F.concat("head", "next")).alias("below"),
            # all keys up to the last whole bin are in: mark it past its longest key
            F.when(F.col("got").isNotNull(), F.concat("head", F.col("got.bin"), F.lit("" if final else "g"))).otherwise(F.col("last")).alias("last"),
        ).withColumnRenamed("below", "head")
        state = cut(state, "prefix")
    return state.select("leaf", "last")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    domains: dict = DOMAINS, domain_weights: dict = DOMAIN_WEIGHTS, language_weights: dict = LANGUAGE_WEIGHTS, source_weights: dict | None = None,
    share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep_columns: list[str] | None = None,
) -> DataFrame:
    """The chosen documents: `keep_columns` (all by default), domain, n_tokens and n_copies (times to be read), rows without copies gone."""
    keep = docs.columns if keep_columns is None else keep_columns
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    sized = docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)],
        lookup(name(source_col), domains, "other").alias("domain"), name(lang_col).alias("lang_node"), name(source_col).alias("source_node"), name(id_col).alias("row_id"),
        F.greatest(F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)), F.lit(1)).cast("long").alias("n_tokens"),
    )
    leaf = F.concat_ws("\x1f", *LEVELS)
    narrow = cut(sized.select(*LEVELS, "row_id", "n_tokens"), "mix")
    supply = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(supply, share, max_epochs, domain_weights, language_weights, source_weights or {})
    leaves = cut(budgets.select(leaf.alias("leaf"), F.floor(F.col("budget") / F.col("tokens")).alias("epochs"), (F.col("budget") % F.col("tokens")).alias("left")), "budgets")
    key = lambda epochs: F.md5(F.concat_ws("/", F.lit(seed).cast("string"), epochs.cast("string"), "row_id"))
    keyed = narrow.select(leaf.alias("leaf"), "row_id", F.col("n_tokens").alias("tokens")).join(leaves.select("leaf", "epochs"), "leaf")
    keyed = keyed.select("leaf", key(F.col("epochs")).alias("key"), "tokens")
    ends = leaves.join(chosen_prefix(keyed, leaves), "leaf", "left").select("leaf", "epochs", "last")
    copies = F.col("epochs") + F.when(F.coalesce("last", F.lit("")) >= key(F.col("epochs")), 1).otherwise(0)
    return (
        sized.withColumn("leaf", leaf).join(cut(ends, "ends"), "leaf").withColumn("n_copies", copies.cast("long")).where("n_copies > 0")
        .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "domain", "n_tokens", "n_copies")
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options
) -> DataFrame:
    """The documents of the mix with their own columns; one chosen for several epochs is there as often."""
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), docs[source_col].alias("source")
    )
    found = mix(rows, "id", "text", "lang", "source", keep_columns=["row"], **options)
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_columns=["doc_id", "lang", "source"])


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {default} END"


def _fill_sql(i: int) -> str:
    """The CTEs of one tree level: children's caps and weights, then their budgets."""
    name, parents = LEVELS[i], LEVELS[:i]
    weights = _case(name, [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {"": 1.0}][i], "1.0")
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    keys = ", ".join([*parents, name])
    join = f"JOIN budget{i - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN budget_root"
    return f"""
cap{i} AS (SELECT {keys}, CAST(sum(tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap, CAST({weights} AS DOUBLE) AS weight FROM supply GROUP BY {keys}),
share{i} AS (SELECT {keys}, cap, weight, (total - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM cap{i} {join} WINDOW w AS ({by} ORDER BY cap / weight, {name})),
budget{i} AS (SELECT {keys}, CASE WHEN level * weight >= cap THEN cap
    ELSE weight * min_by(level, (cap / weight, {name})) FILTER (WHERE level * weight < cap) OVER ({by}) END AS total FROM share{i})"""


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, lang, source, {_case("coalesce(source, '')", DOMAINS, "'other'")} AS domain, coalesce(lang, '') AS lang_node, coalesce(source, '') AS source_node,
    greatest(coalesce(len(regexp_extract_all(text, '{WORD}')), 0), 1) AS n_tokens FROM documents),
supply AS (SELECT domain, lang_node, source_node, sum(n_tokens) AS tokens FROM sized GROUP BY ALL),
budget_root AS (SELECT CAST(floor(sum(tokens) * {BUDGET_SHARE}) AS DOUBLE) AS total FROM supply),
{",".join(_fill_sql(i) for i in range(3))},
leaves AS (SELECT domain, lang_node, source_node, CAST(floor(total + 1e-6) AS BIGINT) // tokens AS epochs, CAST(floor(total + 1e-6) AS BIGINT) % tokens AS rest
  FROM supply JOIN budget2 USING (domain, lang_node, source_node)),
keyed AS (SELECT s.*, epochs, rest, md5(concat_ws('/', '{SEED}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS k
  FROM sized s JOIN leaves USING (domain, lang_node, source_node)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang_node, source_node ORDER BY k) AS upto FROM keyed)
SELECT doc_id, lang, source, domain, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM summed WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
