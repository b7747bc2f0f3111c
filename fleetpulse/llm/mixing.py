"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). Among siblings it is
dealt by weight; a child that cannot use its share, because its subtree has too
few tokens times the epochs allowed, leaves the rest to its siblings, and only
what the whole family cannot use goes back to the relatives of its parent. Each
leaf then gets whole epochs and a token-prefix of one more, in an order that a
seed and the number of the epoch decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.llm.common import WORD, attach, small, table
from fleetpulse.session import written

#: Rows of a leaf that are put in order together.
BLOCK_ROWS = 4096

PATH = ("domain", "lang", "source")
# Production weights of the registered query; names that are not listed weigh 1.
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "code": 2, "forum": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}
MAX_EPOCHS = 4
SEED = 42


def token_count(text: Column) -> Column:
    """Words between white space; a null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain that a source is filed under (a null source counts as an empty name)."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "4", "web").when(digit < "8", "books").when(digit < "c", "code").otherwise("forum")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1).cast("long")
    listed = F.create_map(*[F.lit(x).cast("long") if i % 2 else F.lit(x) for pair in named.items() for i, x in enumerate(pair)])
    return F.coalesce(F.element_at(listed, F.col(level)), F.lit(1).cast("long"))


def pour(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Deal ``budget`` (of the parent, on every child) over children by ``weight``, none above ``capacity``.

    The water level is the largest over the children, taken by capacity per
    weight, of (budget - capacities before) / (weights from here on). Adds ``given``.
    """
    family = W.partitionBy(*parent)
    ordered = family.orderBy("_ratio", name)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    level = F.try_divide(
        (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast("double"),
        F.nullif(F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)), F.lit(0)).cast("double"),
    )
    return (
        children.withColumn("_ratio", F.try_divide(F.col("capacity").cast("double"), F.col("weight").cast("double")))
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(family))
        .withColumn("given", F.least("capacity", F.coalesce(F.floor(F.col("weight") * F.col("_level")), F.lit(0)).cast("long")))
        .drop("_ratio", "_level")
    )


def budgets(leaves: DataFrame, path: Sequence[str], weights: Mapping, budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (path, tokens, docs) with ``given`` tokens each. Nodes without weight or tokens get none."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    above = nodes.agg(budget.cast("long").alias("budget"))
    for depth, level in enumerate(path):
        parent = list(path[:depth])
        grown = nodes.groupBy(*path[: depth + 1]).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights))
        if parent:
            grown = grown.alias("x").join(above.alias("y"), _same(parent)).select("x.*", "y.budget")
        else:
            grown = grown.crossJoin(F.broadcast(above))  # one row
        above = pour(grown, parent, level).select(*path[: depth + 1], F.col("given").alias("budget"))
    return leaves.alias("x").join(above.alias("y"), _same(path)).select("x.*", F.col("y.budget").alias("given"))


def _same(path: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"x.`{p}` <=> y.`{p}`" for p in path))


def _order(epochs: Column, key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epochs.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def plan(slim: DataFrame, path: Sequence[str], weights: Mapping, share: float, max_epochs: int, seed: int, key: str) -> tuple[DataFrame, int]:
    """Per leaf: given tokens, whole epochs, and where the prefix of the next epoch ends.

    ``slim`` has the key, the path, ``leaf`` and ``n_tokens``; the budget is
    ``share`` of all its tokens. Only the block of a leaf in which the prefix ends
    is put in order, so that no leaf is sorted as a whole.
    """
    leaves = slim.groupBy("leaf", *path).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = written(leaves, "mix-leaves")
    dealt = budgets(leaves, path, weights, F.floor(F.sum("tokens") * F.lit(share)), max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).cast("long")
    facts = dealt.withColumn("epochs", whole).withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens"))
    facts = written(facts.select("leaf", "tokens", "docs", "given", "epochs", "rest"), "mix-budgets")
    count = facts.count()

    dealt_rows = join_facts(slim.select("leaf", key, "n_tokens"), facts, count, [key]).where("rest > 0")
    place = F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / 2.0**32
    rows = dealt_rows.withColumn("order", _order(F.col("epochs"), key, seed)).withColumn(
        "block", F.floor(place * F.ceil(F.col("docs") / BLOCK_ROWS)).cast("long")
    )
    sums = rows.groupBy("leaf", "block").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    running = W.partitionBy("leaf").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    cut_block = (
        sums.withColumn("start", F.coalesce(F.sum("held").over(running), F.lit(0)))
        .where("start < rest AND start + held >= rest")
        .select("leaf", "block", "start")
    )
    inside = W.partitionBy("leaf", "block").orderBy("order", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        rows.join(cut_block, ["leaf", "block"])
        .withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("before < rest")
        .groupBy("leaf")
        .agg(F.max(F.struct("order", (-F.col("before")).alias("neg"))).alias("cut"))
    )
    found = facts.join(cut, "leaf", "left").select(facts["*"], F.col("cut.order").alias("cut_order"), (-F.col("cut.neg")).alias("cut_before"))
    return written(found, "mix-plan"), count


def join_facts(rows: DataFrame, facts: DataFrame, count: int, salt_by: Sequence[str]) -> DataFrame:
    """Facts of leaves on their rows: sent to all executors if they fit the bound, else a salted join."""
    size = count * 512
    sized = small(facts, size)
    return rows.join(sized, "leaf") if sized is not facts else attach(rows, facts, "leaf", "docs", salt_by)


def mix(
    docs: DataFrame,
    path: Sequence[str] = PATH,
    weights: Mapping = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """``docs`` (with key, path and ``n_tokens``) with given_tokens (of the leaf), epochs, part_tokens, copies.

    A document is used ``epochs`` times in whole, and in one more epoch up to its
    first ``part_tokens`` tokens; ``copies`` counts both. Null names in the path are
    leaves of their own. Documents without tokens are used in whole epochs and if
    their place is before the cut. Rows that repeat a key stand at one place of the
    order and share a decision. An empty table gives an empty result.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), key, *path, "n_tokens").withColumn(
        "leaf", F.to_json(F.struct(*path))
    )
    slim = written(inner.drop("whole"), "mix-rows")
    facts, count = plan(slim, path, weights, share, max_epochs, seed, key)
    wide = join_facts(inner, facts.drop("tokens"), count, [key])
    order = _order(F.col("epochs"), key, seed)
    part = (
        F.when(F.col("cut_order").isNull() | (order > F.col("cut_order")), 0)
        .when(order < F.col("cut_order"), F.col("n_tokens"))
        .otherwise(F.least("n_tokens", F.col("rest") - F.col("cut_before")))
        .cast("long")
    )
    extra = F.coalesce((order <= F.col("cut_order")).cast("long"), F.lit(0))
    added = {
        "given_tokens": F.col("given"),
        "epochs": F.col("epochs"),
        "part_tokens": part,
        "copies": F.col("epochs") + extra,
    }
    return wide.select(*[F.col(f"whole.`{c}`") for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def with_tree(docs: DataFrame) -> DataFrame:
    """Domain and number of tokens of documents."""
    return docs.withColumn("domain", domain_of(F.col("source"))).withColumn("n_tokens", token_count(F.col("text")))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixing decision for every document."""
    docs = with_tree(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    return mix(docs)


def _sql_level(n: int, path: Sequence[str]) -> str:
    """SQL of one level of the tree: nodes, water level, tokens given."""
    level, cols, parent = path[n], ", ".join(path[: n + 1]), ", ".join(path[:n])
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    by = f"PARTITION BY {parent} " if parent else ""
    source = (
        f"(SELECT {cols}, sum(capacity) AS capacity FROM leaves GROUP BY ALL) x, (SELECT sum(tokens) AS budget FROM leaves) y"
        if not parent
        else f"(SELECT {cols}, sum(capacity) AS capacity FROM leaves GROUP BY ALL) x JOIN g{n - 1} y ON "
        + " AND ".join(f"x.{p} IS NOT DISTINCT FROM y.{p}" for p in path[:n])
    )
    budget = "y.budget" if not parent else "y.given AS budget"
    return f"""
n{n} AS (SELECT {", ".join("x." + p for p in path[: n + 1])}, x.capacity, {budget}, CASE {level} {cases} ELSE 1 END AS weight FROM {source}),
o{n} AS (SELECT *, cast(capacity AS double) / weight AS ratio FROM n{n}),
l{n} AS (SELECT *, cast(budget - coalesce(sum(capacity) OVER w, 0) AS double)
    / cast(sum(weight) OVER ({by}) - coalesce(sum(weight) OVER w, 0) AS double) AS lev
  FROM o{n} WINDOW w AS ({by}ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g{n} AS (SELECT {cols}, cast(least(capacity, floor(weight * max(lev) OVER ({by}))) AS bigint) AS given FROM l{n})"""


SQL = (
    r"""
WITH d AS (
  SELECT doc_id, lang, source,
    CASE WHEN md5(coalesce(source, ''))[1] < '4' THEN 'web' WHEN md5(coalesce(source, ''))[1] < '8' THEN 'books'
      WHEN md5(coalesce(source, ''))[1] < 'c' THEN 'code' ELSE 'forum' END AS domain,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS n_tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * 4 AS capacity FROM d GROUP BY ALL
),"""
    + ",".join(_sql_level(n, PATH) for n in range(3))
    + """, f AS (
  SELECT d.*, g.given, cast(CASE WHEN v.tokens > 0 THEN g.given // v.tokens ELSE 0 END AS bigint) AS epochs, v.tokens
  FROM d JOIN leaves v ON d.domain = v.domain AND d.lang IS NOT DISTINCT FROM v.lang AND d.source IS NOT DISTINCT FROM v.source
  JOIN g2 g ON d.domain = g.domain AND d.lang IS NOT DISTINCT FROM g.lang AND d.source IS NOT DISTINCT FROM g.source
), p AS (
  SELECT *, given - epochs * tokens AS rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('42:' || epochs || ':' || coalesce(cast(doc_id AS varchar), 'null')), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM f
)
SELECT doc_id, lang, source, domain, n_tokens, given AS given_tokens, epochs,
  cast(greatest(0, least(n_tokens, rest - before)) AS bigint) AS part_tokens,
  epochs + cast(before < rest AS bigint) AS copies
FROM p
"""
)
