"""Mixing sources to target weights by hierarchical budgeting.

The token budget runs down a tree domain -> language -> source by target
weights.  A node that has too few tokens for its share (its documents, each
used at most ``max_epochs`` times) takes what it has; the rest goes to its
siblings by their weights, and only what all siblings together cannot use has
lowered the parent's share before, so ancestors' siblings come last.  With
capacities summed up bottom-up this is one water filling per parent, done top
down: children are taken by capacity per weight; as long as one is below the
level, it is filled, and the others share the rest.

All of that happens on one row per leaf.  A leaf's budget then buys whole
epochs of its documents and a prefix of one more: documents are ordered by a
seeded hash of (seed, epoch, doc_id), and taken while the tokens last.  The
prefix is found without ordering a leaf: tokens are summed per leaf and hash
slice, a running sum over the slices finds the one in which the budget ends,
first among 256, then among 256 parts of that one; only its documents are
ordered.  The last hash taken is the leaf's cutoff, and every document decides
by its own hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.common import WORD_PATTERN, cut, fresh

SEED = 17
MAX_EPOCHS = 2
#: Share of all tokens that the mix should have.
BUDGET = (9, 10)
LEVELS = ["domain", "language", "source"]
#: Domains are groups of sources; weights of nodes not listed are 1.
DOMAINS = 4
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "other": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
#: Hexadecimal digits of the order hash that name a slice, coarse and fine.
SLICE_DIGITS = (2, 4)
#: Leaves up to which their table is broadcast (some 10 MB).
BROADCAST_LEAVES = 100_000
LEVELS_OF = ["mix_domain", "mix_language", "mix_source"]


def n_tokens(text: Column) -> Column:
    """Words of the contracts as the unit of the budget; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The number at the end of a source's name modulo DOMAINS; ``other`` without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(
        F.concat(F.lit("d"), F.pmod(number.try_cast("long"), F.lit(DOMAINS)).cast("string"))
    )


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for node, w in weights.items():
        out = F.when(F.col(name) == node, w).otherwise(out)
    return out.cast("decimal(10,0)")


def water_fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Adds ``share``: each parent's ``budget`` dealt to its children by ``weight``,
    none above its ``capacity``; exact integers, rounded down.

    ``children`` has one row per node with parent columns, budget, capacity, weight."""
    big = "decimal(38,0)"
    order = [F.col("capacity").cast("double") / F.col("weight").cast("double"), F.col(node)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*parent)
    left = F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), F.lit(0))
    weight_left = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    out = children.withColumn("left", left.cast("decimal(24,0)")).withColumn("wl", weight_left.cast("decimal(12,0)"))
    # filled: its capacity is within its part of what is left
    filled = F.col("capacity").cast("decimal(24,0)") * F.col("wl") <= F.col("left") * F.col("weight")
    out = out.withColumn("level_left", F.when(~filled, F.col("left"))).withColumn(
        "level_wl", F.when(~filled, F.col("wl"))
    )
    # the first child that is not filled fixes the level for all after it
    first = Window.partitionBy(*parent).orderBy(*order)
    level_left = F.first("level_left", ignorenulls=True).over(first)
    level_wl = F.first("level_wl", ignorenulls=True).over(first)
    out = out.withColumn("ll", level_left).withColumn("lw", level_wl)
    share = F.when(F.col("ll").isNull(), F.col("capacity")).otherwise(
        F.least(F.col("capacity").cast(big), F.floor(F.col("ll") * F.col("weight") / F.col("lw")).cast(big))
    )
    return out.withColumn("share", share.cast("long")).drop("left", "wl", "level_left", "level_wl", "ll", "lw")


def leaf_budgets(
    leaves: DataFrame,
    budget: tuple[int, int] = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    domain_weights: dict[str, int] | None = None,
    language_weights: dict[str, int] | None = None,
) -> DataFrame:
    """``domain, language, source, tokens, share`` from one row per leaf with its tokens."""
    weights = [
        DOMAIN_WEIGHTS if domain_weights is None else domain_weights,
        LANGUAGE_WEIGHTS if language_weights is None else language_weights,
        {},
    ]
    total = leaves.agg(F.floor(F.sum("tokens") * budget[0] / budget[1]).cast("long").alias("budget"))
    above, keys = total.withColumn("root", F.lit(0)), ["root"]
    for depth, (node, w) in enumerate(zip(LEVELS, weights)):
        nodes = LEVELS[: depth + 1]
        level = (
            leaves.withColumn("root", F.lit(0))
            .groupBy("root", *nodes)
            .agg(F.sum("tokens").alias("tokens"), (F.sum("tokens") * max_epochs).alias("capacity"))
            .withColumn("weight", _weight(node, w))
        )
        level = level.join(above, keys)
        filled = water_fill(level, keys, node).drop("budget", "capacity", "weight")
        keys = ["root", *nodes]
        above = filled.select(*keys, F.col("share").alias("budget"))
    return filled.drop("root")


def _add_leaf(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with its leaf (domain, language, source) under ``names``."""
    null = F.lit("(none)")
    leaf = [domain_of(F.col("source")), F.coalesce("lang", null), F.coalesce("source", null)]
    return docs.withColumns(dict(zip(names, leaf)))


def _order_hash(seed: int, whole: Column, doc_id: Column) -> Column:
    """Place of a document in its leaf's epoch after the whole ones."""
    name = F.coalesce(doc_id.cast("string"), F.lit("(none)"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), whole.cast("string"), name).cast("binary"))


def _cutoffs(rows: DataFrame) -> DataFrame:
    """``domain, language, source, cutoff``: the last hash that ``rest`` tokens of a
    leaf reach, from rows ``(leaf, rest, h, tokens)``.

    Slices of the hash space are summed first, coarse then fine; the window
    over single documents sees one 65,536th of a leaf."""
    for digits in SLICE_DIGITS:
        rows = rows.withColumn("slice", F.substring("h", 1, digits))
        sums = rows.groupBy(*LEVELS, "rest", "slice").agg(F.sum("tokens").alias("slice_tokens"))
        upto = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("slice_tokens").over(upto))
        # the one slice per leaf in which the tokens end, and what is left on entering it
        open_ = sums.where("upto > rest and upto - slice_tokens <= rest").select(
            *LEVELS, "slice", (F.col("rest") - F.col("upto") + F.col("slice_tokens")).alias("room")
        )
        rows = rows.join(open_, [*LEVELS, "slice"]).drop("rest").withColumnRenamed("room", "rest")
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h"))
    taken = F.when(running <= F.col("rest"), F.col("h"))
    # without a document taken in the last slice, all slices before it are
    return (
        rows.withColumn("taken", taken)
        .groupBy(*LEVELS, "slice")
        .agg(F.max("taken").alias("last"))
        .select(*LEVELS, F.coalesce("last", "slice").alias("cutoff"))
    )


def mix_plan(docs: DataFrame, seed: int = SEED, **budgets) -> tuple[DataFrame, DataFrame]:
    """(stored rows ``doc_id, leaf, tokens``; one row per leaf with ``whole`` epochs and ``cutoff``)."""
    rows = cut(_add_leaf(docs.select("doc_id", "lang", "source", n_tokens(F.col("text")).alias("tokens")), LEVELS_OF)
               .select("doc_id", *[F.col(x).alias(y) for x, y in zip(LEVELS_OF, LEVELS)], "tokens"))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0)).cast("int")
    shares = cut(
        leaf_budgets(leaves, **budgets)
        .withColumn("whole", whole)
        .select(*LEVELS, "whole", F.greatest(F.col("share") - F.col("whole") * F.col("tokens"), F.lit(0)).alias("rest"))
    )
    keyed = rows.join(shares, LEVELS).select(
        *LEVELS, "rest", "tokens", _order_hash(seed, F.col("whole"), F.col("doc_id")).alias("h")
    )
    # a leaf that the tokens never end in is taken as a whole: behind every hash
    plan = shares.join(_cutoffs(keyed), LEVELS, "left").select(
        *LEVELS, "whole", F.coalesce("cutoff", F.lit("g")).alias("cutoff")
    )
    return rows, cut(plan)


def _n_epochs(seed: int, doc_id: Column) -> Column:
    in_prefix = _order_hash(seed, F.col("whole"), doc_id) <= F.col("cutoff")
    return F.col("whole") + in_prefix.cast("int")


def epochs(docs: DataFrame, seed: int = SEED, **budgets) -> DataFrame:
    """How often each row is used: ``doc_id, domain, language, source, tokens, epochs``.

    One row per row of ``docs(doc_id, text, lang, source)``; null languages and
    sources are leaves of their own, null ids are ordered like the text
    ``(none)``, texts without words cost nothing.  Rows that tie in the seeded
    order (repeated rows) are taken together.  An empty table gives an empty one."""
    rows, plan = mix_plan(docs, seed, **budgets)
    return rows.join(plan, LEVELS).select(
        "doc_id", *LEVELS, "tokens", _n_epochs(seed, F.col("doc_id")).alias("epochs")
    )


def mix(docs: DataFrame, seed: int = SEED, **budgets) -> DataFrame:
    """The rows of ``docs``, each as often as its epochs say; all columns.

    Only the leaves' table is joined, the documents are not shuffled for it
    unless there are too many leaves to broadcast."""
    _, plan = mix_plan(docs, seed, **budgets)
    # one row per leaf; with very many leaves the planner's own join is the other way
    few = plan.count() <= BROADCAST_LEAVES
    names = fresh(docs, *LEVELS_OF, "mix_whole", "mix_cutoff", "mix_copy")
    plan = plan.toDF(*[f"{x}_of" for x in names[:3]], *names[3:5])
    plan = F.broadcast(plan) if few else plan
    with_leaf = _add_leaf(docs, names[:3])
    same = [with_leaf[x] == plan[f"{x}_of"] for x in names[:3]]
    n = F.col(names[3]) + (_order_hash(seed, F.col(names[3]), F.col("doc_id")) <= F.col(names[4])).cast("int")
    used = with_leaf.join(plan, same).withColumn(
        names[5], F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    )
    return used.select(*docs.columns)


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the rows of the query: doc_id, domain, language, source, tokens, epochs."""

    def level(name: str, source: str, parent: list[str], node: str, weight: str, above: str) -> str:
        on = " AND ".join(f"c.{p} = b.{p}" for p in parent) or "TRUE"
        by = ("PARTITION BY " + ", ".join(parent)) if parent else ""
        cols = ", ".join([*parent, node])
        return f"""
{name}_c AS (SELECT {cols}, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {MAX_EPOCHS} AS capacity, {weight} AS weight
  FROM leaves GROUP BY {cols}),
{name}_b AS (SELECT c.*, b.budget::HUGEINT AS budget FROM {name}_c c JOIN {above} b ON {on}),
{name}_w AS (SELECT *, greatest(budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS lft,
  sum(weight) OVER ({by}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM {name}_b WINDOW w AS ({by} ORDER BY capacity::DOUBLE / weight, {node})),
{name}_l AS (SELECT *, first_value(CASE WHEN capacity * wl > lft * weight THEN lft END IGNORE NULLS) OVER w AS ll,
  first_value(CASE WHEN capacity * wl > lft * weight THEN wl END IGNORE NULLS) OVER w AS lw
  FROM {name}_w WINDOW w AS ({by} ORDER BY capacity::DOUBLE / weight, {node} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT {cols}, tokens, CASE WHEN ll IS NULL THEN capacity ELSE least(capacity, (ll * weight) // lw) END::BIGINT AS budget FROM {name}_l)"""

    return f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'other'
      ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % {DOMAINS})::VARCHAR END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens
  FROM {table}),
leaves AS (SELECT domain, language, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
total AS (SELECT (sum(tokens)::HUGEINT * {BUDGET[0]}) // {BUDGET[1]} AS budget FROM leaves),
{level("d", "leaves", [], "domain", _case("domain", DOMAIN_WEIGHTS), "total").strip()},
{level("l", "leaves", ["domain"], "language", _case("language", LANGUAGE_WEIGHTS), "d").strip()},
{level("s", "leaves", ["domain", "language"], "source", "1", "l").strip()},
plan AS (SELECT domain, language, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget, tokens FROM s),
keyed AS (SELECT docs.*, p.whole, greatest(p.budget - p.whole * p.tokens, 0) AS rest,
  md5('{SEED}:' || p.whole::BIGINT::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '(none)')) AS h
  FROM docs JOIN plan p USING (domain, language, source))
SELECT doc_id, domain, language, source, tokens,
  (whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY h) <= rest THEN 1 ELSE 0 END)::INTEGER AS epochs
FROM keyed"""
