"""URL filters by association rules.

Fixed rules (host and path prefix) decide first; the longest that fits wins.
The URLs they decide are the labelled examples from which Spark's FP-growth
mines which combinations of URL tokens go with which verdict.  Mined rules are
pruned by support, by confidence and against simpler rules that are as
confident, and then judge every URL that no fixed rule fits.

Matching uses an inverted index: each mined rule is filed under its rarest
token, a URL looks up its own tokens there, and only then the rest of the rule
is compared.  Mining and matching are DataFrame operations throughout; the
rules are never gathered on the driver.  Counts are summed over equal token
sets first, so a hot URL is one row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import cut, spread_join

#: (verdict, host, path) of the fixed rules (fixed values).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Frequent tokens of a row beyond which FP-growth's sets of every size would be too
#: many; such rows' sets are grown token by token.
MOST_ITEMS = 10
#: ``mine``'s own bound on the tokens of a rule that only such rows give; ``judge_urls`` sets none.
LONG_TOKENS = 3
#: Verdict of a URL that no fixed and no mined rule fits.
DEFAULT = "allow"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fixed rule that fits as ``host + path``, or null."""
    out = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, h + p).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for v, h, p in rules:
        out = F.when(rule == h + p, v).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: words of the host (h:), of the path (p:) and query keys (q:); numbers are ``#``."""

    def words(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit("[a-z]+|[0-9]+"), F.lit(0))
        return F.transform(
            found, lambda x: F.when(x.rlike("^[0-9]"), f"{kind}:#").otherwise(F.concat(F.lit(f"{kind}:"), x))
        )

    lower = F.translate(F.coalesce(url, F.lit("")), CAPITALS, SMALL)
    keys = F.regexp_extract_all(lower, F.lit("[?&]([^=&?#]+)="), F.lit(1))
    keys = F.transform(keys, lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(words(host, "h"), words(F.translate(path, CAPITALS, SMALL), "p"), keys))


def _split(pages: DataFrame) -> DataFrame:
    d = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    d = d.withColumn("rule", fixed_rule(F.col("host"), F.col("path")))
    return d.withColumn("fixed", verdict_of(F.col("rule")))


def _slim(sets: DataFrame, singles: DataFrame) -> DataFrame:
    """``id, verdict, n, items``: the sets of ``sets(id, tokens, verdict, n)`` with their frequent tokens only."""
    each = sets.select("id", "verdict", "n", F.explode("tokens").alias("token"))
    kept = each.join(singles.select("token"), "token").groupBy("id", "verdict", "n")
    return kept.agg(F.sort_array(F.collect_list("token")).alias("items"))


def _growth_candidates(labelled: DataFrame, total: int, slim: DataFrame, support: float) -> DataFrame:
    """Token sets that FP-growth finds often enough with a verdict among the rows
    with at most ``MOST_ITEMS`` frequent tokens."""
    mark = "verdict="
    short = slim.where(F.size("items") <= MOST_ITEMS).select("id", "items", "n")
    baskets = spread_join(labelled, short, "id", "n", total).select(
        F.concat("items", F.array(F.concat(F.lit(mark), "verdict"))).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=support * (1 - 1e-9)).fit(baskets)
    is_mark = lambda x: x.startswith(mark)
    sets = model.freqItemsets.where(F.exists("items", is_mark))
    return sets.select(F.sort_array(F.filter("items", lambda x: ~is_mark(x))).alias("tokens")).where(F.size("tokens") > 0)


def _long_candidates(slim: DataFrame, support: float, least: int, most: int | None) -> DataFrame:
    """The token sets of every size (``most`` tokens, unless null) among the rows with more
    frequent tokens that can be of use.

    A rule is of use if it is surer than those of one token less, so each of its tokens
    takes some of the rows with another verdict away.  That holds for all its parts
    too, and so sets grow by one token at a time from sets of which it holds; tokens
    that always come together (a hot URL's) give no larger sets.  All counts are over
    all rows, looked at only where a set has its share of the longer ones."""
    is_long = F.size("items") > MOST_ITEMS
    n = slim.where(is_long).agg(F.sum("n").alias("n")).first()["n"] or 0
    kinds = "tokens array<string>, verdict string"
    found = [slim.sparkSession.createDataFrame([], kinds)]
    share = max(1, math.floor(n * support))
    combos = slim.select(
        "verdict",
        "n",
        F.when(is_long, F.col("n")).otherwise(0).alias("long"),
        F.array().cast("array<string>").alias("tokens"),
        F.col("items").alias("rest"),
    )
    last = None
    while n and (most is None or len(found) <= most):
        more = combos.select("verdict", "n", "long", "tokens", F.posexplode("rest").alias("at", "token"), "rest")
        combos = more.select(
            "verdict",
            "n",
            "long",
            F.concat("tokens", F.array("token")).alias("tokens"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
        )
        counts = combos.groupBy("tokens", "verdict").agg(F.sum("n").alias("n"), F.sum("long").alias("long"))
        each = F.collect_list(F.struct("verdict", "n", "long"))
        counts = counts.groupBy("tokens").agg(F.sum("n").alias("all"), each.alias("each"))
        counts = counts.select("tokens", "all", F.explode("each").alias("x"))
        counts = counts.select("tokens", "x.verdict", (F.col("all") - F.col("x.n")).alias("against"), "x.n", "x.long")
        level = cut(counts.where((F.col("n") >= least) & (F.col("long") >= share)).drop("n", "long"))
        if last is not None:
            parts = level.withColumn("part", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))))
            of = last.select(F.col("tokens").alias("part"), "verdict", F.col("against").alias("part_against"))
            useful = parts.join(of, ["part", "verdict"]).where("part_against > against").groupBy("tokens", "verdict", "against")
            level = cut(useful.agg(F.count("*").alias("parts")).where(F.col("parts") == F.size("tokens")).drop("parts"))
        last = level
        if level.isEmpty():
            break
        found.append(level.select("tokens", "verdict"))
        # rows go on with the sets that some verdict can grow from
        grow = level.where("against > 0").select("tokens").distinct()
        combos = cut(combos.join(grow, "tokens", "left_semi").where(F.size("rest") > 0))
    return reduce(DataFrame.union, found).select("tokens")


def mine(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, long_tokens: int | None = LONG_TOKENS
) -> DataFrame:
    """``tokens, token, verdict, confidence, count`` of the mined rules from
    ``labelled(tokens, verdict)``; ``token`` is the rarest one, under which the rule is filed.

    Confidence is the share of rows with all tokens that have the verdict.

    FP-growth lists every subset of a frequent basket, so one repeated URL of
    forty tokens would have 2^40 of them.  It therefore gets the rows of at most
    ``MOST_ITEMS`` frequent tokens (2^(MOST_ITEMS + 1) / support sets at most),
    of every size; those of the others are grown token by token from their distinct
    token sets, without the ones that pruning would drop in any case, to ``long_tokens``
    tokens or, if that is None, to every size.  What is frequent among all rows is so in
    one of the two parts, and all candidates are then counted over all rows."""
    schema = "tokens array<string>, token string, verdict string, confidence double, count long"
    n = labelled.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    least = math.ceil(round(support * n, 6))
    labelled = labelled.withColumn(
        "id", F.md5(F.to_json(F.struct(F.sort_array("tokens").alias("t"), F.col("verdict").alias("v"))).cast("binary"))
    )
    same = [F.first(F.sort_array("tokens")).alias("tokens"), F.first("verdict").alias("verdict")]
    sets = cut(labelled.groupBy("id").agg(*same, F.count("*").alias("n")))
    singles = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("token_count"))
    singles = cut(singles.where(F.col("token_count") >= least))
    slim = cut(_slim(sets, singles))
    candidates = _growth_candidates(labelled, n, slim, support).union(_long_candidates(slim, support, least, long_tokens)).distinct()
    filed = candidates.withColumn("token", F.explode("tokens")).join(singles, "token")
    filed = cut(filed.groupBy("tokens").agg(F.min(F.struct("token_count", "token")).alias("r")).select("tokens", "r.token"))
    # equal sets of frequent tokens are counted together, each candidate from its rarest token
    equal = slim.groupBy("items", "verdict").agg(F.sum("n").alias("n"))
    looked = equal.select("items", "verdict", "n", F.explode("items").alias("token")).join(filed, "token")
    counts = looked.where(F.size(F.array_except("tokens", "items")) == 0)
    counts = cut(counts.groupBy("tokens", "token", "verdict").agg(F.sum("n").alias("count")))
    whole = counts.groupBy(F.col("tokens").alias("of")).agg(F.sum("count").alias("all"))
    rules = counts.where(F.col("count") >= least).join(whole, F.col("tokens") == F.col("of"))
    rules = rules.select(
        "tokens", "token", "verdict", (F.col("count") / F.col("all")).alias("confidence"), "count"
    ).where(F.col("confidence") >= confidence)
    # a longer rule is of use only if it is surer than every rule of one token less
    parts = rules.withColumn(
        "part", F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x)))
    ).select("tokens", "verdict", "confidence", "part")
    simple = rules.select(
        F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence")
    )
    vain = parts.join(simple, ["part", "verdict"]).where("part_confidence >= confidence").select("tokens", "verdict")
    rules = rules.join(vain.distinct(), ["tokens", "verdict"], "left_anti")
    return cut(rules.select("tokens", "token", "verdict", "confidence", "count"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, best`` (confidence, count, verdict, tokens) for the URLs of
    ``urls(url, tokens)`` that a rule fits: the surest, then the best supported, then blocking."""
    r = rules.select(
        "token", F.struct("confidence", "count", "verdict", "tokens").alias("r"), F.col("tokens").alias("wanted")
    )
    looked = urls.select("url", F.col("tokens").alias("has"), F.explode("tokens").alias("token"))
    fits = looked.join(r, "token").where(F.size(F.array_except("wanted", "has")) == 0)
    return fits.groupBy("url").agg(F.max("r").alias("best"))


def judge_urls(pages: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence, combination`` for every row of ``pages(page_id, url)``.

    ``rule`` is the fixed rule or null; ``confidence`` and ``combination`` (tokens
    joined by blanks) are those of the mined rule that decided, else null.  A URL
    with an empty host is judged by its other tokens; null URLs and URLs without
    tokens get the default; repeated rows each give a row; other columns are
    ignored."""
    split = _split(pages)
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    labelled = split.where(F.col("rule").isNotNull()).select(tokens.alias("tokens"), F.col("fixed").alias("verdict"))
    rules = mine(labelled, support, confidence, None)
    # each different URL is looked up once; a hot one's rows stay where they are
    undecided = split.where(F.col("rule").isNull() & F.col("url").isNotNull())
    open_ = undecided.groupBy("url").agg(F.count("*").alias("rows"))
    open_ = open_.select("url", "rows", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = match(open_.select("url", tokens.alias("tokens")), rules).withColumnRenamed("url", "of")
    kind = best.schema["best"].dataType
    known = open_.join(best, F.col("url") == F.col("of"), "left").select("url", F.struct("best").alias("found"), "rows")
    known = cut(known)
    total = known.agg(F.sum("rows")).first()[0] or 0
    undecided = spread_join(undecided, known, "url", "rows", total)
    undecided = undecided.withColumn("best", F.col("found.best")).drop("found")
    decided = split.where(F.col("rule").isNotNull() | F.col("url").isNull()).withColumn("best", F.lit(None).cast(kind))
    return decided.unionByName(undecided).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("fixed", "best.verdict", F.lit(DEFAULT)).alias("verdict"),
        F.col("best.confidence").alias("confidence"),
        F.array_join("best.tokens", " ").alias("combination"),
    )


def oracle(table: str = "pages") -> str:
    """DuckDB SQL for the rows of the query."""
    by_length = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by_length) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES) + " END"
    low = lambda x: f"translate({x}, '{CAPITALS}', '{SMALL}')"
    words = lambda x, k: (
        f"list_transform(regexp_extract_all({x}, '[a-z]+|[0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '{k}:#' ELSE '{k}:' || x END)"
    )
    return f"""
WITH RECURSIVE parts AS (SELECT page_id, url, coalesce({low("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM {table}),
ruled AS (SELECT *, {rule} AS rule FROM parts),
toks AS (SELECT row_number() OVER () AS row, *, {verdict} AS fixed,
    list_distinct({words("host", "h")} || {words(low("path"), "p")} ||
      list_transform(regexp_extract_all({low("coalesce(url, '')")}, '[?&]([^=&?#]+)=', 1), lambda x: 'q:' || x)) AS tokens FROM ruled),
n AS (SELECT ceil({SUPPORT} * count(*)) AS least FROM toks WHERE rule IS NOT NULL),
t AS (SELECT row, fixed, unnest(tokens) AS token FROM toks),
frequent AS (SELECT token FROM t WHERE fixed IS NOT NULL GROUP BY token HAVING count(*) >= (SELECT least FROM n)),
sets AS MATERIALIZED (SELECT row, fixed, list(token ORDER BY token) AS items FROM t JOIN frequent USING (token) GROUP BY row, fixed),
equal AS (SELECT items, fixed, count(*) AS n FROM sets WHERE fixed IS NOT NULL GROUP BY items, fixed),
places AS (SELECT unnest(range(1, (SELECT coalesce(max(len(items)), 0) + 1 FROM sets))) AS j),
combos AS (
  SELECT items, fixed, n, [items[j]] AS tokens, j AS last FROM equal JOIN places ON j <= len(items)
  UNION ALL
  SELECT c.items, c.fixed, c.n, list_append(c.tokens, c.items[p.j]), p.j FROM combos c JOIN places p ON p.j > c.last AND p.j <= len(c.items)),
counted AS (SELECT tokens, fixed AS verdict, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY tokens) AS total
  FROM combos GROUP BY tokens, fixed),
rules AS (SELECT tokens, verdict, n::BIGINT AS cnt, n::DOUBLE / total::DOUBLE AS confidence FROM counted, n
  WHERE n >= least AND n::DOUBLE / total::DOUBLE >= {CONFIDENCE}),
kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules s WHERE s.verdict = r.verdict AND len(s.tokens) = len(r.tokens) - 1
  AND list_has_all(r.tokens, s.tokens) AND s.confidence >= r.confidence)),
open AS (SELECT DISTINCT items FROM sets WHERE fixed IS NULL),
best AS (SELECT items, max(row(confidence, cnt, verdict, tokens)) AS b FROM open JOIN kept ON list_has_all(items, tokens) GROUP BY items),
found AS (SELECT row, b FROM sets JOIN best USING (items) WHERE fixed IS NULL)
SELECT page_id, host, path, rule, coalesce(fixed, b[3], '{DEFAULT}') AS verdict, b[1] AS confidence,
  array_to_string(b[4], ' ') AS combination
FROM toks LEFT JOIN found USING (row)"""
