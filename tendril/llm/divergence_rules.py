"""Quality rules by distribution divergence.

Two histograms of every text are compared with those of its language by
Jensen-Shannon distance: the shares of character classes, and the shares of
the language's most common short words among all words.  Texts too short for
a histogram are not judged by it (minimum-length guards).  The references are
counted over all documents; every language that has words has one of its own,
a null language and one without words use that of the corpus.

Everything is DataFrame code.  The references are a table of one row per
language (``COMMON_WORDS`` words and eight shares), joined to the documents by
language; it is broadcast up to ``common.BROADCAST_ROWS`` languages, so that
texts are shuffled only where there are more (and then not those of common ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.llm.common import WORD_PATTERN, bounded_join, cut

WINDOW_WORDS = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
COMMON_WORDS, COMMON_CHARS = 32, 6
#: Languages that the SQL gives references of their own; the code has no such limit.
REFERENCES = 32
#: Largest distances of a kept text, and the lengths from which they are looked at.
CHAR_LIMIT, CHAR_GUARD = 0.25, 200
WORD_LIMIT, WORD_GUARD = 0.36, 100
SYMBOLS = "#*$%&|<>"
WHITE, WHITE_CLASS = " \t\n\x0b\x0c\r", r"\x20\x09-\x0D"
#: Character classes; each is counted in what is left after plain lower-case letters.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?'\"()\x2D]",
    "symbol": f"[{SYMBOLS}]",
    "wide": r"[^\x00-\x7F]",
}
CLASS_NAMES = ["lower", *CLASSES, "rest"]


def _parts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, lang, text, its words, what is left without a-z, and without white space; the
    columns of ``keep`` as they are."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), *keep)
    inner = F.btrim(F.col("text"), F.lit(WHITE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WHITE_CLASS}]+"))
    out = out.withColumn("words", words).withColumn("left", F.regexp_replace("text", "[a-z]+", ""))
    return out.withColumn("few", F.regexp_replace("left", f"[{WHITE_CLASS}]+", ""))


def _class_counts() -> list[Column]:
    """Characters of each class as long columns named like it."""
    gone = {"lower": ("text", "left"), "space": ("left", "few")}
    out = [(F.length(a) - F.length(b)).cast("long").alias(n) for n, (a, b) in gone.items()]
    return out + [F.regexp_count("few", F.lit(p)).cast("long").alias(n) for n, p in CLASSES.items() if n not in gone]


def _rest() -> Column:
    return F.length("text") - sum(F.col(n) for n in CLASS_NAMES[:-1])


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _struct(words: Column, p: Column, q: Column) -> Column:
    return F.struct(words.alias("words"), p.alias("p"), q.alias("q"))


def _key() -> Column:
    """The language as a join key that a null language has, too."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key")


def references(docs: DataFrame) -> tuple[DataFrame, int]:
    """``key, ref, docs`` for every language (and null), and the number of all rows.

    ``ref`` holds the ``words``, their shares ``p`` and the class shares ``q``, ``docs``
    counts the language's rows.  Counted over all rows; words are ordered by count, then
    by their bytes."""
    parts = _parts(docs)
    per_lang = (
        parts.select("lang", F.length("text").alias("chars"), F.size("words").alias("n"), "text", "left", "few")
        .select("lang", "chars", "n", *_class_counts(), "text")
        .withColumn("rest", _rest())
        .groupBy("lang")
        .agg(
            F.sum("chars").alias("chars"),
            F.sum("n").alias("n"),
            *[F.sum(c).alias(c) for c in CLASS_NAMES],
            F.count("*").alias("docs"),
        )
    )
    per_lang = cut(per_lang)
    short = parts.select("lang", F.explode("words").alias("word")).where(F.length("word") <= COMMON_CHARS)
    counts = cut(short.groupBy("lang", "word").agg(F.count("*").alias("n")))
    best = [F.col("n").desc(), F.col("word")]
    sums = [F.sum(c).alias(c) for c in ["chars", "n", *CLASS_NAMES]]
    row = per_lang.agg(*sums, F.sum("docs").alias("docs")).first()
    whole = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(*best).limit(COMMON_WORDS).collect()
    n, chars = max(1, row["n"] or 0), max(1, row["chars"] or 0)
    corpus = _struct(
        _literal([t["word"] for t in whole], "string"),
        _literal([t["n"] / n for t in whole], "double"),
        _literal([(row[c] or 0) / chars for c in CLASS_NAMES], "double"),
    )
    ranked = counts.where("lang is not null").withColumn(
        "k", F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    )
    top = (
        ranked.where(F.col("k") <= COMMON_WORDS)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("k", "word", F.col("n").alias("said")))).alias("top"))
    )
    own = _struct(
        F.coalesce(F.col("top.word"), _literal([], "string")),
        F.coalesce(F.transform("top", lambda t: t["said"] / F.col("n")), _literal([], "double")),
        F.array(*[F.col(c) / F.col("chars") for c in CLASS_NAMES]),
    )
    has_own = F.col("lang").isNotNull() & (F.col("n") > 0)
    refs = per_lang.join(top, "lang", "left").select(_key(), F.when(has_own, own).otherwise(corpus).alias("ref"), "docs")
    return cut(refs), row["docs"] or 0


def _term(p: Column, q: Column) -> Column:
    """One class's part of the Jensen-Shannon divergence, in bits."""
    half = (p + q) / 2
    return (
        F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)
    ) / 2


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    total = F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def _with_other(shares: Column) -> Column:
    return F.concat(shares, F.array(F.greatest(1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))))


def base_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``
    with the columns of ``keep`` and those that ``judge`` goes on with."""
    # words are compared by 64-bit hashes, each taken once
    d = _parts(docs, *keep).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.when(
        n >= WINDOW_WORDS,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW_WORDS),
            lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW_WORDS)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "doc_id", "lang", "hashes", *_class_counts(), F.length("text").alias("chars"), lines.alias("lines"), windows.alias("h"), "text", *keep
    )
    # only a text with equal windows needs their places: sorted by hash, then place
    again = F.size(F.array_distinct("h")) < F.size("h")
    places = F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("rest", _rest()).withColumn("sorted", places).drop("h", "text")
    same = F.filter(
        "sorted",
        lambda s, k: F.coalesce(F.get("sorted", k - 1)["x"] == s["x"], F.lit(False))
        | F.coalesce(F.get("sorted", k + 1)["x"] == s["x"], F.lit(False)),
    )
    at = F.sort_array(F.transform(same, lambda s: s["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        at,
        start,
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW_WORDS - F.greatest(p, a["end"])).alias("n"), (p + WINDOW_WORDS).alias("end")
        ),
        lambda a: a["n"],
    )
    d = d.select(
        "doc_id",
        "lang",
        "hashes",
        "chars",
        *CLASS_NAMES,
        n.cast("long").alias("n_words"),
        (F.col("chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        *keep,
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _common_hashes(refs: DataFrame) -> list[int]:
    """The hashes of all references' words, by which other words are passed over at once; none
    where there are more than ``REFERENCES`` references (words are then looked up one by one)."""
    some = refs.select("ref.hashes").limit(REFERENCES + 1).collect()
    return [] if len(some) > REFERENCES else sorted({h for r in some for h in r["hashes"]})


def judge(docs: DataFrame) -> DataFrame:
    """Base columns, ``char_distance``, ``word_distance`` (null below the guards) and ``kept``.

    One row per row of ``docs(doc_id, text, lang)``: null texts have no words
    and fail the base rules, repeated rows each give a row, other columns are
    ignored, an empty table gives an empty one."""
    refs, total = references(docs)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).withColumn("key", _key())
    refs = refs.withColumn("ref", F.col("ref").withField("hashes", F.transform("ref.words", lambda w: F.xxhash64(w))))
    d = base_rules(bounded_join(rows, refs, "key", "docs", total), "ref")
    # places in the reference; each place is put in once more, so that its run's length gives the count
    common = _common_hashes(refs)
    some = F.filter("hashes", lambda x: x.isin(common)) if common else F.col("hashes")
    hits = F.filter(F.transform(some, lambda x: F.array_position(F.col("ref.hashes"), x)), lambda x: x > 0)
    d = d.withColumn(
        "runs", F.sort_array(F.concat(hits, F.sequence(F.lit(1).cast("long"), F.size("ref.words").cast("long") + 1)))
    ).drop("hashes")
    shares = F.transform(
        F.sequence(F.lit(1).cast("long"), F.size("ref.words").cast("long")),
        lambda k: (F.array_position("runs", k + 1) - F.array_position("runs", k) - 1) / F.col("n_words"),
    )
    enough_words = (F.col("n_words") >= WORD_GUARD) & (F.size("ref.words") > 0)
    d = d.withColumn("shares", F.when(enough_words, shares))
    class_shares = F.array(*[(F.col(c) / F.col("chars")).cast("double") for c in CLASS_NAMES])
    word_distance = F.when(F.col("shares").isNotNull(), _distance(_with_other(F.col("shares")), _with_other(F.col("ref.p"))))
    char_distance = F.when(F.col("chars") >= CHAR_GUARD, _distance(class_shares, F.col("ref.q")))
    d = d.withColumn("char_distance", F.round(char_distance, 6)).withColumn("word_distance", F.round(word_distance, 6))
    far = F.coalesce(F.col("char_distance") > CHAR_LIMIT, F.lit(False)) | F.coalesce(
        F.col("word_distance") > WORD_LIMIT, F.lit(False)
    )
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "char_distance",
        "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the rows of the query."""
    count = lambda keep: f"length(regexp_replace(text, '[^{keep}]', '', 'g'))"
    inside = {n: p[1:-1] for n, p in CLASSES.items() if n != "wide"}
    inside["stop"] = inside["stop"].replace("'", "''")
    classes = {"lower": count("a-z"), **{n: count(p) for n, p in inside.items()}}
    classes["wide"] = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
    columns = ", ".join(f"{sql} AS c_{n}" for n, sql in classes.items())
    rest = " - ".join(["chars", *[f"c_{n}" for n in classes]])
    names = [*classes, "rest"]
    term = lambda p, q: (
        f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
        f" + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END) / 2"
    )
    chars = " + ".join(term(f"(c_{n}::DOUBLE / chars)", f"q_{n}") for n in names)
    word = WORD_PATTERN
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM {table}),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{word}') AS words, length(text) AS chars, {columns} FROM d),
k AS MATERIALIZED (SELECT *, {rest} AS c_rest, len(words) AS n,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
per_lang AS (SELECT lang, sum(n) AS n, sum(chars) AS chars, {", ".join(f"sum(c_{n}) AS c_{n}" for n in names)} FROM k GROUP BY lang),
langs AS (SELECT * FROM per_lang WHERE lang IS NOT NULL AND n > 0 ORDER BY n DESC, lang LIMIT {REFERENCES}),
refs AS (SELECT lang AS ref, n, chars, {", ".join(f"c_{n}" for n in names)} FROM langs
  UNION ALL SELECT NULL, sum(n), sum(chars), {", ".join(f"sum(c_{n})" for n in names)} FROM per_lang),
ref AS (SELECT ref, greatest(n, 1) AS total, {", ".join(f"c_{n}::DOUBLE / greatest(chars, 1) AS q_{n}" for n in names)} FROM refs),
said AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM k) WHERE length(word) <= {COMMON_CHARS} GROUP BY ALL),
per_ref AS (SELECT lang AS ref, word, n FROM said WHERE lang IN (SELECT lang FROM langs)
  UNION ALL SELECT NULL, word, sum(n) FROM said GROUP BY word),
top AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS place FROM per_ref QUALIFY place <= {COMMON_WORDS}),
common AS (SELECT top.ref, place, word, top.n::DOUBLE / total AS q FROM top JOIN ref ON top.ref IS NOT DISTINCT FROM ref.ref),
doc AS (SELECT k.*, CASE WHEN lang IN (SELECT lang FROM langs) THEN lang END AS ref FROM k),
hits AS (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(words) AS word FROM k) GROUP BY ALL),
shares AS (SELECT doc.r, place, coalesce(c, 0)::DOUBLE / n AS p, q FROM doc JOIN common ON common.ref IS NOT DISTINCT FROM doc.ref
  LEFT JOIN hits ON hits.r = doc.r AND hits.word = common.word WHERE n >= {WORD_GUARD}),
sums AS (SELECT r, list_sum(list({term("p", "q")} ORDER BY place)) AS js, greatest(1 - list_sum(list(p ORDER BY place)), 0) AS p,
  greatest(1 - list_sum(list(q ORDER BY place)), 0) AS q FROM shares GROUP BY r),
far_words AS (SELECT r, round(sqrt(greatest(js + {term("p", "q")}, 0)), 6) AS word_distance FROM sums),
win AS (SELECT r, i, words[i:i + {WINDOW_WORDS - 1}] AS win FROM (SELECT r, words, unnest(range(1, n - {WINDOW_WORDS - 2})) AS i FROM k WHERE n >= {WINDOW_WORDS})),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
covered AS (SELECT r, count(DISTINCT p) AS c FROM (SELECT r, unnest(range(i, i + {WINDOW_WORDS})) AS p FROM again) GROUP BY r),
base AS (SELECT doc.*, coalesce(c, 0) AS n_repeat_words,
  n < {LEAST_WORDS} OR 100 * coalesce(c, 0) > {MOST_REPEATED} * n AS base_failed FROM doc LEFT JOIN covered USING (r)),
judged AS (SELECT base.*, word_distance,
  CASE WHEN chars >= {CHAR_GUARD} THEN round(sqrt(greatest({chars}, 0)), 6) END AS char_distance
  FROM base JOIN ref ON base.ref IS NOT DISTINCT FROM ref.ref LEFT JOIN far_words USING (r))
SELECT doc_id, n::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  char_distance, word_distance,
  NOT base_failed AND NOT coalesce(char_distance > {CHAR_LIMIT}, FALSE) AND NOT coalesce(word_distance > {WORD_LIMIT}, FALSE) AS kept
FROM judged"""
