"""Near-duplicates among embeddings by a forest of random-projection trees.

* Equal vectors with equal labels are one node with a count, so exact copies
  cost one row however many they are.
* Every tree splits space recursively at medians of random projections; a
  vector within the spill margin of a split goes to both sides.  A tree starts
  with one group per label and vector length.  Groups of more than two blocks
  are split in rounds: each has up to ``2 ** DEPTH`` parts in a round, fitted in
  a task on ``SAMPLE`` vectors of its own; the next round does the same with the
  parts that are still too large.  So the depth follows the table, and no task
  and no driver holds more than the sample of a group.
* A group of two blocks at most is one task's work, in which the splitting goes
  on until ``LEAF`` vectors are left or a set can't be split, and there every
  pair is verified in double precision.
* A larger group that no direction splits (a dense one) is cut into blocks, and
  every pair of blocks is a task of its own, so it has an exact way and no task
  gets all of it.
* A task reports a star per group of linked nodes, never pairs; the stars of
  all trees are united into components.
* Link counts are then made exact within each component, again by blocks:
  all links of a node lie in its component.

Vectors of different labels are never compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import cut, spread_join
from tendril.llm.components import components

COSINE = 0.98
TREES, SPILL, LEAF, BLOCK = 8, 0.02, 256, 1024
#: Vectors on which a group's splits of one round are fitted, chosen by hash; levels of a round.
SAMPLE, DEPTH = 2048, 5
#: A split whose larger side keeps more of the vectors costs more pairs and copies than blocks do.
SIDE = 0.7
SEED = 29


def _seeded(*seed: int) -> np.random.Generator:
    return np.random.default_rng([SEED, *seed])


def _direction(rng: np.random.Generator, d: int) -> np.ndarray:
    r = rng.normal(size=d)
    return r / np.linalg.norm(r)


def _directions(group: str, d: int) -> np.ndarray:
    """The three directions that a group tries at each of its places, drawn again wherever they are needed."""
    r = _seeded(zlib.crc32(group.encode())).normal(size=(2**DEPTH - 1, 3, d))
    return r / np.linalg.norm(r, axis=2, keepdims=True)


def _try_split(x: np.ndarray, directions: Iterable[np.ndarray], spill: float):
    """(which direction, threshold, left mask, right mask), or None if a side of each keeps most of ``x``."""
    for t, r in enumerate(directions):
        p = x @ r
        at = float(np.median(p))
        left, right = p <= at + spill, p >= at - spill
        if max(left.sum(), right.sum()) <= SIDE * len(x):
            return t, at, left, right
    return None


def fit_splits(x: np.ndarray, group: str, n: int, spill: float) -> tuple[list[float], list[int]]:
    """Thresholds and tried directions (-1: no split) of the ``2 ** DEPTH - 1`` places of a
    group of ``n`` vectors, ``x`` being a sample of them; the sides of place k are 2k+1 and 2k+2."""
    at, tried = [0.0] * (2**DEPTH - 1), [-1] * (2**DEPTH - 1)
    directions, todo = _directions(group, x.shape[1]), [(0, x)]
    while todo:
        k, own = todo.pop()
        if k >= len(at) or len(own) < 32 or len(own) * n <= BLOCK * len(x):
            continue
        split = _try_split(own, directions[k], spill)
        if split is not None:
            tried[k], at[k], left, right = split
            todo += [(2 * k + 1, own[left]), (2 * k + 2, own[right])]
    return at, tried


def descend(x: np.ndarray, group: str, at: list[float], tried: list[int], spill: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, rows of ``x`` in it); a row is in every place that spill leads it to."""
    chosen = _directions(group, x.shape[1])[np.arange(len(at)), tried]
    p, todo = x @ chosen.T, [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if k >= len(at) or tried[k] < 0:
            yield k, rows
            continue
        own = p[rows, k]
        todo += [(2 * k + 1, rows[own <= at[k] + spill]), (2 * k + 2, rows[own >= at[k] - spill])]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, rng: np.random.Generator, cosine: float, spill: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the unit vectors ``x`` with at least ``cosine``: splits on below
    a bucket, compares all pairs of what is left."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        tries = (_direction(rng, x.shape[1]) for _ in range(3))
        split = _try_split(x[rows], tries, spill) if len(rows) > LEAF else None
        if split is not None:
            todo += [rows[split[2]], rows[split[3]]]
            continue
        for at in range(0, len(rows), BLOCK):
            i, j = np.nonzero(x[rows[at : at + BLOCK]] @ x[rows[at:]].T >= cosine)
            keep = i < j
            out.append((rows[at + i[keep]], rows[at + j[keep]]))
    return out


def stars(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per node the smallest index of its group."""
    root = np.arange(n)
    if not pairs:
        return root
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _blocks(df: DataFrame, node: str, parts: str) -> DataFrame:
    """Each row once per pair of blocks (i <= j) that its block is in."""
    out = df.withColumn("part", F.pmod(F.xxhash64(node), F.col(parts)).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return out.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", parts)


def _by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that come sorted by ``keys`` and may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        change[0] = not held or (batch[keys].iloc[0] != held[-1][keys].iloc[-1]).any()
        cuts = [*np.flatnonzero(change), len(batch)]
        if cuts[0] > 0:
            held.append(batch.iloc[: cuts[0]])
        for s, e in zip(cuts, cuts[1:]):
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [batch.iloc[s:e]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _named(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and ``node``: a digest of label and vector, null for unusable ones."""
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.col("label").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")))
    usable = F.coalesce(sound & (length > 0) & (length < float("inf")), F.lit(False))
    text = F.concat_ws(
        ",", F.col("label").cast("string"), F.size("embedding").cast("string"), F.col("embedding").cast("array<string>")
    )
    named = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return named.withColumn("node", F.when(usable, F.md5(text.cast("binary"))))


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))


def _fit(rows: pd.DataFrame, spill: float) -> pd.DataFrame:
    """The splits of one group from its sample, no row if there is none."""
    group, n = rows["group"].iloc[0], int(rows["size"].iloc[0])
    at, tried = fit_splits(_vectors(rows.sort_values("node")), group, n, spill)
    return pd.DataFrame({"group": [group], "at": [at], "tried": [tried]}).iloc[: int(tried[0] >= 0)]


def _route(batches: Iterator[pd.DataFrame], spill: float) -> Iterator[pd.DataFrame]:
    """Rows by the parts of their groups; a part's name is its place before the group's name."""
    for rows in batches:
        vectors, names, found = rows["embedding"].to_numpy(), [], []
        for group, own in rows.groupby("group").indices.items():
            x = unit(np.stack(vectors[own]).astype(np.float64))
            splits = rows["at"].iloc[own[0]], rows["tried"].iloc[own[0]]
            for k, chosen in descend(x, group, *splits, spill):
                names.append(f"{k}.{group}")
                found.append(own[chosen])
        if found:
            out = rows[["node", "embedding"]].iloc[np.concatenate(found)]
            yield out.assign(group=np.repeat(names, [len(at) for at in found]))


def _grouped(nodes: DataFrame, trees: int, spill: float, sample: int) -> DataFrame:
    """``group, node, embedding, parts``: every node in the groups of every tree.

    A group is ``tree:length:label``, with the places of all rounds before it; groups
    of more than two blocks have ``parts`` above 1."""
    kind, grain = nodes.schema["embedding"].dataType.simpleString(), 1_000_000
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    level = nodes.select(tree, "label", "node", "embedding")
    level = level.select(F.concat_ws(":", "tree", F.size("embedding"), "label").alias("group"), "node", "embedding")
    done = None
    while True:
        sizes = cut(level.groupBy("group").agg(F.count("*").alias("n")))
        large = sizes.where(F.col("n") > 2 * BLOCK).withColumn("size", F.col("n"))
        if large.isEmpty():
            rest = level.withColumn("parts", F.lit(1))
            return rest if done is None else done.unionByName(rest)
        total = sizes.agg(F.sum("n")).first()[0]
        chance = F.pmod(F.xxhash64("node", "group"), F.lit(grain))
        chosen = spread_join(level, large, "group", "n", total).where(chance < F.lit(grain * sample) / F.col("size"))
        splits = chosen.groupBy("group").applyInPandas(
            lambda rows: _fit(rows, spill), "group string, at array<double>, tried array<int>"
        )
        facts = cut(sizes.join(splits, "group", "left").select("group", "n", F.struct("n", "at", "tried").alias("f")))
        known = spread_join(level, facts, "group", "n", total)
        parts = F.ceil(F.col("f.n") / (2 * BLOCK)).cast("int").alias("parts")
        ready = known.where(F.col("f.at").isNull()).select("group", "node", "embedding", parts)
        done = ready if done is None else done.unionByName(ready)
        open_rows = known.where(F.col("f.at").isNotNull()).select("group", "node", "embedding", "f.at", "f.tried")
        level = cut(open_rows.mapInPandas(lambda it: _route(it, spill), f"node string, embedding {kind}, group string"))


def _link(batches: Iterator[pd.DataFrame], cosine: float, spill: float) -> Iterator[pd.DataFrame]:
    for g in _by_group(batches, ["group", "i", "j"]):
        if len(g) < 2:
            continue
        g = g.sort_values("node").reset_index(drop=True)
        rng = _seeded(zlib.crc32(g["group"].iloc[0].encode()))  # no two trees search alike
        root = stars(len(g), linked_pairs(_vectors(g), rng, cosine, spill))
        linked = np.flatnonzero(root != np.arange(len(g)))
        name = g["node"].to_numpy()
        yield pd.DataFrame({"a": name[linked], "b": name[root[linked]]})


def _count(batches: Iterator[pd.DataFrame], cosine: float) -> Iterator[pd.DataFrame]:
    """Copies of all other nodes linked to each node, within one pair of blocks."""
    for g in _by_group(batches, ["root", "i", "j"]):
        x, copies = _vectors(g), g["copies"].to_numpy()
        first = (g["part"] == g["i"]).to_numpy()
        one_block = g["i"].iloc[0] == g["j"].iloc[0]
        links = np.zeros(len(g), np.int64)
        sides = [(first, first)] if one_block else [(first, ~first), (~first, first)]
        for asking, asked in sides:
            rows, others = np.flatnonzero(asking), np.flatnonzero(asked)
            for at in range(0, len(rows), BLOCK):
                own = rows[at : at + BLOCK]
                near = x[own] @ x[others].T >= cosine
                if one_block:
                    near[np.arange(len(own)), np.searchsorted(others, own)] = False
                links[own] += near @ copies[others]
        yield pd.DataFrame({"node": g["node"], "links": links})


def embedding_components(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows with a null label or vector, a zero vector, or null or non-finite
    components link with nothing and are their own component; repeated rows
    are copies that link with each other; vectors of different lengths never
    link.  Other columns are ignored, an empty table gives an empty one."""
    named = _named(vectors)
    nodes = cut(
        named.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
            F.min("vec_id").alias("first"),
            F.count("*").alias("copies"),
        )
    )
    keys = ["group", "i", "j"]
    dealt = _blocks(_grouped(nodes, trees, spill, sample), "node", "parts").repartition(*keys).sortWithinPartitions(*keys)
    roots = components(dealt.mapInPandas(lambda it: _link(it, cosine, spill), "a string, b string"), "a", "b")
    linked = cut(nodes.join(roots, "node"))
    # a component of very many nodes, then a vector of very many copies, is spread over all tasks
    size = linked.groupBy("root").agg(
        F.count("*").alias("n"),
        F.struct(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("first").alias("id")).alias("c"),
    )
    size, total = cut(size), linked.count()
    keys = ["root", "i", "j"]
    asked = spread_join(linked.select("node", "root", "embedding", "copies"), size, "root", "n", total)
    asked = _blocks(asked.withColumn("parts", F.col("c.parts")).drop("c"), "node", "parts")
    asked = asked.repartition(*keys).sortWithinPartitions(*keys)
    counts = asked.mapInPandas(lambda it: _count(it, cosine), "node string, links long")
    counts = counts.groupBy("node").agg(F.sum("links").alias("links"))
    found = spread_join(linked.select("node", "root"), size, "root", "n", total)
    found = found.join(counts, "node").select("node", F.col("c.id").alias("component_id"), "links")
    result = F.struct(
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"),
    )
    known = cut(
        nodes.select("node", "first", "copies").join(found, "node", "left").select("node", result.alias("r"), "copies")
    )
    ids = cut(named.select("vec_id", "node"))
    usable = spread_join(ids.where(F.col("node").isNotNull()), known, "node", "copies", ids.count())
    alone = ids.where(F.col("node").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    found = usable.select("vec_id", "r.n_links", "r.component_id").union(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def oracle(table: str = "embeddings", cosine: float = COSINE) -> str:
    """DuckDB SQL for the rows of the query: all pairs, then reachability."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {cosine}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
first AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(f.b, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(f.b, e.vec_id) AS kept
FROM {table} e LEFT JOIN first f ON f.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
