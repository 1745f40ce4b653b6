"""SimHash near-duplicates with BK-trees.

* Every text gets a 64-bit fingerprint of its word shingles.
* Equal fingerprints are one node, however many documents share them.
* Fingerprints are cut into five blocks.  Two that differ in at most four bits
  agree in one block at least, so each block deals the fingerprints into shards
  by the hash of its value, and no link can fall between shards.  There are so
  many shards that one has some ``SHARD_ROWS`` fingerprints; where five blocks
  have too few values for that, six are used, two of which must agree, and so on.
* A shard is a BK-tree: children hang under their parent by integer Hamming
  distance, and a search follows only edges within the radius.  A shard of
  more than twice ``SHARD_ROWS`` fingerprints (a common block value) is cut into
  parts of bounded size; one part is the tree, the other one asks it, for every
  pair of parts.
* A shard reports a star per group it found, never all pairs; components are
  then joined over all shards.

Trees travel with their shard's key instead of being broadcast whole: all
trees together grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import cut, fresh, spread_join, text_udf
from tendril.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
SHARD_ROWS = 2048
#: Values of a shard's key for each shard, at least.
SPARE = 4


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text; 0 without words.

    A-Z are lower-cased, words are runs without ASCII white space, a text of
    fewer words than a shingle is one shingle.  A bit is set if it is set in
    more than half of the shingle hashes, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        hashes = [xxh64_intdigest(joined, HASH_SEED)]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        end = np.cumsum(size)
        start = (end - size)[: 1 - words].tolist()
        stop = (end - 1)[words - 1 :].tolist()
        hashes = [xxh64_intdigest(joined[i:j], HASH_SEED) for i, j in zip(start, stop)]
    ones = np.zeros(64, np.int64)
    all_ = np.array(hashes, np.uint64).astype("<u8")
    for at in range(0, len(all_), 1 << 15):
        part = all_[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(all_), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text column as a long; null texts count as empty."""
    return text_udf("long", lambda: lambda t: fingerprint(t, words))(text)


class BKTree:
    """Distinct fingerprints by integer distance to their parent.

    Node ``i`` has ``pivot[i]`` and in ``children[i]`` a node by distance.  ``asked``
    counts the comparisons of searches so far."""

    def __init__(self, values: np.ndarray):
        self.pivot, self.children, self.asked = [], [], 0
        todo = [(values, None, 0)]
        while todo:
            own, parent, at = todo.pop()
            if not len(own):
                continue
            node = len(self.pivot)
            self.pivot.append(own[0])
            self.children.append({})
            if parent is not None:
                self.children[parent][at] = node
            far = np.bitwise_count(own[1:] ^ own[0])
            todo += [(own[1:][far == d], node, int(d)) for d in np.unique(far)]

    def within(self, asked: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.uint64]]:
        """(fingerprints of ``asked``, fingerprint of the tree) within ``radius`` of each other."""
        found, todo = [], [(0, asked)] if self.pivot and len(asked) else []
        while todo:
            node, q = todo.pop()
            self.asked += len(q)
            far = np.bitwise_count(q ^ self.pivot[node]).astype(np.int16)
            near = q[far <= radius]
            if len(near):
                found.append((near, self.pivot[node]))
            for d, child in self.children[node].items():
                on = q[np.abs(far - d) <= radius]
                if len(on):
                    todo.append((child, on))
        return found


def _stars(tree_side: np.ndarray, asking: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one shard part as (node, smallest node of its group in the shard)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for near, value in BKTree(tree_side).within(asking, radius):
        v = find(int(value.astype(np.int64)))
        for x in near.astype(np.int64).tolist():
            r = find(x)
            if r != v:
                v, r = min(v, r), max(v, r)
                parent[r] = v
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _shards(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard part; a part may span batches."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(rows):
            key = rows[["key", "i", "j"]].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            fp, part = rows["fp"].to_numpy().astype(np.int64).view(np.uint64), rows["part"].to_numpy()
            for s, e in zip([0, *edge], [*edge, len(rows)]):
                if e - s < 2:
                    continue
                f, p, (_, i, j) = fp[s:e], part[s:e], key[s]
                out += _stars(f, f, radius) if i == j else _stars(f[p == i], f[p == j], radius)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = (rows[["key", "i", "j"]] == rows[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        held = rows[last]
        yield links(rows[~last])
    if held is not None:
        yield links(held)


def _blocks(radius: int, shards: int) -> tuple[list[tuple[int, int]], int]:
    """Blocks of the 64 bits as (first bit, width), and how many of them two fingerprints
    within ``radius`` have in common: enough for ``SPARE`` times as many keys as shards."""
    for count in range(radius + 1, 65):
        same = count - radius
        edges = [64 * i // count for i in range(count + 1)]
        widths = [b - a for a, b in zip(edges, edges[1:])]
        if same == 4 or 2 ** sum(sorted(widths)[:same]) >= SPARE * shards:
            break
    return list(zip(edges, widths)), same


def link_edges(prints: DataFrame, radius: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``a, b`` that connect the distinct fingerprints of ``prints(fp)``
    exactly as all links of at most ``radius`` bits do."""
    shards = -(-prints.count() // shard_rows) or 1
    blocks, same = _blocks(radius, shards)

    def block(first: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.lit(n * shards) + F.pmod(F.xxhash64(*[block(*x) for x in chosen]), F.lit(shards))
        for n, chosen in enumerate(combinations(blocks, same))
    ]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    few = F.when(F.col("n") <= 2 * shard_rows, 1).otherwise(F.ceil(F.col("n") / shard_rows)).cast("int")
    parts = dealt.join(sizes, "key").select("key", "fp", few.alias("parts"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = parts.select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp"
    )
    sorted_ = parts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInPandas(lambda it: _shards(it, radius), "a long, b long")


def _marked(docs: DataFrame, words: int, row: Column | None = None) -> DataFrame:
    """doc_id, content hash (``row`` or that of the text) and fingerprint of every row, stored once."""
    content = F.xxhash64("text") if row is None else row
    return cut(
        docs.select(
            F.col("doc_id"), content.alias("content"), fingerprint_column(F.col("text"), words).alias("fp")
        )
    )


def _row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; maps, which have none, are left out."""
    cols = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    """``marked`` with root and component_id, the smallest doc_id of all documents reachable."""
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = components(link_edges(prints.select("fp"), radius), "a", "b")
    prints = cut(
        prints.join(roots, prints["fp"] == roots["node"], "left").select(
            "fp", "first", "n", F.coalesce("root", "fp").alias("root")
        )
    )
    first = F.struct(F.min("first").alias("component_id")).alias("first")  # the id itself may be null
    least = cut(prints.groupBy("root").agg(F.count("*").alias("prints"), first))
    # fingerprints of a large group, then documents of a common fingerprint, are not one task's work
    named = spread_join(prints.select("fp", "n", "root"), least, "root", "prints", prints.count())
    named = cut(named.select("fp", "n", F.struct("root", "first.component_id").alias("group")))
    return spread_join(marked, named.select("fp", "group", "n"), "fp", "n", marked.count()).select(
        *marked.columns, "group.*"
    )


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty and have fingerprint zero; repeated rows each
    give a row; null ids never name a component unless all its ids are null.
    Other columns are ignored, an empty table gives an empty one."""
    return _grouped(_marked(docs, words), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per group: that of the smallest doc_id (null ids
    last, then the smallest hash of the whole row, so that a recomputed task
    keeps the same one); of equal rows one stays.  All columns are returned."""
    row = _row_hash(docs)
    who = F.struct(F.col("doc_id").isNull(), "doc_id", "content")
    best = _grouped(_marked(docs, words, row), radius)
    best = best.groupBy("root").agg(F.min(who).alias("w"), F.count("*").alias("n"))
    d, c, n = fresh(docs, "keep_id", "keep_content", "keep_n")
    best = best.select(F.col("w.doc_id").alias(d), F.col("w.content").alias(c), F.col("n").alias(n))
    hit = docs.join(best, docs["doc_id"].eqNullSafe(best[d]) & (row == best[c]))
    alone = hit.where(F.col(n) == 1)
    # only rows of groups of several can be repeated rows
    one_of = hit.where(F.col(n) > 1).dropDuplicates([d, c])
    return alone.union(one_of).select(*[docs[x] for x in docs.columns])
