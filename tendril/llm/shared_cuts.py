"""Alignment of the tokens of two tokenizers, by divide and conquer at shared cuts.

* A text is encoded by both: space and text by the byte-level one (A), the text by
  the sentence-piece one (B), which adds the space itself.  Neither joins anything
  across a single space between two other characters, so the text is encoded in
  such units; a worker remembers the units it has met.
* An interval of tokens with common ends is split at a common end near its middle:
  the middle A token's end is looked up among B's ends by bisection, then the ones
  beside it, ever farther out; both halves follow.  An interval without a common
  end inside is a group.  All intervals of a level go through together.
* Tokens of A and B are linked where their bytes overlap.  A link's count is the
  number of documents that hold its id pair.  Counts by task are summed per pair;
  the most common pairs (``HOT_PAIRS`` at most) go to every task, the links of the
  others meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.byte_level import PRE_TOKENS, kept, least_of_most, spread, stored, vocabulary

#: Most id pairs whose counts are broadcast (12 bytes each).
HOT_PAIRS = 1_000_000
#: A worker forgets its units beyond so many of them or so many characters.
UNITS, UNIT_CHARS = 300_000, 24_000_000
#: Characters of the texts that are aligned together (one text at least).
CHUNK_CHARS = 400_000
#: Characters up to here are split alike by both implementations of the byte-level pattern.
PLAIN = re.compile("[^\x00-ɏ]")
UNIT_EDGE = re.compile(r"(?<=\S) (?=\S)")


class Units:
    """Token ids of units by both tokenizers, kept in flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        ranks = vocabulary(path_a)
        self.plain = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path_a)
        self.full.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: b for b, i in ranks.items()}
        self.bytes_b = piece_bytes(self.pieces)
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.size_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.flat = [np.zeros(1 << 16, np.int32) for _ in "ab"]
        self.at = np.zeros((2, 1 << 12), np.int64)  # where a unit's ids begin
        self.size = np.zeros((2, 1 << 12), np.int64)
        self.good = np.zeros(1 << 12, bool)
        self.end = [0, 0]

    def _encoded(self, new: list[str]) -> tuple[list[list[int]], list[list[int]], list[int]]:
        """Ids of either side, and which units need the full tokenizer for A."""
        a: list = [None if PLAIN.search(u) else self.plain.encode_ordinary(" " + u) for u in new]
        odd = [i for i, ids in enumerate(a) if ids is None]
        for i, e in zip(odd, self.full.encode_batch([" " + new[i] for i in odd], add_special_tokens=False)):
            a[i] = e.ids
        return a, self.pieces.encode(new, num_threads=1), odd

    def _learn(self, new: list[str]) -> None:
        a, b, odd = self._encoded(new)
        first, n = len(self.place), len(new)
        self.place.update(zip(new, range(first, first + n)))
        self.chars += sum(map(len, new))
        while first + n > self.good.size:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)], 1)
            self.size = np.concatenate([self.size, np.zeros_like(self.size)], 1)
            self.good = np.concatenate([self.good, np.zeros_like(self.good)])
        for side, ids in enumerate((a, b)):
            sizes = np.fromiter(map(len, ids), np.int64, n)
            total = int(sizes.sum())
            while self.end[side] + total > len(self.flat[side]):
                self.flat[side] = np.concatenate([self.flat[side], np.zeros_like(self.flat[side])])
            self.flat[side][self.end[side] : self.end[side] + total] = [i for x in ids for i in x]
            self.at[side, first : first + n] = self.end[side] + np.cumsum(sizes) - sizes
            self.size[side, first : first + n] = sizes
            self.end[side] += total
        raw = [b" " + u.encode("utf-8", "surrogatepass") for u in new]
        of_b = self.bytes_b
        self.good[first : first + n] = [r == b"".join([of_b[i] for i in y]) for r, y in zip(raw, b)]
        for k in odd:  # the others are encoded from their bytes, without loss
            self.good[first + k] &= raw[k] == b"".join([self.bytes_a.get(i, b"") for i in a[k]])

    def places(self, units: list[str]) -> np.ndarray:
        if len(self.place) > UNITS or self.chars > UNIT_CHARS:
            self.forget()
        got = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        miss = np.flatnonzero(got < 0)
        if len(miss):
            self._learn(list(dict.fromkeys(units[i] for i in miss.tolist())))
            got[miss] = [self.place[units[i]] for i in miss.tolist()]
        return got

    def ids(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has."""
        sizes = self.size[side][places]
        return self.flat[side][spread(self.at[side][places], sizes)], sizes


def piece_bytes(pieces) -> list[bytes]:
    """Bytes that each piece stands for: U+2581 is a space, <0xHH> one byte."""
    out = []
    for i in range(pieces.get_piece_size()):
        p = pieces.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
    return out


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A-side ends of the groups (as token counts), sorted, from the ends of all tokens.

    ``lo, hi``: token ranges of A, a text each, whose last ends are common ends.
    Each level splits every interval at the common end nearest to its middle."""
    found = [hi]
    while len(lo):
        live = hi - lo > 1  # a single token has no end inside
        lo, hi = lo[live], hi[live]
        last = hi - 2  # the last end inside an interval
        middle, cut = (lo + last) // 2, np.full(len(lo), -1)
        todo, near, width = np.arange(len(lo)), 0, 1
        while len(todo):
            # the ends at distances near .. near + width - 1 on either side, nearest first
            d = np.arange(near, near + width)
            off = np.stack([d, -d], 1).ravel()
            at = middle[todo, None] + off
            inside = (at >= lo[todo, None]) & (at <= last[todo, None])
            end = ends_a[np.where(inside, at, 0)]
            hit = inside & (ends_b[np.searchsorted(ends_b, end)] == end)
            some = hit.any(1)
            cut[todo[some]] = at[some, hit[some].argmax(1)]
            near, width = near + width, 2 * width
            todo = todo[~some & (near <= np.maximum(middle[todo] - lo[todo], last[todo] - middle[todo]))]
        split = cut >= 0
        mid = cut[split] + 1
        found.append(mid)
        # in order, so that bisection goes through B's ends from left to right
        lo, hi = np.stack([lo[split], mid], 1).ravel(), np.stack([mid, hi[split]], 1).ravel()
    return np.sort(np.concatenate(found))


def aligned(units: Units, texts: list[str | None]) -> dict:
    """Tokens, groups and links of some texts, as flat arrays with sizes per text."""
    split = [UNIT_EDGE.split(t) if t else [] for t in texts]
    n_units = np.fromiter(map(len, split), np.int64, len(split))
    places = units.places([u for x in split for u in x])
    of_text = np.repeat(np.arange(len(texts)), n_units)
    bad = np.bincount(of_text, ~units.good[places], len(texts)) > 0
    stays = ~bad[of_text]
    places, of_text = places[stays], of_text[stays]
    side = []
    for s, size in ((0, units.size_a), (1, units.size_b)):
        ids, per_unit = units.ids(s, places)
        per_text = np.bincount(of_text, per_unit, len(texts)).astype(np.int64)
        side.append((ids, per_text, np.cumsum(per_text), np.cumsum(size[ids])))
    (a, n_a, stop_a, ends_a), (b, n_b, stop_b, ends_b) = side
    lo, hi = (stop_a - n_a)[n_a > 0], stop_a[n_a > 0]
    cut_a = shared_cuts(ends_a, ends_b, lo, hi)
    cut_b = np.searchsorted(ends_b, ends_a[cut_a - 1]) + 1
    n_groups = np.diff(np.searchsorted(cut_a, stop_a, "right"), prepend=0)
    # a link for every stretch of bytes between two neighbouring ends of either side
    marks = np.zeros((2, int(ends_a[-1]) + 1 if len(a) else 1), bool)
    marks[0, ends_a] = marks[1, ends_b] = True
    stretch = np.flatnonzero(marks[0] | marks[1])
    token = [(np.cumsum(m, dtype=np.int64) - m)[stretch] for m in marks]
    return {
        "a": a, "b": b, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
        "cut_a": cut_a, "cut_b": cut_b, "link_a": a[token[0]], "link_b": b[token[1]],
    }


def group_texts(x: dict) -> list[bytes]:
    """Per text the groups as ``a1,a2|b1;a3|b2,b3``."""
    most = int(max(x["a"].max(initial=0), x["b"].max(initial=0))) + 1
    width = len(str(most)) + 1
    digits = np.array([str(i) for i in range(most)], f"S{width}")
    order = np.empty(len(x["a"]) + len(x["b"]), f"S{width}")
    for mine, other, ids, stop in (("cut_a", "cut_b", x["a"], b"|"), ("cut_b", "cut_a", x["b"], b";")):
        sizes = np.diff(x[mine], prepend=0)
        # tokens of the other side that stand before: of earlier groups, for B of this one, too
        before = x[other] - np.diff(x[other], prepend=0) if mine == "cut_a" else x[other]
        place = np.arange(len(ids)) + np.repeat(before, sizes)
        sign = np.full(len(ids), b",")
        sign[x[mine] - 1] = stop
        order[place] = np.char.add(digits[ids], sign)
    raw, out, at = order.tobytes(), [], 0
    for n in ((x["n_a"] + x["n_b"]) * width).tolist():
        out.append(raw[at : at + n].translate(None, b"\0")[:-1])
        at += n
    return out


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(np.fromiter((len(t or "") for t in batch[column].to_pylist()), np.int64, len(batch)))
        at = 0
        while at < len(batch):
            base = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, base + CHUNK_CHARS)))
            yield batch.slice(at, stop - at)
            at = stop


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _units(path_a: str, path_b: str) -> Units:
    return kept("units", f"{path_a} {path_b}", lambda: Units(path_a, path_b))


def _pair_base(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _digests(docs: DataFrame, path_a: str, path_b: str, base: int) -> DataFrame:
    """A row per document: its figures, and its distinct id pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path_a, path_b)
        for batch in _chunks(batches, "text"):
            x = aligned(units, batch["text"].to_pylist())
            key = np.repeat(np.arange(len(batch), dtype=np.int64) << 40, x["n_links"])
            key = np.sort(key + x["link_a"].astype(np.int64) * base + x["link_b"])
            first = np.flatnonzero(np.diff(key, prepend=-1))
            per_text = np.bincount(key[first] >> 40, minlength=len(batch))
            sha = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(group_texts(x), x["n_groups"])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"], batch["doc_id"],
                    *(pa.array(x[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array(sha, pa.string()),
                    _lists(key[first] & (1 << 40) - 1, per_text, pa.int64()),
                    _lists(np.diff(first, append=len(key)), per_text, pa.int32()),
                ],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(
        run,
        f"row long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, links array<int>",
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair in a task, whose distinct pairs are merged again and again."""

    def merged(pairs: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        p, c = np.concatenate(pairs), np.concatenate(n)
        order = np.argsort(p, kind="stable")
        p, c = p[order], c[order]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        return p[first], np.add.reduceat(c, first) if len(first) else c[:0]

    pairs, n, size = [], [], 0
    for batch in batches:
        p = np.sort(batch["pairs"].flatten().to_numpy())
        first = np.flatnonzero(np.diff(p, prepend=-1))
        pairs.append(p[first])
        n.append(np.diff(first, append=len(p)))
        size += len(first)
        if size > 2_000_000:
            p, c = merged(pairs, n)
            pairs, n, size = [p], [c], 0
            if len(p) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], ["pair", "n"])
                pairs, n = [], []
    if pairs:
        p, c = merged(pairs, n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], ["pair", "n"])


def pair_counts(digests: DataFrame, base: int) -> DataFrame:
    """``pair, n, best``: documents that hold the pair, and whether no pair of its A id has more."""
    n = stored(digests.select("pairs").mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.floor(F.col("pair") / base).alias("a")
    most = n.groupBy(a).agg(F.max("n").alias("most"))  # a row per A id, as many as its vocabulary at most
    return n.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every
    row of ``docs(doc_id, text)``.

    Null and empty texts, and those whose joined token bytes differ from space and
    text, have zeros and an empty digest.  Repeated rows count each as a document;
    other columns are ignored; an empty table gives an empty one."""
    base = _pair_base(path_b)
    rows = stored(_digests(docs, path_a, path_b, base))
    counts = stored(pair_counts(rows, base))
    least = least_of_most(counts, "n", hot_pairs)
    hot = counts.where(F.col("n") >= least).sort("pair").toPandas()
    known = docs.sparkSession.sparkContext.broadcast(
        (hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["best"].to_numpy(bool))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            p = batch["pairs"].flatten().to_numpy()
            links = batch["links"].flatten().to_numpy().astype(np.int64)
            per_row = np.diff(batch["pairs"].offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), per_row)
            if len(pairs):
                at = np.searchsorted(pairs, p)
                at[at == len(pairs)] = 0
                hit = pairs[at] == p
            else:
                at, hit = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
            total, top = np.zeros((2, len(batch)), np.int64)
            np.add.at(total, row[hit], links[hit] * n[at[hit]])
            np.add.at(top, row[hit], links[hit] * best[at[hit]])
            cold = np.bincount(row[~hit], minlength=len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(top), pa.array(total), _lists(p[~hit], cold, pa.int64()), _lists(links[~hit], cold, pa.int64())],
                ["row", "hot_best", "hot_sum", "pairs", "links"],
            )

    looked = rows.select("row", "pairs", "links").mapInArrow(
        look_up, "row long, hot_best long, hot_sum long, pairs array<long>, links array<long>"
    )
    looked = stored(looked)
    rare = looked.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links")
    )
    rare = rare.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.col("links") * F.col("n")).alias("sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best")
    )
    whole = rows.drop("pairs", "links").join(looked.select("row", "hot_best", "hot_sum"), "row").join(rare, "row", "left")
    return whole.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("hot_best") + F.coalesce("best", F.lit(0))).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, groups``: the groups of every document as arrays of A and B ids; none
    for documents without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(path_a, path_b)
        for batch in _chunks(batches, "text"):
            x = aligned(units, batch["text"].to_pylist())
            sides = [_lists(x[s], np.diff(x[f"cut_{s}"], prepend=0), pa.int32()) for s in "ab"]
            groups = pa.StructArray.from_arrays(sides, ["a", "b"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(x["n_groups"])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, groups)], ["doc_id", "groups"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, groups array<struct<a:array<int>,b:array<int>>>")
