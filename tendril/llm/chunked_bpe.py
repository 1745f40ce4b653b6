"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of one chunk is pre-tokenised and encoded where it lies.  A longer one
is cut into chunks that overlap; the chunks are dealt out over the cluster
(copies of a text once), pre-tokenised and encoded independently, and stitched
afterwards.  What the pattern matches from a position on depends only on the
text behind it, so two neighbours agree for good from the first pre-token
boundary that both have in their overlap; the earlier chunk's ids are used up
to there, the later one's from there.  Pre-tokens that touch a chunk's open
end are not trusted.  Where an overlap has no common boundary (one pre-token
longer than the overlap), the text is restored by decoding the chunks and
encoded in one piece, so the result is always that of the whole text.

Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import YIELD

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: Pre-tokens of up to so many bytes are remembered within a task, this many of them.
SHORT, REMEMBERED = 40, 400_000
#: Rows of a merge matrix.
MERGED_AT_ONCE = 4096
#: Chunks that a task encodes and hands back at once: their ids and boundaries take
#: several times the room of their text.
CHUNKS_AT_ONCE = 16
#: The pattern's Unicode classes among the characters below U+0100 (fixed values).
LATIN = {
    r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff",
    r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe",
    r"\s": "\t-\r\x20\x85\xa0",
}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file (base64 token, blank, id per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token of any length: again and again the leftmost pair of
    lowest rank is joined, found with a heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = parts[i] + parts[after[i]]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))

    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or len(parts[i]) + len(parts[j]) != size or ranks[parts[i] + parts[j]] != r:
            continue  # one of the two was joined meanwhile
        parts[i] += parts[j]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        offer(before[i])
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class Merger:
    """The merges of many short pre-tokens at once, a row of a matrix each."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[t[:i]] << 24 | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.joined = np.array([r for _, r in pairs] + [self.NONE], np.int32)
        two = self._rank(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        self.two = two.reshape(256, 256)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the token that two tokens join to, which is its rank; else NONE."""
        key = left << 24 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.joined[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as the bytes of an int32 array."""
        n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max()) + 1  # one column behind the longest
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte[raw].ravel()
        rank = np.full((n, width), self.NONE, np.int32)
        rank[:, :-1] = self.two[raw[:, :-1], raw[:, 1:]]
        rank[np.arange(width) >= size[:, None] - 1] = self.NONE
        after = np.tile(np.arange(1, width + 1), n)  # per row the next part's column
        before = np.tile(np.arange(-1, width - 1), n)
        alive = (np.arange(width) < size[:, None]).ravel()
        flat_rank, rows = rank.ravel(), np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            base = rows * width
            i = base + at
            low = flat_rank[i]
            go = low < self.NONE
            rows, base, i, low = rows[go], base[go], i[go], low[go]
            j = base + after[i]  # joined into i
            ids[i] = low
            alive[j], flat_rank[j] = False, self.NONE
            nxt = after[j]
            after[i] = nxt
            inside = nxt < size[rows]
            k = base + np.minimum(nxt, width - 1)
            before[k[inside]] = (i - base)[inside]
            flat_rank[i] = np.where(inside, self._rank(ids[i], ids[k]), self.NONE)
            has = before[i] >= 0
            p, i = (base + before[i])[has], i[has]
            flat_rank[p] = self._rank(ids[p], ids[i])
        count = alive.reshape(n, width).sum(1)
        packed = ids[alive].astype(np.int32).tobytes()
        end = np.cumsum(count * 4).tolist()
        return [packed[s:e] for s, e in zip([0, *end], end)]


def encoder(path: str) -> Callable[[list[list[str]]], list[list[bytes]]]:
    """A function from the pre-tokens of several texts to each one's ids as bytes of
    int32; what is new in the batch is merged together and remembered by the task."""
    ranks = load_ranks(path)
    merger, known = Merger(ranks), {}

    def learn(pieces: set[str]) -> list[str]:
        """Puts pieces into ``known``; gives back those too long to be kept."""
        whole, short, long_ = [], [], []
        for p in pieces:
            b = p.encode("utf-8", "replace")
            (whole if b in ranks else short if len(b) <= SHORT else long_).append((b, p))
        known.update((p, ranks[b].to_bytes(4, "little")) for b, p in whole)
        short.sort(key=lambda x: len(x[0]))  # rows of one matrix have about the same length
        for at in range(0, len(short), MERGED_AT_ONCE):
            some = short[at : at + MERGED_AT_ONCE]
            known.update(zip((p for _, p in some), merger.merge([b for b, _ in some])))
        known.update((p, np.array(merge(b, ranks), np.int32).tobytes()) for b, p in long_)
        return [p for _, p in long_]

    def encode(texts: list[list[str]]) -> list[list[bytes]]:
        if len(known) > REMEMBERED:
            known.clear()
        out = [list(map(known.get, t)) for t in texts]
        holes = [[i for i, ids in enumerate(found) if ids is None] for found in out]
        long_ = learn({t[i] for t, at in zip(texts, holes) for i in at})
        for t, found, at in zip(texts, out, holes):
            for i in at:
                found[i] = known[t[i]]
        for p in long_:
            del known[p]
        return out

    return encode


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens.

    Texts whose characters are all below U+0100 take the pattern with the
    Unicode classes written out for those characters, which the standard
    library matches faster; all others take it as it is."""
    import regex

    full = regex.compile(pattern).findall
    small = pattern
    for name, inside in LATIN.items():
        # a class within brackets needs no brackets of its own
        small = re.sub(rf"(\[\^?[^\]]*?){re.escape(name)}", lambda m: m[1] + inside, small)
        small = small.replace(name, f"[{inside}]")
    small = small.replace(r"\S", f"[^{LATIN[chr(92) + 's']}]")
    if re.search(r"\\[pPsSwWdD]", small.replace(LATIN[r"\s"], "")):
        return full
    fast = re.compile(small).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return fast(text)

    return split


def flat(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ids), np.int32)


def _whole(path: str, pattern: str, decoded: bool):
    """pandas UDF: a text to its ids, in one piece, and if asked for to the bytes of
    the ids again; ``YIELD`` rows at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, split = encoder(path), splitter(pattern)
        decode = decoder(path) if decoded else None
        for texts in batches:
            for at in range(0, len(texts), YIELD):
                ids = [flat(x) for x in encode([split(t or "") for t in texts.iloc[at : at + YIELD]])]
                out = pd.DataFrame({"ids": pd.Series(ids, dtype=object)})
                if decode:
                    out["decoded"] = pd.Series([decode(x) for x in ids], dtype=object)
                yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "struct<ids:array<int>,decoded:binary>" if decoded else "struct<ids:array<int>>")


def _cut(batches: Iterator[pd.DataFrame], chunk: int, overlap: int) -> Iterator[pd.DataFrame]:
    """Texts to chunks; each goes ``overlap`` characters into its successor."""
    for rows in batches:
        for digest, text in zip(rows["digest"], rows["text"]):
            last = (len(text) - 1) // chunk
            for k in range(last + 1):
                piece = text[k * chunk : (k + 1) * chunk + overlap]
                yield pd.DataFrame({"digest": [digest], "k": [k], "last": [k == last], "piece": [piece]})


def _encode_chunks(batches: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    """Per chunk: starts of its pre-tokens, how many ids precede each, and the ids;
    ``CHUNKS_AT_ONCE`` rows at a time."""
    encode, split = encoder(path), splitter(pattern)
    for rows in (b.iloc[at : at + CHUNKS_AT_ONCE] for b in batches for at in range(0, len(b), CHUNKS_AT_ONCE)):
        out = []
        for digest, k, last, piece in rows.itertuples(index=False):
            tokens = split(piece)
            if not last:
                # the open end: a pre-token that ends there, and white space before it,
                # could go on or be split otherwise; their starts are no boundaries
                trusted = len(tokens) - 2
            else:
                trusted = len(tokens)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            (lists,) = encode([tokens])
            before = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
            out.append(
                (digest, k, max(0, trusted), starts.tobytes(), before.tobytes(), flat(lists).tobytes())
            )
        yield pd.DataFrame(out, columns=["digest", "k", "trusted", "starts", "before", "ids"])


def stitch(chunks: list[tuple], chunk: int) -> np.ndarray | None:
    """Ids of the whole text from its encoded chunks in order, each
    ``(trusted, starts, before, ids)``; None where two do not resynchronise."""
    out, begin = [], 0  # begin: index of the first pre-token to use in the current chunk
    for (trusted, starts, before, ids), (next_trusted, next_starts, *_) in zip(chunks, chunks[1:]):
        # boundaries of both in the overlap, from the next chunk's view
        mine = starts[begin : trusted + 1] - chunk
        common = np.intersect1d(mine[mine >= 0], next_starts[: next_trusted + 1])
        if not len(common):
            return None
        out.append(ids[before[begin] : before[np.searchsorted(starts, common[0] + chunk)]])
        begin = int(np.searchsorted(next_starts, common[0]))
    _, starts, before, ids = chunks[-1]
    out.append(ids[before[begin] :])
    return np.concatenate(out)


def _stitch_text(rows: pd.DataFrame, path: str, pattern: str, chunk: int, decoded: bool) -> pd.DataFrame:
    rows = rows.sort_values("k")
    parts = [
        (t, *(np.frombuffer(x, np.int32) for x in (s, b, i)))
        for t, s, b, i in zip(rows["trusted"], rows["starts"], rows["before"], rows["ids"])
    ]
    decode, ids = decoder(path), stitch(parts, chunk)
    if ids is None:
        text = "".join(decode(p[3]).decode("utf-8")[:chunk] for p in parts)
        (lists,) = encoder(path)([splitter(pattern)(text)])
        ids = flat(lists)
    out = pd.DataFrame({"of": [rows["digest"].iloc[0]], "ids": [ids]})
    return out.assign(decoded=[decode(ids)]) if decoded else out


def _coded(
    docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, keep: tuple[str, ...], decoded: bool
) -> DataFrame:
    outputs = ["ids", "decoded"] if decoded else ["ids"]
    kept = [c for c in keep if c not in ("doc_id", *outputs)]
    rows = docs.select("doc_id", *[F.col(c).alias(f"kept_{c}") for c in kept], F.coalesce("text", F.lit("")).alias("text"))
    out = ["doc_id", *[F.col(f"kept_{c}").alias(c) for c in kept]]
    is_long = F.length("text") > chunk
    short = rows.where(~is_long).withColumn("coded", _whole(path, pattern, decoded)(F.col("text")))
    short = short.select(*out, *[F.col(f"coded.{c}") for c in outputs])
    long_ = rows.where(is_long).withColumn("digest", F.sha2("text", 256))
    cuts = long_.select("digest", "text").mapInPandas(
        lambda it: _cut(it, chunk, overlap), "digest string, k int, last boolean, piece string"
    )
    # copies of a text are encoded once; chunks are dealt out by text and place
    encoded = cuts.dropDuplicates(["digest", "k"]).mapInPandas(
        lambda it: _encode_chunks(it, path, pattern),
        "digest string, k int, trusted int, starts binary, before binary, ids binary",
    )
    # a group is one text's ids, never more than its row holds
    texts = encoded.groupBy("digest").applyInPandas(
        lambda g: _stitch_text(g, path, pattern, chunk, decoded),
        "of string, ids array<int>" + (", decoded binary" if decoded else ""),
    )
    if "text" not in kept:
        long_ = long_.drop("text")
    long_ = long_.join(texts, F.col("digest") == F.col("of"))
    return short.union(long_.select(*out, *outputs))


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``ids`` (array of int) for every row of
    ``docs(doc_id, text)``.

    Null and empty texts have no ids (an empty array); repeated rows each give
    a row; other columns are ignored.  ``text`` must be valid UTF-8, as Arrow
    takes no other."""
    return _coded(docs, path, pattern, chunk, overlap, keep, False)


def encode_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Like ``encode``, and ``decoded`` (binary): the ids' bytes, decoded where they were made."""
    return _coded(docs, path, pattern, chunk, overlap, keep, True)


def decoder(path: str) -> Callable[[np.ndarray], bytes]:
    """A function from ids to their bytes; an id outside the vocabulary fails."""
    ranks = load_ranks(path)
    token = [None] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        token[i] = t
    return lambda ids: b"".join(map(token.__getitem__, ids.tolist()))


def decode_column(ids: Column, path: str) -> Column:
    """Bytes of a column of id arrays; a null array has none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = decoder(path)
        for rows in batches:
            yield pd.Series([decode(r) if r is not None else b"" for r in rows], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(ids)


def digests(docs: DataFrame, path: str, pattern: str, **sizes) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    return encode_decode(docs, path, pattern, **sizes).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
