"""Helpers of the operators on public tokenizers: a byte-level vocabulary, objects kept
per worker process, large frames stored once, and cuts that bound a broadcast."""

from __future__ import annotations

import json
import sys
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.session import checkpoint_path

#: Fixed value: how the byte-level vocabulary splits a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary(path: str) -> dict[bytes, int]:
    """Bytes and id of every entry of a byte-level BPE file, special tokens left out.

    Ids must be the order of the merges, so that they can serve as ranks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_of_char()
    ranks = {bytes(map(of.__getitem__, entry)): i for entry, i in model["vocab"].items()}
    for k, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        if model["vocab"][left + right] != 256 + k:
            raise ValueError(f"{path}: ids do not follow the order of the merges")
    return ranks


def kept(name: str, of: str, make: Callable[[], object]) -> object:
    """``make()`` once per process, for as long as the worker lives and the last object
    kept under this name was also made for ``of``."""
    home = sys.modules.setdefault("_tendril_kept", types.ModuleType("_tendril_kept"))
    if (getattr(home, name, None) or (None,))[0] != of:
        setattr(home, name, None)  # frees the old one first
        setattr(home, name, (of, make()))
    return getattr(home, name)[1]


def stored(df: DataFrame) -> DataFrame:
    """The frame written once as Parquet to the shared checkpoint folder and read again."""
    at = checkpoint_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def least_of_most(df: DataFrame, n: str, most: int) -> int:
    """The smallest power of two such that at most ``most`` rows have ``n`` >= it.

    What is broadcast from such a cut is bounded at any size of the table."""
    bits = df.groupBy(F.length(F.bin(F.col(n))).alias("b")).agg(F.count("*").alias("rows")).collect()
    above, least = 0, 63
    for b, rows in sorted(((r["b"], r["rows"]) for r in bits), reverse=True):
        if above + rows > most:
            break
        above, least = above + rows, b
    return 1 << least - 1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions ``start, start + 1, ...`` of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
