"""Deterministic feature-hash embeddings, in Arrow batches."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+")


def _embed_one(text: str | None, dim: int) -> np.ndarray:
    """Signed counts of tokens, and of pairs of neighbours at half weight, at the places that their 64-bit digests give; unit length."""
    out = np.zeros(dim)
    tokens = _TOKEN.findall((text or "").lower())
    for weight, items in ((1.0, tokens), (0.5, [f"{a}␟{b}" for a, b in zip(tokens, tokens[1:], strict=False)])):
        for t in items:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            out[h % dim] += weight if h >> 1 & 1 else -weight
    n = np.linalg.norm(out)
    return out / n if n else out


def _md5_embed_one(text: str | None, dim: int) -> np.ndarray:
    """Words split at blanks, and pairs of neighbours at half weight, by MD5 as one large number: its remainder is the place,
    an odd quotient makes the sign negative; unit length."""
    words = (text or "").lower().split()
    weighted = [(w, 1.0) for w in words] + [(" ".join(p), 0.5) for p in zip(words, words[1:], strict=False)]
    out = np.zeros(dim)
    for feature, weight in weighted:
        quotient, place = divmod(int.from_bytes(hashlib.md5(feature.encode()).digest(), "big"), dim)
        out[place] += -weight if quotient & 1 else weight
    n = np.linalg.norm(out)
    return out / n if n else out


def md5_embedding(dim: int):
    """A column function: the embedding of a text by MD5 of its words, or a zero vector."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_md5_embed_one(t, dim) for t in texts])

    return embed


def hash_embedding(dim: int):
    """A column function: the embedding of a text, or a zero vector."""
    if dim <= 0:
        raise ValueError("dim must be positive")

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([_embed_one(t, dim).astype(np.float32) for t in texts])

    return embed
