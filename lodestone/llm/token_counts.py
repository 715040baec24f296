"""Exact byte-level BPE token counts of every prefix, by dynamic programming over prefixes.

The pre-tokenizer's pattern cuts a text into pieces that are encoded on their own. Within a piece, the encoding of each
prefix is known by its last token: token t may end the prefix of length i if it and the last token of the prefix of length
i - len(t) are what BPE makes of the bytes of the two together. Exactly one token fits, so
count[i] = count[i - len(t)] + 1. The counts of all prefixes of a piece are kept; the count of a text is a sum over its
pieces, and any prefix, truncation or budget question is answered from the stored counts, without encoding again.

Defined cases: null text is empty and has 0 tokens. The strings of added special tokens found in a text count as one
token each, as the tokenizer's default has it. Texts are taken whole, of any length. Repeated rows and null ids give a
row each.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LIMIT = 512
#: The pre-tokenizer's pattern of byte-level BPE, as its library has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker keeps; beyond, it starts anew. Bounds memory, not results.
KEPT_PIECES = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes are themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixCounter:
    """The stored prefix counts of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.tokens = {raw(s) for s in spec["model"]["vocab"] if all(c in letters for c in s)}
        self.longest = max(map(len, self.tokens))
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.ends: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """BPE of data by its merges, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def adjoin(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 4 * KEPT_PIECES:
                self.fits.clear()
            ok = self.fits[key] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def piece(self, data: bytes) -> list[int]:
        """count[i] for i = 0..len(data): the tokens of data[:i]."""
        last, count = [b""], [0]
        for i in range(1, len(data) + 1):
            for n in range(min(i, self.longest), 0, -1):
                t = data[i - n : i]
                if t in self.tokens and self.adjoin(last[i - n], t):
                    last.append(t)
                    count.append(count[i - n] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {data[:i]!r}")
        return count

    def counts(self, piece: str) -> tuple[int, ...]:
        """The stored counts of every byte prefix of a piece."""
        got = self.ends.get(piece)
        if got is None:
            got = tuple(self.piece(piece.encode("utf-8", "surrogatepass")))
            if len(piece) > 200:  # a rare, long piece isn't worth keeping
                return got
            if len(self.ends) >= KEPT_PIECES:
                self.ends.clear()
            self.ends[piece] = got
        return got

    def pieces(self, text: str) -> Iterator[str | None]:
        """The pieces in order; None stands for a special token."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self.find(text[at : m.start()])
            yield None
            at = m.end()
        yield from self.find(text[at:] if at else text)

    def count(self, text: str) -> int:
        ends, total = self.ends, 0
        for p in self.pieces(text):
            if p is None:
                total += 1
            else:
                got = ends.get(p)
                total += (got if got is not None else self.counts(p))[-1]
        return total

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The counts of a text's prefixes: cumulative at the pieces, stored within them."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.starts, self.before, self.parts = [], [], []
        at = tokens = 0
        for p in counter.pieces(text):
            if p is None:
                n, k = counter.special.match(text, at).end() - at, 1
            else:
                n, k = len(p), counter.counts(p)[-1]
            self.starts.append(at)
            self.before.append(tokens)
            self.parts.append(p)
            at, tokens = at + n, tokens + k
        self.total = tokens

    def tokens(self, chars: int) -> int:
        """Tokens of text[:chars]. The cut may change only how the last two pieces split, and those are looked up again."""
        if chars <= 0 or not self.starts:
            return 0
        j = max(0, bisect_right(self.starts, chars - 1) - 2)
        if chars >= len(self.text):
            return self.total
        while j and (self.parts[j] is None or self.parts[j].isspace()):
            j -= 1
        return self.before[j] + sum(1 if p is None else self.counter.counts(p)[-1] for p in self.counter.pieces(self.text[self.starts[j] : chars]))

    def cut(self, budget: int) -> int:
        """The most whole pieces that hold no more than budget tokens, as a number of characters."""
        j = bisect_right(self.before, budget) - 1
        if self.total <= budget:
            return len(self.text)
        return self.starts[j] if j >= 0 else 0


_KEPT: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker and file."""
    if path not in _KEPT:
        _KEPT[path] = PrefixCounter(path)
    return _KEPT[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text). path: the tokenizer's file, on every machine."""
    path = path or default_path()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.count(t) if t else 0 for t in texts], dtype="int64")

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
