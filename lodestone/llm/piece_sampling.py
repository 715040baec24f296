"""SentencePiece segmentations by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has a node for each byte and an edge for each piece of the vocabulary that stands there; characters that
are no piece have an edge for each of their bytes. A segmentation's probability is the product of its pieces' weights,
1 / (rank + RANK_OFFSET) ** ALPHA, over the sum for all segmentations. The k segmentations of the largest
Gumbel-perturbed log-probabilities are a sample without replacement. They are found as A* finds best paths: the queue holds
sets of segmentations that share a start; a set's perturbed maximum has the sum of its members as location, which is an
exact bound. The best set is opened by walking to its maximum, as every piece is drawn in proportion to what follows it;
each node passed leaves the set of what was not chosen there, its maximum a Gumbel truncated at the one just found.

The sample comes with inclusion scores 1 - exp(-exp(log p - threshold)), the threshold being the largest perturbed value
left out. Random numbers hash the row's key, the round and the byte offset: a row's sample depends on nothing else.

Pieces never hold a blank mark but in front, so a text's lattice is a chain of its words' lattices, and a batch builds that
of each distinct word once. Batches are bounded in bytes; a longer text is gone through in parts, with the same samples.

Defined cases: null text has no sample, empty text the empty segmentation alone. Texts with fewer than k segmentations give
all, with inclusion 1. Repeated rows have the same sample, null ids share one key. A blank mark in a text decodes as a blank.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, text_slices

SAMPLES = 3
ALPHA = 1.0
RANK_OFFSET = 10
BATCH_BYTES = 1_600_000
WALK_BYTES = 800_000
#: Bytes before the end of a word within which probabilities are multiplied as they are.
PLAIN = 48
#: Words whose lattices are built at a time.
CHUNK_WORDS = 12_000
BLANK = "▁"
SCHEMA = "doc_id long, samples array<struct<ids: array<int>, log_p: double, inclusion: double>>"

_BASE = np.uint64(0x100000001B3)


def _bits(key: np.ndarray, round_: int, stream: int, offset: np.ndarray) -> np.ndarray:
    """64 random bits from a counter: the same for the same row, round, stream and byte offset."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((round_ * 8 + stream + 1) * 0x9E3779B97F4A7C15 % 2**64) + offset.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(key: np.ndarray, round_: int, stream: int, offset: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1) of those bits."""
    return ((_bits(key, round_, stream, offset) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The base's powers 0 to n at least, and those of its inverse; kept, as every batch needs them."""
    if len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))):
                _POWERS[k] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n + n // 4, base)), dtype=np.uint64)
    return _POWERS


class Pieces:
    """The vocabulary of one SentencePiece file: bytes, weights and lookups of its pieces."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p, n = self.processor, self.processor.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int32)
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        weight = np.full(n, -alpha * np.log(n + RANK_OFFSET))
        for i in range(n):
            if p.is_byte(i):
                b = int(p.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_id[b] = bytes([b]), i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                piece = p.id_to_piece(i)
                self.bytes[i] = piece.encode()
                if BLANK not in piece[1:]:
                    weight[i] = -alpha * np.log(-p.get_score(i) + RANK_OFFSET)
                    by_length.setdefault(len(self.bytes[i]), []).append((self.bytes[i], i))
        self.weight = weight
        self.lengths = sorted(by_length)
        codes, ids = [], []
        for length, own in by_length.items():
            h = self.hashes(b"".join(b for b, _ in own))
            codes.append(self.of(h, np.arange(len(own)) * length, length))
            ids.append(np.array([i for _, i in own], dtype=np.int32))
        order = np.argsort(np.concatenate(codes))
        self.codes, self.ids = np.concatenate(codes)[order], np.concatenate(ids)[order]
        # Codes are in order; a table by their first bits leads to the few that share them.
        self.bucket = np.searchsorted(self.codes >> np.uint64(46), np.arange(2**18, dtype=np.uint64)).astype(np.int32)
        self.probes = int(np.bincount((self.codes >> np.uint64(46)).astype(np.int64)).max())
        self.codes, self.ids = np.append(self.codes, np.zeros(self.probes + 1, np.uint64)), np.append(self.ids, np.zeros(self.probes + 1, np.int32))
        self.single = {b for length in by_length for b, _ in by_length[length] if len(b.decode()) == 1}
        # Where a text agrees with no longer piece so far, none has to be looked for: a table by the first bits of the codes of openings.
        self.goes_on = np.zeros(2**20, dtype=bool)
        for length in self.lengths:
            opens = {b[:length] for longer, own in by_length.items() if longer > length for b, _ in own}
            if opens:
                h = self.hashes(b"".join(opens))
                self.goes_on[(self.of(h, np.arange(len(opens)) * length, length) >> np.uint64(44)).astype(np.int64)] = True

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are those of pieces, and their ids."""
        k = self.bucket[(code >> np.uint64(46)).astype(np.int64)]
        have = self.codes[k]
        hit = have == code
        below = np.flatnonzero(have < code)  # few: most buckets are empty
        for _ in range(self.probes - 1):
            if not len(below):
                break
            k[below] += 1
            have = self.codes[k[below]]
            hit[below] = have == code[below]
            below = below[have < code[below]]
        found = np.flatnonzero(hit)
        return found, self.ids[k[found]]

    @staticmethod
    def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of bytes times powers of an odd base, wrapping, and the inverse powers: substring hashes by difference."""
        n = len(data)
        power, back = _powers(n)
        with np.errstate(over="ignore"):
            values = (np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((values ^ (values >> np.uint64(29))) * power[:n], dtype=np.uint64)])
        return sums, back

    @staticmethod
    def of(h: tuple[np.ndarray, np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h[0][start + length] - h[0][start]) * h[1][start] + np.uint64(length)) * np.uint64(0xD6E8FEB86659FD93)

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        get = self.bytes
        text = b"".join([get[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


class Lattice:
    """The lattices of distinct words, each with a blank mark in front: a node for each byte, edges in the order of their nodes."""

    def __init__(self, pieces: Pieces, words: Iterable[str]):
        data = "".join([BLANK + w for w in words]).encode("utf-8", "replace")
        n = len(data)
        raw = np.frombuffer(data, np.uint8)
        b0, b1, b2 = BLANK.encode()
        self.starts = np.flatnonzero((raw[:-2] == b0) & (raw[1:-1] == b1) & (raw[2:] == b2)).astype(np.int32)  # words hold no blank mark
        self.sizes = np.diff(np.append(self.starts, np.int32(n)))
        ends = np.repeat(self.starts + self.sizes, self.sizes)
        at = np.arange(n, dtype=np.int32)
        left = ends - at
        to, piece, ends_word, first = self._edges(pieces, data, raw, at, left, ends)
        count = np.diff(first)
        start = np.repeat(at, count)
        onward = self._onward(pieces.weight[piece], start, np.where(ends_word, np.int32(n), to), left)
        log_p = pieces.weight[piece] + np.where(ends_word, 0.0, onward[to]) - onward[start]
        # The likeliest piece of a node stands first: most draws need no search.
        own = np.flatnonzero(count)  # no edge starts within a character that is a piece
        head, count = first[own], count[own]
        lead = np.flatnonzero(log_p == np.repeat(np.maximum.reduceat(log_p, head), count)) if n else head
        lead = lead[np.append(True, np.diff(start[lead]) > 0)] if n else lead
        swap = np.arange(len(start), dtype=np.int32)
        swap[head], swap[lead] = lead, head
        log_p = log_p[swap]
        self.to, self.piece, self.ends_word, self.start, self.first = to[swap], piece[swap], ends_word[swap], start, first
        # Sums in whole units of 2 ** -31 and 2 ** -32: exact, so that a row's sample doesn't depend on its neighbours in the batch.
        self.units = np.rint(log_p * 2.0**32).astype(np.int64)
        p = np.exp(log_p)
        parts = np.rint(p * 2.0**31).astype(np.int64)
        sums = np.cumsum(parts)
        before = (sums - parts)[head]
        self.likeliest = np.zeros(n + 1, dtype=np.int64)
        self.likeliest[own] = parts[head]
        node = start.astype(np.int64) << 32
        self.cum = node + np.minimum(sums - np.repeat(before, count), 2**31)
        # What a node leaves over beside an edge: a sum of the others for its likeliest, for which 1 - p would lose them.
        self.rest = 1.0 - p
        if n:
            last = head + count - 1
            self.cum[last] = node[last] + 2**31
            p[head] = 0.0
            self.rest[head] = np.add.reduceat(p, head)

    @classmethod
    def of(cls, pieces: Pieces, words: Iterable[str], most: int = CHUNK_WORDS) -> Lattice:
        """The lattice of any number of words, built from so many at a time, whose arrays a processor's cache holds."""
        words = iter(words)
        parts = [cls(pieces, list(itertools.islice(words, most)))]
        while some := list(itertools.islice(words, most)):
            parts.append(cls(pieces, some))
        if len(parts) == 1:
            return parts[0]
        out = object.__new__(cls)
        nodes = np.cumsum([0, *(len(x.first) - 1 for x in parts)])
        edges = np.cumsum([0, *(len(x.to) for x in parts)])
        for name, shifts in {"starts": nodes, "sizes": None, "to": nodes, "piece": None, "ends_word": None, "start": nodes, "units": None, "cum": nodes << 32, "rest": None}.items():
            own = [getattr(x, name) for x in parts]
            setattr(out, name, np.concatenate(own if shifts is None else [a + a.dtype.type(s) for a, s in zip(own, shifts, strict=False)]))
        out.first = np.concatenate([x.first[:-1] + np.int32(s) for x, s in zip(parts, edges, strict=False)] + [edges[-1:].astype(np.int32)])
        out.likeliest = np.concatenate([x.likeliest[:-1] for x in parts] + [np.zeros(1, np.int64)])
        return out

    @staticmethod
    def _edges(pieces: Pieces, data: bytes, raw: np.ndarray, at: np.ndarray, left: np.ndarray, ends: np.ndarray):
        """to, piece, ends_word of each edge in the order of nodes, and each node's first edge."""
        n = len(data)
        h = pieces.hashes(data)
        lead = (raw & 0xC0) != 0x80
        heads = np.flatnonzero(lead)
        no = np.cumsum(lead)
        char_end = np.append(heads, n)[no] if n else at
        alone = np.zeros(n + 1, dtype=bool)  # a lead byte whose character is a piece
        count, found, some = np.zeros(n, dtype=np.int32), [], at[lead]
        for length in pieces.lengths:
            some = some[left[some] >= length]
            if not len(some):
                break
            code = pieces.of(h, some, length)
            hit, of = pieces.find(code)
            hit = some[hit]
            some = some[pieces.goes_on[(code >> np.uint64(44)).astype(np.int64)]]
            found.append((hit, count[hit], length, of))
            count[hit] += 1
            alone[hit[char_end[hit] == hit + length]] = True
        other = at[~alone[heads[no - 1]]] if n else at
        found.append((other, count[other], 1, pieces.byte_id[raw[other]]))
        count[other] += 1
        first = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(count, out=first[1:])
        to, piece = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
        for hit, nth, length, of in found:
            k = first[hit] + nth
            to[k], piece[k] = hit + np.int32(length), of
        return to, piece, to == np.repeat(ends, count), first

    @staticmethod
    def _onward(weight: np.ndarray, start: np.ndarray, after: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The log of what follows each node, summed, from the ends of the words: nodes with as many bytes left at a time."""
        n = len(left)
        onward = np.zeros(n + 1)
        e_left = left[start]
        by_left = np.argsort(e_left.astype(np.uint16) if n and left.max() < 2**16 else e_left, kind="stable")
        cuts = np.flatnonzero(np.diff(e_left[by_left], prepend=-1)) if n else np.zeros(0, dtype=np.int64)
        nodes, after, weight = start[by_left], after[by_left], weight[by_left]
        heads = np.flatnonzero(np.diff(nodes, prepend=-1))
        head_cuts = np.searchsorted(heads, np.append(cuts, len(nodes)))
        # Near the end of a word products don't underflow; further on logarithms are added.
        plain = np.exp(weight[: cuts[PLAIN] if len(cuts) > PLAIN else len(weight)])
        onward[n] = 1.0
        for level, (a, b) in enumerate(zip(cuts, np.append(cuts[1:], len(by_left)), strict=True)):
            first = heads[head_cuts[level] : head_cuts[level + 1]]
            node, first = nodes[first], first - a
            if level < PLAIN:
                onward[node] = np.add.reduceat(plain[a:b] * onward[after[a:b]], first)
                continue
            if level == PLAIN:
                with np.errstate(divide="ignore"):
                    onward = np.log(onward)
            x = weight[a:b] + onward[after[a:b]]
            top = np.maximum.reduceat(x, first)
            onward[node] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, b - a)))), first))
        return onward if len(cuts) > PLAIN else np.log(onward, where=onward > 0, out=np.zeros(n + 1))

    def walk(self, node: np.ndarray, key: np.ndarray, offset: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draws a path to the word's end from each node. owner, offset, edge of every step, owner by owner, and a uniform number
        for each: the halves of its bits draw the edge and give that."""
        owner, out, count = np.arange(len(node), dtype=np.int32), [], np.zeros(len(node), dtype=np.int32)
        while len(owner):
            bits = _bits(key, round_, 0, offset)
            u = (bits >> np.uint64(33)).astype(np.int64)
            edge = self.first[node]
            other = np.flatnonzero(u >= self.likeliest[node])
            o = node[other]
            edge[other] = np.clip(np.searchsorted(self.cum, (o.astype(np.int64) << 32) + u[other], side="right"), edge[other], self.first[o + 1] - 1)
            out.append((owner, offset, edge, bits.astype(np.uint32)))
            count[owner] += 1
            on = np.flatnonzero(~self.ends_word[edge])
            owner, key, to = owner[on], key[on], self.to[edge[on]]
            offset = offset[on] + (to - node[on])
            node = to
        begin = np.cumsum(count) - count
        steps, edges, low = (np.empty(int(count.sum()), t) for t in (np.int64, np.int32, np.uint32))
        for nth, (who, offset, edge, bits) in enumerate(out):
            k = begin[who] + nth
            steps[k], edges[k], low[k] = offset, edge, bits
        return np.repeat(np.arange(len(count), dtype=np.int32), count), steps, edges, (low + 0.5) / 2.0**32

    def opened(self, node: np.ndarray, used: list[np.ndarray], u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge of each node other than the used ones (arrays of an edge, or -1, for each node), drawn by u in proportion to
        what follows; and what is left of the node's mass without all of them."""
        count = self.first[node + 1] - self.first[node]
        cut = np.cumsum(count) - count
        of = np.repeat(np.arange(len(node)), count)
        edge = self.first[node][of] + (np.arange(len(of)) - cut[of])
        p = np.exp(self.units[edge] / 2.0**32)
        for e in used:
            p[edge == e[of]] = 0.0
        # Whole parts of the largest: their running sums are exact, and none that is left is nothing.
        parts = np.where(p > 0, np.maximum(np.rint(p / np.maximum.reduceat(p, cut)[of] * 2.0**31), 1.0), 0.0).astype(np.int64)
        sums = np.cumsum(parts)
        before = (sums - parts)[cut]
        total = sums[cut + count - 1] - before
        chosen = np.searchsorted(sums, before + np.minimum((u * total).astype(np.int64), total - 1), side="right")
        p[chosen] = 0.0
        return edge[chosen], np.add.reduceat(p, cut)


def _race(prior: np.ndarray, rest: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The perturbed maximum, not yet truncated, of what a node leaves over: a Gumbel at prior + log(rest); -inf for nothing."""
    with np.errstate(divide="ignore"):
        return prior + np.log(np.maximum(rest, 0.0)) - np.log(-np.log(u))


def _truncated(value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """A Gumbel truncated at bound, from the untruncated one that the same random number gives."""
    return -np.logaddexp(-bound, -value)


class Walks:
    """The steps that one round has drawn, in the order of documents and offsets, with the sets they leave over."""

    def __init__(self, lattice: Lattice, word: np.ndarray, doc: np.ndarray, offset: np.ndarray, edge: np.ndarray, u: np.ndarray, before: np.ndarray):
        """before by document: log-probability up to the first step, in units of 2 ** -32."""
        self.word, self.doc, self.offset, self.edge = word, doc, offset, edge
        self.cut = np.searchsorted(doc, np.arange(len(before) + 1))
        sums = np.concatenate([[0], np.cumsum(lattice.units[edge])])
        self.prior = before[doc] + sums[:-1] - sums[self.cut][doc]
        self.end = before + sums[self.cut[1:]] - sums[self.cut[:-1]]
        self.value = _race(self.prior / 2.0**32, lattice.rest[edge], u)

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """By document the largest value and its step."""
        has = np.flatnonzero(self.cut[1:] > self.cut[:-1])
        top, at = np.full(len(self.cut) - 1, -np.inf), np.zeros(len(self.cut) - 1, dtype=np.int64)
        if len(has):
            top[has] = np.maximum.reduceat(self.value, self.cut[:-1][has])
            hit = np.flatnonzero(self.value == np.repeat(top, np.diff(self.cut)))
            d, first = np.unique(self.doc[hit], return_index=True)
            at[d] = hit[first]
        return top, at


def _inclusion(log_p: float, kept: float) -> float:
    return 1.0 if not np.isfinite(kept) else float(-np.expm1(-np.exp(min(log_p - kept, 700.0))))


def sample_batch(pieces: Pieces, texts: list[str | None], keys: np.ndarray, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float]] | None]:
    """For each text its samples: ids, log-probability and inclusion score, the largest perturbed value first."""
    known: dict[str, int] = defaultdict(itertools.count().__next__)  # numbers words as they come
    words, per_doc = [], np.zeros(len(texts), dtype=np.int64)
    for d, t in enumerate(texts):
        if t:
            parts = t.replace(BLANK, " ").split(" ")
            words.extend(map(known.__getitem__, parts))
            per_doc[d] = len(parts)
    lattice = Lattice.of(pieces, known)
    del known
    word = np.array(words, dtype=np.int32)
    del words
    word_cut = np.concatenate([[0], np.cumsum(per_doc)])
    found = []
    for a, b in _cuts(texts, WALK_BYTES):  # few at a time, so that arrays stay small
        found += _samples(lattice, word[word_cut[a] : word_cut[b]], per_doc[a:b], keys[a:b], k)
    return [None if t is None else x if t else [(np.zeros(0, dtype=np.int32), 0.0, 1.0)] for t, x in zip(texts, found, strict=True)]


def _samples(lattice: Lattice, word: np.ndarray, per_doc: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """The samples of documents that are chains of word, per_doc of them each."""
    n = len(per_doc)
    doc = np.repeat(np.arange(n, dtype=np.int32), per_doc)
    word_cut = np.concatenate([[0], np.cumsum(per_doc)])
    sums = np.concatenate([[0], np.cumsum(lattice.sizes[word], dtype=np.int64)])
    offset = sums[:-1] - sums[word_cut][doc]
    node, zero = lattice.starts[word], np.zeros(n, dtype=np.int64)
    bounds = [-np.log(-np.log(_uniform(keys, 0, 3, zero)))]
    owner, step, edge, u = lattice.walk(node, keys[doc], offset, 0)
    rounds = [Walks(lattice, owner, doc[owner], step, edge, u, zero)]
    paths = [[lattice.piece[edge[a:b]]] for a, b in zip(rounds[0].cut[:-1].tolist(), rounds[0].cut[1:].tolist(), strict=True)]
    log_p, places = [rounds[0].end], [zero]
    used: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # round, step and edge of every opening
    again: list[np.ndarray] = []  # what each opening left over
    kept = np.full(n, -np.inf)
    for r in range(1, k + 1):
        best, at_round, at = np.full(n, -np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for j, w in enumerate(rounds):
            top, i = w.best()
            top = _truncated(top, bounds[j])
            better = top > best
            best, at_round, at = np.where(better, top, best), np.where(better, j, at_round), np.where(better, i, at)
        for (j, i, _), top in zip(used, again, strict=True):
            better = top > best
            best, at_round, at = np.where(better, top, best), np.where(better, j, at_round), np.where(better, i, at)
        kept = best
        todo = np.flatnonzero(np.isfinite(best))
        if r == k or not len(todo):
            break
        # The opened nodes: their steps leave the race, as does what earlier openings of them left over.
        shape = [np.zeros(n, dtype=np.int64) for _ in range(4)]
        taken, prior, at_offset, at_word = shape
        for j, w in enumerate(rounds):
            d = todo[at_round[todo] == j]
            i = at[d]
            taken[d], prior[d], at_offset[d], at_word[d] = w.edge[i], w.prior[i], w.offset[i], w.word[i]
            w.value[i] = -np.inf
        same = [(j == at_round) & (i == at) for j, i, _ in used]
        for left_over, x in zip(again, same, strict=True):
            left_over[todo] = np.where(x[todo], -np.inf, left_over[todo])
        v = lattice.start[taken[todo]]
        others = [np.where(x[todo], e[todo], -1) for x, (_, _, e) in zip(same, used, strict=True)]
        new, rest = lattice.opened(v, [taken[todo], *others], _uniform(keys, r, 2, zero)[todo])
        left_over = np.full(n, -np.inf)
        left_over[todo] = _truncated(_race(prior[todo] / 2.0**32, rest, _uniform(keys, r, 4, zero)[todo]), best[todo])
        chosen = np.full(n, -1, dtype=np.int64)
        chosen[todo] = new
        used.append((np.where(np.isfinite(best), at_round, -1), at, chosen))
        again.append(left_over)
        # From the new piece on, paths are drawn to the documents' ends: the rest of its word, if any, and the words after it.
        inside = ~lattice.ends_word[new]
        begin = at_word[todo] + ~inside
        count = word_cut[todo + 1] - begin
        cut = np.cumsum(count) - count
        on = np.repeat(begin - cut, count) + np.arange(int(count.sum()))
        nodes, offsets = node[on], offset[on]
        nodes[cut[inside]] = lattice.to[new[inside]]
        offsets[cut[inside]] = (at_offset[todo] + lattice.to[new] - v)[inside]
        before = zero.copy()
        before[todo] = prior[todo] + lattice.units[new]
        owner, step, edge, u = lattice.walk(nodes, keys[doc[on]], offsets, r)
        walks = Walks(lattice, on[owner], doc[on[owner]], step, edge, u, before)
        cuts, place = walks.cut.tolist(), zero.copy()
        for d, e in zip(todo.tolist(), new.tolist(), strict=True):
            j, i = int(at_round[d]), int(at[d])
            place[d] = places[j][d] + i - rounds[j].cut[d] + 1
            parent = paths[d][j]  # each round of a document has added a path, up to its last
            paths[d].append(np.concatenate([parent[: place[d] - 1], lattice.piece[e : e + 1], lattice.piece[edge[cuts[d] : cuts[d + 1]]]]))
        rounds.append(walks)
        bounds.append(best)
        log_p.append(walks.end)
        places.append(place)
    return [[(ids, float(log_p[j][d] / 2.0**32), _inclusion(log_p[j][d] / 2.0**32, kept[d])) for j, ids in enumerate(paths[d])] for d in range(n)]


def sample_long(pieces: Pieces, text: str, key: np.ndarray, k: int = SAMPLES, most: int = BATCH_BYTES) -> list[tuple[np.ndarray, float, float]]:
    """The samples that sample_batch gives for the text and the key (an array of one), from lattices of at most so many bytes of words
    at a time: a round goes through the text and carries sums and the k best of what its steps leave over."""
    words = text.replace(BLANK, " ").split(" ")
    sizes = np.fromiter((len(w.encode("utf-8", "replace")) for w in words), dtype=np.int64, count=len(words)) + len(BLANK.encode())
    begins = np.cumsum(sizes) - sizes
    one = np.zeros(1, dtype=np.int64)

    def drawn(round_: int, first: int, inside: int, before: int):
        """ids, log-probability and the best sets left over of a path from byte inside of word first on."""
        ids, best, steps_before = [], [], 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(begins, begins[first] + most, side="right")) - 1) if begins[-1] > begins[first] + most else len(words)
            number: dict[str, int] = defaultdict(itertools.count().__next__)
            word = np.fromiter(map(number.__getitem__, words[first:last]), dtype=np.int32, count=last - first)
            lattice = Lattice.of(pieces, number)
            node, offset = lattice.starts[word], begins[first:last].copy()
            node[0], offset[0] = node[0] + inside, offset[0] + inside
            owner, step, edge, u = lattice.walk(node, np.repeat(key, len(node)), offset, round_)
            sums = np.cumsum(lattice.units[edge])
            prior = before + sums - lattice.units[edge]
            value = _race(prior / 2.0**32, lattice.rest[edge], u)
            for i in np.argsort(-value, kind="stable")[:k].tolist():
                best.append((float(value[i]), int(step[i]), first + int(owner[i]), int(prior[i]), steps_before + i, int(lattice.to[edge[i]] - lattice.start[edge[i]])))
            ids.append(lattice.piece[edge])
            before, steps_before = before + int(sums[-1]), steps_before + len(edge)
            first, inside = last, 0
        best = sorted(best, key=lambda b: -b[0])[:k]
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), before, best

    ids, end, best = drawn(0, 0, 0, 0)
    bound = -np.log(-np.log(_uniform(key, 0, 3, one)))
    # value, round, offset, word, prior, place, lengths of the pieces already taken there
    queue = [(float(_truncated(np.array([b[0]]), bound)[0]), 0, *b[1:5], (b[5],)) for b in best]
    found, places, kept = [(ids, end)], [0], -np.inf
    for r in range(1, k + 1):
        queue = sorted((q for q in queue if np.isfinite(q[0])), key=lambda q: -q[0])
        kept = queue[0][0] if queue else -np.inf
        if r == k or not queue:
            break
        value, j, offset, at, prior, place, lengths = queue.pop(0)
        lattice, v = Lattice(pieces, [words[at]]), np.array([offset - begins[at]])
        edges = np.arange(lattice.first[v[0]], lattice.first[v[0] + 1])
        taken = [edges[lattice.to[edges] - v[0] == n] for n in lengths]
        (new,), rest = lattice.opened(v, taken, _uniform(key, r, 2, one))
        length = int(lattice.to[new] - v[0])
        left = _truncated(_race(np.array([prior / 2.0**32]), rest, _uniform(key, r, 4, one)), np.array([value]))[0]
        queue.append((float(left), j, offset, at, prior, place, (*lengths, length)))
        inside = 0 if lattice.ends_word[new] else int(lattice.to[new])
        ids, end, best = drawn(r, at + (inside == 0), inside, prior + int(lattice.units[new]))
        kept_steps = places[j] + place
        found.append((np.concatenate([found[j][0][:kept_steps], lattice.piece[new : new + 1], ids]), end))
        places.append(kept_steps + 1)
        queue += [(float(_truncated(np.array([b[0]]), np.array([value]))[0]), r, *b[1:5], (b[5],)) for b in best]
    return [(ids, end / 2.0**32, _inclusion(end / 2.0**32, kept)) for ids, end in found]


_KEPT: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float = ALPHA) -> Pieces:
    """One vocabulary for each worker and file."""
    if (path, alpha) not in _KEPT:
        _KEPT[path, alpha] = Pieces(path, alpha)
    return _KEPT[path, alpha]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _cuts(texts: list[str | None], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    a = size = 0
    for b, t in enumerate(texts):
        if b > a and size + len(t or "") > most:
            yield a, b
            a, size = b, 0
        size += len(t or "")
    if texts:
        yield a, len(texts)


def sample_segmentations(docs: DataFrame, path: str | None = None, k: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """doc_id, samples (ids, log_p, inclusion) for each row of docs(doc_id, text). path: the model's file, on every machine."""
    import pyarrow as pa

    path = path or default_path()
    item = pa.struct([("ids", pa.list_(pa.int32())), ("log_p", pa.float64()), ("inclusion", pa.float64())])

    def sample(batches):
        vocabulary = pieces(path, alpha)
        for batch in batches:
            keys = np.asarray(batch.column(2)).astype(np.int64).view(np.uint64)
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                texts = batch.column(1)[a:b].to_pylist()
                long = b == a + 1 and len(texts[0] or "") > BATCH_BYTES
                found = [sample_long(vocabulary, texts[0], keys[a:b], k)] if long else sample_batch(vocabulary, texts, keys[a:b], k)
                each = [s for x in found if x is not None for s in x]
                ends = np.concatenate([[0], np.cumsum([len(i) for i, _, _ in each])]).astype(np.int32)
                flat = np.concatenate([i for i, _, _ in each]).astype(np.int32) if each else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                structs = pa.StructArray.from_arrays([ids, pa.array([p for _, p, _ in each], pa.float64()), pa.array([q for _, _, q in each], pa.float64())], fields=list(item))
                bounds = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array([None if i < len(found) and found[i] is None else int(v) for i, v in enumerate(bounds)], pa.int32()), structs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["doc_id", "samples"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("key"))
    return rows.mapInArrow(sample, SCHEMA)


def decoder(path: str | None = None):
    """A column function: the text of a segmentation (array<int>)."""
    import pandas as pd

    path = path or default_path()

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        vocabulary = pieces(path)
        return pd.Series([None if x is None else vocabulary.decode(x.tolist()) for x in ids], dtype=object)

    return decode


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of samples, and of each its pieces, hash of ids, log-probability and inclusion score."""
    text = lambda f: F.array_join(F.transform("samples", f), ",")
    return found.select(
        "doc_id",
        F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n_samples"),
        text(lambda s: F.size(s["ids"]).cast("string")).alias("n_pieces"),
        text(lambda s: F.hex(F.xxhash64(s["ids"]))).alias("ids_hash"),
        text(lambda s: F.round(s["log_p"], 4).cast("string")).alias("log_p"),
        text(lambda s: F.format_string("%.4e", s["inclusion"])).alias("inclusion"),
    )


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(sample_segmentations(table(spark, sf_dir, "documents")))
