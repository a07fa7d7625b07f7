"""SentencePiece encoding and decoding, batched in numpy.

A text is normalised as the model says (dummy prefix, escaped white space) and cut into units that no piece reaches
over: a run of escaped spaces with the characters up to the next one, without characters that no piece holds. Units are
found by the kinds of neighbouring characters and told apart by a 64-bit hash, in arrays of a batch's characters; distinct
ones that are not yet known are encoded in batches which advance together.

* Unigram models: Viterbi. At each end position the substrings of every length are hashed, the hashes probe the sorted
  piece keys, and vectorised maxima over the lengths store best scores and backpointers.
* Byte-pair models: the scores are merge ranks, not probabilities, and a best path over them gives other pieces than the
  model's own encoder, so they can't be right. Here the units of a batch merge together: a table has the piece that two
  neighbouring symbols make, and in each round a vectorised maximum picks each unit's best, leftmost pair.

Both leave characters without a piece to the byte pieces (or the unknown piece).

Defined results: a null text is null ids and null decoding; an empty text has no ids; texts and words of any length are
encoded whole; equal texts have equal ids.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column

from tidemark.llm.texts import arrow_over_texts, mixed

SPACE = "▁"
#: Units longer than this are encoded one by one, in time that grows as n log n.
LONG = 64
#: Texts whose units are encoded together.
TOGETHER = 512
#: Characters whose units are told apart together; a longer unit is taken whole.
WINDOW = 1 << 18
SCHEMA = "ids array<int>, n_pieces int"
#: A random odd factor for each place in a unit.
FACTORS = np.random.default_rng(3).integers(0, 1 << 63, LONG + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    until = np.cumsum(size)
    return np.repeat(start - until + size, size) + np.arange(until[-1] if len(until) else 0)


@dataclass
class Known:
    """Piece numbers of units by their hash: sorted keys, and where each one's run of numbers stands."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of these keys, -1 for those not known."""
        if not len(self):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Takes in sorted keys that are not known yet."""
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.keys, self.size, self.ids = np.insert(self.keys, at, keys), np.insert(self.size, at, size), np.concatenate([self.ids, ids.astype(np.int32)])


@dataclass
class Vocabulary:
    """Pieces by number, from a model file's own list."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]  # can be found in a text
    bytes_at: dict[int, int]  # byte -> number
    byte_of: dict[int, int]
    unknown: int
    control: frozenset[int]
    bpe: bool
    prefix: bool
    squeeze: bool  # remove surplus spaces
    cache: Known = field(default_factory=Known)
    before: Known = field(default_factory=Known)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        kinds = [p.type for p in model.pieces]
        spec = model.normalizer_spec
        if spec.precompiled_charsmap:
            raise ValueError("models with a character map are not supported")
        found = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [k in (1, 4) for k in kinds], found, {i: b for b, i in found.items()}, kinds.index(2), frozenset(i for i, k in enumerate(kinds) if k == 3), model.trainer_spec.model_type == 2, spec.add_dummy_prefix, spec.remove_extra_whitespaces)

    def __post_init__(self) -> None:
        usable = [i for i, ok in enumerate(self.normal) if ok]
        self.number = {self.pieces[i]: i for i in reversed(usable)}
        self.alphabet = frozenset(c for i in usable for c in self.pieces[i])
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.value = np.array(self.scores, float)
        # by character, those beyond the alphabet at the last place: 2 for escaped spaces, 1 for others of a piece, 0 for those of none
        self.kind = np.zeros(max(map(ord, self.alphabet | {SPACE})) + 2, np.uint8)
        self.kind[[ord(c) for c in self.alphabet]] = 1
        self.kind[ord(SPACE)] = 2
        if self.bpe:
            self.table_of_pairs()
        else:
            self.table_of_hashes(usable)
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def table_of_hashes(self, usable: list[int]) -> None:
        keys = np.concatenate([self.prefix_hashes(self.codes([self.pieces[i]]), len(self.pieces[i])) for i in usable] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], np.array(usable, np.int64)[order]
        # keys are spread evenly: those that share their first bits are few, and stand from one place on
        shared = np.bincount((keys >> self.SHIFT).astype(np.int64), minlength=1 << 20)
        self.first, self.deep = np.cumsum(shared) - shared, int(shared.max())
        self.keys, self.ids = np.r_[keys, np.full(self.deep, ~np.uint64(0))], np.r_[ids, np.full(self.deep, -1)]

    def table_of_pairs(self) -> None:
        """For each two symbols (pieces, or characters of the alphabet) that make a piece: that piece. Symbols are piece numbers, further numbers for characters that are no piece themselves, and a last one for what stands beside a unit."""
        symbol = self.number | {c: len(self.pieces) + k for k, c in enumerate(sorted(self.alphabet - self.number.keys()))}
        self.beside = len(self.pieces) + len(symbol) - len(self.number)
        self.symbol = np.full(len(self.kind), self.beside, np.int32)
        self.symbol[[ord(c) for c in self.alphabet]] = [symbol[c] for c in self.alphabet]
        # the higher a score, the higher its level, from 1 on
        self.level = np.unique(self.value, return_inverse=True)[1].astype(np.int32 if len(self.value) < 1 << 23 else np.int64) + 1
        found = [(symbol[a], symbol[b], i) for p, i in self.number.items() for k in range(1, len(p)) if (a := p[:k]) in symbol and (b := p[k:]) in symbol]
        left, right, piece = np.array(found, np.int64).reshape(-1, 3).T
        keys = left * (self.beside + 1) + right
        self.bits = np.uint64(64 - max(10, (8 * len(keys)).bit_length()))
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        shared = np.bincount(slot, minlength=1 << int(64 - self.bits))
        self.pair_first, self.pair_deep = (np.cumsum(shared) - shared).astype(np.int32), int(shared.max(initial=0))
        self.pair_crowded = shared > 1
        self.pair_keys, self.pair_piece = np.r_[keys[order], np.full(self.pair_deep + 1, -1)], np.r_[piece[order], np.full(self.pair_deep + 1, -1)].astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def together(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, -1 for none."""
        keys = left.astype(np.int64) * (self.beside + 1) + right
        slot = self.slot(keys)
        at = self.pair_first[slot]
        hit = self.pair_keys[at] == keys
        out = np.where(hit, self.pair_piece[at], np.int32(-1))
        rest = np.flatnonzero(self.pair_crowded[slot] & ~hit)
        for k in range(1, self.pair_deep):
            if not len(rest):
                break
            hit = self.pair_keys[at[rest] + k] == keys[rest]
            out[rest[hit]] = self.pair_piece[at[rest[hit]] + k]
            rest = rest[~hit]
        return out

    SHIFT = np.uint64(44)

    @staticmethod
    def codes(units: list[str]) -> np.ndarray:
        return np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(len(units), -1).astype(np.uint64)

    @staticmethod
    def prefix_hashes(codes: np.ndarray, length: int) -> np.ndarray:
        """The hash of the first ``length`` characters of each row."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(length):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[:, k] + np.uint64(1)
        return mixed(h + np.uint64(length))

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at = self.first[(h >> self.SHIFT).astype(np.int64)]
        out = np.full(h.shape, -1)
        for _ in range(self.deep):
            out = np.where((self.keys[at] == h) & (out < 0), self.ids[at], out)
            at = at + 1
        return out

    def viterbi(self, units: list[str]) -> list[tuple[int, ...]]:
        """Best-scored pieces of units of one length; a character without a piece costs more than any piece and is the unknown piece."""
        codes = self.codes(units)
        n, length = codes.shape
        poor = float(self.value.min(initial=0.0)) - 10.0
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, length + 1), np.int64), np.full((n, length + 1), self.unknown)
        for end in range(1, length + 1):
            starts = range(max(0, end - self.longest), end)
            found = np.stack([self.probe(self.prefix_hashes(codes[:, s:end], end - s)) for s in starts], 1)
            gain = np.where(found >= 0, self.value[found], -np.inf)
            gain[:, -1] = np.where(found[:, -1] >= 0, gain[:, -1], poor)
            total = best[:, list(starts)] + gain
            k = total.argmax(1)
            rows = np.arange(n)
            best[:, end], back[:, end] = total[rows, k], k + starts[0]
            piece[:, end] = np.where(found[rows, k] >= 0, found[rows, k], self.unknown)
        out = []
        for row in range(n):
            at, ids = length, []
            while at:
                ids.append(int(piece[row, at]))
                at = int(back[row, at])
            out.append(tuple(ids[::-1]))
        return out

    def merged(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of units of up to LONG characters, one after the other, and how many each has, by merging each unit's best, leftmost pair until none is left."""
        n, size = len(units), np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        symbols, until = self.symbol[np.minimum(codes, len(self.symbol) - 1)], np.cumsum(size)
        count, parts = np.zeros(n, np.int64), []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, LONG)):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                # places of a unit are rows, from 1 on; before and after it are symbols that no piece has
                place = runs(np.zeros(len(own), np.int64), size[own])
                x = np.full((high + 2, len(own)), self.beside, np.int32)
                x[place + 1, np.repeat(np.arange(len(own)), size[own])] = symbols[runs((until - size)[own], size[own])]
                x = self.merged_columns(x)
                kept = (x >= 0) & (x != self.beside)
                count[own] = kept.sum(1)
                parts.append((own, x[kept]))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for own, ids in parts:
            out[runs(start[own], count[own])] = ids
        out[out >= len(self.pieces)] = self.unknown
        return out, count

    def merged_columns(self, x: np.ndarray) -> np.ndarray:
        """The symbols of units, a row for each, -1 where a symbol has become part of the one before it. ``x``: a column for each unit."""
        high, n = x.shape
        done = np.zeros((n, high), np.int32)
        place = np.arange(high, dtype=np.int32)[:, None]
        live, after, before = np.arange(n), np.repeat(place + 1, n, 1), np.repeat(place - 1, n, 1)
        piece = np.full(x.shape, -1, np.int32)
        piece[:-1] = self.together(x[:-1].ravel(), x[1:].ravel()).reshape(high - 1, n)
        # the level of a pair's piece, and below it its place, so that a maximum is of the best pair, and of the leftmost of those
        key = np.where(piece >= 0, self.level[piece] * 128 + 127 - place, 0)
        while len(live):
            best = key.max(0)
            going = best > 0
            if not going.all():
                done[live[~going]] = x[:, ~going].T
                live, best = live[going], best[going]
                x, after, before, piece, key = (np.ascontiguousarray(m[:, going]) for m in (x, after, before, piece, key))
                if not len(live):
                    break
            n = len(live)
            column = np.arange(n)
            k = 127 - (best & 127)
            at = k * n + column
            gone = after.ravel()[at] * n + column
            right = after.ravel()[gone]
            left = before.ravel()[at]
            right_at, left_at = right * n + column, left * n + column
            new = piece.ravel()[at]
            x.ravel()[at], x.ravel()[gone], key.ravel()[gone] = new, -1, 0
            after.ravel()[at], before.ravel()[right_at] = right, k
            two = self.together(np.concatenate([x.ravel()[left_at], new]), np.concatenate([new, x.ravel()[right_at]]))
            where, row = np.concatenate([left_at, at]), np.concatenate([left, k])
            piece.ravel()[where] = two
            key.ravel()[where] = np.where(two >= 0, self.level[two] * 128 + 127 - row, 0)
        return done

    def merged_long(self, unit: str) -> tuple[int, ...]:
        """The same for one unit, with a heap of pairs."""
        n = len(unit)
        end, before, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (k := self.number.get(unit[i : end[j]])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, end[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, until = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != until:
                continue
            end[i], after[i], alive[j] = until, after[j], False
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return tuple(self.number.get(unit[i : end[i]], self.unknown) for i in range(n) if alive[i])

    def fallback(self, unit: str) -> tuple[int, ...]:
        if self.bytes_at:
            return tuple(self.bytes_at[b] for b in unit.encode())
        return (self.unknown,) * len(unit)

    CACHE = 200_000

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of these units, one after the other, and how many each has."""
        found: dict[int, np.ndarray] = {}
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if u[0] not in self.alphabet:
                found[k] = np.array(self.fallback(u), np.int32)
            elif not self.bpe:
                by_length.setdefault(len(u), []).append(k)
            elif len(u) > LONG:
                found[k] = np.array(self.merged_long(u), np.int32)
        for length, group in by_length.items():
            step = max(1, 200_000 // length)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                found.update(zip(part, (np.array(x, np.int32) for x in self.viterbi([units[k] for k in part])), strict=True))
        if not found:
            return self.merged(units)
        rest = [k for k in range(len(units)) if k not in found]
        size = np.array([len(found.get(k, ())) for k in range(len(units))], np.int64)
        if rest:
            ids, size[rest] = self.merged([units[k] for k in rest])
            found.update(zip(rest, np.split(ids, np.cumsum(size[rest])[:-1]), strict=True))
        return np.concatenate([found[k] for k in range(len(units))]), size

    def known(self, keys: np.ndarray, unit: Callable[[int], str]) -> np.ndarray:
        """Places in the cache of these sorted keys, whose units it holds from now on. When it would grow beyond its size, it becomes the one before, in place of that, from which units that come again are taken over."""
        new = np.flatnonzero(self.cache.find(keys) < 0)
        if len(new):
            if len(self.cache) + len(new) > self.CACHE:
                self.before, self.cache, new = self.cache, Known(), np.arange(len(keys))
            at = self.before.find(keys[new])
            old, again = at[at >= 0], new[at >= 0]
            if len(old):
                self.cache.add(keys[again], self.before.ids[runs(self.before.start[old], self.before.size[old])], self.before.size[old])
            new = new[at < 0]
            if len(new):
                self.cache.add(keys[new], *self.encode_units([unit(k) for k in new.tolist()]))
        return self.cache.find(keys)

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((SPACE if self.prefix else "") + text).replace(" ", SPACE)

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of the texts, one after the other, and where each text's begin, and the last's end; a null text has none."""
        parts = [self.normalised(t) if t else "" for t in texts]
        begin = np.cumsum([0] + [len(x) for x in parts])
        whole = "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kind[np.minimum(codes, len(self.kind) - 1)]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & ((kind[:-1] != 2) | (kind[1:] != 1))
        cut[begin] = True
        edge = np.flatnonzero(cut)
        counts, ids, a = [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + WINDOW, "right")) - 1)
            found, count = self.window(whole, codes, edge[a : b + 1])
            ids.append(found)
            counts.append(count)
            a = b
        until = np.cumsum(np.concatenate(counts))
        return np.concatenate(ids), until[np.searchsorted(edge, begin)]

    def window(self, whole: str, codes: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of the units between these edges, one after the other, and how many each has."""
        start, size = edge[:-1], np.diff(edge)
        long = np.flatnonzero(size > LONG)
        place = np.minimum(np.arange(edge[0], edge[-1]) - np.repeat(start, size), LONG)
        key = mixed(np.add.reduceat((codes[edge[0] : edge[-1]].astype(np.uint64) + np.uint64(1)) * FACTORS[place], start - edge[0]) + size.astype(np.uint64))
        order = np.argsort(key)
        ordered = key[order]
        first = np.ones(len(order), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        keys, one = ordered[first], order[first]
        if len(long):  # these are told apart by their characters
            short = size[one] <= LONG
            renumbered = np.cumsum(short) - 1
            keys, one, which = keys[short], one[short], renumbered[which]
        at = self.known(keys, lambda k: whole[start[one[k]] : start[one[k]] + size[one[k]]])
        if not len(long):
            at = at[which]
            return self.cache.ids[runs(self.cache.start[at], self.cache.size[at])], self.cache.size[at]
        units = [whole[start[k] : start[k] + size[k]] for k in long.tolist()]
        distinct = {u: k for k, u in enumerate(dict.fromkeys(units))}
        ids, count = self.encode_units(list(distinct))
        places = np.array([distinct[u] for u in units])
        begin, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        short = size <= LONG
        begin[short], n[short] = self.cache.start[at[which[short]]], self.cache.size[at[which[short]]]
        begin[long], n[long] = len(self.cache.ids) + (np.cumsum(count) - count)[places], count[places]
        return np.concatenate([self.cache.ids, ids])[runs(begin, n)], n

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, at = self.flat(texts)
        return [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        if len(ids) and not 0 <= min(ids) <= max(ids) < len(self.raw_size):
            raise ValueError("a piece number that the model lacks")
        return self.joined(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def joined(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """``decode`` of each text's numbers, as ``flat`` gives them."""
        size = self.raw_size[ids]
        text = self.raw[runs(self.raw_start[ids], size)].tobytes()
        until = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        out = [text[a:b].decode(errors="replace") for a, b in zip(until[:-1], until[1:], strict=True)]
        return [x[1:] if self.prefix and x.startswith(" ") else x for x in out]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    """The model of a file that every executor has at this path, read once for each worker."""
    if model_file not in _loaded:
        _loaded[model_file] = Vocabulary.load(model_file)
    return _loaded[model_file]


def lists(texts: list[str | None], ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """The columns ids and n_pieces."""
    null = np.array([t is None for t in texts], bool)
    kind = pa.list_(pa.field("element", pa.int32()))
    return [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), type=kind, mask=pa.array(null)), pa.array(np.diff(at), pa.int32(), mask=null)]


def encode(column: Column, model_file: str) -> Column:
    """A struct (ids, n_pieces) for each text."""

    def start():
        v = vocabulary(model_file)

        def score(texts: list[str | None]) -> pa.StructArray:
            return pa.StructArray.from_arrays(lists(texts, *v.flat(texts)), ["ids", "n_pieces"])

        return score

    return arrow_over_texts(column, start, SCHEMA, TOGETHER)


def round_trip(column: Column, model_file: str) -> Column:
    """A struct (ids, n_pieces, decoded, exact): exact where decoding gives the text (white space escapes read as spaces) again."""

    def start():
        v = vocabulary(model_file)

        def score(texts: list[str | None]) -> pa.StructArray:
            ids, at = v.flat(texts)
            back = [None if t is None else x for t, x in zip(texts, v.joined(ids, at), strict=True)]
            exact = [None if t is None else b == (t.replace(SPACE, " ") if not v.squeeze else re.sub(" +", " ", t).strip(" ")) for t, b in zip(texts, back, strict=True)]
            return pa.StructArray.from_arrays([*lists(texts, ids, at), pa.array(back, pa.string()), pa.array(exact, pa.bool_())], ["ids", "n_pieces", "decoded", "exact"])

        return score

    return arrow_over_texts(column, start, f"{SCHEMA}, decoded string, exact boolean", TOGETHER)


def decode(column: Column, model_file: str) -> Column:
    """The text of each array of piece numbers; numbers that the model lacks raise an error."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def apply(ids: pd.Series) -> pd.Series:
        v = vocabulary(model_file)
        return pd.Series([None if x is None else v.decode([int(i) for i in x]) for x in ids], dtype=object)

    return apply(column)
