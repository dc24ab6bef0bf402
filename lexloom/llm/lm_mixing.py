"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and one end. Every symbol is coded in eight
binary decisions:

* a word of the vocabulary by its class (the first eight bits of its place in
  the counted, alphabetical vocabulary: classes of nearly equal weight), then, if
  the class has several, by its place in the class (the next eight bits); what
  words share a place is their exact share of it, from the counts. Any other word
  is the escape, followed by its bytes two by two and an end, in classes of byte
  pairs made the same way. Decisions with one possible outcome cost nothing, so the
  probabilities of all texts sum to one.
* Each decision is predicted by five hashed contexts (one, two and three
  preceding words; the word before the last; the classes of the last two; in
  spelled words the one to four pairs before, and the place; for a place in a
  class these and the class), by
  the exact counts without context, and by what the text itself has taken so far
  (counts that adapt inside the text).
* The predictions, in the logistic domain, are summed with weights chosen by a
  gate (classes, spelling or places, and how often the one-word and two-word contexts were
  seen). The result is refined by an adaptive table over predictions.
* Weights, refinement and the text's own counts learn while a text is coded:
  after every ``STEP`` symbols at first, and never later than after a sixteenth
  of what the text has shown. Nothing is reset inside a text. Texts are coded
  side by side, each with its own state.

Training texts are those whose fold of 10 is not 0. Word counts, and with them
the classes, cover all of them. Contexts are counted over all of them but one in
``TUNE``, on which the starting weights and refinement are learned (averaged
over the texts that used them). Context tables are counted by as many tasks as
the cluster has cores, so what is shuffled does not grow with the splits; their
size, ``table_bits``, doubles with the training tokens up to ``MAX_BITS``, which
is what a Python worker can hold. Base scores of words outside the vocabulary
come from a shuffle join with the full word counts.

Null texts count as empty: just the end. Ids may be null (then they train),
repeated or of any type; rows may repeat; very long texts and words are coded
whole; other columns are ignored, whatever their names. Without training texts
all words are spelled and all counts are zero. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, materialize, prepare

#: Memory limits of a worker: words of the vocabulary, and slots of each context table.
VOCAB = 1 << 19
MAX_BITS = 23
TUNE = 24
TUNE_ROUNDS = 2
STEP = 8
#: Symbols that are coded side by side.
GROUP = 1 << 18
CHUNK = 1 << 16
#: Texts whose words are counted at once.
TEXT_BYTES = 8 << 20
END = b"\n"
GAPS = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
CONTEXTS = 5
INPUTS = CONTEXTS + 3
#: Kinds of symbols: class of a word, byte pair, place of a word in its class.
KINDS = 3
GATES = KINDS * 4 * 4
#: Nodes whose outcomes a text counts: of classes, of pairs, and those that the places of all classes share by a hash.
SHARED = 4096
TAKEN = 512 + SHARED
#: Texts that are coded side by side at most.
TEXTS = 2048
BUCKETS = 24
#: Predictions end here, inside the first and the last bucket.
LIMIT = np.float32(7.99)
RATE = 0.07
SCALE = np.float32(4096)
#: Codes of byte pairs; the blank is in no word, so it fills the last pair, and two of them are the end.
PAIRS, PAIR_END = 1 << 16, 32 * 257
M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

ODD = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

_depth, _class = np.arange(8)[:, None], np.arange(256)
#: Nodes of the whole tree (1..255) on the way to each class, and whether it goes on to the upper side.
NODE = ((1 << _depth) | (_class >> (8 - _depth))).T
SIDE = ((_class >> (7 - _depth)) & 1).T


def _halves(by_class: np.ndarray) -> np.ndarray:
    """A class is two halves of four decisions: (4, 512), first the upper halves of all classes, then the lower ones."""
    return np.ascontiguousarray(np.concatenate([by_class[:, :4], by_class[:, 4:]]).T)


#: Of each half: outcomes, nodes of the whole tree, and nodes of the half's own tree (1..15).
TURN = _halves(SIDE)
BIT = TURN.astype(np.float32)
STOP = _halves(NODE)
PLACE = np.where(np.arange(512) < 256, STOP, (1 << _depth[:4]) | STOP & (1 << _depth[:4]) - 1)
#: Cells of a text's own counts: nodes of classes and of pairs, and what the places of all classes share.
_node = np.arange(512 + (1 << 16))
CELL = np.where(_node < 512, _node, 512 + ((_node & 255) + (_node >> 8) * 1297 & SHARED - 1))


def table_bits(tokens: int) -> int:
    """Slots of a context table, as a power of two: one for 8 training tokens, 2**20 at least."""
    return min(MAX_BITS, max(20, math.ceil(math.log2(max(2, tokens))) - 3))


def steps(longest: int) -> np.ndarray:
    """Symbols after which a text learns: its ``STEP``, then a sixteenth of itself more."""
    out = [0]
    while out[-1] < longest:
        out.append(out[-1] + max(STEP, out[-1] // 16 // STEP * STEP))
    return np.array(out, np.int64)


def word_keys(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """A number of eight bytes for each word: its bytes, each times an odd number of its place, summed."""
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.add.reduceat((flat.astype(np.uint64) + M[0]) * ODD.take(place & 255), offsets[:-1])


def logit_counts(n0, n1):
    return np.log((n1 + np.float32(0.35)) / (n0 + np.float32(0.35)))


class Code:
    """Classes and shares of the vocabulary's words, of the escape (their last symbol), and of byte pairs.

    ``pair_counts`` tells how often a pair (first byte * 256 + second) spelled a rare word.
    """

    def __init__(self, words: list[bytes], counts, escaped: int, pair_counts: np.ndarray):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.blob = b" ".join(words[i] for i in order)
        self.counts = np.array([counts[i] for i in order], np.int64)
        weight = np.append(self.counts, max(1, escaped)).astype(np.float64)
        self.cls, self.sub, self.tail, whole = self.places(weight)
        first, second = np.divmod(np.arange(PAIRS), 256)
        blanks = np.array([9, 10, 11, 12, 13, 32])
        never = np.isin(first, blanks) | np.isin(second, blanks[:-1])
        never[PAIR_END] = False
        self.pair_cls, self.pair_tail, pairs = self.classes(np.where(never, 0, pair_counts + 1 / 64))
        deep = np.bincount(self.cls.astype(np.int64) * 256 + self.sub, weight, 1 << 16).reshape(256, 256)
        self.several = (deep > 0).sum(axis=1) > 1  # classes in which a place is left open
        # trees of the classes, of the pairs, and of the places in each class
        self.base, self.free, self.share = (np.empty(512 + (1 << 16), np.float32) for _ in range(3))
        for k, mass in enumerate([whole, pairs, *deep]):
            n = np.bincount(NODE.reshape(-1), np.repeat(mass, 8), 256)
            ones = np.bincount(NODE.reshape(-1), (mass[:, None] * SIDE).reshape(-1), 256)
            at = slice(256 * k, 256 * k + 256)
            self.free[at] = (ones > 0) & (ones < n)
            self.base[at] = logit_counts(n - ones, ones)
            self.share[at] = np.clip((ones + 0.01) / (n + 0.02), 1e-4, 1 - 1e-4)
        self._index = self._keyed = None

    @staticmethod
    def classes(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each symbol, nats of its share of the class, and the weight of the 256 classes."""
        place = (np.cumsum(weight) - weight / 2) / weight.sum()
        cls = np.minimum(place * 256, 255).astype(np.uint8)
        whole = np.bincount(cls, weight, 256)
        with np.errstate(divide="ignore"):
            return cls, (np.log(whole[cls]) - np.log(weight)).astype(np.float32), whole

    @staticmethod
    def places(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Class and place in the class of each symbol, nats of its share of the place, and the weight of the classes."""
        place = (np.cumsum(weight) - weight / 2) / weight.sum()
        both = np.minimum(place * 65536, 65535).astype(np.int64)
        held = np.bincount(both, weight, 1 << 16)
        return (both >> 8).astype(np.uint8), (both & 255).astype(np.uint8), (np.log(held[both]) - np.log(weight)).astype(np.float32), held.reshape(256, 256).sum(axis=1)

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_keyed": None}

    @property
    def index(self) -> dict[bytes, int]:
        if self._index is None:
            self._index = {w: i for i, w in enumerate(self.blob.split(b" "))}
        return self._index

    @property
    def keyed(self) -> tuple[np.ndarray, ...]:
        """Keys of the words in order, the word of each, and offsets and bytes of all words."""
        if self._keyed is None:
            flat = np.frombuffer(self.blob, np.uint8)
            inside = flat != 32
            ends = np.flatnonzero(np.append(~inside, True))
            offsets, flat = np.append(0, ends - np.arange(len(ends))), flat[inside]
            keys = word_keys(offsets, flat)
            order = np.argsort(keys)
            self._keyed = keys[order], order, offsets, flat
        return self._keyed

    def find(self, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """``look_up`` of an Arrow array: each distinct word once, by its key; then its bytes are compared."""
        if not len(words):
            return np.zeros(0, np.int64), []
        coded = words.dictionary_encode()
        _, offsets, flat = coded.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(coded.dictionary) + 1)
        flat, size = np.frombuffer(flat, np.uint8, offsets[-1]), np.diff(offsets)
        raw, (keys, order, starts, letters) = flat.tobytes(), self.keyed
        if (keys[1:] == keys[:-1]).any():  # two words with one key: look up the words themselves
            ids = look_up(self.index, [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])[0]
        else:
            key = word_keys(offsets, flat)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ids = order[at]
            other = letters.take(np.repeat(starts[ids] - offsets[:-1], size) + np.arange(len(flat)), mode="clip") != flat
            ids[(keys[at] != key) | (np.diff(starts)[ids] != size) | np.logical_or.reduceat(other, offsets[:-1])] = -1
        at = np.frombuffer(coded.indices.buffers()[1], np.int32, len(words))
        ids = ids.take(at)
        at = at[ids < 0]
        return ids, [raw[a:b] for a, b in zip(offsets[at].tolist(), offsets[at + 1].tolist(), strict=True)]

    def symbols(self, ids: np.ndarray, sizes: np.ndarray, unknown: list[bytes]) -> Symbols:
        """Symbols of texts: word ids (-1 unknown), words of each text, and the unknown words in order."""
        return Symbols(self, ids, sizes, unknown)


class Symbols:
    """Texts as symbols in order: outcome, kind (0 class, 1 byte pair, 2 place in the class), tree, nats of the share, text, place, and context sources."""

    def __init__(self, code: Code, ids: np.ndarray, sizes: np.ndarray, unknown: list[bytes], words: bool = True):
        known = np.where(ids < 0, len(code.counts), ids).astype(np.int32)
        n, cls = len(known), code.cls[known]
        deep = code.several[cls]
        length = 1 + deep  # symbols of each word
        spelled = np.fromiter(map(len, unknown), np.int64, len(unknown)) // 2 + 1
        length[ids < 0] += spelled
        first = np.cumsum(length) - length  # symbol of each word
        total = n + int(spelled.sum()) + int(deep.sum())
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        start = (np.cumsum(sizes) - sizes)[sizes > 0]  # of each text's words
        back, before = [], np.zeros((2, n), np.int32)  # 0 where the text has no word so far back
        for k in (1, 2, 3):
            word = np.zeros(n, np.int32)
            word[k:] = known[:max(0, n - k)] + 1
            for j in range(k):
                word[(start + j)[start + j < n]] = 0
            back.append(word)
            if k < 3:
                before[k - 1, k:] = cls[:max(0, n - k)]
                before[k - 1] += 1
                before[k - 1] *= word > 0
        pair = before[0] * 257 + before[1]
        own = np.flatnonzero(deep)
        second = first[own] + 1
        self.kind = np.ones(total, np.int8)
        self.kind[first], self.kind[second] = 0, 2
        self.cls = np.empty(total, np.uint8)
        self.cls[first], self.cls[second] = cls, code.sub[known[own]]
        self.tree = self.kind.astype(np.int16)
        self.tree[second] += cls[own]
        self.tail = np.zeros(total, np.float32)
        self.tail[first] = code.tail[known]
        self.text = np.empty(total, np.int32)
        self.text[first], self.text[second] = text, text[own]
        self.source = np.zeros((4, total), np.int32 if len(code.counts) < 1 << 22 else np.int64)
        within = cls[own].astype(self.source.dtype) + 1
        for k, x in enumerate([*back, pair]):
            self.source[k, first] = x
            self.source[k, second] = x[own] if k == 2 else x[own] * self.source.dtype.type(257) + within
        if unknown:
            # a word of even length ends with a pair of blanks, one of odd length with a half pair
            letters = np.frombuffer(b"".join([w + (b" " if len(w) % 2 else b"  ") for w in unknown]), np.uint8).reshape(-1, 2).astype(np.int64)
            pair = letters[:, 0] * 256 + letters[:, 1]
            at = np.arange(len(pair)) - np.repeat(np.cumsum(spelled) - spelled, spelled)  # place in the word
            put = np.repeat((first + deep)[ids < 0] + 1, spelled) + at
            self.cls[put] = code.pair_cls[pair]
            self.tail[put] = code.pair_tail[pair]
            self.text[put] = np.repeat(text[ids < 0], spelled)
            for k in range(4):
                shifted = np.concatenate([np.zeros(k + 1, np.int64), pair[:max(0, len(pair) - k - 1)] + 1])[:len(pair)]
                self.source[k, put] = np.where(at > k, shifted, 0)
            self.source[3, put] += np.minimum(at, 15) << 17
        starts = np.searchsorted(self.text, np.arange(len(sizes)))
        self.place = np.arange(total) - starts[self.text] if total else np.zeros(0, np.int64)
        if not words:  # spelling only: leave the escapes out
            self.take(np.flatnonzero(self.kind == 1))

    def take(self, at: np.ndarray) -> None:
        self.kind, self.cls, self.tree, self.tail, self.text, self.place = (x[at] for x in (self.kind, self.cls, self.tree, self.tail, self.text, self.place))
        self.source = self.source[:, at]

    def blocks(self, rows: slice, bits: int) -> list[np.ndarray]:
        """For each context the first slots (2, symbols) of the halves of the tree."""
        return [lines << 4 for lines in self.lines(rows, bits)]

    def lines(self, rows: slice, bits: int) -> list[np.ndarray]:
        """For each context the blocks of 16 slots (2, symbols) of the halves of the tree."""
        a, b, c, d = (self.source[k, rows].astype(np.uint64) for k in range(4))
        kind = self.kind[rows].astype(np.uint64) * M[4]
        one = (a + kind + np.uint64(1)) * M[0]
        two = (one ^ (one >> np.uint64(32)) ^ (b * M[1])) * M[2]
        three = (two ^ (two >> np.uint64(29)) ^ (c * M[3])) * M[0]
        skip = (b + kind + np.uint64(7)) * M[3]
        classes = (d + kind + np.uint64(3)) * M[1]
        half = ((self.cls[rows] >> 4).astype(np.uint64) + np.uint64(1)) * M[2]
        shift, out = np.uint64(64 - (bits - 4)), []
        for h in (one, two, three, skip, classes):
            h ^= h >> np.uint64(31)
            both = np.empty((2, len(h)), np.int64)
            both[0] = (h * M[1]) >> shift
            both[1] = ((h ^ half) * M[3]) >> shift
            out.append(both)
        return out


def slot_table(counts: np.ndarray) -> np.ndarray:
    """One 16-bit entry per slot: the logistic prediction; the first of 16 tells how often its block was seen.

    counts: how often each of the 16 outcomes of half a tree followed, block by block.
    """
    level = counts.reshape(-1, 16).astype(np.float32)
    entry = np.empty((len(level), 16), np.int16)
    for first in (8, 4, 2, 1):  # nodes of a depth; ``level`` holds the counts of their outcomes
        pair = level.reshape(len(level), first, 2)
        entry[:, first:2 * first] = np.clip(logit_counts(pair[:, :, 0], pair[:, :, 1]) * SCALE, -32767, 32767)
        level = pair.sum(axis=2)
    entry[:, 0] = np.digitize(level[:, 0], (1, 4, 32))
    return entry.reshape(-1)


class State:
    """Mixing weights (inputs, gates) and the refinement table."""

    def __init__(self):
        start = np.array([0.35, 0.35, 0.3, 0.15, 0.15, 0.05, 0.1, 0.0], np.float32)
        self.weights = np.repeat(start[:, None], GATES, axis=1)
        centre = (np.arange(BUCKETS, dtype=np.float32) - BUCKETS / 2 + 0.5) * (16 / BUCKETS)
        self.refined = np.tile(1 / (1 + np.exp(-centre)), KINDS).astype(np.float32)


class Model:
    """Broadcast to the tasks: the code and the context tables."""

    def __init__(self, code: Code, bits: int, tables: list[np.ndarray]):
        self.code, self.bits, self.tables = code, bits, tables

    def nats(self, sym: Symbols, texts: int, state: State, learned: list | None = None) -> np.ndarray:
        """Nats of each text, every one from its own copy of the state.

        With ``learned``, the states the texts end with, weighted by their use,
        are added to it.
        """
        code, bits = self.code, self.bits
        sizes = np.bincount(sym.text, minlength=texts)
        rank, by_rank = np.empty(texts, np.int64), np.argsort(-sizes, kind="stable")
        rank[by_rank] = np.arange(texts)  # texts with symbols left come first
        cuts = steps(int(sizes.max(initial=0)))
        own, n_all = rank[sym.text], len(sym.cls)
        first = np.cumsum(sizes[by_rank]) - sizes[by_rank]
        order = np.empty(n_all, np.int64)
        order[first[own] + sym.place] = np.arange(n_all)
        step = (np.searchsorted(cuts, sym.place[order], "right") - 1).astype(np.int16)
        by_step = np.argsort(step, kind="stable")
        order, step = order[by_step], step[by_step]
        sym.take(order)
        own = own[order]
        ends = np.searchsorted(step, np.arange(len(cuts) - 1), "right").tolist()
        weights = [np.tile(w, texts) for w in state.weights]
        refined = np.tile(state.refined, texts)
        # what each text took at each cell: (the lower side + 4, the upper side), read as one number of eight bytes
        taken = np.zeros((texts * TAKEN, 2), np.float32)
        taken[:, 0] = 4
        taken = taken.reshape(-1)
        both_sides = taken.view(np.int64)
        used = np.zeros(texts * GATES, np.float32) if learned is not None else None
        loss = np.bincount(own, sym.tail, texts).astype(np.float64)
        opened = code.free.reshape(-1, 256).take(NODE[:, 4:], axis=1).any(axis=2).reshape(-1)
        shares, tables = 4 * code.share, [t.view("V32") for t in self.tables]
        at = 0
        for end in ends:
            rows, n = slice(at, end), end - at
            at = end
            if not n:
                continue
            # arrays over (decision of the half, halves): all upper halves, then the lower ones in which anything is left to decide
            cls, tree = sym.cls[rows].astype(np.int64), sym.tree[rows].astype(np.int64) * 256
            lower = np.flatnonzero(opened.take(tree + cls))
            which = np.concatenate([np.arange(n), lower])
            half, text, kind, tree = cls.take(which), own[rows].take(which), sym.kind[rows].take(which).astype(np.int64), tree.take(which)
            half[n:] += 256
            live = int(text[:n].max()) + 1
            node = STOP.take(half, axis=1)
            node += tree
            cell = CELL.take(node)
            cell += text * TAKEN
            share = shares.take(node)
            sides = both_sides.take(cell).view(np.float32).reshape(4, len(half), 2)
            under = sides[:, :, 0] - share
            share += sides[:, :, 1]
            share /= under
            x = [code.base.take(node), np.log(share, out=share)]
            # a block is read whole, then its slots; entries keep their scale, which the weights undo (a power of two)
            slot = PLACE.take(half, axis=1)
            slot += np.arange(0, 16 * len(half), 16)
            gate = text * GATES + kind * 16
            for k, lines in enumerate(sym.lines(rows, bits)):
                found = tables[k].take(np.concatenate([lines[0], lines[1].take(lower)])).view(np.int16)
                if k < 2:
                    gate += found[::16].astype(np.int64) * (4, 1)[k]
                x.append(found.take(slot).astype(np.float32))
            mixed = x[0] * weights[0].take(gate)
            for k in range(1, INPUTS - 1):
                w = weights[k].take(gate)
                mixed += x[k] * (w if k < 2 else w * (1 / SCALE))
            mixed += np.float32(0.3) * weights[-1].take(gate)
            np.clip(mixed, -LIMIT, LIMIT, out=mixed)
            p = 1 / (1 + np.exp(-mixed))
            mixed *= np.float32(BUCKETS / 16)
            mixed += np.float32(BUCKETS / 2)
            bucket = mixed.astype(np.int64)
            bucket += (text * KINDS + kind) * BUCKETS
            final = np.float32(0.4) * refined.take(bucket)
            final += np.float32(0.6) * p
            np.clip(final, np.float32(1e-5), np.float32(1 - 1e-5), out=final)
            free, bit = code.free.take(node), BIT.take(half, axis=1)
            cost, err = np.log(np.abs(1 - bit - final)), bit - p
            cost *= free
            err *= free
            bit *= free
            loss[:live] -= np.bincount(text, cost.sum(axis=0), live)
            # learn, where the symbols came by
            gates, width = live * GATES, live * KINDS * BUCKETS
            uses = np.bincount(gate, minlength=gates)
            met = np.flatnonzero(uses)
            slot = np.empty(gates, np.int64)
            slot[met] = np.arange(len(met))
            slot = slot.take(gate)
            rate = (RATE / np.sqrt(1 + uses.take(met))).astype(np.float32)
            scaled = rate * (1 / SCALE)
            for k, (w, values) in enumerate(zip(weights, x, strict=False)):
                values *= err
                w[met] += (rate if k < 2 else scaled) * np.bincount(slot, values.sum(axis=0), len(met))
            weights[-1][met] += rate * np.bincount(slot, np.float32(0.3) * err.sum(axis=0), len(met))
            bucket = bucket.reshape(-1)
            hits, ones = np.bincount(bucket, free.reshape(-1), width), np.bincount(bucket, bit.reshape(-1), width)
            met = np.flatnonzero(hits)
            hits, before = hits.take(met), refined.take(met)
            refined[met] = before + ((ones.take(met) - hits * before) / (hits + 60)).astype(np.float32)
            cell *= 2
            cell += TURN.take(half, axis=1)
            np.add.at(taken, cell.reshape(-1), np.float32(1))
            if used is not None:
                used[:gates] += uses
        if learned is not None:
            by_gate = used.reshape(texts, GATES)
            both = np.stack([(w.reshape(texts, GATES) * by_gate).sum(axis=0, dtype=np.float64) for w in weights])
            learned.append((both, by_gate.sum(axis=0, dtype=np.float64), (refined.reshape(texts, -1) * sizes[by_rank][:, None]).sum(axis=0, dtype=np.float64), float(sizes.sum())))
        return loss[rank]


def average(learned: list, start: State) -> State:
    """The mean of learned states by their use; what no text used stays as it was."""
    out = State()
    if learned:
        both, use, refined, n = (sum(x[k] for x in learned) for k in range(4))
        out.weights = np.where(use > 0, both / np.maximum(use, 1), start.weights).astype(np.float32)
        out.refined = (refined / max(n, 1)).astype(np.float32) if n else start.refined
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    name = F.col(id_col).cast("string").cast("binary")
    fold = F.coalesce(F.pmod(F.crc32(name), F.lit(10)), F.lit(1))
    tune = F.coalesce(F.pmod(F.xxhash64(name), F.lit(TUNE)), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), (fold == 0).alias("held"),
                       ((fold != 0) & (tune == 0)).alias("tune"))


def binary_array(offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def split_words(texts: list) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, an end after each text, without Python objects, and how many each text has."""
    flat = np.frombuffer(b"   ".join([*(t or b"" for t in texts), b""]).translate(BLANKS), np.uint8).copy()
    ends = np.cumsum(np.fromiter((len(t or b"") + 3 for t in texts), np.int64, len(texts))) - 2
    inside = ~GAPS.take(flat)
    flat[ends], inside[ends] = END[0], True
    change = np.flatnonzero(np.diff(inside, prepend=False))
    starts = change[0::2]
    words = binary_array(np.append(0, np.cumsum(change[1::2] - starts)), flat[inside])
    return words, np.diff(np.searchsorted(starts, ends), prepend=-1)


def groups(batches, column: int):
    """Row batches joined to groups of about ``GROUP`` words: (batches, words, sizes)."""
    held, words, sizes = [], [], []
    for b in batches:
        own, n = split_words(b.column(column).to_pylist())
        held.append(b)
        words.append(own)
        sizes.append(n)
        if sum(map(len, words)) >= GROUP or sum(map(len, sizes)) >= TEXTS:
            yield held, pa.concat_arrays(words), np.concatenate(sizes)
            held, words, sizes = [], [], []
    if held:
        yield held, pa.concat_arrays(words), np.concatenate(sizes)


def count_words(train: DataFrame) -> DataFrame:
    """Rows (word, c) over all training texts, written to the shared folder."""

    def counted(texts: list) -> pa.RecordBatch:
        counts = pc.value_counts(split_words(texts)[0])
        return pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()), counts.field(1)], names=["word", "c"])

    def run(batches):
        texts, size = [], 0
        for b in batches:
            texts += b.column(0).to_pylist()
            size += b.column(0).nbytes
            if size >= TEXT_BYTES:
                yield counted(texts)
                texts, size = [], 0
        if texts:
            yield counted(texts)

    return materialize(train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def look_up(index: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Ids of words (-1 unknown), and the unknown words in order."""
    ids = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
    return ids, [words[i] for i in np.flatnonzero(ids < 0).tolist()]


def _pack(n: np.ndarray) -> bytes:
    """Counts as bytes; those over 254 follow with their places."""
    big = np.flatnonzero(n > 254).astype("<u4")
    small = np.minimum(n, 255).astype(np.uint8)
    return small.tobytes() + big.tobytes() + n[big].astype("<u4").tobytes()


def _add(total: np.ndarray, raw: bytes) -> None:
    size = len(total)
    total += np.frombuffer(raw, np.uint8, size)
    big = np.frombuffer(raw, "<u4", offset=size).reshape(2, -1)
    total[big[0]] += big[1] - 255


def context_tables(train: DataFrame, rare: DataFrame, shared, bits: int) -> list[np.ndarray]:
    """Slot tables of the contexts, counted over the texts and, once each, the spellings of vocabulary words.

    Unseen words are spelled like the known ones, so these teach the spelling.
    """
    schema = "tab int, chunk int, raw binary"
    step = min(CHUNK, 1 << bits)

    def rows(items):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in items], pa.int32()), pa.array([x[1] for x in items], pa.int32()),
                                           pa.array([x[2] for x in items], pa.binary())], names=["tab", "chunk", "raw"])

    def counter(spell: bool):
        def run(batches):
            code = shared.value
            tables = [np.zeros(1 << bits, np.uint32) for _ in range(CONTEXTS)]
            one = np.uint32(1)

            def add(sym: Symbols):
                for at in range(0, len(sym.cls), 1 << 15):
                    part = slice(at, at + (1 << 15))
                    cls = sym.cls[part]
                    outcome = np.stack([cls >> 4, cls & 15])
                    for t, block in zip(tables, sym.blocks(part, bits), strict=True):
                        np.add.at(t, (block + outcome).reshape(-1), one)

            if spell:
                for b in batches:
                    words = b.column(0).to_pylist()
                    add(Symbols(code, np.full(len(words), -1, np.int32), np.ones(len(words), np.int64), words, words=False))
            else:
                for _, words, sizes in groups(batches, 0):
                    ids, unknown = code.find(words)
                    add(code.symbols(ids, sizes, unknown))
            for i, t in enumerate(tables):
                for c in range(len(t) // step):
                    piece = t[c * step:(c + 1) * step]
                    if piece.any():
                        yield rows([(i, c, _pack(piece))])
        return run

    def total(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for tab, chunk, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _add(sums.setdefault((tab, chunk), np.zeros(step, np.uint32)), raw)
        for (tab, chunk), n in sums.items():
            yield rows([(tab, chunk, slot_table(n).tobytes())])

    cores = max(1, train.sparkSession.sparkContext.defaultParallelism)
    found = train.select("text").coalesce(cores).mapInArrow(counter(False), schema).unionByName(
        rare.select("word").coalesce(max(1, cores // 4)).mapInArrow(counter(True), schema))
    whole = materialize(found.repartition("tab", "chunk").mapInArrow(total, schema), "tables")
    out = [np.zeros(1 << bits, np.int16) for _ in range(CONTEXTS)]
    for r in whole.toLocalIterator():  # at most CONTEXTS * 2**MAX_BITS slots of two bytes
        out[r["tab"]][r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["raw"], np.int16)
    return out


def fit_code(words: DataFrame, n_total: int, vocab: int) -> tuple[Code, DataFrame]:
    """The code, and the vocabulary's words other than the end."""
    least = 1
    if words.count() > vocab:  # the least count that leaves at most ``vocab`` words
        sizes = words.groupBy("c").count().orderBy(F.desc("c"))
        room = vocab
        for r in sizes.toLocalIterator():  # few distinct counts
            room -= r["count"]
            if room < 0:
                break
            least = r["c"]
    top = words.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toArrow()  # at most ``vocab`` + 1 rows
    names, counts = top.column("word").to_pylist(), top.column("c").to_numpy().tolist()
    if END not in names:
        names, counts = [*names, END], [*counts, 1]
    pairs = np.zeros(PAIRS, np.int64)

    def tally(batches):
        n = np.zeros(PAIRS, np.int64)
        for b in batches:
            words = [w + (b" " if len(w) % 2 else b"  ") for w in b.column(0).to_pylist()]
            spelled = np.frombuffer(b"".join(words), ">u2")
            times = np.repeat(b.column(1).to_numpy(), [len(w) // 2 for w in words])
            n += np.bincount(spelled, times, PAIRS).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["b", "n"])

    # words never seen are like those seen once: these stand for the escape and teach its pairs, beside what the vocabulary leaves out
    rare = words.where(((F.col("c") < least) | (F.col("c") == 1)) & (F.col("word") != F.lit(END)))
    once = words.where((F.col("c") == 1) & (F.col("word") != F.lit(END))).count() if least == 1 else 0
    for r in rare.select("word", "c").mapInArrow(tally, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[r["b"]] += r["n"]
    return Code(names, counts, n_total - sum(counts) + once, pairs), words.where((F.col("c") >= least) & (F.col("word") != F.lit(END)))


def fit_state(tune: DataFrame, shared) -> State:
    """Starting weights and refinement: tasks learn on the tuning texts, their states are averaged."""
    state = State()

    def learn(start: State):
        def run(batches):
            model, here = shared.value, start
            for _ in [0]:
                every = []
                for _, words, sizes in groups(batches, 0):
                    ids, unknown = model.code.find(words)
                    learned: list = []
                    model.nats(model.code.symbols(ids, sizes, unknown), len(sizes), here, learned)
                    here = average(learned, here)
                    every += learned
                for both, use, refined, n in every:
                    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([both.reshape(-1), use, refined, [n]]).tobytes()], pa.binary())], names=["raw"])
        return run

    for _ in range(TUNE_ROUNDS):
        learned = []
        for r in tune.select("text").mapInArrow(learn(state), "raw binary").toLocalIterator():  # a few kB for each GROUP of words
            flat = np.frombuffer(r["raw"], np.float64)
            w = INPUTS * GATES
            learned.append((flat[:w].reshape(INPUTS, GATES), flat[w:w + GATES], flat[w + GATES:-1], flat[-1]))
            if len(learned) > 64:
                learned = [tuple(sum(x[k] for x in learned) for k in range(4))]
        state = average(learned, state)
    return state


def score_texts(docs: DataFrame, bits: int | None = None, vocab: int = VOCAB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    ``n_bytes`` counts what is coded: the lower-cased words, each with a blank,
    and the end. ``bits`` sets the tables' size instead of ``table_bits``.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = _texts(docs, id_col, text_col)
    train = texts.where("NOT held")
    words = count_words(train)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bits = bits or table_bits(total)
    code, vocabulary = fit_code(words, total, vocab)
    sent = spark.sparkContext.broadcast(code)
    shared = spark.sparkContext.broadcast(Model(code, bits, context_tables(train.where("NOT tune"), vocabulary, sent, bits)))
    state = fit_state(texts.where("tune"), shared)
    schema = (f"row long, id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, nats double, "
              "n_bytes long, rest array<binary>")
    names = [f.split()[0] for f in schema.split(", ")]
    trained = bool(total)

    def run(batches):
        model = shared.value
        logs = np.log10(model.code.counts + 0.1)
        row = TaskContext.get().partitionId() << 33
        for held, words, sizes in groups(batches, 1):
            ids, unknown = model.code.find(words)
            n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            nats = model.nats(model.code.symbols(ids, sizes, unknown), n, state)
            n_bytes = np.bincount(text, pc.binary_length(words).to_numpy() + 1, n).astype(np.int64) - 1
            inside = ids >= 0 if trained else np.zeros(len(ids), bool)
            rest = words.filter(pa.array(~inside)).cast(pa.binary())
            known = np.bincount(text[inside], minlength=n)
            base = np.bincount(text[inside], logs[ids[inside]], n)
            offsets = np.concatenate([[0], np.cumsum(sizes - known)]).astype(np.int32)
            arrays = [pa.array(np.arange(row, row + n)), pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(2) for b in held]), pa.array(sizes),
                      pa.array(known), pa.array(base), pa.array(nats), pa.array(n_bytes), pa.ListArray.from_arrays(pa.array(offsets), rest)]
            row += n
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    seen = materialize(texts.select("id", "text", "held").mapInArrow(run, schema), "scored")
    rest = seen.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
    rest = rest.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rest_base"))
    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    ln10 = float(np.log(10))
    return seen.drop("rest").join(rest, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), (-F.col("nats") / ln10).alias("score"),
        "n_bytes", (F.col("nats") / float(np.log(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
