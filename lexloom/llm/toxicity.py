"""Toxicity scores from a convolutional text classifier trained in numpy.

Words are lower-cased runs of letters and digits, hashed into ``BUCKETS``
buckets; buckets seen in fewer than ``MIN_DOCS`` training documents share the
zero vector. Filters of several widths run over the word vectors, each is
max-pooled over the whole text, and a logistic layer reads the maxima. Gradients
flow through the maxima only. A two-parameter calibration and one threshold per
language are fitted on a fold of the training rows that a first network never
saw; the final network is trained alike on all training rows and keeps them, as
is usual where a calibrator is fitted on held-out predictions and the model on
all rows (one network on four fifths, calibrated by itself, finds fewer toxic
texts: recall 0.70 instead of 0.73 on the 0.1 data at the same precision).

Training uses a bounded sample: at most ``sample`` toxic and ``sample`` other
labelled rows, among those of at most ``sample_bytes`` bytes (parameters), picked
by a hash of the id. Ids are of any type. Other columns are ignored or kept
unchanged, whatever their names; an empty table gives no rows. Scoring reads every whole text: a filter's response at a window is a sum
of table rows, and long texts are pooled piece by piece.

Labels, language, source and id are never inputs of a score; the language only
selects the threshold that turns a score into a rejection. Null and empty texts
are scored as texts without words; null or other labels are ignored; without
labelled rows of both kinds every score is the share of toxic labels (0 if
there are none). Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lower_words, materialize, prepare

#: Hashed embeddings: words of one bucket share a vector.
BUCKETS = 1 << 18
MIN_DOCS = 3
WIDTHS = (1, 2, 3)
FILTERS = 12
DIM = 16
PIECE = 1 << 15
BATCH_WORDS = 1 << 16
PAD = max(WIDTHS) - 1
#: Words that a task learns from at once and in all, and that the starting network learns from.
GROUP_WORDS = 1 << 21
TASK_WORDS = 1 << 23
START_WORDS = 1 << 20
START_EPOCHS = 4
ROUNDS = 2
#: Embedding rows that are summed together, and numbers of each: moves of the vector and of its squared gradients' logarithm, and how often it moved.
CHUNK = 512
SUMMED = DIM + 2
#: Logits are summed in cells of this width for the calibration; thresholds are tried on GRID.
CELL = 1 / 256
GRID = np.linspace(0.2, 0.8, 61)


class Rows(dict):
    """Word -> embedding row, through the word's bucket."""

    def __init__(self, row_of: np.ndarray):
        super().__init__()
        self.row_of = row_of

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        row = self[word] = int(self.row_of[bucket(word)])
        return row


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Model:
    """Filters, the embedding rows of seen buckets, calibration and thresholds."""

    def __init__(self, row_of, vectors, filters, biases, out, bias):
        self.row_of, self.vectors, self.filters, self.biases, self.out, self.bias = row_of, vectors, filters, biases, out, bias
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.threshold = 0.5

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.rows = model, Rows(model.row_of)
        self.tables = [[(model.vectors @ model.filters[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS]

    def pooled(self, ids: np.ndarray, starts: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Maxima of all filters over segments; ``real`` marks window starts."""
        out = []
        for w, table, bias in zip(WIDTHS, self.tables, self.model.biases, strict=True):
            n = len(ids) - PAD
            h = table[0][ids[:n]]
            for j in range(1, w):
                h += table[j][ids[j:n + j]]
            h += bias
            np.maximum(h, 0, out=h)
            h[~real[:n]] = 0
            out.append(np.maximum.reduceat(h, starts, axis=0))
        return np.concatenate(out, axis=1)

    def logits(self, texts) -> np.ndarray:
        get = self.rows.__getitem__
        words = (lower_words(t, ALNUM) for t in texts)
        return self.logits_of([np.fromiter(map(get, w), np.int32, len(w)) for w in words])

    def logits_of(self, docs: list[np.ndarray]) -> np.ndarray:
        """Logits of texts given as embedding rows."""
        best = np.zeros((len(docs), FILTERS * len(WIDTHS)), np.float32)
        for owner, ids, starts, real in piled(docs, range(len(docs)), len(docs) + 1):
            np.maximum.at(best, owner, self.pooled(ids, starts, real))
        return best @ self.model.out + self.model.bias

    def scores(self, texts) -> np.ndarray:
        return sigmoid(self.model.scale * self.logits(texts).astype(np.float64) + self.model.shift)


def piled(docs: list[np.ndarray], order, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Piles of texts: (text of each piece, ids, first place of each piece, whether a window starts at a place).

    A pile ends after ``most`` texts or ``BATCH_WORDS`` words. Pieces of a text
    overlap by PAD words, so every window starts in one of them; PAD zeros end the pile.
    """
    owner, ids, starts, real, n, texts = [], [], [], [], 0, 0
    tail = np.zeros(PAD + 1, np.int32)
    for i in order:
        doc = docs[i]
        for at in range(0, max(1, len(doc)), PIECE):
            part = doc[at:at + PIECE + PAD]
            own = min(len(part), PIECE)
            owner.append(i)
            starts.append(n)
            ids += [part, tail]
            real += [np.ones(own, bool), np.zeros(len(part) - own + PAD + 1, bool)]
            n += len(part) + PAD + 1
            if n >= BATCH_WORDS and at + PIECE < len(doc):
                yield np.array(owner), np.concatenate([*ids, tail[1:]]), np.array(starts), np.concatenate([*real, np.zeros(PAD, bool)])
                owner, ids, starts, real, n = [], [], [], [], 0
        texts += 1
        if n >= BATCH_WORDS or texts == most:
            yield np.array(owner), np.concatenate([*ids, tail[1:]]), np.array(starts), np.concatenate([*real, np.zeros(PAD, bool)])
            owner, ids, starts, real, n, texts = [], [], [], [], 0, 0
    if owner:
        yield np.array(owner), np.concatenate([*ids, tail[1:]]), np.array(starts), np.concatenate([*real, np.zeros(PAD, bool)])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Net:
    """A network that learns: embedding rows with their squared gradients, and dense parameters with Adam's moments."""

    def __init__(self, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.vectors = rng.standard_normal((rows + 1, DIM), np.float32) * np.float32(0.1)
        self.vectors[0] = 0
        self.squares = np.full(rows + 1, 1e-3, np.float32)
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS]
        self.dense = [*filters, *(np.zeros(FILTERS) for _ in WIDTHS), rng.normal(0, 0.3, FILTERS * len(WIDTHS)), np.zeros(1)]
        self.moment, self.spread = [np.zeros_like(p) for p in self.dense], [np.zeros_like(p) for p in self.dense]
        self.step = 0.0

    def copy(self) -> Net:
        out = object.__new__(Net)
        out.vectors, out.squares, out.step = self.vectors.copy(), self.squares.copy(), self.step
        out.dense, out.moment, out.spread = ([p.copy() for p in x] for x in (self.dense, self.moment, self.spread))
        return out

    def flat(self) -> np.ndarray:
        """All but the embedding rows, as one array."""
        return np.concatenate([*(p.reshape(-1) for x in (self.dense, self.moment, self.spread) for p in x), [self.step]])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (self.dense, self.moment, self.spread):
            for p in x:
                p[...] = flat[at:at + p.size].reshape(p.shape)
                at += p.size
        self.step = float(flat[at])

    def model(self, row_of: np.ndarray) -> Model:
        k = len(WIDTHS)
        dense = [p.astype(np.float32) for p in self.dense]
        return Model(row_of, self.vectors, dict(zip(WIDTHS, dense[:k], strict=True)), dense[k:2 * k], dense[2 * k], float(self.dense[-1][0]))

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int, rng, used: np.ndarray | None = None, batch: int = 64, rate: float = 0.04) -> None:
        """Run over texts given as embedding rows; ``used`` counts the steps that moved each row."""
        for _ in range(epochs):
            order, at = rng.permutation(len(docs)), 0
            while at < len(order):
                # a step takes ``batch`` texts; long ones come in several piles, of which the maxima are kept
                pick = order[at:at + batch]
                at += len(pick)
                self._step(docs, pick, labels[pick], rate, used)

    def _step(self, docs, pick, labels, rate, used) -> None:
        k = len(WIDTHS)
        filters, biases, out, bias = self.dense[:k], self.dense[k:2 * k], self.dense[2 * k], self.dense[2 * k + 1]
        place = {int(i): n for n, i in enumerate(pick)}
        every = np.concatenate([f[j] for f in filters for j in range(len(f))], axis=1).astype(np.float32)
        top = np.zeros((k, len(pick), FILTERS), np.float32)
        windows = [np.zeros((w, len(pick), FILTERS), np.int32) for w in WIDTHS]
        columns = np.arange(FILTERS)
        for owner, ids, starts, real in piled(docs, pick, len(pick) + 1):
            n = len(ids) - PAD
            part = self.vectors[ids] @ every
            ends = (starts + np.maximum(np.add.reduceat(real, starts, dtype=np.int64), 1)).tolist()
            mine = [place[int(i)] for i in owner]
            c = 0
            for q, w in enumerate(WIDTHS):
                h = part[:n, c:c + FILTERS].copy()
                for j in range(1, w):
                    h += part[j:n + j, c + j * FILTERS:c + (j + 1) * FILTERS]
                c += w * FILTERS
                h += biases[q].astype(np.float32)
                for m, s, e in zip(mine, starts.tolist(), ends, strict=True):
                    pos = s + h[s:e].argmax(axis=0)
                    got = h[pos, columns]
                    better = got > top[q, m]
                    top[q, m, better] = got[better]
                    for j in range(w):
                        windows[q][j, m, better] = ids[pos[better] + j]
        pooled = np.concatenate(list(top), axis=1).astype(np.float64)
        err = (sigmoid(pooled @ out + bias) - labels) / len(pick)
        grads, bias_grads, rows, row_grads = [], [], [], []
        for q, w in enumerate(WIDTHS):
            g = err[:, None] * out[q * FILTERS:(q + 1) * FILTERS] * (top[q] > 0)
            bias_grads.append(g.sum(axis=0))
            grads.append(np.stack([np.einsum("bf,bfd->df", g, self.vectors[windows[q][j]]) for j in range(w)]))
            for j in range(w):
                rows.append(windows[q][j].ravel())
                row_grads.append((g[:, :, None] * filters[q][j].T[None]).reshape(-1, DIM))
        self.step += 1
        for p, g, m, v in zip(self.dense, [*grads, *bias_grads, pooled.T @ err + 1e-4 * out, np.array([err.sum()])], self.moment, self.spread, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.5 * rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        rows, row_grads = np.concatenate(rows), np.concatenate(row_grads)
        moved = np.abs(row_grads).max(axis=1) > 0
        unique, inverse = np.unique(rows[moved], return_inverse=True)
        total = np.zeros((len(unique), DIM))
        np.add.at(total, inverse, row_grads[moved])
        self.squares[unique] += (total * total).mean(axis=1)
        self.vectors[unique] -= 5 * rate * total / np.sqrt(self.squares[unique])[:, None]
        self.vectors[0] = 0
        if used is not None:
            used[unique] += 1


def rows_of(seen: np.ndarray) -> np.ndarray:
    """Embedding row of each bucket, from the number of texts it was seen in."""
    often = np.flatnonzero(seen >= MIN_DOCS)
    out = np.zeros(BUCKETS, np.int32)
    out[often] = np.arange(1, len(often) + 1)
    return out


class Buckets(dict):
    """Word -> bucket."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = bucket(word)
        return out


def hashed(text: str, known: Buckets) -> np.ndarray:
    words = lower_words(text, ALNUM)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def train(texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.04, seed: int = 7) -> Model:
    """Fit the network on a list of texts with 0/1 labels."""
    known, seen = Buckets(), np.zeros(BUCKETS, np.int64)
    docs = [hashed(t, known) for t in texts]
    for d in docs:
        seen[np.unique(d)] += 1
    row_of = rows_of(seen)
    net = Net(int(row_of.max()), seed)
    net.learn([row_of[d] for d in docs], labels, epochs, np.random.default_rng(seed), None, batch, rate)
    return net.model(row_of)


def packed(ids: np.ndarray) -> bytes:
    """Bucket numbers of 18 bits: all lower halves, then the upper bits of four in a byte."""
    high = (ids >> 16).astype(np.uint8)
    high = np.concatenate([high, np.zeros(-len(high) % 4, np.uint8)]).reshape(-1, 4)
    return (ids & 65535).astype("<u2").tobytes() + (high[:, 0] | high[:, 1] << 2 | high[:, 2] << 4 | high[:, 3] << 6).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    high = np.frombuffer(raw, np.uint8, offset=2 * n)
    high = np.stack([high >> k & 3 for k in (0, 2, 4, 6)], axis=1).reshape(-1)[:n]
    return np.frombuffer(raw, "<u2", n).astype(np.int32) | high.astype(np.int32) << 16


def tokens(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (k, y, lang, held, n, raw): each labelled document's words as bucket numbers, written once."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("string").alias("k"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    texts = texts.where("k IS NOT NULL").where(fold(F.col("k"), 5) != 0)

    def run(batches):
        known = Buckets()
        for b in batches:
            ids = [hashed(t, known) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, ids)), pa.int64()), pa.array(list(map(packed, ids)), pa.binary())],
                                             names=["k", "lang", "n", "raw"])

    # always by a shuffle of the numbers, so that work and disk grow in proportion to the table
    found = texts.mapInArrow(run, "k string, lang string, n long, raw binary").join(marked.hint("merge"), "k")
    held = fold(F.col("k"), 5) == 1
    return materialize(found.select("k", F.col("y").cast("double").alias("y"), "lang", held.alias("held"), "n", "raw").sortWithinPartitions(F.xxhash64("k"), "k", "n"), "tokens")


def piece(net: int, chunk: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([net], pa.int32()), pa.array([chunk], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["part", "chunk", "raw"])


PIECES = "part int, chunk int, raw binary"


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Texts in which each bucket was seen (2, BUCKETS): without the fold that calibrates, and with it."""
    width = 1 << 14

    def run(batches):
        seen = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            for held, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen[int(held), np.unique(unpacked(raw, n))] += 1
        for part in (0, 1):
            for chunk in range(0, BUCKETS, width):
                if seen[part, chunk:chunk + width].any():
                    yield piece(part, chunk, seen[part, chunk:chunk + width])

    def total(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for part, chunk, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sums.setdefault((part, chunk), np.zeros(width, np.int64))[:] += np.frombuffer(raw, np.int32)
        for (part, chunk), n in sums.items():
            yield piece(part, chunk, n)

    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows.select("held", "n", "raw").mapInArrow(run, PIECES).repartition("part", "chunk").mapInArrow(total, PIECES).collect():  # 2 * BUCKETS numbers
        out[r["part"], r["chunk"]:r["chunk"] + width] = np.frombuffer(r["raw"], np.int64)
    out[1] += out[0]
    return out


def a_round(rows: DataFrame, net: Net, row_of: np.ndarray, epochs: int, rate: float, seed: int) -> None:
    """Each task runs over its rows from ``net``, which then moves by the mean of their moves."""
    shared = rows.sparkSession.sparkContext.broadcast((net, row_of))

    def run(batches):
        start, place = shared.value
        mine, used = start.copy(), np.zeros(len(start.vectors), np.float32)
        rng, seen = np.random.default_rng([seed, TaskContext.get().partitionId()]), 0
        docs, y, words = [], [], 0

        def learn():
            nonlocal docs, y, words, seen
            if docs:
                mine.learn([place[d] for d in docs], np.array(y), epochs, rng, used, rate=rate)
            seen, docs, y, words = seen + len(docs), [], [], 0

        for b in batches:
            for label, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append(unpacked(raw, n))
                y.append(label)
                words += n
                if words >= GROUP_WORDS:
                    learn()
        learn()
        if not seen:
            return
        yield piece(0, -1, np.append(mine.flat(), seen))
        for at in range(0, len(used), CHUNK):
            here = slice(at, at + CHUNK)
            if used[here].any():
                moves = [mine.vectors[here] - start.vectors[here], np.log(mine.squares[here] / start.squares[here])[:, None], used[here, None]]
                yield piece(0, at, np.clip(np.concatenate(moves, axis=1), -65000, 65000).astype(np.float16))

    def mean(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = np.frombuffer(raw).reshape(1, -1).copy() if chunk < 0 else np.frombuffer(raw, np.float16).reshape(-1, SUMMED).astype(np.float64)
                own[:, :-1] *= own[:, -1:]
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        for chunk, total in sums.items():
            total = total[:, :-1] / np.maximum(total[:, -1:], 1)
            yield piece(0, chunk, total if chunk < 0 else total.astype(np.float16))

    moved = rows.select("y", "n", "raw").mapInArrow(run, PIECES).repartition("part", "chunk").mapInArrow(mean, PIECES)
    for r in moved.collect():  # one network
        if r["chunk"] < 0:
            net.put(np.frombuffer(r["raw"]))
        else:
            moves = np.frombuffer(r["raw"], np.float16).reshape(-1, SUMMED - 1).astype(np.float32)
            net.vectors[r["chunk"]:r["chunk"] + CHUNK] += moves[:, :-1]
            net.squares[r["chunk"]:r["chunk"] + CHUNK] *= np.exp(moves[:, -1])
    shared.destroy()


def network(rows: DataFrame, row_of: np.ndarray, words: int) -> Net:
    """A network that learned from all ``rows``, which have about ``words`` words."""
    net = Net(int(row_of.max()), 7)
    if words <= GROUP_WORDS:
        a_round(rows.coalesce(1), net, row_of, 10, 0.04, 0)
        return net
    share = F.pmod(F.xxhash64("k", F.lit(1)), F.lit(-(-words // START_WORDS))) == 0
    a_round(rows.where(share).coalesce(1), net, row_of, START_EPOCHS, 0.04, 0)
    for n in range(ROUNDS):
        a_round(rows.coalesce(-(-words // TASK_WORDS)), net, row_of, 1, 0.04 / 2**n, n + 1)
    return net


def calibrate(model: Model, held: DataFrame) -> None:
    """Platt scaling, then one threshold per language, on all rows of the fold not used in training."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def logits(batches):
        scorer, place = shared.value.scorer(), shared.value.row_of
        for b in batches:
            z = scorer.logits_of([place[unpacked(r, n)] for n, r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z.astype(np.float64))], names=["y", "lang", "z"])

    scored = materialize(held.select("y", "lang", "n", "raw").mapInArrow(logits, "y double, lang string, z double"), "logits")
    cells = scored.groupBy("y", F.floor(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("z"))) / CELL).alias("cell")).agg(F.count("*").alias("n"), F.avg("z").alias("z"))
    found = cells.orderBy("y", "cell").collect()  # at most 2 * 120 / CELL rows
    z, labels, weights = (np.array([r[c] for r in found], float) for c in ("z", "y", "n"))
    weights = weights / weights.mean()
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = sigmoid(a * z + b)
        grad = x.T @ (weights * (labels - p)) - np.array([1e-3 * (a - 1), 0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        da, db = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + da, b + db
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    scale, shift = model.scale, model.shift

    def reached(batches):
        for r in batches:  # thresholds that each row's score reaches
            n = np.searchsorted(GRID, sigmoid(scale * r.column(2).to_numpy() + shift), "right")
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(n.astype(np.int32))], names=["y", "lang", "reached"])

    counts = scored.mapInArrow(reached, "y double, lang string, reached int").groupBy("lang", "y", "reached").agg(F.count("*").alias("n"))
    counts = materialize(counts, "reached")
    enough = counts.groupBy("lang").agg(*(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)))
    enough = enough.where("lang IS NOT NULL AND n0 >= 10 AND n1 >= 10").select("lang")
    whole, own = np.zeros((2, len(GRID) + 1)), {}
    for r in counts.groupBy("y", "reached").agg(F.sum("n").alias("n")).collect():
        whole[int(r["y"]), r["reached"]] = r["n"]
    for r in counts.join(enough, "lang").collect():  # at most 124 rows a language
        own.setdefault(r["lang"], np.zeros_like(whole))[int(r["y"]), r["reached"]] = r["n"]
    model.threshold = best_threshold(whole, 0.5)
    model.thresholds = {lang: best_threshold(n, model.threshold) for lang, n in sorted(own.items())}


def best_threshold(counts: np.ndarray, default: float) -> float:
    """The middle of the best range of thresholds by accuracy; few rows: ``default``.

    counts (2, GRID + 1): rows of each label by the number of thresholds their score reaches.
    """
    if (counts.sum(axis=1) < 10).any():
        return default
    below = np.cumsum(counts, axis=1)[:, :-1]  # rows that do not reach each threshold
    right = below[0] + counts[1].sum() - below[1]
    best = np.flatnonzero(right >= right.max() - 1e-9)
    near = best[np.argmin(np.abs(GRID[best] - 0.5))]
    run = best[np.cumsum(np.diff(best, prepend=best[0] - 1) != 1) == np.cumsum(np.diff(best, prepend=best[0] - 1) != 1)[best == near][0]]
    return float((GRID[run[0]] + GRID[run[-1]]) / 2)


def fold(id_col: Column, of: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(of)), F.lit(1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Train on all labelled rows whose fold of 5 is not 0; fold 1 calibrates. Ids of any type."""
    prepare(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("string").alias("k"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND k IS NOT NULL")
    marked = marked.where(fold(F.col("k"), 5) != 0).groupBy("k").agg(F.max("y").alias("y"))
    rows = tokens(docs, marked, id_col, text_col, lang_col)
    found = {(int(r["y"]), r["held"]): r for r in rows.groupBy("y", "held").agg(F.count("*").alias("n"), F.sum("n").alias("words")).collect()}
    if len({y for y, _ in found}) < 2:
        shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
        rate = float(shares.get(1, 0) / max(1, sum(shares.values())))
        empty = Model(np.zeros(BUCKETS, np.int32), np.zeros((1, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS},
                      [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)
        empty.shift = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
        return empty
    places, words = [rows_of(n) for n in bucket_counts(rows)], sum(r["words"] for r in found.values())
    first = None
    if len(found) == 4:  # else too few to calibrate on rows of their own
        first = network(rows.where("NOT held"), places[0], words - sum(r["words"] for (_, held), r in found.items() if held)).model(places[0])
        calibrate(first, rows.where("held"))
        first.row_of = first.vectors = None
    model = network(rows, places[1], words).model(places[1])
    if first is not None:
        model.scale, model.shift, model.threshold, model.thresholds = first.scale, first.shift, first.threshold, first.thresholds
    return model


def scored(docs: DataFrame, model: Model, out_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus a score column."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # at most BUCKETS vectors

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for t in texts:
            yield pd.Series(scorer.scores(t.tolist()))

    return docs.withColumn(out_col, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def threshold(model: Model, lang: Column) -> Column:
    """The rejection threshold of a row's language."""
    out = F.lit(model.threshold)
    for name, t in sorted(model.thresholds.items()):
        out = F.when(lang == name, t).otherwise(out)
    return out


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` below their language's threshold, columns unchanged."""
    name = "score"
    while name in docs.columns:
        name += "_"
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return scored(docs, model, name, text_col).where(F.col(name) < threshold(model, lang)).drop(name)
