import math
import random
import zlib
from collections import Counter

import numpy as np

from lexloom.llm import lm_mixing, toxicity
from lexloom.llm.common import BLANKS, lower_words

from . import fixtures


def auc(scores, labels):
    order = sorted(zip(scores, labels, strict=True))
    ranks = sum(i for i, (_, y) in enumerate(order) if y)
    pos = sum(labels)
    return (ranks - pos * (pos - 1) / 2) / (pos * (len(labels) - pos))


def synthetic():
    rng = random.Random(9)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["bad", "worse", "worst"]))
        rows.append((i, " ".join(w), y, rng.choice(["en", "fr"])))
    return rows


def test_planted_words_are_learned(spark):
    rows = synthetic()
    docs = spark.createDataFrame([(i, t, lang) for i, t, _, lang in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in toxicity.scored(docs, model, "s").collect()}
    held = [(got[i], y) for i, _, y, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(*zip(*held, strict=True)) > 0.97
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.93
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert sum(y for i, _, y, _ in rows if i in kept) <= 0.1 * sum(y for _, _, y, _ in rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_long_texts_are_pooled_whole(spark):
    rows = synthetic()
    model = toxicity.train([t for _, t, _, _ in rows], np.array([y for _, _, y, _ in rows], float), epochs=2)
    rng = random.Random(1)
    words = [f"w{rng.randrange(400)}" for _ in range(3 * toxicity.PIECE + 5)]
    for at in (0, toxicity.PIECE - 1, toxicity.PIECE, len(words) - 1):
        text = " ".join(words[:at] + ["worst"] + words[at:])
        scorer = model.scorer()
        ids = [scorer.rows[w] for w in lower_words(text, toxicity.ALNUM)]
        whole = scorer.pooled(np.array(ids + [0] * (2 * toxicity.PAD + 1)), np.array([0]), np.array([True] * len(ids) + [False] * (2 * toxicity.PAD + 1)))
        assert np.allclose(scorer.logits([text]), whole @ model.out + model.bias, atol=1e-4)


def test_long_labelled_texts_are_learned(spark):
    """All toxic texts are longer than 16 KB; every labelled row of the training folds is counted."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        w = [f"w{rng.randrange(400)}" for _ in range(5000 if i % 3 == 0 else 40)]
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "worst")
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["s"] for r in toxicity.scored(docs, toxicity.fit(docs, labels), "s").collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.9  # a constant score is right for two thirds
    marked = labels.selectExpr("cast(doc_id AS string) AS k", "toxic AS y")
    counts, want = toxicity.bucket_counts(toxicity.tokens(docs, marked, "doc_id", "text", "lang")), np.zeros((2, toxicity.BUCKETS))
    for i, t, _ in rows:
        fold = zlib.crc32(str(i).encode()) % 5
        if fold:
            want[int(fold == 1):, list({toxicity.bucket(w) for w in lower_words(t, toxicity.ALNUM)})] += 1
    assert (counts == want).all()


def test_no_text_reaches_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} " * 600) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    kind, got = type(docs), []
    plain = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: got.extend(out := plain(self)) or out)
    toxicity.fit(docs, labels)
    assert got and not any(isinstance(v, str) and len(v) > 1000 for r in got for v in r)


def test_tasks_learn_together(spark, monkeypatch):
    """A table over the limit of one task is learned in rounds over all rows."""
    monkeypatch.setattr(toxicity, "GROUP_WORDS", 1000)
    monkeypatch.setattr(toxicity, "START_WORDS", 8000)
    monkeypatch.setattr(toxicity, "TASK_WORDS", 8000)
    rows = synthetic()
    docs = spark.createDataFrame([(i, t, lang) for i, t, _, lang in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["s"] for r in toxicity.scored(docs, toxicity.fit(docs, labels), "s").collect()}
    held = [(got[i], y) for i, _, y, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(*zip(*held, strict=True)) > 0.9


def test_long_texts_are_learned_like_whole():
    """Pieces of a training text find the windows that a single piece finds."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(1, 50, n).astype(np.int32) for n in (0, 1, 7, 300, 1000)]
    labels, nets, used = np.array([0, 1, 0, 1, 1.0]), [], []
    for size in (16, 1 << 15):
        before = toxicity.PIECE
        toxicity.PIECE = size
        try:
            net, use = toxicity.Net(50, 3), np.zeros(51, np.float32)
            net.learn(docs, labels, 3, np.random.default_rng(1), use)
        finally:
            toxicity.PIECE = before
        nets.append(net)
        used.append(use)
    assert np.allclose(nets[0].vectors, nets[1].vectors, atol=1e-5) and (used[0] == used[1]).all()


def test_toxicity_awkward_tables(spark):
    df = fixtures.docs(spark)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.scored(df, model, "s").collect()
    assert len(got) == df.count() and all(0 <= r["s"] <= 1 for r in got)
    assert toxicity.scored(df.limit(0), model, "s").count() == 0
    assert toxicity.fit(df.limit(0), labels.limit(0)).threshold == 0.5


def small_model(bits=10):
    pairs = np.zeros(lm_mixing.PAIRS, int)
    pairs[[ord("z") * 257, lm_mixing.PAIR_END]] = 3
    code = lm_mixing.Code([b"a", b"b", b"c", b"\n"], [5, 3, 2, 2], 3, pairs)
    rng = np.random.default_rng(1)
    return lm_mixing.Model(code, bits, [lm_mixing.slot_table(rng.integers(0, 9, 1 << bits)) for _ in range(lm_mixing.CONTEXTS)])


def large_model(words=1500):
    """Rare words share classes, and some of them places."""
    rng = np.random.default_rng(8)
    counts = np.r_[rng.integers(20_000, 90_000, 20), rng.integers(1, 400, words)].tolist()
    code = lm_mixing.Code([*(b"f%d" % i for i in range(20)), *(b"r%d" % i for i in range(words - 1)), b"\n"], counts, 50, rng.integers(0, 5, 65_536))
    return lm_mixing.Model(code, 10, [lm_mixing.slot_table(rng.integers(0, 9, 1 << 10)) for _ in range(lm_mixing.CONTEXTS)])


def symbols_of(model, texts):
    words, sizes = [w for t in texts for w in t], np.array([len(t) for t in texts], np.int64)
    ids, unknown = lm_mixing.look_up(model.code.index, words)
    return model.code.symbols(ids, sizes, unknown)


def nats(model, texts):
    return model.nats(symbols_of(model, texts), len(texts), model_state())


def model_state():
    rng = np.random.default_rng(3)
    state = lm_mixing.State()
    state.weights += rng.normal(0, 0.1, state.weights.shape).astype(np.float32)
    return state


def test_shares_of_a_class_sum_to_one():
    code = small_model().code
    for code_of in (code, large_model().code):
        for cls, tail in ((code_of.cls.astype(int) * 256 + code_of.sub, code_of.tail), (code_of.pair_cls, code_of.pair_tail)):
            for c in set(cls.tolist()):
                assert math.isclose(np.exp(-tail[cls == c].astype(float)).sum(), 1, rel_tol=1e-3)
    sym = symbols_of(small_model(), [[b"a", b"zzz", b"zz", b"b"]])
    # the escape and, two by two, the letters: zz z_ and zz __
    assert sym.kind.tolist() == [0, 0, 1, 1, 0, 1, 1, 0]
    assert sym.cls[[2, 5, 6]].tolist() == code.pair_cls[[ord("z") * 257, ord("z") * 257, lm_mixing.PAIR_END]].tolist()


def test_probabilities_sum_to_one():
    """Over all continuations of a fixed history; the escape's share is taken without its spelling."""
    model = small_model()

    def p(words, symbols):
        sym = symbols_of(model, [words])
        sym.take(np.arange(symbols))
        return math.exp(-model.nats(sym, 1, model_state())[0])

    history = [b"a", b"zz", b"b"]  # five symbols
    total = sum(p([*history, w], 6) for w in (b"a", b"b", b"c", b"\n", b"unknown")) / p(history, 5)
    assert abs(total - 1) < 1e-4


def test_probabilities_of_places_sum_to_one():
    """Over all words of a vocabulary whose classes leave places open."""
    model = large_model(60)
    history = [b"r3", b"f1", b"r7"]
    base = symbols_of(model, [history])
    n, words = len(base.cls), [*model.code.index, b"unseen"]
    before = math.exp(-model.nats(base, 1, model_state())[0])

    def p(w):
        sym = symbols_of(model, [[*history, w]])
        own = 1 + int(model.code.several[model.code.cls[model.code.index.get(w, len(model.code.counts))]])
        sym.take(np.arange(n + own))  # without spelling
        return math.exp(-model.nats(sym, 1, model_state())[0])

    assert any(model.code.several) and abs(sum(map(p, words)) / before - 1) < 1e-3


def replay(model, words, state):
    """One text, decision by decision, in plain Python."""
    code, sym = model.code, symbols_of(model, [words])
    weights, refined = state.weights.astype(float).tolist(), state.refined.astype(float).tolist()
    taken = [[0, 0] for _ in range(lm_mixing.TAKEN)]
    cuts, total, i = set(lm_mixing.steps(len(sym.cls)).tolist()[1:]), float(sym.tail.sum()), 0
    block = []

    def learn():
        uses, moves = Counter(), Counter()
        seen, ones = Counter(), Counter()
        for gate, err, x, bucket, bit, node in block:
            uses[gate] += 0.25
            for k, v in enumerate(x):
                moves[k, gate] += err * v
            seen[bucket] += 1
            ones[bucket] += bit
            taken[node][bit] += 1
        for (k, gate), v in moves.items():
            weights[k][gate] += lm_mixing.RATE / math.sqrt(1 + uses[gate]) * v
        for c, n in seen.items():
            refined[c] += (ones[c] - n * refined[c]) / (n + 60)
        block.clear()

    for i in range(len(sym.cls)):
        if i in cuts:
            learn()
        cls, kind, tree = int(sym.cls[i]), int(sym.kind[i]), int(sym.tree[i])
        blocks = [b[:, 0].tolist() for b in sym.blocks(slice(i, i + 1), model.bits)]
        for d in range(8):
            bit, node, half = cls >> (7 - d) & 1, (1 << d | cls >> (8 - d)) + 256 * tree, d // 4
            place = 1 << d | cls >> (8 - d) if d < 4 else 1 << (d - 4) | (cls & 15) >> (8 - d)
            gate = (kind * 4 + int(model.tables[0][blocks[0][half]])) * 4 + int(model.tables[1][blocks[1][half]])
            cell, share = node if kind < 2 else 512 + ((node % 256) + 1297 * tree) % lm_mixing.SHARED, 4 * float(code.share[node])
            x = [float(code.base[node]), math.log((taken[cell][1] + share) / (taken[cell][0] + 4 - share))]
            x += [float(t[b[half] + place]) / 4096 for t, b in zip(model.tables, blocks, strict=True)] + [0.3]
            if not code.free[node]:
                continue
            mixed = max(-7.99, min(7.99, sum(w[gate] * v for w, v in zip(weights, x, strict=True))))
            p, bucket = 1 / (1 + math.exp(-mixed)), int(mixed * 1.5 + 12) + 24 * kind
            final = max(1e-5, min(1 - 1e-5, 0.6 * p + 0.4 * refined[bucket]))
            total -= math.log(final if bit else 1 - final)
            block.append((gate, bit - p, x, bucket, bit, cell))
    return total


def test_scores_match_a_plain_replay():
    model = small_model()
    rng = random.Random(4)
    texts = [[rng.choice([b"a", b"b", b"c", b"zz", b"long" * 9]) for _ in range(n)] + [b"\n"] for n in (0, 3, 60, 900)]
    assert np.allclose(nats(model, texts), [replay(model, t, model_state()) for t in texts], rtol=2e-3)
    model = large_model()
    texts = [[rng.choice([b"f%d" % rng.randrange(20), b"r%d" % rng.randrange(1499), b"unseen"]) for _ in range(n)] + [b"\n"] for n in (0, 5, 200, 600)]
    sym = symbols_of(model, texts)
    assert {0, 1, 2} == set(sym.kind.tolist()) and (sym.kind == 2).sum() > 200
    assert np.allclose(nats(model, texts), [replay(model, t, model_state()) for t in texts], rtol=2e-3)


def test_halves_without_an_open_decision_teach_nothing():
    """Nearer to the replay than when they counted (1e-3)."""
    model, rng = large_model(), random.Random(4)
    texts = [[rng.choice([b"f%d" % rng.randrange(20), b"r%d" % rng.randrange(1499), b"unseen"]) for _ in range(n)] + [b"\n"] for n in (0, 5, 200, 600)]
    assert np.allclose(nats(model, texts), [replay(model, t, model_state()) for t in texts], rtol=6e-4)


def test_texts_learn_while_they_are_scored():
    """Repeated words get cheaper, in short texts too, and a text is never reset."""
    model = small_model()
    cost = nats(model, [[b"c", b"c", b"b"] * n for n in (8, 16, 2000, 4000)])
    assert cost[1] - cost[0] < 0.8 * cost[0] and cost[3] - cost[2] < cost[2]
    assert all(np.diff(lm_mixing.steps(10**6)) <= np.maximum(lm_mixing.STEP, lm_mixing.steps(10**6)[:-1] / 16))


def test_texts_side_by_side_score_as_alone():
    model = small_model()
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"c", b"zz"]) for _ in range(n)] + [b"\n"] for n in (0, 1, 7, 300, 40, 300, 2000)]
    assert np.allclose(nats(model, texts), [nats(model, [t])[0] for t in texts], rtol=1e-4)
    assert len(nats(model, [])) == 0


def test_distinct_words_are_found_once_by_their_bytes(monkeypatch):
    rng = random.Random(6)
    pool = [b"a", b"b", b"ab", b"\x00", b"a\x00", b"w" * 300, b"w" * 556, "\u00e9\u4e2d".encode(), *(b"k%d" % i for i in range(40))]
    vocab = [*pool[::2], b"\n"]
    texts = [b"", None, b" \n\t\x0b\x0c\r", b"A \x1f\x85", *(b"  ".join(rng.choice(pool) for _ in range(n)) for n in (1, 3, 400))]
    words, sizes = lm_mixing.split_words(texts)
    plain = [[*(t or b"").translate(BLANKS).split(), b"\n"] for t in texts]
    assert words.to_pylist() == [w for t in plain for w in t] and sizes.tolist() == [len(t) for t in plain]
    listed = words.to_pylist()
    # keys of all words apart, keys that words outside the vocabulary share with others, and one key for all
    own = lm_mixing.word_keys
    for keys, python in ((own, False), (lambda o, f: own(o, f) % np.uint64(1 << 12), None), (lambda o, f: np.zeros(len(o) - 1, np.uint64), True)):
        monkeypatch.setattr(lm_mixing, "word_keys", keys)
        code = lm_mixing.Code(vocab, [3] * len(vocab), 5, np.zeros(lm_mixing.PAIRS, int))
        want = lm_mixing.look_up(code.index, listed)
        looked = []
        with monkeypatch.context() as m:
            plain_look_up = lm_mixing.look_up
            m.setattr(lm_mixing, "look_up", lambda index, w: looked.extend(w) or plain_look_up(index, w))
            ids, unknown = code.find(words)
        assert ids.tolist() == want[0].tolist() and unknown == want[1]
        assert len(looked) == len(set(looked)) and (python is None or bool(looked) == python)
    assert [len(x) for x in code.find(words[:0])] == [0, 0]


def test_scores_match_brute_force_base(spark):
    data = fixtures.rows()
    got = lm_mixing.score_texts(fixtures.docs(spark), bits=12, vocab=64).collect()
    tokens = [[*lower_words(r[1], BLANKS), b"\n"] for r in data]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in data]
    counts = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r, t, h in zip(data, tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r[0], h, len(t), sum(w in counts for w in t), n, round(base, 6))] += 1
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm_mixing.score_texts(fixtures.docs(spark, []), bits=12, vocab=64).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(8)
    nxt = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(400):
        at, words = rng.randrange(200), []
        for _ in range(60):
            words.append(f"word{at}")
            at = rng.choice(nxt[at])
        rows.append((i, " ".join(words) + f" rare{rng.randrange(10**6)}"))
    got = [r for r in lm_mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), bits=16).collect() if r["held_out"]]
    assert len(got) > 20
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)
    assert all(r["score"] > r["base_score"] for r in got)
