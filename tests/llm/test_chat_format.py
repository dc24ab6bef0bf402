import hashlib
import random

from pyspark.sql import functions as F

from lexloom.llm import chat_format, queries

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "<\\s>", "[\\\\INST]", "<", "[", "\\", "\n", "é\U0001F600"]
SCHEMA = "conv_id long, turn long, role string, text string, first long, pos string, ck string"


def conversations():
    rng = random.Random(2)
    rows = []

    def text():
        return "".join(rng.choice(CONTROLS + ["word ", "other "]) for _ in range(rng.randrange(0, 40)))

    for conv in range(12):
        roles = (["system"] if conv % 3 == 0 else []) + ["user", "assistant"] * rng.randrange(1, 30)
        rows += [(conv, i, r, text()) for i, r in enumerate(roles)]
    rows += [(50, 0, "assistant", "first"), (50, 0, "assistant", "first"), (50, 1, "tool]<s>", "x[/ROLE]"), (50, 2, None, None), (50, 3, "system", "late")]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", "answer")]
    rows += [(60, i, "user" if i % 2 == 0 else "assistant", "long " * (3000 if i == 3 else 3)) for i in range(8)]
    rows += [(70, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(9000)]
    return [(*r, 1, "p", "c") for r in rows]


def brute(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    return {k: [(role, text) for _, role, text in sorted(v, key=lambda t: t[0])] for k, v in out.items()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_windows_restore_every_turn(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    windows = chat_format.format_windows(df, budget=200, history_turns=2, history_tokens=60)
    assert not any(x in windows._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    got = windows.withColumn("turns", chat_format.read_turns(F.col("text"))).withColumn("under", chat_format.read_loss(F.col("text"), F.col("loss"))).collect()
    want = brute(rows)
    by_conv = {}
    for r in sorted(got, key=lambda r: r["first_turn"]):
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert set(by_conv) == set(want)
    for conv, parts in by_conv.items():
        turns = [(t["role"], t["text"]) for r in parts for t in r["turns"][r["repeated"]:]]
        assert turns == want[conv]
        assert "".join(r["under"] for r in parts) == "".join(t for role, t in want[conv] if role == "assistant")
        for k, r in enumerate(parts):
            assert (k == 0) == (r["repeated"] == 0) or r["repeated"] == 0
            assert r["over_budget"] == (r["tokens"] > 200)
            if r["over_budget"]:
                assert len(r["turns"]) - r["repeated"] == 1
            if k and want[conv][0][0] == "system":
                assert (r["turns"][0]["role"], r["turns"][0]["text"]) == want[conv][0]
            back = r["repeated"] - (1 if k and want[conv][0][0] == "system" else 0)
            at = r["first_turn"]
            assert [(t["role"], t["text"]) for t in r["turns"][r["repeated"] - back:r["repeated"]]] == want[conv][at - back:at]
            assert back <= 2
    assert len(by_conv[70]) > 10
    assert chat_format.format_windows(df.limit(0)).count() == 0


def test_registered_query(spark, sf):
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = brute(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == digest("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), digest(loss))
        assert got[conv]["formatted_chars"] > sum(len(t) for _, t in turns)
