"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded on its own by the library; those
that come back as exactly their own id are proven whole. A pre-token that equals
one of them counts as one token without any merging; only the rest is merged,
and its count is remembered in a bounded cache. Pre-tokens that hold a string
that is not proven are counted by the library.

``byte_level`` files of the tokenizers library (byte-level BPE, no normaliser,
no post-processor) take this route; any other file is counted by its library
directly. Special strings inside texts are one token each, as is the library's
default. Null texts count as empty; empty texts have no tokens; very long
texts and runs are processed whole; ids may be null, repeated or of any type;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import pickle
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare

#: The pre-token pattern of this tokenizer family, with the
#: library's white space spelled out (Python's \s differs in U+001C-U+001F).
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
CACHE = 400_000
#: Characters beyond which a pre-token goes to the library.
LONG_PIECE = 4096


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_spec(path: str) -> dict | None:
    """What the shortcut needs of a tokenizer file, None if it does not apply."""
    return spec_of(Path(path).read_text(encoding="utf-8"))


def share_spec(spark: SparkSession, path: str) -> Broadcast:
    """The pickled spec of a tokenizer file for the tasks.

    The driver only reads the file. One task parses it and proves its vocabulary,
    as the objects of the library and the parser would stay in the driver's memory.
    """
    prepare(spark)
    text = Path(path).read_text(encoding="utf-8")
    raw = spark.sparkContext.parallelize([text], 1).map(lambda t: pickle.dumps(spec_of(t))).first()
    return spark.sparkContext.broadcast(raw)  # a vocabulary: its size is fixed


def shared_spec(shared: Broadcast) -> dict | None:
    """In a task, the spec of ``share_spec``; a process keeps its last one."""
    if not _spec or _spec[0] is not shared.value:
        _spec[:] = [shared.value, pickle.loads(shared.value)]
    return _spec[1]


def spec_of(text: str) -> dict | None:
    """The spec of a tokenizer file's text."""
    spec = json.loads(text)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    simple = (
        model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        and not spec["normalizer"] and not spec["post_processor"] and not spec["truncation"]
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not simple:
        return None
    letters = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ordered = all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
    if not ordered:
        return None
    whole, other = encoded_alone(text, ranks)
    return {"ranks": ranks, "special": special, "whole": whole, "other": other, "file": json.dumps(spec)}


def open_library(path: str, spec: dict | None = None):
    """The file's tokenizer, without truncation or padding; from the spec's copy of the file if there is one."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec["file"]) if spec else Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encoded_alone(file: str, ranks: dict[bytes, int]) -> tuple[set[str], set[str]]:
    """The vocabulary strings that are text: those that the library encodes alone as their own id, and the others."""
    from tokenizers import Tokenizer

    texts = {}
    for raw, i in ranks.items():
        try:
            texts[raw.decode("utf-8")] = i
        except UnicodeDecodeError:
            continue
    found = Tokenizer.from_str(file).encode_batch(list(texts), add_special_tokens=False)
    whole = {t for (t, i), e in zip(texts.items(), found, strict=True) if e.ids == [i]}
    return whole, set(texts) - whole


def merge_engine(spec: dict):
    """The merges of a spec as a tiktoken encoding with the same ids."""
    import tiktoken

    pattern = PRE_TOKEN.replace("\\u", "\\x").replace("\\x", "\\x")  # one escape style for the Rust engine
    pattern = regex.sub(r"\\x([0-9a-f]{4}|[0-9a-f]{2})", lambda m: f"\\x{{{m[1]}}}", pattern)
    return tiktoken.Encoding("lexloom", pat_str=pattern, mergeable_ranks=spec["ranks"], special_tokens=spec["special"])


def whole_tokens(spec: dict) -> set[str]:
    """Vocabulary strings proven by the library to encode alone as one token."""
    return spec["whole"]


class Counts(dict):
    """Tokens by pre-token: whole tokens for good, merged ones up to a bound.

    The engine makes any vocabulary string one token, so pre-tokens that hold one
    that is not proven are counted by the library.
    """

    def __init__(self, spec, whole):
        super().__init__((w, 1) for w in whole)
        self.spec, self.learned, self.whole = spec, 0, frozenset(whole)
        self.unproven = regex.compile("|".join(map(regex.escape, sorted(spec["other"])))).search if spec["other"] else None
        self.merged, self.library = merge_engine(spec)._encode_single_piece, None  # a pre-token is cut no further

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONG_PIECE or self.unproven and self.unproven(piece):
            self.library = self.library or open_library("", self.spec)
            n = len(self.library.encode(piece, add_special_tokens=False).ids)
        else:
            n = len(self.merged(piece))
        if self.learned >= CACHE:
            self.clear()
            self.update((w, 1) for w in self.whole)
            self.learned = 0
        self[piece] = n
        self.learned += 1
        return n


class Counter:
    def __init__(self, spec: dict, whole):
        self.find = regex.compile(PRE_TOKEN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True)))) if spec["special"] else None
        self.counts = Counts(spec, whole)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        get = self.counts.__getitem__
        return len(parts) - 1 + sum(sum(map(get, self.find(p))) for p in parts if p)


_worker: list = []
_spec: list = []


def worker_counter(spec: dict) -> Counter:
    """The process's counter of a spec: engine, dictionary and learned counts serve all its tasks."""
    if not _worker or _worker[0] is not spec:
        _worker[:] = [spec, Counter(spec, whole_tokens(spec))]
    return _worker[1]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens), one per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = share_spec(spark, tokenizer_path) if tokenizer_path.endswith(".json") else None
    names = ["id", "n_bytes", "n_tokens"]

    def run(batches):
        if shared and (spec := shared_spec(shared)):
            counter = worker_counter(spec)
            count = lambda texts: [counter.count(t) for t in texts]
        elif tokenizer_path.endswith(".json"):
            tok = open_library(tokenizer_path)
            count = lambda texts: [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(count(texts), pa.int64())], names=names)

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
