"""URL filters on a sorted digest array.

Rules are (host, path, verdict). Their keys ``host + path`` are hashed with
64-bit xxhash; the digests, sorted, form one file together with the full keys
and verdicts. Executors fetch that file through Spark and memory-map it, so
its pages are shared by all workers of a machine and only touched pages are
resident. A url's candidate keys (its host or a parent domain with a prefix of
the path, of lengths that occur together in a rule) are probed in one vectorised
binary search per batch; a digest hit counts only if the stored full string is equal, and
all entries of an equal digest are compared. The longest fitting key wins; if
none fits, the verdict is ``default``.

Null urls, or urls without ``://``, have an empty host and path and get the
default. Very long hosts and paths are read whole; as only the rules' lengths are
probed, their work and memory do not grow with the square of their labels. Hosts without labels, ports, user parts and unusual characters are
compared literally. Repeated rules: the last verdict in order of (key,
verdict) wins. Rows are independent: repeated rows, extra columns and empty
tables need no care.
"""

from __future__ import annotations

import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_root, write_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPLIT = re.compile(r"([^/?#]*)([^?#]*)")


def split_url(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = SPLIT.match(url, at + 3).groups()
    return host.translate(LOWER), path


def pack_rules(rules) -> bytes:
    """File image: count, digests, key offsets, path lengths, host lengths, verdict bytes, keys.

    Rules without a host, or with a path that does not begin with a slash, fit nothing and are left out.
    """
    table = {}
    for host, path, verdict in sorted(rules):
        if verdict not in ("block", "allow"):
            raise ValueError(f"unknown verdict {verdict!r} of rule {host}{path}")
        if not host or path and path[0] != "/":
            continue
        table[host.translate(LOWER) + path] = (verdict, len(path), len(host))
    keys = sorted(table, key=lambda k: (xxhash.xxh64_intdigest(k.encode()), k))
    blob = [k.encode() for k in keys]
    digests = np.array([xxhash.xxh64_intdigest(b) for b in blob], "<u8")
    offsets = np.zeros(len(keys) + 1, "<u8")
    np.cumsum([len(b) for b in blob], out=offsets[1:])
    verdicts = np.array([table[k][0] == "block" for k in keys], "u1")
    lengths = np.array([table[k][1:] for k in keys], "<u4").reshape(-1, 2).T
    return b"".join([struct.pack("<Q", len(keys)), digests.tobytes(), offsets.tobytes(), lengths.tobytes(),
                     verdicts.tobytes(), *blob])


class DigestArray:
    """The memory-mapped file of ``pack_rules``."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        n = int(raw[:8].view("<u8")[0])
        at = 8
        self.digests = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.offsets = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.path_lengths = raw[at:at + 4 * n].view("<u4")
        at += 4 * n
        host_lengths = raw[at:at + 4 * n].view("<u4")
        at += 4 * n
        self.blocked = raw[at:at + n]
        self.keys = raw[at + n:]
        self.n = n
        #: (host length, path lengths) that occur in rules: nothing else is probed
        self.shapes: dict[int, list[int]] = {}
        for h, p in np.unique(np.stack([host_lengths, self.path_lengths], axis=1), axis=0).tolist():
            self.shapes.setdefault(h, []).append(p)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Entry of each key, -1 if it is not stored."""
        found = np.full(len(keys), -1, np.int64)
        if not self.n or not keys:
            return found
        want = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, want, "left")
        live = np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == want))
        while live.size:
            for i in live:
                e = int(at[i])
                if self.keys[int(self.offsets[e]):int(self.offsets[e + 1])].tobytes() == keys[i]:
                    found[i] = e
            at[live] += 1
            live = live[(found[live] < 0) & (at[live] < self.n)]
            live = live[self.digests[at[live]] == want[live]]
        return found

    def judge(self, urls: list, default: str):
        """Lists host, path, rule, verdict."""
        hosts, paths, keys, owner = [], [], [], []
        for i, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            for h, lengths in self.shapes.items():
                at = len(host) - h
                if at < 0 or at and host[at - 1] != ".":
                    continue
                for n in lengths:
                    if n > len(path):
                        break
                    keys.append((host[at:] + path[:n]).encode("utf-8", "surrogatepass"))
                    owner.append(i)
        rules, verdicts = [None] * len(urls), [default] * len(urls)
        best = [(-1, -1)] * len(urls)
        found = self.probe(keys)
        for j in np.flatnonzero(found >= 0):
            i, e = owner[j], int(found[j])
            key = keys[j].decode("utf-8", "surrogatepass")
            rank = (len(key), len(key) - int(self.path_lengths[e]))
            if rank > best[i]:
                best[i], rules[i] = rank, key
                verdicts[i] = "block" if self.blocked[e] else "allow"
        return hosts, paths, rules, verdicts


def publish_rules(spark: SparkSession, rules) -> str:
    """Write the rule file to the shared folder and hand it to every executor."""
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = f"{shared_root(spark)}/{name}"
    write_bytes(spark, path, [pack_rules(rules)])
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict), one per row of ``pages``; ids of any type."""
    spark = pages.sparkSession
    prepare(spark)
    name = publish_rules(spark, list(rules))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    names = ["id", "host", "path", "rule", "verdict"]

    def judge(batches):
        array = DigestArray(SparkFiles.get(name))
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.string()) for x in array.judge(b.column(1).to_pylist(), default))], names=names)

    return src.mapInArrow(judge, f"id {src.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
