"""Readers for court judgments and statutes behind paged APIs.

The Python Data Source API gives one partition per page range or year. A
``Fetcher`` is injected (options cannot carry functions, so it is named as
``module:function``); ``folder_fetcher`` serves saved responses, which is what
tests use. Transient errors are retried inside the partition.
"""

from __future__ import annotations

import importlib
import json
import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, Not)

RAW = "source string, external_id string, doc_type string, raw_content string, content_format string, payload string, source_url string, modified string"
#: Pages read again after a restart.
OVERLAP = 20
#: Seconds of an attempt, and of all attempts beyond it.
ATTEMPT_SECONDS, EXTRA_SECONDS = 45, 30


def folder_fetcher(root: str):
    """path -> parsed JSON of ``root/path.json``, None if absent."""
    def fetch(path: str):
        name = os.path.join(root, *path.split("/")) + ".json"
        if not os.path.exists(name):
            return None
        with open(name, encoding="utf-8") as f:
            return json.load(f)

    return fetch


def resolve(options: dict):
    module, _, name = options.get("fetcher", f"{__name__}:folder_fetcher").partition(":")
    return getattr(importlib.import_module(module), name)(options.get("root", ""))


def patient(fetch, path: str, attempts: int = 3, pause: float = 0.2):
    """Retries transient errors within twice an attempt's time and a margin."""
    began = time.monotonic()
    for k in range(attempts):
        try:
            return fetch(path)
        except OSError:
            if k + 1 == attempts or time.monotonic() - began > 2 * ATTEMPT_SECONDS + EXTRA_SECONDS:
                raise
            time.sleep(pause * 2**k)
    return None


def judgment_row(doc: dict, url: str) -> tuple:
    data = doc.get("data", doc)
    return ("SAOS", str(data.get("id")), "judgment", data.get("textContent") or "", "html", json.dumps(data, ensure_ascii=False), url, data.get("modificationDate"))


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _JudgmentReader(DataSourceReader):
    """Search pages, then each document by its id."""

    def __init__(self, options):
        self.options = options

    def wanted(self, item: dict) -> bool:
        return True

    def partitions(self):
        head = patient(resolve(self.options), "search/0") or {}
        size, total = int(self.options.get("pagesize", 100)), int(head.get("total", 0))
        pages, step = -(-total // size), int(self.options.get("pagesperpartition", 10))
        return [Pages(a, min(a + step, pages)) for a in range(0, pages, step)] or [Pages(0, 0)]

    def read(self, partition):
        fetch = resolve(self.options)
        for page in range(partition.first, partition.last):
            for item in (patient(fetch, f"search/{page}") or {}).get("items", []):
                if not self.wanted(item):
                    continue
                doc = patient(fetch, f"judgments/{item['id']}")
                if doc is not None and (doc.get("data", doc).get("textContent") or "").strip():
                    yield judgment_row(doc, item.get("href"))


class _PushingReader(_JudgmentReader):
    """Filters on the id and on the modification date are applied before the
    download; Spark applies them again. Needs ``spark.sql.python.filterPushdown.enabled``."""

    def __init__(self, options):
        super().__init__(options)
        self.only, self.skip, self.since = None, frozenset(), None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("external_id",):
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, Not) and isinstance(f.child, (EqualTo, In)) and f.child.attribute == ("external_id",):
                self.skip |= {str(v) for v in (f.child.value if isinstance(f.child, In) else [f.child.value])}
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("modified",):
                self.since = max(self.since or "", str(f.value))
            yield f

    def wanted(self, item: dict) -> bool:
        own, changed = str(item["id"]), item.get("modificationDate")
        return own not in self.skip and (self.only is None or own in self.only) and (self.since is None or changed is None or changed >= self.since)


class _ListingReader(_JudgmentReader):
    """The search pages alone: what could be downloaded."""

    def read(self, partition):
        for page in range(partition.first, partition.last):
            for item in (patient(resolve(self.options), f"search/{page}") or {}).get("items", []):
                yield ("SAOS", str(item["id"]), item.get("href"), item.get("modificationDate"))


class _JudgmentStream(DataSourceStreamReader):
    """Dump pages since a date; the offset is the next page, a restart overlaps.

    The driver only finds out where the dump ends, by doubling and halving; the
    pages are read by tasks, a range each.
    """

    def __init__(self, options):
        self.options = options

    def path(self, page: int) -> str:
        since = self.options.get("since")
        return f"dump/since={since}/{page}" if since else f"dump/{page}"

    def initialOffset(self):  # noqa: N802
        return {"page": max(0, int(self.options.get("page", 0)) - OVERLAP)}

    def latestOffset(self):  # noqa: N802
        fetch, low, step = resolve(self.options), self.initialOffset()["page"], 1
        there = lambda page: patient(fetch, self.path(page)) is not None
        while there(low + step - 1):
            low, step = low + step, step * 2
        high = low + step - 1  # page ``high`` is absent, all before ``low`` are there
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if there(mid) else (low, mid)
        return {"page": low}

    def partitions(self, start, end):
        step = int(self.options.get("pagesperpartition", 10))
        return [Pages(a, min(a + step, end["page"])) for a in range(start["page"], end["page"], step)]

    def read(self, partition):
        fetch, since = resolve(self.options), self.options.get("since")
        for page in range(partition.first, partition.last):
            for d in (patient(fetch, self.path(page)) or {}).get("items", []):
                if (d.get("textContent") or "").strip() and not (since and d.get("modificationDate") and d["modificationDate"] < since):
                    yield judgment_row({"data": d}, d.get("href"))

    def commit(self, end):
        """Offsets are in the query's checkpoint."""


class JudgmentSource(DataSource):
    """``spark.read.format("judgments").option("root", ...)``, also as a stream; option ``pushdown``: filters precede downloads."""

    @classmethod
    def name(cls):
        return "judgments"

    def schema(self):
        return RAW

    def reader(self, schema):
        return (_PushingReader if self.options.get("pushdown") == "true" else _JudgmentReader)(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _JudgmentStream(self.options)


class JudgmentListing(DataSource):
    """(source, external_id, href, modified) of the search pages, without documents."""

    @classmethod
    def name(cls):
        return "judgment_listing"

    def schema(self):
        return "source string, external_id string, href string, modified string"

    def reader(self, schema):
        return _ListingReader(self.options)


def download_judgments(missing: DataFrame, options: dict) -> DataFrame:
    """Raw rows of the listed documents (external_id, href), downloaded where the rows are.

    An anti join of the listing with the raw store comes before, so that nothing
    stored is downloaded, however many documents are stored.
    """
    def run(batches):
        import pyarrow as pa

        fetch, names = resolve(options), [c.split()[0] for c in RAW.split(", ")]
        for b in batches:
            rows = []
            for own, href in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc = patient(fetch, f"judgments/{own}")
                if doc is not None and (doc.get("data", doc).get("textContent") or "").strip():
                    rows.append(judgment_row(doc, href))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    return missing.select("external_id", "href").mapInArrow(run, RAW)


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class _ActListReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Year(y) for y in range(int(self.options["yearfrom"]), int(self.options["yearto"]) + 1)]

    def read(self, partition):
        for item in (patient(resolve(self.options), f"acts/{partition.year}") or {}).get("items", []):
            yield (item.get("ELI"), item.get("type"), item.get("status"), partition.year, json.dumps(item, ensure_ascii=False))


class ActListSource(DataSource):
    """Yearly listings: one partition per year."""

    @classmethod
    def name(cls):
        return "act_listing"

    def schema(self):
        return "eli string, type string, status string, year int, payload string"

    def reader(self, schema):
        return _ActListReader(self.options)


class _ActReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [Addresses(a) for a in (self.options.get("addresses") or "").split(",") if a] or [Addresses(None)]

    def read(self, partition):
        fetch = resolve(self.options)
        meta = patient(fetch, f"{partition.address}/meta") if partition.address else None
        if meta is None:
            return
        from_id = newest_reference(meta) or partition.address
        target = patient(fetch, f"{from_id}/meta") or meta
        kind = "html" if target.get("textHTML") else "pdf-text"
        body = patient(fetch, f"{from_id}/{'html' if kind == 'html' else 'pdf'}") or {}
        # identity stays with the base act, the text is the newest consolidated one
        yield ("ELI", partition.address, "act", body.get("text", ""), kind, json.dumps(meta, ensure_ascii=False), f"{from_id}", meta.get("changeDate"))


class Addresses(InputPartition):
    def __init__(self, address):
        self.address = address


class ActSource(DataSource):
    @classmethod
    def name(cls):
        return "acts"

    def schema(self):
        return RAW

    def reader(self, schema):
        return _ActReader(self.options)


def newest_reference(meta: dict, relation: str = "Inf. o tekście jednolitym") -> str | None:
    best = None
    for r in (meta.get("references") or {}).get(relation, []):
        parts = (r.get("id") or "").split("/")
        if len(parts) >= 2 and parts[-1].isdigit() and parts[-2].isdigit():
            best = max(best or ((-1, -1), ""), ((int(parts[-2]), int(parts[-1])), r["id"]))
    return best[1] if best else None


def register(spark) -> None:
    for s in (JudgmentSource, JudgmentListing, ActListSource, ActSource):
        spark.dataSource.register(s)


def in_slice(df: DataFrame, court_type: str | None = None, court_prefix: str | None = None, date_from=None, today=None) -> DataFrame:
    """Judgments of a court type, a court name prefix and a date range; missing values pass."""
    out = df
    if court_type:
        out = out.where(F.col("court_type").isNull() | (F.lower("court_type") == court_type.lower()))
    if court_prefix:
        out = out.where(F.startswith(F.lower(F.coalesce("court", F.lit(""))), F.lit(court_prefix.lower())))
    day = F.try_to_date(F.col("judgment_date"), "yyyy-MM-dd")
    if date_from is not None:
        out = out.where(day.isNull() | (day >= F.lit(date_from).cast("date")))
    return out.where(day.isNull() | (day <= (F.current_date() if today is None else F.lit(today).cast("date"))))


def should_include(eli: Column, kind: Column, status: Column, kinds: list[str], statuses: list[str]) -> Column:
    """Discovery predicate: an id, a listed type and, if any are listed, a listed status."""
    ok = (F.length(F.trim(F.coalesce(eli, F.lit("")))) > 0) & F.lower(kind).isin([k.lower() for k in kinds])
    return F.coalesce(ok & F.lower(status).isin([s.lower() for s in statuses]) if statuses else ok, F.lit(False))


def act_addresses(discovered: DataFrame, configured: list[str], limit: int | None = None) -> DataFrame:
    """Discovered and configured addresses (eli), trimmed, each once whatever its case."""
    spark = discovered.sparkSession
    extra = spark.createDataFrame([(a,) for a in configured], "eli string")
    both = discovered.select("eli").unionByName(extra).select(F.trim("eli").alias("eli")).where("eli <> ''")
    once = both.groupBy(F.lower("eli").alias("k")).agg(F.min("eli").alias("eli")).select("eli").orderBy("eli")
    return once if limit is None else once.limit(limit)


def non_empty(df: DataFrame, text: str = "raw_content") -> DataFrame:
    return df.where(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")) > 0)
