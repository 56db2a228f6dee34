"""URL filters: a memory-mapped sorted array of 64-bit digests, confirmed by the stored strings."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that one index may hold; the file is built on the driver and sent to each executor once.
MOST_RULES = 5_000_000


def write_index(rules: Iterable[tuple[str, str, str]], path: str) -> None:
    """Rules (verdict, host, path) as one file: count, sorted digests, offsets, verdicts, strings.

    A string with both verdicts blocks.  More than MOST_RULES rules raise ValueError.
    """
    table: dict[str, str] = {}
    for verdict, host, prefix in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        if prefix and not prefix.startswith("/"):
            raise ValueError(f"a path starts with a slash: {prefix}")
        key = host.lower() + prefix
        table[key] = "block" if "block" in (verdict, table.get(key)) else "allow"
        if len(table) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
    keys = sorted(((xxhash.xxh64_intdigest(k.encode()), k.encode(), v) for k, v in table.items()), key=lambda x: x[:2])
    with open(path, "wb") as f:
        np.array([len(keys)], np.int64).tofile(f)
        np.array([h for h, _, _ in keys], np.uint64).tofile(f)
        np.cumsum([0, *(len(k) for _, k, _ in keys)]).astype(np.int64).tofile(f)
        np.array([v == "block" for _, _, v in keys], np.uint8).tofile(f)
        f.write(b"".join(k for _, k, _ in keys))


class DigestIndex:
    """Views into the mapped file; nothing but the pages that probes touch is read."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        self.digests = raw[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = raw[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.blocks = raw[16 + 16 * n : 16 + 17 * n]
        self.strings = raw[16 + 17 * n :]

    def string(self, at: int) -> bytes:
        return self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Each key's entry, or -1; every entry of an equal digest is compared in full."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        lo, hi = np.searchsorted(self.digests, digests), np.searchsorted(self.digests, digests, side="right")
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(hi > lo):
            found[i] = next((at for at in range(lo[i], hi[i]) if self.string(at) == keys[i]), -1)
        return found


def _share(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """The name of the index file among the files that Spark sends to executors."""
    name = f"url-rules-{hashlib.sha256(repr(rules).encode()).hexdigest()[:24]}.bin"
    folder = os.path.join(tempfile.gettempdir(), f"url-rules-{os.getpid()}")  # the driver's own copy; executors get it from Spark
    os.makedirs(folder, exist_ok=True)
    path = os.path.abspath(os.path.join(folder, name))
    if not os.path.exists(path):
        write_index(rules, f"{path}.new")
        os.replace(f"{path}.new", path)
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", *, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    host is what follows the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased; path follows up to `?`, `#` or the end.  A rule (verdict, host,
    path) fits its host and all subdomains if the page's path starts with its
    path; of those that fit the longest host + path wins and is `rule`.  A page
    that no entry fits has a null rule and the verdict `otherwise`.

    Each host suffix is paired with the path prefixes of the lengths that occur
    in rules, all digests of a batch are probed by one binary search.  A null
    url or one without `://` has empty host and path, and no rule fits it.
    Ids may be null or repeat; other columns are ignored.
    """
    rules = [tuple(r) for r in rules]
    lengths = sorted({len(p) for _, _, p in rules})
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(url, parts, 2).alias("path"))
    name = _share(pages.sparkSession, rules)

    def run(batches):
        index = DigestIndex(SparkFiles.get(name))
        for batch in batches:
            owner, keys = [], []
            for i, (host, path) in enumerate(zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)):
                if not host:
                    continue
                cuts = [0, *(at + 1 for at, c in enumerate(host) if c == ".")]
                for n in lengths:
                    if n <= len(path):
                        keys += [(host[c:] + path[:n]).encode() for c in cuts]
                        owner += [i] * len(cuts)
            best: dict[int, int] = {}
            size = [len(k) for k in keys]
            chosen: dict[int, int] = {}
            for k, at in enumerate(index.probe(keys)):
                if at >= 0 and size[k] > best.get(owner[k], -1):
                    best[owner[k]], chosen[owner[k]] = size[k], at
            fits = [chosen.get(i) for i in range(len(batch))]
            yield pa.record_batch(
                {
                    "page_id": batch["page_id"],
                    "host": batch["host"],
                    "path": batch["path"],
                    "rule": pa.array([None if at is None else index.string(at).decode() for at in fits], pa.string()),
                    "verdict": pa.array([otherwise if at is None else "block" if index.blocks[at] else "allow" for at in fits], pa.string()),
                }
            )

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
