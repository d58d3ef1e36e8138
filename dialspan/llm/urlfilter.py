"""URL verdicts by rules in a sorted array of 64-bit xxhash keys.

A rule is a host and the beginning of a path; its key is the hash of host + path. The
sorted keys and the full strings are files that Spark ships to every executor, where they
are memory-mapped and shared by its tasks. A URL's candidates (each suffix of the host at a
label's edge, each beginning of the path with a length that some rule has) are hashed,
probed by one vectorised binary search a batch, and confirmed by the stored string, so that
a collision of keys never matches. The list is a parameter of the caller's; its size does
not depend on the table that is judged, which is not shuffled.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rules of one array: 8 bytes of key each, and the strings.
MOST_RULES = 20_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for none or null."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for none or null."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def write_array(rules: list[tuple[str, str, str]], folder: str) -> dict[str, str]:
    """The files of the rules (verdict, host, path); of equal host and path the last rule counts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; one array holds {MOST_RULES}")
    last = {(host.encode(), path.encode()): verdict for verdict, host, path in rules}
    strings = [host + path for host, path in last]
    hosts = np.array([len(host) for host, _ in last], np.int64)
    paths = np.array([len(path) for _, path in last], np.int64)
    keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
    order = np.argsort(keys, kind="stable")
    sizes = np.array([len(strings[i]) for i in order], np.int64)
    blocked = np.array([v == "block" for v in last.values()], bool)
    parts = {"keys": keys[order], "hosts": hosts[order], "blocked": blocked[order], "lengths": np.unique(paths), "ends": np.cumsum(sizes), "text": np.frombuffer(b"".join(strings[i] for i in order), np.uint8)}
    stem, files = uuid.uuid4().hex, {}
    for name, values in parts.items():
        files[name] = os.path.join(folder, f"{stem}-{name}.npy")
        np.save(files[name], values)
    return files


class Digests:
    """The memory-mapped array in a task."""

    def __init__(self, files: dict[str, str]):
        load = lambda name: np.load(files[name], mmap_mode="r" if os.path.getsize(files[name]) > 128 else None)
        self.keys, self.hosts, self.blocked, self.lengths, self.ends, self.text = map(load, ("keys", "hosts", "blocked", "lengths", "ends", "text"))

    def string(self, at: int) -> bytes:
        return self.text[self.ends[at - 1] if at else 0 : self.ends[at]].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[bool | None]]:
        """(the longest rule that fits, whether it blocks) of each URL; None where none fits."""
        owner, sizes, cands = [], [], []
        lengths = self.lengths.tolist()
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            h, p = host.encode(), path.encode()
            at = 0
            while True:
                suffix = h[at:]
                for n in lengths:
                    if n <= len(p):
                        owner.append(i)
                        sizes.append(len(suffix))
                        cands.append(suffix + p[:n])
                if (dot := h.find(b".", at)) < 0:
                    break
                at = dot + 1
        rule: list[str | None] = [None] * len(hosts)
        blocks: list[bool | None] = [None] * len(hosts)
        if cands and len(self.keys):
            keys = np.fromiter(map(xxhash.xxh64_intdigest, cands), np.uint64, len(cands))
            lo = np.searchsorted(self.keys, keys)
            for c in np.flatnonzero(self.keys[np.minimum(lo, len(self.keys) - 1)] == keys):
                at = int(lo[c])
                while at < len(self.keys) and self.keys[at] == keys[c]:
                    if self.hosts[at] == sizes[c] and self.string(at) == cands[c]:
                        i = owner[c]
                        if rule[i] is None or len(cands[c]) > len(rule[i].encode()):
                            rule[i], blocks[i] = cands[c].decode(), bool(self.blocked[at])
                    at += 1
        return rule, blocks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; a URL that no rule fits, a null one among them, gets ``otherwise``.

    Columns of those names in the input are replaced. Every row gives one row.
    """
    spark: SparkSession = pages.sparkSession
    files = write_array(rules, tempfile.mkdtemp(prefix="digests-"))
    for path in files.values():
        spark.sparkContext.addFile(path)
    names = {k: os.path.basename(v) for k, v in files.items()}
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests({k: SparkFiles.get(v) for k, v in names.items()})
        for batch in batches:
            rule, blocks = digests.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            verdict = [otherwise if b is None else "block" if b else "allow" for b in blocks]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, schema)
