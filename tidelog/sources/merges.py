"""The log of merged batches: which batches of a store are read from where.

A merge writes the closed batches of a store once more, as one batch, into a folder
of its own, and then adds one line to the log.  Readers take a batch from the widest
merge that covers it and otherwise from its own folders, so they see either all of
a merge or nothing of it, and the ingest query goes on adding batches meanwhile.
A merge that stopped half-way has no line and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

LOG, MERGED = "merge_log", "merged"


@dataclass(frozen=True)
class Merge:
    first: int
    last: int
    folder: str

    def covers(self, other: Merge) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def read_log(spark: SparkSession, root: str) -> list[Merge]:
    """The merges that count: those no other one covers, by first batch.  One small file each."""
    path, fs = _files(spark, f"{root}/{LOG}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = []
    for name in names:
        first, last, folder = name.removesuffix(".json").split("_", 2) if name.endswith(".json") and not name.startswith(".") else (None, None, None)
        if first is not None:
            found.append(Merge(int(first), int(last), f"{root}/{MERGED}/{folder}"))
    return sorted((m for m in found if not any(o.covers(m) for o in found)), key=lambda m: m.first)


def new_folder(first: int, last: int) -> str:
    return f"{first}-{last}-{uuid.uuid4().hex[:12]}"


def commit(spark: SparkSession, root: str, first: int, last: int, folder: str) -> None:
    """One line of the log, there as a whole or not at all: a file that gets its name when it is complete."""
    if any(m.first <= last and first <= m.last and not (first <= m.first and m.last <= last) for m in read_log(spark, root)):
        raise ValueError(f"batches {first} to {last} overlap a merge that they do not cover")
    name = f"{first}_{last}_{folder}.json"
    draft, fs = _files(spark, f"{root}/{LOG}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"first": first, "last": last, "folder": folder}).encode()))
    out.close()
    if not fs.rename(draft, _files(spark, f"{root}/{LOG}/{name}")[0]):
        raise OSError(f"{name} could not be added to the merge log")


def superseded(spark: SparkSession, root: str, tables: list[str]) -> list[str]:
    """Folders no reader that starts now looks into: batches and merges that a merge covers."""
    log = read_log(spark, root)
    used = {m.folder.rsplit("/", 1)[1] for m in log}
    out = []

    def below(path: str) -> list[str]:
        at, fs = _files(spark, path)
        return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []

    def batches(path: str) -> None:
        for name in below(path):
            if name.startswith("batch_id=") and any(m.first <= int(name[9:]) <= m.last for m in log):
                out.append(f"{path}/{name}")

    for table in tables:
        batches(f"{root}/{table}")
        for name in below(f"{root}/{table}"):
            if name.startswith("event_date="):
                batches(f"{root}/{table}/{name}")
    # A folder that is not in the log may belong to a merge under way; only covered ones are listed.
    path, fs = _files(spark, f"{root}/{LOG}")
    logged = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = {n.removesuffix(".json").split("_", 2)[2] for n in logged if n.endswith(".json") and not n.startswith(".")}
    out += [f"{root}/{MERGED}/{name}" for name in sorted(done - used)]
    return out


def delete(spark: SparkSession, paths: list[str]) -> list[str]:
    gone = []
    for path in paths:
        at, fs = _files(spark, path)
        if fs.exists(at) and fs.delete(at, True):
            gone.append(path)
    return gone
