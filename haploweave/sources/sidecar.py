"""Binary sidecar of graph threads: set ids to thread ids."""
from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Magic and version of the format.
MAGIC, VERSION = b"PGS1", 1


def decode(raw: bytes) -> list[tuple[int, list[int]]]:
    """(set id, thread ids) of a sidecar: magic, version, flag byte, sized fingerprint, then sized records, little-endian.

    Thread ids are taken as signed 64-bit numbers: they are only compared for equality and order."""
    at = 0

    def take(form: str):
        nonlocal at
        size = struct.calcsize("<" + form)
        if at + size > len(raw):
            raise ValueError("sidecar ends within a record")
        out = struct.unpack_from("<" + form, raw, at)
        at += size
        return out

    if raw[:4] != MAGIC:
        raise ValueError("not a sidecar: bad magic")
    at = 4
    if (version := take("I")[0]) != VERSION:
        raise ValueError(f"sidecar version {version} is not supported")
    take("B")
    size = take("I")[0]
    if at + size > len(raw):
        raise ValueError("sidecar ends within its fingerprint")
    at += size
    found: dict[int, list[int]] = {}
    while at < len(raw):
        set_id, n = take("II")
        if set_id in found:
            raise ValueError(f"sidecar has set {set_id} twice")
        found[set_id] = list(take(f"{n}q"))
    return list(found.items())


def encode(sets: list[tuple[int, list[int]]], fingerprint: bytes = b"") -> bytes:
    head = MAGIC + struct.pack("<IBI", VERSION, 0, len(fingerprint)) + fingerprint
    return head + b"".join(struct.pack(f"<II{len(t)}q", s, len(t), *t) for s, t in sets)


def read(spark: SparkSession, path: str) -> DataFrame:
    """set_id, thread: one row each."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                pairs = [(s, t) for s, ts in decode(raw) for t in ts]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["set_id", "thread"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "set_id long, thread long")
