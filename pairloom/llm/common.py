"""Helpers that several operators share."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters of text that a Python step works on at a time; one longer text is a step of its own.
STEP_CHARS = 1_000_000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when they are started elsewhere and see its folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def steps(texts: Iterable[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into ranges (from, to) of about ``most`` characters, whole texts each."""
    first = held = last = 0
    for last, text in enumerate(texts, 1):
        held += len(text) + 1
        if held >= most:
            yield first, last
            first, held = last, 0
    if last > first:
        yield first, last


class Recent:
    """A bounded memo in two generations: what was not asked for lately is forgotten.

    It only saves work. Whatever it has forgotten is made again by ``make(keys) -> values``.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 450_000):
        self.make, self.limit = make, limit
        self.new: dict = {}
        self.old: dict = {}

    def values(self, keys: list) -> list:
        """The values of distinct ``keys``, in order."""
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        found = [*map(self.new.get, keys)]
        missing = [k for k, value in enumerate(found) if value is None]
        if self.old and missing:
            for k in missing:
                value = self.old.get(keys[k])
                if value is not None:
                    self.new[keys[k]] = found[k] = value
            missing = [k for k in missing if found[k] is None]
        if missing:
            wanted = [keys[k] for k in missing]
            made = self.make(wanted)
            self.new.update(zip(wanted, made))
            for k, value in zip(missing, made):
                found[k] = value
        return found


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}


def schema_of(columns: str) -> pa.Schema:
    """The Arrow schema of ``name type, name type``."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
