"""Rows of lists dealt into blocks that fetch a place's values once.

A row holds a list of places (terms, indices) and one of numbers.  Rows are
dealt by a hash of their key into blocks of a bounded number of entries and
kept so.  Values by place (topic counts, centres) come to a block once per
distinct place, however many of its entries have it: a table of the blocks
that ask for a place is made once, kept by place, and joined with the values of
every step.  A cogroup then hands numpy a block's rows with its values.

Rows are packed into runs (``packed``) before they are dealt and stay packed, on
the executors' disks: a task holds a block's bytes and unpacks a run at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import NARROW
from .packed import Runs, numbers, pack, runs, unpack

#: Entries of a block, about.
BLOCK_ENTRIES = 1 << 23
#: Entries that a task packs at once, about.
HELD_ENTRIES = 1 << 22
#: Values that a pass over a block holds at once for its entries.
SLICE_VALUES = 1 << 21


def empty(schema: str) -> pa.Table:
    return to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()


def in_blocks(rows: DataFrame, n: int, block: str = "block") -> DataFrame:
    """Partition i holds block i of the n blocks, and no other.

    By a hash of its number a block would share its partition with others, up
    to five in one of 19, and a task would hold them all.  A number of its own:
    adaptive execution leaves the partitions as they are.
    """
    return rows.repartitionById(n, block)


def beside(dealt: DataFrame, values: DataFrame, n: int):
    """A cogroup of ``in_blocks`` rows with the values ``of`` each block; the rows stay where they are."""
    return dealt.groupBy("block").cogroup(in_blocks(values, n, "of").groupBy("of"))


def totals(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """Sums by key of rows that a task has once a key: dealt before they are
    added up, as combining them in the task would hold all its keys for nothing."""
    return rows.repartition(*keys).groupBy(*keys).agg(*sums)


def distinct_places(dealt: DataFrame, places: str) -> DataFrame:
    """(of, place): the distinct places of each block.  Blocks are whole in
    their partitions, so nothing moves before."""
    def run(batches):
        found = {}
        for b in batches:
            block = numbers(b.column(0))
            lists = b.column(1)
            of = np.repeat(block, numbers(lists.value_lengths().fill_null(0)))
            place = numbers(lists.flatten())
            for n in np.unique(block).tolist():
                kept = found.setdefault(n, [])
                kept.append(np.unique(place[of == n]))
                if len(kept) > 8:
                    found[n] = [np.unique(np.concatenate(kept))]
        for n, kept in found.items():
            place = np.unique(np.concatenate(kept)).astype(np.int32)
            for s in range(0, len(place), 1 << 16):
                part = place[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n, np.int32)), pa.array(part)], names=["of", "place"])

    return dealt.select("block", places).mapInArrow(run, "of int, place int")


def block_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _pack_rows(places: str):
    """(block, .., lists) rows -> (block, run), some rows at a time."""
    def packed(held: list):
        table = pa.Table.from_batches(held)
        block = numbers(table.column("block"))
        table = table.drop_columns(["block"]).take(pa.array(np.argsort(block, kind="stable"))).combine_chunks()
        block = np.sort(block)
        sizes = numbers(table.column(places).combine_chunks().value_lengths().fill_null(0)).astype(np.int64)
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            for s, e in runs(sizes[part]):
                at = int(part[0])
                yield int(block[at]), pack(table.slice(at + s, e - s).to_batches()[0])

    def run(batches):
        def out(held):
            for block, data in packed(held):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "run"])

        held, many = [], 0
        for b in batches:
            for s, e in runs(numbers(b.column(b.schema.get_field_index(places)).value_lengths().fill_null(0)), HELD_ENTRIES):
                held.append(b.slice(s, e - s))
                many += len(held[-1].column(b.schema.get_field_index(places)).flatten())
                if many >= HELD_ENTRIES:
                    yield from out(held)
                    held, many = [], 0
        if held:
            yield from out(held)

    return run


def _wanted(places: str):
    """(block, run) -> (of, place): the distinct places of each block.  Blocks are
    whole in their partitions, so nothing moves before."""
    def run(batches):
        found = {}
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                place = numbers(unpack(data.as_buffer(), [places]).column(places).combine_chunks().flatten())
                kept = found.setdefault(block, [])
                kept.append(np.unique(place))
                if len(kept) > 8:
                    found[block] = [np.unique(np.concatenate(kept))]
        for block, kept in found.items():
            place = np.unique(np.concatenate(kept)).astype(np.int32)
            for s in range(0, len(place), 1 << 16):
                part = place[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), pa.array(part)], names=["of", "place"])

    return run


def _unpack_rows(batches):
    for b in batches:
        for block, data in zip(b.column(0).to_pylist(), b.column(1)):
            rows = unpack(data.as_buffer())
            for x in rows.add_column(0, "block", pa.array(np.full(rows.num_rows, block, np.int32))).to_batches():
                yield x


@dataclass
class Blocks:
    """``packed`` runs of rows with their ``block``, and the blocks ``of`` that ask for a ``place``."""
    packed: DataFrame
    wanted: DataFrame
    n: int
    schema: T.StructType

    @classmethod
    def deal(cls, rows: DataFrame, key: Column, places: str, per_block: int = 0, entries: int | None = None) -> "Blocks":
        """``rows`` is read twice: for its ``entries`` unless they are given, and to be dealt."""
        if entries is None:
            entries = rows.agg(F.sum(F.size(places).cast("long"))).first()[0] or 0
        n = max(NARROW, -(-entries // (per_block or BLOCK_ENTRIES)))
        rows = rows.drop("block").select(block_of(key, n).alias("block"), "*")
        return cls.keep(rows.mapInArrow(_pack_rows(places), "block int, run binary"), n, rows.schema, places)

    @classmethod
    def keep(cls, packed: DataFrame, n: int, schema: T.StructType, places: str) -> "Blocks":
        """Packed rows (block, run) of ``schema``, dealt and kept."""
        dealt = in_blocks(packed, n).persist(StorageLevel.DISK_ONLY)
        wanted = dealt.mapInArrow(_wanted(places), "of int, place int").groupBy("place").agg(F.collect_list("of").alias("of"))
        return cls(dealt, wanted.persist(StorageLevel.DISK_ONLY), n, schema)

    @property
    def rows(self) -> DataFrame:
        """The rows, each with its ``block``, in the partition of that number."""
        return self.packed.mapInArrow(_unpack_rows, self.schema)

    def fetch(self, table: DataFrame, place: str) -> DataFrame:
        """``table``'s rows, once for each block ``of`` that has their place."""
        return self.wanted.withColumnRenamed("place", "_place").join(table, F.col("_place") == F.col(place)).select(
            F.explode("of").alias("of"), *table.columns)

    def map_runs(self, values: DataFrame, schema: str, fn) -> DataFrame:
        """fn(the block's ``Runs`` of rows, values) -> tables, over every block; ``values`` has ``of``."""
        nothing = empty(schema)

        def run(own: pa.Table, there: pa.Table) -> pa.Table:
            return pa.concat_tables([nothing, *fn(Runs(own.column("run")), there)]) if own.num_rows else nothing

        return beside(self.packed, values, self.n).applyInArrow(run, schema)

    def map(self, values: DataFrame, schema: str, fn) -> DataFrame:
        """fn(rows, values) -> tables, over every block's rows at once."""
        return self.map_runs(values, schema, lambda own, there: fn(pa.concat_tables(own), there))

    def unpersist(self) -> None:
        self.wanted.unpersist()
        self.packed.unpersist()


class Entries:
    """A block's entries end to end, with each one's row."""

    def __init__(self, own: pa.Table, places: str, values: str):
        lists = own.column(places).combine_chunks()
        self.place = numbers(lists.flatten())
        self.value = numbers(own.column(values).combine_chunks().flatten())
        self.sizes = numbers(lists.value_lengths()).astype(np.int64)
        self.ends = np.cumsum(self.sizes)

    def slices(self, width: int):
        """(first row, end row, entries) of rows with at most SLICE_VALUES values, or one row."""
        i = 0
        while i < len(self.sizes):
            start = int(self.ends[i] - self.sizes[i])
            to = max(i + 1, int(np.searchsorted(self.ends, start + SLICE_VALUES // max(1, width), "right")))
            yield i, to, slice(start, int(self.ends[to - 1]))
            i = to


def lookup(known: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where each place stands among the rising known ones; -1 where it does not."""
    if not len(known):
        return np.full(len(places), -1)
    at = np.minimum(np.searchsorted(known, places), len(known) - 1)
    return np.where(known[at] == places, at, -1)
