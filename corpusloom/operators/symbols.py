"""Symbol catalogs from candidate declarations, and range joins within a file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CATALOG = "project_id string, path string, language string, kind string, name string, exported boolean, start_byte long, end_byte long, identity_key string, parent_key string, qualified_name string, occurrence int"


def build_symbols(declarations: DataFrame, max_per_file: int = 5_000, max_name_bytes: int = 1_024) -> DataFrame:
    """``declarations(project_id, path, language, kind, name, exported, start_byte, end_byte)`` -> a catalog.

    In order of start, longest first, kind and name; repeated declarations count once.
    The parent is the nearest declaration that strictly encloses, of equal ones the last;
    qualified names and keys follow the parents. Names over the limit are left out with
    all that they enclose; so is what exceeds ``max_per_file``. Rows are dealt by file and
    sorted, then every task reads its files one after another and holds what is open only.
    """
    columns = ["project_id", "path", "language", "kind", "name", "exported", "start_byte", "end_byte"]
    names = [c.split()[0] for c in CATALOG.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = last = None
        stack, seen, kept = [], {}, 0
        for batch in batches:
            rows = []
            for n, r in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                project, path, language, kind, name, _, start, end = r
                if (project, path) != file:
                    file, last, stack, seen, kept = (project, path), None, [], {}, 0
                here = (start, end)
                if last == (here, kind, name):
                    continue
                last = (here, kind, name)
                while stack and stack[-1][0] != here and not (stack[-1][0][0] <= start and end <= stack[-1][0][1]):
                    stack.pop()
                above = next((s for s in reversed(stack) if s[0] != here), None)
                if (above is not None and above[1] is None) or len(name.encode()) > max_name_bytes or kept >= max_per_file:
                    stack.append((here, None, None))
                    continue
                parent, full = (above[1], f"{above[2]}.{name}") if above else (None, name)
                nth = seen[parent, kind, name] = seen.get((parent, kind, name), -1) + 1
                key = hashlib.sha256("\0".join([language, parent or "", kind, name, str(nth)]).encode()).hexdigest()
                stack.append((here, key, full))
                kept += 1
                rows.append((n, key, parent, full, nth))
            if rows:
                at, *own = zip(*rows, strict=True)
                given = batch.take(pa.array(at, pa.int32()))
                own = [pa.array(c, t) for c, t in zip(own, (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*given.columns, *own], names)

    dealt = declarations.select(*columns).repartition("project_id", "path")
    return dealt.sortWithinPartitions("project_id", "path", "start_byte", F.desc("end_byte"), "kind", "name").mapInArrow(build, CATALOG)


def range_contains_join(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Inner ranges with the first outer range, by start and key, of the same file that contains them."""
    o = outer.select(*keys, F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"), F.col("identity_key").alias("owner_key"))
    hit = inner.join(o, keys).where("o_start <= start_byte AND o_end >= end_byte")
    return hit.groupBy(*keys, "start_byte", "end_byte").agg(F.min_by("owner_key", F.struct("o_start", "owner_key")).alias("owner_key"))


def range_overlap_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ranges of the same file that overlap, ends exclusive."""
    other = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    return a.join(other, keys).where("start_byte < end_byte_b AND end_byte > start_byte_b")
