"""Chunks of source text, cut at symbols and line ends, and their embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import chunk_key, embedding_input, sha256_hex
from corpusloom.operators.budgets import cover_gaps, outermost_ranges, saturating_budget


def split_range(data: bytes, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Pieces of at most ``most`` bytes that end after a line end where there is one, and never inside a character."""
    out = []
    while start < end:
        stop = min(start + most, end)
        if stop < end:
            line = data.rfind(b"\n", start, stop)
            if line >= start:
                stop = line + 1
            else:
                back = stop
                while back > start and data[back] & 0xC0 == 0x80:
                    back -= 1
                stop = back if back > start else stop
        out.append((start, stop))
        start = stop
    return out


def chunk_sources(files: DataFrame, symbols: DataFrame | None = None, max_bytes: int = 8192, max_chunks: int = 500) -> DataFrame:
    """``files(project_id, path, language, text)`` -> one row a chunk with range, hashes, owner and stable key.

    The outermost ``symbols(project_id, path, identity_key, start_byte, end_byte, name, kind)``
    and the gaps between them are split on their own. Blank chunks are dropped; of a
    file's others the first ``max_chunks`` stay and ``truncated`` tells whether there
    were more. A leading byte-order mark does not count. A file is one row, so its texts
    are never shuffled; only ranges of symbols are, to be joined to the text once.
    """
    keys = ["project_id", "path"]
    body = files.select(*keys, "language", F.regexp_replace("text", "^﻿", "").alias("text"))
    if symbols is None:
        cut = body.withColumn("ranges", F.array(F.struct(F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), F.lit(None).cast("string").alias("identity_key"))))
    else:
        kept = outermost_ranges(symbols, keys)
        sizes = body.select(*keys, F.octet_length("text").cast("long").alias("size_bytes"))
        ranges = cover_gaps(kept, sizes, keys)
        listed = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "identity_key"))).alias("ranges"))
        cut = body.join(listed, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, out, met = (row["text"] or "").encode(), [], {}
                lines = np.frombuffer(data, np.uint8)
                ends = np.nonzero(lines == 10)[0]
                for r in row["ranges"]:
                    for a, b in split_range(data, r["start_byte"], r["end_byte"], max_bytes):
                        text = data[a:b].decode("utf-8", "replace")
                        if text.strip():
                            first, last = int(np.searchsorted(ends, a)), int(np.searchsorted(ends, b))
                            column = lambda at, line: at - (int(ends[line - 1]) + 1 if line else 0)
                            again = met[text, r["identity_key"]] = met.get((text, r["identity_key"]), -1) + 1
                            out.append((a, b, first, last, column(a, first), column(b, last), r["identity_key"], text, again))
                columns = list(zip(*out[:max_chunks], strict=True)) if out else [()] * 9
                n = min(len(out), max_chunks)
                kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[c]] * n, pa.string()) for c in ("project_id", "path", "language")), pa.array(range(n), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([len(out) > max_chunks] * n, pa.bool_())],
                    ["project_id", "path", "language", "ordinal", "start_byte", "end_byte", "start_line", "end_line", "start_col", "end_col", "owner_key", "content", "occurrence", "truncated"],
                )

    schema = "project_id string, path string, language string, ordinal int, start_byte long, end_byte long, start_line long, end_line long, start_col long, end_col long, owner_key string, content string, occurrence int, truncated boolean"
    rows = cut.select(*keys, "language", "text", "ranges").mapInArrow(run, schema)
    rows = rows.withColumn("content_hash", sha256_hex("content"))
    rows = rows.withColumn("identity_key", chunk_key("path", "content_hash", "owner_key", "occurrence"))
    if symbols is None:
        named = rows.withColumn("symbol_name", F.lit(None).cast("string")).withColumn("symbol_kind", F.lit(None).cast("string"))
    else:
        owners = symbols.select(*keys, F.col("identity_key").alias("owner_key"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"))
        named = rows.join(owners, [*keys, "owner_key"], "left")
    return named.withColumn("input_hash", sha256_hex(embedding_input("path", "language", "content", "symbol_name", "symbol_kind")))


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic bag-of-words embedder for tests and defaults."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1 if h >> 63 else -1
        return out

    return embed


def embed(df: DataFrame, text: str, embed_fn: Callable[[list[str]], np.ndarray], dimensions: int, batch: int = 64, strict: bool = True) -> DataFrame:
    """Adds ``embedding``: one vector of ``dimensions`` a row; texts are never cut.

    Where ``embed_fn`` raises or returns another shape the job fails; unless ``strict``,
    the batch is then tried text by text, and those that fail alone get a null.
    """

    def vectors_of(texts: list[str]) -> list:
        try:
            found = np.asarray(embed_fn(texts), np.float32)
            if found.shape != (len(texts), dimensions):
                raise ValueError(f"the embedder returned {found.shape} for {len(texts)} texts of {dimensions} dimensions")
            return list(found)
        except Exception:
            if strict:
                raise
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors_of([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column, vectors = rows.column(rows.schema.get_field_index(text)).to_pylist(), []
            for at in range(0, len(column), batch):
                vectors += vectors_of([t or "" for t in column[at : at + batch]])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*rows.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, schema + ", embedding array<float>")


def index_embeddings(chunks: DataFrame, prior: DataFrame, embed_fn: Callable, dimensions: int, identity: str, max_chunks: int = 50_000, strict: bool = True) -> DataFrame:
    """Chunks of each project up to a budget, with the prior vector where key, input and ``identity`` of the model are the same, else a new one.

    The match runs without vectors; they are fetched for the hits only.
    """
    chosen, _ = saturating_budget(chunks, ["path", "ordinal"], max_chunks)
    keys = ["project_id", "identity_key", "input_hash"]
    usable = prior.where((F.col("identity") == identity) & (F.size("embedding") == dimensions))
    marked = chosen.join(usable.select(*keys).distinct().withColumn("reused", F.lit(True)), keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
    old = marked.where("reused").join(usable.select(*keys, "embedding").dropDuplicates(keys), keys)
    new = embed(marked.where("NOT reused").withColumn("input", embedding_input("path", "language", "content", "symbol_name", "symbol_kind")), "input", embed_fn, dimensions, strict=strict).drop("input")
    return old.unionByName(new).withColumn("identity", F.lit(identity))
