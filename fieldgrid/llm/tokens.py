"""Token counts by separator scan: documents of flat token files that have no index.

A file is a run of token ids of fixed width, each document followed by the end-of-document id, held as numbered
blocks that are cut wherever they are full. Each block is searched in one vectorised comparison. Documents that cross
blocks are stitched by prefix scans over the blocks' summaries (tokens, separators, place of the last separator):
within groups of GROUP blocks, and over the groups, so that no task orders all blocks of a long file.

Defined cases: two separators in a row enclose a document of 0 tokens; tokens behind the last separator of a file are
a document that is not terminated; null and empty blocks have no tokens; files without tokens have no documents;
a block whose length is no multiple of the width raises ValueError; null texts are written as empty documents, repeated
rows as documents of their own, long texts over as many blocks as they fill; extra columns are left out; an empty table
gives no files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder
from .common import cut

BLOCK_TOKENS = 65_536
#: Blocks of a file whose prefix scan is one task's.
GROUP = 1024
#: Files up to this size are read whole; blocks of a range of a larger one; tasks that read ranges.
WHOLE_BYTES, PART_BLOCKS, MOST_TASKS = 1 << 28, 512, 10_000
_TYPES = {2: "<u2", 4: "<u4"}


def token_blocks(docs: DataFrame, path: str, pattern: str, end_id: int, *, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, doc_ids): the encoded texts of each partition of ``docs(doc_id, text)`` as one file.

    ``doc_ids`` names the documents that end in the block; the scan does not need it. The result must be written
    before it is used twice, as a file is what one partition holds.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, block, held, size, ids = TaskContext.get().partitionId(), 0, [], 0, []
        bpe = encoder(path, pattern)
        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), b["text"], strict=True):
                rest = np.array([*bpe.encode(text), end_id], dtype=_TYPES[width])
                while len(rest):
                    part, rest = rest[: block_tokens - size], rest[block_tokens - size :]
                    held.append(part)
                    size += len(part)
                    if not len(rest):
                        ids.append(doc_id)
                    if size == block_tokens:
                        yield _block(file, block, held, ids)
                        block, held, size, ids = block + 1, [], 0, []
        if size:
            yield _block(file, block, held, ids)

    return docs.select("doc_id", "text").mapInPandas(write, "file int, block long, tokens binary, doc_ids array<long>")


def _block(file: int, block: int, held: list[np.ndarray], ids: list) -> pd.DataFrame:
    return pd.DataFrame({"file": [file], "block": [block], "tokens": [b"".join(x.tobytes() for x in held)], "doc_ids": [ids]})


def file_blocks(spark: SparkSession, path: str, *, width: int = 2, block_tokens: int = BLOCK_TOKENS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(file, block, tokens) of raw token files under a path that Spark reads; empty files have no blocks.

    A file of ``whole_bytes`` or fewer is read by one task, once, by Spark's own reader. A larger one is read by ranges
    of PART_BLOCKS blocks, each in any task, through the file systems of pyarrow.
    """
    size = width * block_tokens

    def batch(file: str, block: int, part: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([part], pa.binary())], ["file", "block", "tokens"])

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("file"), b.column("content"), strict=True):
                whole = content.as_buffer()
                for k in range(-(-whole.size // size)):
                    yield batch(file.as_py(), k, whole.slice(k * size, min(size, whole.size - k * size)).to_pybytes())

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length, part in zip(*(b.column(c).to_pylist() for c in ("file", "length", "part")), strict=True):
                system, name = _file_system(file)
                with system.open_input_file(name) as f:
                    for k in range(part * PART_BLOCKS, min((part + 1) * PART_BLOCKS, -(-length // size))):
                        yield batch(file, k, f.read_at(min(size, length - k * size), k * size))

    schema = "file string, block long, tokens binary"
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    small = files.where(F.col("length") <= whole_bytes).select(F.col("path").alias("file"), "content").mapInArrow(slices, schema)
    # Only names and lengths are read here; a row for each range.
    large = files.where(F.col("length") > whole_bytes).select(F.col("path").alias("file"), "length")
    parts = large.select("file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (size * PART_BLOCKS)).cast("int"))).alias("part"))
    many = parts.count()
    if not many:
        return small
    return small.unionByName(parts.repartition(min(many, MOST_TASKS), "file", "part").mapInArrow(ranges, schema))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path as Spark names it, and the path there."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def scan(blocks: DataFrame, end_id: int, *, width: int = 2, labels: str | None = None) -> DataFrame:
    """(file, doc_no, start, n_tokens, terminated) of each document in the blocks' files, and its label if there are any.

    ``labels``: an array column that names, in order, the documents that end in the block. The blocks' bytes are read
    once and not moved; their summaries (the separators' places) are written and used from there.
    """
    kind = _TYPES[width]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b["tokens"]:
                raw = raw or b""
                if len(raw) % width:
                    raise ValueError(f"a block of {len(raw)} bytes does not hold whole tokens of {width} bytes")
                x = np.frombuffer(raw, kind)
                rows.append((len(x), np.flatnonzero(x == end_id).astype(np.int32)))
            yield b.drop(columns="tokens").assign(n=[n for n, _ in rows], ends=[e for _, e in rows])

    rest = [c for c in ("file", "block", labels) if c]
    kinds = dict(blocks.dtypes)
    found = blocks.select(*rest, "tokens").mapInPandas(find, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", n long, ends array<int>")
    found = cut(found)  # four uses; without it each would search the blocks again
    found = found.withColumn("part", F.floor(F.col("block") / GROUP)).withColumn("d", F.size("ends").cast("long"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("file", "part").orderBy("block")
    parts = Window.partitionBy("file").orderBy("part")
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = found.withColumn("n_before", zero(F.sum("n").over(earlier(in_part)))).withColumn("d_before", zero(F.sum("d").over(earlier(in_part))))
    # The place behind the last separator so far, counted in the part.
    behind = F.when(F.col("d") > 0, F.col("n_before") + F.element_at("ends", -1) + 1)
    found = found.withColumn("behind", behind).withColumn("open_at", F.max("behind").over(earlier(in_part)))
    sums = found.groupBy("file", "part").agg(F.sum("n").alias("pn"), F.sum("d").alias("pd"), F.max("behind").alias("pb"))
    sums = sums.withColumn("n0", zero(F.sum("pn").over(earlier(parts)))).withColumn("d0", zero(F.sum("pd").over(earlier(parts))))
    sums = sums.withColumn("p_behind", F.col("n0") + F.col("pb")).withColumn("o0", zero(F.max("p_behind").over(earlier(parts))))
    at = found.join(sums.select("file", "part", "n0", "d0", "o0"), ["file", "part"])
    at = at.withColumn("base", F.col("n0") + F.col("n_before")).withColumn("open", F.coalesce(F.col("n0") + F.col("open_at"), F.col("o0")))
    ended = at.where(F.col("d") > 0).select("file", "base", "open", (F.col("d0") + F.col("d_before")).alias("d_base"), "ends", *([labels] if labels else []), F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    named = [F.get(labels, F.col("i")).alias("label")] if labels else []
    docs = ended.select("file", (F.col("d_base") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"), *named)
    whole = sums.groupBy("file").agg(F.sum("pn").alias("n"), F.sum("pd").alias("d"), zero(F.max("p_behind")).alias("o")).where(F.col("n") > F.col("o"))
    tail = whole.select("file", F.col("d").alias("doc_no"), F.col("o").alias("start"), (F.col("n") - F.col("o")).alias("n_tokens"), F.lit(False).alias("terminated"), *([F.lit(None).cast("long").alias("label")] if labels else []))
    return docs.unionByName(tail)
