"""Operator 6: token files in Simple-8b words, written in document order and read back.

Files are binary, written by the tasks to a shared folder through Arrow's file systems (local and
mounted paths, object stores, HDFS) and read with Spark's binaryFile source. A task writes under a
temporary name and renames, and its input is sorted, so a task that runs again writes the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, shuffle_partitions, thrifty

#: A file is closed when it holds so many ids, so that one file fits a task's memory.
FILE_TOKENS = 1_500_000


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every whole text, append end_id to each and write the ids in ascending id order.

    Null and empty texts give the end id alone; null ids come first; rows of equal id are ordered by
    text, repeated rows stay; an empty table writes no file. Extra columns aren't read. Returns the
    written directory table: part, file, n_docs, n_tokens.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    # ceil of the shuffle setting: rows are dealt by id range, text crosses the shuffle once
    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), F.col("i").asc_nulls_first()).sortWithinPartitions(
        F.col("i").asc_nulls_first(), F.col("t").asc_nulls_first())

    def write(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyarrow import fs

        from palimpsest.llm.simple8b import pack_file
        from palimpsest.llm.tokens import encoder

        context, coder, tail = TaskContext.get(), encoder(tokenizer_path), end_id.to_bytes(4, "little")
        part, start, files = context.partitionId(), 0, 0
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        held_ids: list = []
        held: list[bytes] = []
        size = 0

        def close():
            nonlocal held_ids, held, size, start, files
            name = f"part-{part:05d}-{files:05d}.s8b"
            passing = f"{root}/_{name}.{context.taskAttemptId()}-{os.getpid()}"
            with system.open_output_stream(passing) as out:
                out.write(pack_file(held_ids, held, part, start))
            system.move(passing, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(held)], "n_tokens": [size]},
                                             schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            start, files, size, held_ids, held = start + size, files + 1, 0, [], []
            return row

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), 256):
                for i, ids in zip(doc_ids[at : at + 256], coder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    held_ids.append(i)
                    held.append(ids + tail)
                    size += len(ids) // 4 + 1
                    if size >= file_tokens:
                        yield close()
        if held:
            yield close()

    return ordered.mapInArrow(thrifty(write), "part long, file string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, folder: str, directory: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of every written document.

    start counts the ids of all documents before it: the file holds the count within its part, and the
    parts' totals (a row a part, as many as shuffle partitions) give the rest.
    """
    totals = directory.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for row in totals:
        rows.append((row["part"], before))
        before += row["n"]
    parts = spark.createDataFrame(rows, "part long, before long")

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.simple8b import unpack_file

        schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for cell in batch.column(0):
                part, start, doc_ids, counts, ids = unpack_file(cell.as_py())
                ends = np.cumsum(counts)
                raw = ids.tobytes()
                held = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array(held, pa.binary())], schema=schema)

    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("content")
    found = files.mapInArrow(thrifty(read), "part long, doc_id long, within long, n_tokens long, ids binary")
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    folder = f"{ws.folder}/tokens"
    directory = ws.table(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_file(), end_id=2), "directory")
    return read_token_files(spark, folder, directory).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
