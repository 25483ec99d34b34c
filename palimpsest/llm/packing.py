"""Operator 10: packing token sequences, balanced by estimated attention cost."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import thrifty
from palimpsest.llm.token_files import tokenizer_file

#: Ids that a task holds before it packs them; its memory is bounded by this and the longest text.
WINDOW_TOKENS = 2_000_000
#: Estimated cost of a piece of n ids: LINEAR * n + n * n / QUADRATIC.
LINEAR, QUADRATIC = 1.0, 512.0


def balance(lengths, bins: int, seq_len: int):
    """Assign pieces to `bins` sequences: descending, each to the lowest-cost one that has room.

    Yields (piece, cut from, length, sequence, offset). A piece that fits nowhere is cut over the
    lowest-cost sequences that have any room; what no sequence takes is yielded with sequence -1.
    """
    import numpy as np

    lengths = np.asarray(lengths)
    cost, used = np.zeros(bins), np.zeros(bins, np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n, begin = int(lengths[piece]), 0
        while n:
            room = seq_len - used
            fits = room >= n if begin == 0 else room > 0
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    yield piece, begin, n, -1, 0
                    break
            at = int(np.where(fits, cost, np.inf).argmin())
            take = min(n, int(room[at]))
            yield piece, begin, take, at, int(used[at])
            cost[at] += LINEAR * take + take * take / QUADRATIC
            used[at] += take
            begin, n = begin + take, n - take


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, seq_len: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pack every whole text, tokenised and with end_id appended, into sequences of seq_len ids.

    Each input partition packs its own documents in windows, so nothing is shuffled: whole sequences
    are cut off texts that are longer, the rest is balanced over as many sequences as it fills, and
    what is left over passes to the next window. A partition's last ids go to sequences whose lengths
    are powers of two, so no sequence is padded. Null and empty texts are the end id alone, null ids
    and repeated rows are packed as any other, an empty table gives no rows, extra columns aren't read.

    Returns a row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id (partition and running number), offset.
    """
    from pyspark import TaskContext

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from palimpsest.llm.tokens import encoder

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        coder, tail = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        size = 0
        rows: list[tuple] = []

        def put(piece: tuple, begin: int, length: int, sequence_id: int, offset: int) -> None:
            doc, start, ids, total = piece
            rows.append((doc, start + begin, length, ids[4 * begin : 4 * (begin + length)], total, sequence_id, offset))

        def fill() -> None:
            """Pack what is held; the last incomplete sequence's pieces stay held."""
            nonlocal held, size, sequence
            bins, left = size // seq_len, []
            for piece, begin, length, at, offset in balance([len(p[2]) // 4 for p in held], bins, seq_len):
                if at >= 0:
                    put(held[piece], begin, length, sequence + at, offset)
                else:
                    doc, start, ids, total = held[piece]
                    left.append((doc, start + begin, ids[4 * begin :], total))
            sequence += bins
            held, size = left, size - bins * seq_len

        def finish() -> None:
            """Deal the last ids, fewer than a sequence, to sequences of descending powers of two."""
            nonlocal sequence
            room, offset, rest = 0, 0, size
            for piece in held:
                begin, n = 0, len(piece[2]) // 4
                while begin < n:
                    if not room:
                        room, offset = 1 << (rest.bit_length() - 1), 0
                        rest -= room
                        sequence += 1
                    take = min(room, n - begin)
                    put(piece, begin, take, sequence - 1, offset)
                    begin, room, offset = begin + take, room - take, offset + take

        def flush():
            nonlocal rows
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), 256):
                for doc, ids in zip(doc_ids[at : at + 256], coder.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    whole = n // seq_len * seq_len
                    for begin in range(0, whole, seq_len):
                        put((doc, 0, ids, n), begin, seq_len, sequence, 0)
                        sequence += 1
                    if n > whole:
                        held.append((doc, whole, ids[4 * whole :], n))
                        size += n - whole
                if size >= window_tokens:
                    fill()
                if len(rows) >= 500:
                    yield flush()
        fill()
        finish()
        if rows:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        thrifty(pack), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
