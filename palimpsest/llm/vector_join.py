"""Operator 2: near-duplicate vectors by an epsilon grid order join.

Vectors are rotated to the principal axes of a bounded sample, put in the lexicographic order of their
grid cells on the leading axes, and cut into blocks of that sequence. Blocks meet if their boxes lie
within epsilon, found by an equal join on the cells of the first axes; a task then joins the two sequences by
halving intervals and skipping those whose boxes are provably too far apart. The axes change only what
is skipped, never a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, connected_components, lookup_join, shuffle_partitions, thrifty

#: Links need at least this cosine.
COSINE = 0.98
#: Leading axes whose cells order the vectors and whose boxes are compared.
AXES = 6
#: Axes whose cells the blocks of a group meet by, if it has more than FEW_BLOCKS; so few meet all.
MEET_AXES, FEW_BLOCKS = 3, 8
#: Vectors of which the axes are taken: at most so many and so many bytes.
SAMPLE, SAMPLE_BYTES = 4096, 32 << 20
#: Bytes of vectors in a block; a task holds two blocks. Intervals of at most LEAF vectors are compared.
BLOCK_BYTES, LEAF = 1 << 20, 128


def _units(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, unit (binary, doubles of length 1) and key of each row; unit and key are null where nothing can link."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, labels = batch.column(2), batch.column(1).to_pylist()
            lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(math.nan))
            ends = np.cumsum(lengths)
            unit: list = [None] * batch.num_rows
            for d in np.unique(lengths[lengths > 0]).tolist():
                at = np.nonzero(lengths == d)[0]
                x = flat[(ends[at] - d)[:, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    most = np.abs(x).max(axis=1)
                    good = np.isfinite(most) & (most > 0)
                    x = x[good] / most[good, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                for i, row in zip(at[good].tolist(), x, strict=True):
                    if labels[i] is not None:
                        unit[i] = row.tobytes()
            key = [None if u is None else hashlib.blake2b(f"{g}\0".encode() + u, digest_size=16).digest() for g, u in zip(labels, unit, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.binary()), pa.array(key, pa.binary())], names=["id", "label", "unit", "key"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.mapInArrow(thrifty(run), "id long, label string, unit binary, key binary")


def _axes(classes: DataFrame, axes: int):
    """The leading principal axes, one a column, of a sample of at most SAMPLE vectors, padded to the longest."""
    import numpy as np

    n, width = classes.agg(F.count("*"), F.max("d")).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    taken = classes.where(F.pmod(F.xxhash64("key"), F.lit(-(-n // most))) == 0).limit(most).select("unit").collect()
    x = np.zeros((max(1, len(taken)), width))
    for i, row in enumerate(taken):
        own = np.frombuffer(row["unit"])
        x[i, : len(own)] = own
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:axes].T.copy()


def _sequence(classes: DataFrame, axes, epsilon: float, block_bytes: int) -> DataFrame:
    """The vectors with their place on the axes (p), block and place in it (seq), in epsilon grid order within each group."""

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = batch.column("unit").to_pylist()
            p = np.zeros((len(raw), axes.shape[1]))
            for d in {len(u) // 8 for u in raw}:
                at = [i for i, u in enumerate(raw) if len(u) == 8 * d]
                p[at] = np.frombuffer(b"".join(raw[i] for i in at)).reshape(-1, d) @ axes[:d]
            cells = np.floor(p / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "p", "cells"])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block, held, group = (TaskContext.get().partitionId() << 32) - 1, 0, None
        for batch in batches:
            blocks, seqs = [], []
            for label, d in zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), strict=True):
                if (label, d) != group or held >= max(LEAF, block_bytes // (8 * d)):
                    block, held, group = block + 1, 0, (label, d)
                blocks.append(block)
                seqs.append(held)
                held += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(seqs, pa.int64())], names=[*batch.schema.names, "block", "seq"])

    columns = "cid long, label string, d int, n long, unit binary, p array<double>"
    placed = classes.select("cid", "label", "d", "n", "unit").mapInArrow(thrifty(place), f"{columns}, cells array<int>")
    order = ["label", "d", "cells", "cid"]
    placed = placed.repartitionByRange(shuffle_partitions(classes.sparkSession), *order).sortWithinPartitions(*order).drop("cells")
    return placed.mapInArrow(cut, f"{columns}, block long, seq long")


def _block_pairs(sequence: DataFrame, axes: int, epsilon: float) -> DataFrame:
    """(a, b), a <= b: the blocks of one group whose boxes lie within epsilon."""
    p = [F.element_at("p", i + 1) for i in range(axes)]
    boxes = sequence.groupBy("block", "label", "d").agg(F.array(*map(F.min, p)).alias("lo"), F.array(*map(F.max, p)).alias("hi"))
    counted = boxes.groupBy("label", "d").agg(F.count("*").alias("n"))
    boxes = boxes.join(counted, ["label", "d"])
    meet = [f"cell{i}" for i in range(min(MEET_AXES, axes))]

    def met(name: str, lo: str, hi: str, more: int) -> DataFrame:
        out = boxes.select("label", "d", "n", F.col("block").alias(name), F.col("lo").alias(lo), F.col("hi").alias(hi))
        for i, cell in enumerate(meet, 1):
            first, last = (F.floor(F.element_at(side, i) / epsilon) for side in (lo, hi))
            few = F.col("n") <= FEW_BLOCKS
            out = out.withColumn(cell, F.explode(F.sequence(F.when(few, 0).otherwise(first - more), F.when(few, 0).otherwise(last + more))))
        return out.drop("n")

    one, two = met("a", "alo", "ahi", 0), met("b", "blo", "bhi", 1)
    gap = F.zip_with(F.zip_with("blo", "ahi", lambda x, y: x - y), F.zip_with("alo", "bhi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= epsilon * epsilon * (1 + 1e-9)
    return one.join(two, ["label", "d", *meet]).where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()


def _join_blocks(sequence: DataFrame, pairs: DataFrame, axes, epsilon: float, cosine: float) -> DataFrame:
    """(cid, root, links): in each pair of blocks, a linked vector's links and one vector that its links reach."""
    reach = epsilon * epsilon * (1 + 1e-9)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.groups import by_key

        schema = pa.schema([("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
        for table in by_key(batches):
            first = int(np.count_nonzero(np.asarray(table.column("side")) == 0))
            both = first < table.num_rows
            cid, n = np.asarray(table.column("cid")), np.asarray(table.column("n"))
            x = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(cid), -1)
            p = x @ axes[: x.shape[1]]
            links, root = np.zeros(len(cid), np.int64), list(range(len(cid)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            def compare(a: slice, b: slice) -> None:
                near = x[a] @ x[b].T >= cosine
                if a == b:
                    np.fill_diagonal(near, False)
                if not near.any():
                    return
                links[a] += near @ n[b]
                if a != b:
                    links[b] += near.T @ n[a]
                # the least place that each vector's links reach within this leaf
                left, right = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
                while True:
                    most = len(cid)
                    new_left = np.minimum(left, np.where(near, right[None, :], most).min(axis=1))
                    new_right = np.minimum(right, np.where(near, new_left[:, None], most).min(axis=0))
                    if a == b:
                        new_left = new_right = np.minimum(new_left, new_right)
                    if (new_left == left).all() and (new_right == right).all():
                        break
                    left, right = new_left, new_right
                for part, least in ((a, left), (b, right)):
                    for i, j in zip(range(part.start, part.stop), least.tolist(), strict=True):
                        if i != j:
                            i, j = find(i), find(j)
                            root[max(i, j)] = min(i, j)

            todo = [(0, first, first, len(cid)) if both else (0, first, 0, first)]
            while todo:
                a0, a1, b0, b1 = todo.pop()
                same = (a0, a1) == (b0, b1)
                if not same:
                    gap = np.maximum(np.maximum(p[b0:b1].min(axis=0) - p[a0:a1].max(axis=0), p[a0:a1].min(axis=0) - p[b0:b1].max(axis=0)), 0)
                    if (gap * gap).sum() > reach:
                        continue
                if max(a1 - a0, b1 - b0) <= LEAF:
                    compare(slice(a0, a1), slice(b0, b1))
                elif same:
                    m = (a0 + a1) // 2
                    todo += [(a0, m, a0, m), (m, a1, m, a1), (a0, m, m, a1)]
                elif a1 - a0 >= b1 - b0:
                    m = (a0 + a1) // 2
                    todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
                else:
                    m = (b0 + b1) // 2
                    todo += [(a0, a1, b0, m), (a0, a1, m, b1)]
            hit = np.nonzero(links)[0]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(cid[[find(i) for i in hit.tolist()]]), pa.array(links[hit])], schema=schema)

    sides = pairs.withColumn("pair", F.xxhash64("a", "b"))
    sides = sides.select("pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))).alias("s"), "a", "b")
    sides = sides.where((F.col("s.side") == 0) | (F.col("a") != F.col("b"))).select("pair", "s.*")
    dealt = sequence.select("block", "seq", "cid", "n", "unit").join(sides, "block")
    dealt = dealt.repartition("pair").sortWithinPartitions("pair", "side", "seq").select("pair", "side", "cid", "n", "unit")
    return dealt.mapInArrow(thrifty(run), "cid long, root long, links long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                 axes: int = AXES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of vectors: id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Rows link if their labels are equal and not null, their vectors equally long and the vectors' cosine,
    in double precision, is at least `cosine`. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. Rows of equal direction are one class from the start, so
    any number of copies, repeated rows included, costs one vector; each still counts as a link of the
    others. A null id takes part in links but names no component. An empty table gives no rows. Other
    columns aren't read.

    A task gets two blocks of bounded bytes and gives one row a linked vector, never the pairs.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark)
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-6
    rows = _units(vectors, id_col, vector_col, label_col)
    first = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("id").alias("rep"))
    classes = ws.table(first.select(F.monotonically_increasing_id().alias("cid"), "key", "label", (F.octet_length("unit") / 8).cast("int").alias("d"), "n", "rep", "unit"), "classes")
    if classes.isEmpty():
        found = spark.createDataFrame([], "cid long, root long, links long")
    else:
        turn = _axes(classes, axes)
        sequence = ws.table(_sequence(classes, turn, epsilon, block_bytes), "sequence")
        pairs = ws.table(_block_pairs(sequence, turn.shape[1], epsilon), "pairs")
        found = ws.table(_join_blocks(sequence, pairs, turn, epsilon, cosine), "found")
        ws.drop("sequence")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = connected_components(ws, found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = ws.table(linked.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    least = linked.join(least, "component").select(F.col("node").alias("cid"), "least")
    answer = classes.select("cid", "key", "n", "rep").join(counts, "cid", "left").join(least, "cid", "left")
    answer = ws.table(answer.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "answer")
    ws.drop("classes")
    whole = lookup_join(rows.select("id", "key"), answer, ["key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS MATERIALIZED (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= {COSINE}),
reach(vec_id, other) AS (SELECT a, a FROM links UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = other),
least AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM v LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
