"""Operator 8: near-duplicate documents by a chosen-path set similarity join over minwise hashes.

Documents with equal shingle sets are one class from the start. A tree's root and every node that is
too large choose a few of the minwise hashes, by a hash of the path so far, and send each class to
one child a chosen hash, named by its value; similar sets stay together with a chance that grows with
each choice. Small nodes compare all their classes by sketches of the hashes. What the sketches
connect is then compared exactly, on full sets, and only exact links count.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, connected_components, lookup_join, thrifty

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Independent trees, and hashes that each node chooses. Two sets at 0.85 share none of 4 chosen hashes with
#: chance 0.15 ** 4, so at depth d all 4 trees lose them with chance of about (d * 0.0005) ** 4.
TREES, CHOICES, DEPTH = 4, 4, 3
#: A node of at most so many classes compares them all; its sketches take 128 bytes each.
NODE_CLASSES = 3000
#: Equal bytes of the 128 in two sketches from which sets are compared exactly: 5.7 deviations below the mean at 0.85.
SKETCH_EQUAL = 86
#: Classes and shingles that one task compares exactly; larger groups are compared block against block.
BLOCK_CLASSES, BLOCK_SHINGLES = 3000, 1_000_000


def shingled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n_shingles, key (of the set) and signature for each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from palimpsest.llm.shingles import set_keys, shingle_sets, signatures

        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets, sizes = shingle_sets(part.column(2))
                sig = iter(signatures(sets, sizes))
                keys = set_keys(sets, sizes)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array([next(sig).tobytes() if k else None for k in keys], pa.binary())], names=["id", "text_hash", "n_shingles", "key", "signature"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(thrifty(run), "id long, text_hash long, n_shingles long, key binary, signature binary")


def _branch(classes: DataFrame, root: bool, trees: int, choices: int, level: int) -> DataFrame:
    """(path, cid): the children of the roots, or of the nodes in column path, that each class goes to."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.shingles import HASHES, mix

        salt = np.uint64(7919 * (level + 1))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, HASHES)
            cid = batch.column("cid")
            if root:
                starts = [np.full(n, t + 1, np.uint64) for t in range(trees)]
            else:
                starts = [np.asarray(batch.column("path")).astype(np.int64).view(np.uint64)]
            for path in starts:
                for j in range(choices):
                    drawn = mix(path * np.uint64(choices + 1) + np.uint64(j) + salt)
                    which = (drawn % np.uint64(HASHES)).astype(np.int64)
                    child = mix(mix(path ^ drawn) + sig[np.arange(n), which].astype(np.uint64) + (which.astype(np.uint64) << np.uint64(32)))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), cid], names=["path", "cid"])

    columns = ["cid", "signature"] if root else ["path", "cid", "signature"]
    return classes.select(*columns).mapInArrow(thrifty(run), "path long, cid long")


def _compare_nodes(nodes: DataFrame, equal: int) -> DataFrame:
    """Links (a, b) that connect, within each node, what the sketches find similar: fewer than its classes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.groups import by_key

        out_a: list = []
        out_b: list = []
        for node in by_key(batches):
            cid = np.asarray(node.column("cid"))
            sketch = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1)
            pool = np.arange(1, len(cid))
            queue = [0]
            while len(pool):
                at = queue.pop() if queue else None
                if at is None:
                    at, pool = int(pool[0]), pool[1:]
                near = (sketch[pool] == sketch[at]).sum(axis=1) >= equal
                found = pool[near]
                if len(found):
                    out_a += [int(cid[at])] * len(found)
                    out_b += cid[found].tolist()
                    queue += found.tolist()
                    pool = pool[~near]
            if len(out_a) > 20_000:
                yield pa.RecordBatch.from_pydict({"a": out_a, "b": out_b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_pydict({"a": out_a, "b": out_b}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return nodes.repartition("path").sortWithinPartitions("path").select("path", "cid", "sketch").mapInArrow(thrifty(run), "a long, b long")


def candidate_links(ws: Workspace, classes: DataFrame, trees: int = TREES, choices: int = CHOICES, depth: int = DEPTH,
                    node_classes: int = NODE_CLASSES, equal: int = SKETCH_EQUAL) -> DataFrame:
    """Links of classes (cid, signature, sketch) whose sketches are similar, found along chosen paths.

    Nodes that are still too large at the last depth hold sets that share nearly all hashes: they are
    dealt to sub-nodes by pairs of blocks, so that every two of their classes meet in one.
    """
    paths, found = _branch(classes, True, trees, choices, 0), None
    for level in range(depth):
        paths = ws.table(paths, f"paths-{level}")
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        nodes = ws.table(paths.join(sizes, "path"), f"nodes-{level}")
        ws.drop(f"paths-{level}")
        leaves = nodes.where(F.col("n") <= node_classes)
        large = nodes.where(F.col("n") > node_classes)
        more = not large.isEmpty()
        if more and level == depth - 1:
            blocks = F.ceil(F.col("n") / (node_classes // 2)).cast("int")
            own = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
            dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            pair = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
            leaves = leaves.select("path", "cid").unionByName(dealt.select(pair.alias("path"), "cid"))
            more = False
        links = _compare_nodes(leaves.select("path", "cid").join(classes.select("cid", "sketch"), "cid"), equal)
        links = ws.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"links-{level}")
        found = links if found is None else found.unionByName(links)
        if not more:
            break
        paths = _branch(large.join(classes.select("cid", "signature"), "cid"), False, 1, choices, level + 1).distinct()
    return found


def _exact_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect, within each group, the sets that are similar enough; exact, on full sets."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.groups import by_key

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in by_key(batches):
            table = table.combine_chunks()
            one = {c: s for c, s in zip(table.column("cid").to_pylist(), table.column("shingles").to_pylist(), strict=True)}  # a class may stand twice
            cid = list(one)
            size = np.array([len(s) // 8 for s in one.values()])
            owner = np.repeat(np.arange(len(cid)), size)
            _, shingle, df = np.unique(np.frombuffer(b"".join(one.values()), np.uint64), return_inverse=True, return_counts=True)
            shared = df[shingle] > 1
            shingle, owner = shingle[shared], owner[shared]
            begin = np.searchsorted(owner, np.arange(len(cid) + 1))
            marked = np.zeros(len(df), bool)
            free = np.ones(len(cid), bool)
            rest, rest_owner = shingle, owner
            out_a: list = []
            out_b: list = []
            for first in range(len(cid)):
                if not free[first]:
                    continue
                free[first] = False
                queue = [first]
                while queue:
                    at = queue.pop()
                    mine = shingle[begin[at] : begin[at + 1]]
                    marked[mine] = True
                    common = np.bincount(rest_owner[marked[rest]], minlength=len(cid))
                    marked[mine] = False
                    found = np.nonzero(free & (100 * common >= percent * (size[at] + size - common)))[0]
                    free[found] = False
                    out_a += [cid[at]] * len(found)
                    out_b += [cid[i] for i in found]
                    queue += found.tolist()
                    if len(found) and 2 * np.count_nonzero(free[rest_owner]) < len(rest_owner):
                        left = free[rest_owner]
                        rest, rest_owner = rest[left], rest_owner[left]
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": out_a, "b": out_b}, schema=schema)

    return sets.repartition("group").sortWithinPartitions("group").select("group", "cid", "shingles").mapInArrow(thrifty(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int = TREES,
                    choices: int = CHOICES, equal: int = SKETCH_EQUAL, block_classes: int = BLOCK_CLASSES, block_shingles: int = BLOCK_SHINGLES,
                    node_classes: int = NODE_CLASSES) -> DataFrame:
    """A row per row of docs: id, text_hash, n_shingles, component_id, kept, chosen.

    Words are runs of anything but ASCII white space, A-Z lower-cased. component_id is the least id that
    is reachable by links, kept says that it is the row's own. A text without words has an empty set,
    links with nothing and is kept, as is a null text. A null id takes part in links but names no
    component; alone its component is null, and it is kept. Repeated rows are one class and each keeps its
    row. chosen, unlike kept, holds for one (id, text_hash) of a component whatever its ids: the least, null
    ids last; and for texts without words. An empty table gives no rows. Other columns aren't read.

    Distributed throughout: a class with a third of all rows is one row after partial aggregation, nodes
    and groups that exceed a task's bounds are divided in blocks that meet pairwise, and each task gives
    links that connect, fewer than its rows, never all pairs.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    rows = ws.table(shingled(docs, id_col, text_col), "rows")
    held = rows.where(F.col("key").isNotNull())
    least_row = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    first = held.groupBy("key").agg(least_row.alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # the low byte of each little-endian hash
    sketch = F.unhex(F.regexp_replace(F.hex("signature"), "(..)......", "$1"))
    classes = ws.table(first.select(F.monotonically_increasing_id().alias("cid"), "key", "row", F.col("row.id").alias("rep"), "n_shingles", "signature", sketch.alias("sketch")), "classes")
    near = connected_components(ws, candidate_links(ws, classes, trees, choices, DEPTH, node_classes, equal), "near")
    near = ws.table(near.join(classes.select(F.col("cid").alias("node"), "key", "rep", "n_shingles"), "node").select(F.col("node").alias("cid"), "component", "key", "rep", "n_shingles"), "near")
    weight = near.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_classes), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("parts"))
    weight = ws.table(weight.select("component", F.when(F.col("parts") > 1, 2 * F.col("parts")).otherwise(1).alias("blocks")), "weights")

    def sets_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from palimpsest.llm.shingles import set_keys, shingle_sets

        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                sets, sizes = shingle_sets(batch.column(0).slice(at, 400))
                raw, ends = sets.tobytes(), np.cumsum(sizes).tolist()
                cut = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends, sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets, sizes), pa.binary()), pa.array(cut, pa.binary())], names=["key", "shingles"])

    # texts of the classes in question, each by the row with its least id, or by any that has no id
    named = near.where(F.col("rep").isNotNull()).select(F.col("rep").alias("i")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    texts = lookup_join(texts.where(F.col("i").isNotNull()), named, ["i"], "left_semi").unionByName(texts.where(F.col("i").isNull())).select("t")
    asked = ws.table(near.join(weight, "component").select("cid", "key", "component", "blocks"), "asked")
    sets = lookup_join(texts.mapInArrow(thrifty(sets_of), "key binary, shingles binary"), asked, ["key"], "inner")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    links = ws.table(_exact_links(dealt.select(group.alias("group"), "cid", "shingles"), percent), "exact")
    linked = connected_components(ws, links, "exact-cc")
    linked = linked.join(classes.select(F.col("cid").alias("node"), "row"), "node")
    least = linked.groupBy("component").agg(F.min("row").alias("least"))
    least = ws.table(linked.join(least, "component").select(F.col("node").alias("cid"), "least"), "least")
    answer = classes.select("cid", "key", "row").join(least, "cid", "left").select("key", F.coalesce("least", "row").alias("row"))
    answer = ws.table(answer.select("key", F.col("row.id").alias("component_id"), F.col("row.text_hash").alias("least_hash")), "answer")
    for name in ("classes", "near", "weights", "asked", "exact", "least"):
        ws.drop(name)
    rows = rows.select("id", "text_hash", "n_shingles", "key")
    whole = lookup_join(rows, answer, ["key"], "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    chosen = F.col("key").isNull() | (kept & (F.col("text_hash") == F.col("least_hash")))
    return whole.select(F.col("id").alias(id_col), "text_hash", "n_shingles", "component_id", kept.alias("kept"), chosen.alias("chosen"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP8_SQL = f"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
