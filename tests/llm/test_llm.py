"""The corpus operators against their SQL, against brute force, and on nulls, ties, repeated rows and empty tables."""

import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import archive, language, line_dedup, mixing, near_dedup, packing, search, secrets, token_files, vector_join
from palimpsest.llm.queries import ORACLES, QUERIES
from palimpsest.llm.simple8b import decode_blocks, encode_blocks
from palimpsest.llm.tokens import WordEncoder
from tests.compare import SF, assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name])


def odd_docs(spark):
    """Nulls in any column, empty and blank texts, a very long one, copies, repeated rows, and columns that clash."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    base = " ".join(rng.choice(WORDS) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base, "en", "a"), (2, near, None, None), (3, base, "de", "a"), (3, base, "de", "a"), (4, None, "en", "b"), (5, "", "en", "b"), (6, " \n ", "en", "b"),
            (7, long, "fr", "a"), (None, base, "en", "a"), (8, "one two", "en", "c"), (9, "ONE two", "en", "c"), (10, "123 !!", "en", "c")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("_host", "key", "text_hash", "n_tokens", "sampled", "probability", "cid", "component_id")})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_dedup_odd(spark):
    docs = odd_docs(spark)
    rows = docs.where("doc_id is not null").collect()
    sets = [shingles(r["text"]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {r: min(rows[i]["doc_id"] for i in range(len(rows)) if root[i] == r) for r in root}
    want = sorted((r["doc_id"], len(s), least[c], r["doc_id"] == least[c]) for r, s, c in zip(rows, sets, root, strict=True))
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [tuple(r)[2:] for r in got if r["doc_id"] is None] == [(1, False)]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_stage_odd(spark):
    """One row of a group stays with null and with repeated ids too."""
    odd = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup_stage(spark, odd, SF).collect()) == sorted(["1", "4", "5", "6", "7", "8", "10"])
    rng = random.Random(9)
    rows = []
    for ids in ([None, None, None], [7, 7, 7], [None, 8, 8]):
        base = [rng.choice(WORDS) for _ in range(150)]
        rows += [(i, " ".join([*base[:70], *(["other"] * k), *base[70:]]), "en", "s", 0) for k, i in enumerate(ids)]
    kept = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows + rows[:2], DOCS), SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "8", "None"]


def test_near_dedup_blocks(spark):
    """One group larger than a node and a block: every link is found by pairs of blocks."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(400)]
    docs = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        docs.append((i + 1, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, node_classes=10, block_classes=8, block_shingles=3000).collect()
    assert {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_hot(spark, monkeypatch, few):
    """Stars around the least and the greatest node, and a link between them: hot nodes are joined apart, with the same result."""
    from palimpsest.llm import shared

    monkeypatch.setattr(shared, "FEW_LINKS", few)
    links = [(4999, i) for i in range(1, 1500)] + [(0, i) for i in range(2000, 3500)] + [(7, 2500), (6001, 6000), (6002, 6001), (6002, 6002)]
    found = shared.connected_components(shared.Workspace(spark), spark.createDataFrame(links, "a long, b long")).collect()
    want = {i: 6000 if i >= 6000 else 0 for pair in links for i in pair}
    assert len(found) == len(want) and {r["node"]: r["component"] for r in found} == want


def test_vectors_odd(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    vectors = [(base * s + rng.normal(size=8) * e).tolist() for s, e in ((1, 0), (3, 0), (1, 0.02), (1, 0.05), (1, 0.1), (-1, 0))] + [base.tolist()] * 2
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(20, vectors[0], 2), (21, vectors[0], None), (22, None, 1), (23, [0.0] * 8, 1), (24, [float("nan")] * 8, 1), (25, [float("inf")] + [1.0] * 7, 1), (26, [None] + [1.0] * 7, 1), (27, [], 1), (28, [1.0], 1), (28, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1))

    def good(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if a[2] is None or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if linked(rows[i], rows[j])]
    root = components(len(rows), links)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}
    want = sorted((r[0], sum(i in x for x in links), least[c], r[0] == least[c]) for i, (r, c) in enumerate(zip(rows, root, strict=True)))
    assert sorted(tuple(r) for r in vector_join.near_vectors(df).collect()) == want
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_vectors_blocks(spark):
    """Groups over many small blocks give the links of brute force."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(400, 16)), rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.12]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(800), "embedding": x.tolist(), "label": 1}))
    got = {r["vec_id"]: r["n_links"] for r in vector_join.near_vectors(df, block_bytes=1).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [got[i] for i in range(800)] == ((u @ u.T >= 0.98).sum(axis=1) - 1).tolist()


def test_search(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 120)))) for i in range(600)]
    docs += [(601, docs[50][1]), (602, None), (603, ""), (604, " ".join(WORDS * 300))]
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit(1))
    for slice_bytes in (1 << 20, 3000):
        assert_same(search.search(df, df.where("doc_id % 50 = 0"), shard_bytes=150_000, slice_bytes=slice_bytes), search.OP3_SQL, documents=frame)
    again = df.unionByName(df.where("doc_id = 0")).unionByName(spark.createDataFrame([(None, "w1 w2")], "doc_id long, text string").withColumn("shard", F.lit(1)))
    assert search.search(again, again.where("doc_id = 50 or doc_id is null"), k=3).count() == 6
    assert search.search(df.limit(0), df).count() == 0
    assert search.search(df, df.where("text is null or text = ''")).count() == 0


def test_search_ties(spark):
    """Equal scores go by id, null ids last, at rank k too."""
    df = spark.createDataFrame([(i, "same words here") for i in (5, 3, None, 9, 1, 7)] + [(100, "other")], "doc_id long, text string")
    asked = df.where("doc_id = 5")
    assert [r["doc_id"] for r in search.search(df, asked, k=3).orderBy("rank").collect()] == [1, 3, 5]
    assert [r["doc_id"] for r in search.search(df, asked, k=9).orderBy("rank").collect()] == [1, 3, 5, 7, 9, None]


def test_search_moves_once(spark):
    """Index and queries are shuffled once, however many shards and slices meet; shards of a group hand on their best."""
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 120)))) for i in range(600)]
    docs += [(600 + i, docs[i][1]) for i in range(0, 600, 50)]
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    jvm = spark.sparkContext._jvm

    def shuffled() -> int:
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    moved = []
    for sizes in ({}, {"shard_bytes": 6000, "slice_bytes": 300}):
        before = shuffled()
        assert_same(search.search(df, df.where("doc_id % 50 = 0"), **sizes), search.OP3_SQL, documents=frame)
        moved.append(shuffled() - before)
    assert moved[1] < 3 * moved[0]
    ties = spark.createDataFrame([(i, "same words here") for i in (5, 3, None, 9, 1, 7)] + [(100, "other")], "doc_id long, text string")
    for k, want in ((3, [1, 3, 5]), (9, [1, 3, 5, 7, 9, None])):
        assert [r["doc_id"] for r in search.search(ties, ties.where("doc_id = 5"), k=k, shard_bytes=10, slice_bytes=10).orderBy("rank").collect()] == want


def test_search_order(spark):
    """A task gives the same whatever the order of pieces, and none without all of them."""
    import pyarrow as pa

    df = spark.createDataFrame([(i, f"a b{i % 3} c{i % 7}") for i in range(40)], "doc_id long, text string")
    frequency = search.word_frequencies(df)
    asked = [{"end": True, "query_id": r["query_id"], "query": r["query"], "word": bytes(r["word"]), "df": bytes(r["df"])} for r in search.asked_words(df.where("doc_id < 8"), frequency).collect()]
    pieces = [{"end": r["name"] is None, "shard": r["shard"], "part": r["part"], "name": r["name"], "data": r["data"] and bytes(r["data"])} for r in search.build_index(df, 3).collect()]
    rows = [p | q for p in pieces for q in (asked if p["end"] else [{}])]
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("data", pa.binary()), ("end", pa.bool_()), ("query_id", pa.int64()), ("query", pa.int64()), ("word", pa.binary()), ("df", pa.binary())])

    def run(rows: list, size: int) -> list:
        batches = pa.Table.from_pylist(rows, schema).to_batches(size)
        return sorted(tuple(r.values()) for b in search.searched(40, 3.0, 5)(iter(batches)) for r in b.to_pylist())

    want = run(rows, 1000)
    assert len(want) == 40 and {r[2] for r in want if r[0] == 0} >= {0, 21}
    mixed = random.Random(1).sample(rows, len(rows))
    assert run(rows[::-1], 7) == want and run(sorted(mixed, key=lambda r: not r["end"]), 3) == want
    assert run(sorted(mixed, key=lambda r: (r["end"], r["shard"] if r["end"] else 0)), 50) == want
    with pytest.raises(RuntimeError, match="lack pieces"):
        run(rows[1:], 50)


def test_search_prunes():
    """Most postings aren't read, few documents are scored whole, and the results are those of brute force."""
    import pyarrow as pa

    rng = random.Random(3)
    tongues = [[f"{c}{i}" for i in range(4000)] for c in "abc"]
    weights = [1 / (i + 3) for i in range(4000)]
    texts = [" ".join(rng.choices(tongues[i % 3], weights=weights, k=rng.choice((20, 60, 200)))) for i in range(3000)]
    for i in range(0, 600, 2):  # near copies, as search engines have them
        texts[i + 1] = texts[i].replace(" ", "  ", 1)
    builder = search.Builder()
    builder.add(list(range(3000)), pa.array(texts))
    arrays = builder.finish()
    mean = float(arrays["length"].mean())
    shard = search.Shard(arrays, mean, counting=True)
    size, begin = arrays["size"].astype(int), np.concatenate([[0], np.cumsum(arrays["size"].astype(int))])
    asks = []
    for i in range(0, 3000, 60):
        words = search.distinct_words(pa.array([texts[i]]))[0]
        df = size[np.searchsorted(arrays["word"], words)].astype(float)
        asks.append((words, np.log(1 + (3000 - df + 0.5) / (df + 0.5))))
    norm = search.K1 * (1 - search.B + search.B * arrays["length"] / mean)
    for (words, weight), (place, score) in zip(asks, shard.search(asks, 10), strict=True):
        want = np.zeros(3000)
        for t, w in zip(np.searchsorted(arrays["word"], words), weight, strict=True):
            doc, tf = arrays["doc"][begin[t] : begin[t + 1]], arrays["tf"][begin[t] : begin[t + 1]].astype(float)
            want[doc] += w * tf * (search.K1 + 1) / (tf + norm[doc])
        least = np.sort(want)[-10]
        assert {p for p, s in zip(place.tolist(), score.tolist(), strict=True) if s > least + 1e-5} == set(np.nonzero(want > least + 1e-5)[0].tolist())
        assert np.allclose(score, want[place], atol=2e-6) and len(place) >= 10
    assert shard.read < 0.6 * shard.held and shard.whole < 0.1 * 3000 * len(asks)


def test_mixing_odd(spark):
    docs = odd_docs(spark)
    found = mixing.mixing_weights(docs, mixing._dimensions(docs), mixing.word_count(F.col("text")))
    assert found.count() == docs.count() and found.columns[: len(docs.columns)] == docs.columns
    rows = found.collect()
    assert all(not r[-1] and r[-2] == 0 for r in rows if not words(r["text"])) and max(r[-2] for r in rows) == 1.0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mixing_residual(spark):
    """Targets that contradict each other are told of; a table without source and lang is mixed by form alone."""
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c d", "de", "t")], "doc_id long, text string, lang string, source string")
    dims, size = {"lang": F.col("lang"), "source": F.col("source")}, mixing.word_count(F.col("text"))
    share = lambda v, x: spark.createDataFrame([(v[0], x), (v[1], 1 - x)], "value string, share double")
    against = {"lang": share(("en", "de"), 0.9), "source": share(("s", "t"), 0.1)}
    with pytest.raises(ValueError, match="can't be met"):
        mixing.mixing_weights(docs, dims, size, targets=against, max_residual=0.05)
    with pytest.warns(UserWarning, match="from its target"):
        mixing.mixing_weights(docs, dims, size, targets=against)
    mixing.mixing_weights(docs, dims, size, targets={"lang": share(("en", "de"), 0.9), "source": share(("s", "t"), 0.9)}, max_residual=1e-6)
    assert mixing.mixed(docs.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_mixing_rare(spark):
    """A document of a new source and language doesn't shrink the sample of the others; null ids are drawn apart."""
    rows = [(i, f"{i} " * 60, "en" if i % 3 else "de", f"s{i % 4}", 0) for i in range(4000)]
    rare = [(9999, "new " * 20, "xx", "new", 0)]
    common = {r["doc_id"] for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()}
    both = {r["doc_id"] for r in mixing.mixed(spark.createDataFrame(rows + rare, DOCS)).collect()}
    assert 9999 in both and abs(len(common) / 4000 - 0.9) < 0.02 and len(common ^ (both - {9999})) < 20
    unnamed = mixing.mixed(spark.createDataFrame([(None, *r[1:]) for r in rows], DOCS)).count()
    assert abs(unnamed / 4000 - 0.9) < 0.02


def test_mixing_scale(spark):
    """The factor solves the share of tokens over any cells: brute force by bisection."""
    rng = random.Random(4)
    cells = [(rng.randint(1, 1000), rng.random() ** 8 * 100) for _ in range(300)] + [(7, 0.0)]
    frame = spark.createDataFrame([(t, r * t, r) for t, r in cells], "tokens long, weight double, ratio double")
    for keep in (0.1, 0.5, 0.9, 1.0):
        scale = mixing.scale_for(frame, keep)
        assert abs(sum(t * min(1, scale * r) for t, r in cells) / sum(t for t, r in cells if r) - keep) < 1e-9


def test_rake_meets_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en" if i % 3 else "de", f"s{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string")
    target = spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")
    found = mixing.mixing_weights(docs, {"lang": F.col("lang"), "source": F.col("source")}, mixing.word_count(F.col("text")), targets={"lang": target})
    shares = {r["lang"]: r["x"] for r in found.groupBy("lang").agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("x")).collect()}
    assert abs(shares["en"] / shares["de"] - 1) < 1e-6


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op5_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    odd = odd_docs(spark)
    model = language.fit(odd)
    found = {r["doc_id"]: r for r in language.predict(odd, model, [F.col("doc_id")]).collect()}
    assert {i for i, r in found.items() if r["lang_pred"] == "und"} == {4, 5, 6, 10} and all(found[i]["score"] == 0 for i in (4, 5, 6, 10))
    assert (language.fit(odd.unionByName(odd).unionByName(odd)).weights == model.weights).all()  # repeated rows are learned once
    assert language.fit(odd.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(odd, None, [F.col("text")]).collect()} == {"und"}


def plain_language(raw, model):
    """The language of a text by plain Python: trigram counts, a margin a classifier, the best family, then votes of its pairs."""
    codes = [0, 0]
    for run in bytes(raw).translate(bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))).split():
        codes += [*run, 0]
    codes.append(0)
    counts = {}
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        x = ((a * 65599 + b) * 65599 + c) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        counts[(x >> 7) % language.BINS] = counts.get((x >> 7) % language.BINS, 0) + 1
    total = sum(counts.values())
    margins = [float(model.bias[k]) + sum((n / total) ** 0.5 * float(model.weights[i, k]) for i, n in counts.items()) for k in range(model.weights.shape[1])]
    chances = [1 / (1 + np.exp(-3 * m)) for m in margins]
    family, score = model.families[0], 1.0
    if model.first_pair:
        best = max(range(model.first_pair), key=lambda f: margins[f])
        family, score = model.families[best], chances[best]
    members = model.members[family]
    votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for (f, i, j), c in zip(model.pairs, chances[model.first_pair :], strict=True):
        if f == family:
            votes[members[i if c >= 0.5 else j]] += 1
            sums[members[i]] += c
            sums[members[j]] += 1 - c
    best = max(members, key=lambda g: votes[g] + sums[g] / (2 * len(members)))
    return best, score * (sums[best] / (len(members) - 1) if len(members) > 1 else 1.0)


def test_language_brute_force(spark):
    """Predictions equal those of plain Python, text by text, so they don't depend on the texts beside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("lang", F.when((F.col("lang") == "en") & (F.col("doc_id") % 3 == 0), "nl").otherwise(F.col("lang")))
    model = language.fit(docs)
    assert len(model.pairs) > 1 and model.first_pair > 1
    for r in language.predict(docs, model, [F.col("doc_id"), F.col("text")]).collect():
        if r["text"] and language.has_letter(r["text"].encode()):
            lang, score = plain_language(r["text"].encode(), model)
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_language_many(spark):
    """70 labels are all learned, the rarest too, by tasks as by the driver; without labels the stage keeps its rows."""
    rng = random.Random(6)
    rows = []
    for g in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 5)
        rows += [(100 * g + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(40)), f"x{g:02}", "s", 0) for i in range(3 if g < 64 else 2)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs)
    assert model.langs == [f"x{g:02}" for g in range(70)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model, [F.col("doc_id")]).collect()}
    assert sum(found[r[0]] == r[2] for r in rows[-12:]) >= 11
    x = language.features([r[1].encode() for r in rows])
    here, there = language.Model(x, [r[2] for r in rows]), language.Model(x, [r[2] for r in rows], spark)
    assert (here.weights == there.weights).all() and (here.bias == there.bias).all()
    held = language.Rows([np.nonzero(v)[0].astype("<u2").tobytes() for v in x], [v[v != 0].tobytes() for v in x])
    assert (held[np.arange(len(x))] == x).all()
    copies = spark.createDataFrame([(1, "one text of many copies", "en", "s", 0)] * 1000, DOCS)
    assert language.fit(copies.unionByName(docs.limit(3))).langs == ["en", "x00"]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, SF).count() == len(rows)


def test_line_dedup_odd(spark):
    docs = odd_docs(spark)
    out = line_dedup.drop_boilerplate(docs, min_pages=2, ratio=0.1)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by[4] is None and by[5] == "" and by[6] == " \n " and by[1] == "" and by[2] == next(r["text"] for r in docs.collect() if r["doc_id"] == 2)
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
    salted = line_dedup.drop_boilerplate(docs, min_pages=2, ratio=0.1, broadcast_rows=0)
    assert sorted(map(str, salted.collect())) == sorted(map(str, out.collect()))


def test_line_dedup_copies(spark):
    """A third of a host's rows are copies of one text: the pipeline's stage leaves it whole, but takes a line of many different pages."""
    copied = "first line of a page\nsecond line of a page"
    rows = [(i, copied, "en", "h", 0) for i in range(20)] + [(100 + i, f"own {i}\n" + ("everywhere" if i < 10 else f"more {i}"), "en", "h", 0) for i in range(40)]
    by = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, DOCS), SF).collect()}
    assert [by[i] for i in range(20)] == [copied] * 20
    assert [by[100 + i] for i in range(40)] == [f"own {i}" + ("" if i < 10 else f"\nmore {i}") for i in range(40)]


def test_secrets_odd(spark):
    rows = [(1, "password = 'abcdef1' and AKIA" + "A" * 16, "x/a"), (2, "token: abc", "x/b"), (3, None, None), (4, "", "x"), (5, "é" * 3 + " SECRET=zzzzzz9 " + "0a" * 12, "y"), (5, "é" * 3 + " SECRET=zzzzzz9 " + "0a" * 12, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(0))
    found = secrets.find_secrets(df).collect()
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in found}
    assert len(found) == 6 and spans == {1: [(0, 0, 19), (1, 25, 45)], 2: [], 3: [], 4: [], 5: [(0, 4, 18), (2, 19, 43)]}
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_secrets_owned(spark):
    """Owned spans by owners, over nulls: shared ones and those that touch a base span go, copies in one owner's repositories stay."""
    one, two, three, four = (f"{c}{'aB3' * 11}" for c in "wxyz")
    hexed = "0123456789abcdef" * 2
    rows = [(1, f"é {one} end", "ann/a"), (2, f"{one}\n{two}", "ann/b"), (3, f"{two} {hexed} x", "bob/a"), (4, f"token={three} {three}", "bob/a"), (5, four, None), (6, f"password: {hexed}A", "eve/z"), (7, f"{hexed}", None)]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    spans = {i: [(s["kind"], s["start"], s["end"], s["repositories"], s["owners"]) for s in v] for i, v in found.items()}
    assert spans == {1: [(3, 2, 36, 2, 1)], 2: [(3, 0, 34, 2, 1)], 3: [(2, 35, 67, 2, 2)], 4: [(0, 0, 40, 1, 1), (3, 41, 75, 1, 1)], 5: [], 6: [(0, 0, 43, 1, 1), (2, 10, 42, 2, 2)], 7: [(2, 0, 32, 2, 2)]}


def test_secrets_long(spark):
    """A text of over 1 MB with 20,000 matches of one kind and 10,000 of others, at the places that brute force finds."""
    text = " ".join(f"é{i} {i:024x} more filling" + (f" Token = '{i:06}'" if i % 2 else "") for i in range(20_000))
    found = secrets.find_secrets(spark.createDataFrame([(1, text, "a/b"), (2, None, "a/b")], "doc_id long, text string, source string")).where("doc_id = 1").first()["spans"]
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"Token = '[0-9]{6}", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    assert len(text) > 1_000_000 and [(s["start"], s["kind"], s["end"]) for s in found] == sorted(want)


def test_archive_copies(spark):
    """Many copies of one row are a response and revisits, each with an id of its own; records' lengths and digests are those of their bytes."""
    from palimpsest.llm.shared import Workspace

    df = spark.range(25_000).select(F.lit(7).alias("page_id"), F.lit("u").alias("url"), F.lit("body").alias("html"))
    back = archive.read_archive(*archive.write_archive(Workspace(spark), df))
    kinds = {r["record_type"]: (r["n"], r["m"]) for r in back.groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("record").alias("m")).collect()}
    assert kinds == {"response": (1, 1), "revisit": (24_999, 24_999)}


def test_archive_odd(spark):
    from palimpsest.llm.shared import Workspace

    rows = [(1, "u", "<p>é</p>"), (2, "u\nv", "<p>é</p>"), (2, "u\nv", "<p>é</p>"), (3, None, None), (4, "w", ""), (None, "z", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    records, payloads = archive.write_archive(Workspace(spark), df)
    back = archive.read_archive(records, payloads).collect()
    assert payloads.count() == 3 and len(back) == 6
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in back) == sorted([("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 4), ("4", "response", None), ("None", "response", None)])
    whole = next(bytes(r["record"]) for r in back if r["page_id"] == 2 and r["record_type"] == "response")
    head, _, rest = whole.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 9" in head and rest == "<p>é</p>".encode() + b"\r\n\r\n"
    records, payloads = archive.write_archive(Workspace(spark), df.limit(0))
    assert archive.read_archive(records, payloads).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_file())


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("window", [1, 50, 1 << 19])
def test_encoder(library, window):
    rng = random.Random(1)
    parts = list("abzAZ09 \n\t'<>|!?.-_éÉßÿ×÷Àñ́İıж中 \"\\&") + ["<|startoftext|>", "<|ENDOFTEXT|>", "'s", "n'T", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["", None, "x" * 4000, "\n" * 300, " a\n" * 500]
    coder = WordEncoder(token_files.tokenizer_file(), pieces=2000, window=window)
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(part)] == [library.encode(t or "", add_special_tokens=False).ids for t in part]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_simple8b(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2, n) * rng.integers(0, 1 << 40, n) >> rng.integers(0, 41, n)).astype(np.uint64)
    assert decode_blocks(*encode_blocks(ids), n).tolist() == ids.tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, library):
    from palimpsest.llm.shared import Workspace

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    start, want = 0, []
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = ids_of(library, r["text"], 2)
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op6_token_files"](spark, SF).collect()) == want
    ws, odd = Workspace(spark), odd_docs(spark)
    directory = ws.table(token_files.write_token_files(odd, f"{ws.folder}/t", token_files.tokenizer_file(), 2, file_tokens=100), "d")
    back = token_files.read_token_files(spark, f"{ws.folder}/t", directory).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 2, 3, 3, *range(4, 11)] and directory.count() > 3
    ws = Workspace(spark)
    directory = ws.table(token_files.write_token_files(odd.limit(0), f"{ws.folder}/t", token_files.tokenizer_file(), 2), "d")
    assert token_files.read_token_files(spark, f"{ws.folder}/t", directory).count() == 0


@pytest.mark.parametrize("window", [3000, 2_000_000])
def test_packing(spark, library, window):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).where("doc_id is not null").select((F.col("doc_id") % 11 + 10**6).alias("doc_id"), "text").distinct())
    pieces = packing.pack_documents(docs, token_files.tokenizer_file(), 1, window_tokens=window).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for r in docs.collect():
        own, ids = sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]), ids_of(library, r["text"], 1)
        assert np.frombuffer(b"".join(p["ids"] for p in own), "<u4").tolist() == ids and all(p["doc_tokens"] == len(ids) for p in own)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack_documents(docs.limit(0), token_files.tokenizer_file(), 1).count() == 0


def test_pipeline(spark, library, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert kept[name].columns == docs.columns
            docs = kept[name]
    first = {r["doc_id"]: r for r in kept["language_id"].collect()}
    assert len(first) == spark.read.parquet(f"{SF}/documents.parquet").count()  # all have a language
    lines = line_dedup.OP1_SQL.replace("FROM documents", f"FROM '{tmp_path}/language_id/*.parquet'")
    assert_same(line_dedup.drop_boilerplate(kept["language_id"], count_col="n_dropped").select("doc_id", "text", "n_dropped"), lines)
    before, after = kept["line_dedup"].collect(), {r["doc_id"] for r in kept["near_dedup"].collect()}
    sets = [shingles(r["text"]) for r in before]
    links = [(i, j) for i, j in itertools.combinations(range(len(before)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components(len(before), links)
    assert after == {min(before[i]["doc_id"] for i in range(len(before)) if root[i] == r) for r in set(root)}
    assert {r["doc_id"] for r in kept["mixing"].collect()} <= after
    pieces = {}
    for p in kept["packing"].collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    for r in kept["mixing"].collect():
        assert np.frombuffer(b"".join(p["ids"] for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"])), "<u4").tolist() == ids_of(library, r["text"], 1)


def test_stages_on_odd_rows(spark):
    for docs in (odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"), odd_docs(spark).limit(0).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
