"""Operator 5: language identification, family first and then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, lookup_join, thrifty

#: Families of languages by code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
#: Bins of hashed letter trigrams.
BINS = 4096
#: The sample that the classifiers are fitted on: about so many rows a language, and so many in all, but of each
#: language about LEAST_ROWS even if there are so many languages that these are more.
SAMPLE_ROWS, ALL_ROWS, LEAST_ROWS = 400, 25_600, 25
#: Classifiers from which on they are fitted by tasks, not by the driver.
FIT_HERE = 32
#: Passages of a sampled text that are learned beside the whole, by letters; short texts are then like those learned from.
PASSAGES = (400, 80, 25)
#: Fitting: epochs and regularisation of the SVMs.
EPOCHS, REGULAR = 12, 1e-4
#: Letters of texts that a task counts at once.
BATCH_BYTES = 1 << 20


def _trigrams(texts: list[bytes]):
    """(owner, bin) of each trigram of letters; a run of other signs is one space, ASCII letters are lower-cased.

    Two spaces stand before a text's first letter and after its last, so that its trigrams are its own whatever stands beside it.
    """
    import numpy as np

    code = np.zeros(256, np.uint32)
    code[128:] = np.arange(128, 256)
    code[97:123] = code[65:91] = np.arange(97, 123)
    data = code[np.frombuffer(b"\n" + b"".join([b"\n" + t + b"\n" for t in texts]) + b"\n", np.uint8)]
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), lengths), [len(texts) - 1]])
    letters = data != 0
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[np.cumsum(lengths) - lengths + 1] = keep[0] = keep[-1] = True
    data, owner = data[keep], owner[keep]
    mixed = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return owner[1:-1], (mixed >> np.uint32(7)) & np.uint32(BINS - 1)


def features(texts: list[bytes]):
    """A row per text: square roots of its trigram counts, of length 1."""
    import numpy as np

    owner, bins = _trigrams(texts)
    counts = np.bincount(owner * BINS + bins, minlength=len(texts) * BINS).reshape(len(texts), BINS)
    x = np.sqrt(counts.astype(np.float32))
    return x / np.maximum(np.sqrt(counts.sum(axis=1)), 1.0)[:, None].astype(np.float32)


def has_letter(text: bytes) -> bool:
    return text.translate(None, _OTHERS) != b"" and any(c.isalpha() for c in text.decode("utf-8", "replace"))


#: ASCII bytes that aren't letters.
_OTHERS = bytes(b for b in range(128) if not chr(b).isalpha())


def family_of(lang: str) -> str:
    return next((family for family, members in FAMILIES.items() if lang in members), lang)


class Rows:
    """Rows of features, held by their bins that aren't 0; indexing gives a dense array."""

    def __init__(self, bins: list[bytes], values: list[bytes]):
        import numpy as np

        self.shape = (len(bins), BINS)
        self.ends = np.cumsum([0, *(len(b) // 2 for b in bins)])
        self.bins, self.values = np.frombuffer(b"".join(bins), "<u2"), np.frombuffer(b"".join(values), "<f4")

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows):
        import numpy as np

        out = np.zeros((len(rows), BINS), np.float32)
        for i, row in enumerate(rows):
            at = slice(self.ends[row], self.ends[row + 1])
            out[i, self.bins[at]] = self.values[at]
        return out


def _svm(x, rows, y, seed: int):
    """Weights and bias of a linear SVM on those rows by averaged stochastic subgradients; y holds their -1 and 1."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    total, total_b, n = np.zeros_like(w), 0.0, 0
    balance = np.where(y > 0, 0.5 / max(1e-9, (y > 0).mean()), 0.5 / max(1e-9, (y < 0).mean()))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            part = order[at : at + 32]
            seen = x[rows[part]]
            inside = y[part] * (seen @ w + b) < 1
            step = 8.0 / (1 + epoch)
            push = (balance[part] * y[part] * inside / len(part)).astype(np.float32)
            w = (1 - step * REGULAR) * w + step * (push @ seen)
            b += step * 0.1 * float(push.sum())
            if epoch >= EPOCHS // 2:
                total, total_b, n = total + w, total_b + b, n + 1
    return total / n, total_b / n


def _fit_one(task: tuple[str, str, int], x, lang, family):
    """_svm of a language against another (language, other language, seed), or of a family against the rest ("", family, seed)."""
    import numpy as np

    one, other, seed = task
    if not one:
        return _svm(x, np.arange(len(x)), np.where(family == other, 1.0, -1.0), seed)
    own = np.nonzero((lang == one) | (lang == other))[0]
    return _svm(x, own, np.where(lang[own] == one, 1.0, -1.0), seed)


def _fit_in_tasks(spark: SparkSession, tasks: list[tuple[str, str, int]], x, lang, family) -> list:
    """_fit_one of each, in a task of its own."""
    shared = spark.sparkContext.broadcast((x, lang, family))

    rows = spark.sparkContext.parallelize(tasks, len(tasks)).map(lambda task: _fit_one(task, *shared.value)).collect()
    shared.unpersist()
    return rows


class Model:
    """Families one against the rest; within a family, each pair of its languages."""

    def __init__(self, x, langs: list[str], spark: SparkSession | None = None):
        import numpy as np

        self.langs = sorted(set(langs))
        self.families = sorted({family_of(g) for g in self.langs})
        lang = np.array(langs)
        family = np.array([family_of(g) for g in langs])
        families = self.families if len(self.families) > 1 else []
        self.first_pair = len(families)
        self.members = {f: [g for g in self.langs if family_of(g) == f] for f in self.families}
        self.pairs = [(f, i, j) for f in self.families for i in range(len(self.members[f])) for j in range(i + 1, len(self.members[f]))]
        tasks = [("", f, i) for i, f in enumerate(families)] + [(self.members[f][i], self.members[f][j], 1000 + n) for n, (f, i, j) in enumerate(self.pairs)]

        if spark is None or len(tasks) <= FIT_HERE:
            rows = [_fit_one(t, x, lang, family) for t in tasks]
        else:
            rows = _fit_in_tasks(spark, tasks, x, lang, family)
        self.weights = np.stack([w for w, _ in rows], axis=1) if rows else np.zeros((x.shape[1], 0), np.float32)
        self.bias = np.array([b for _, b in rows])

    def predict(self, x) -> tuple[list[str], list[float]]:
        """Each row's language and a score: the family's chance times that of the language within it."""
        import numpy as np

        margin = x @ self.weights + self.bias
        chance = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
        n = len(margin)
        if self.first_pair:
            family, score = margin[:, : self.first_pair].argmax(axis=1), chance[:, : self.first_pair].max(axis=1)
        else:
            family, score = np.zeros(n, np.int64), np.ones(n)
        out = np.empty(n, object)
        for f, name in enumerate(self.families):
            own, members = np.nonzero(family == f)[0], self.members[name]
            votes, sums = np.zeros((len(own), len(members))), np.zeros((len(own), len(members)))
            for k, (g, i, j) in enumerate(self.pairs):
                if g == name:
                    c = chance[own, self.first_pair + k]
                    votes[:, i] += c >= 0.5
                    votes[:, j] += c < 0.5
                    sums[:, i] += c
                    sums[:, j] += 1 - c
            best = (votes + sums / (2.0 * len(members))).argmax(axis=1)
            out[own] = np.array(members, object)[best]
            if len(members) > 1:
                score[own] *= sums[np.arange(len(own)), best] / (len(members) - 1)
        return out.tolist(), np.clip(score, 0, 1).tolist()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on every labelled language: on about sample_rows rows of each, or fewer if ALL_ROWS don't allow it.

    Rows are taken by a hash of id and text, and that with a letter and the least hash in any case, so that
    no language is without. Features are made by the tasks, and only the sampled rows' sparse counts reach the
    driver. None without a labelled row whose text has a letter.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    ws = Workspace(docs.sparkSession)
    lettered = F.when(F.col("t").rlike(r"\p{L}"), F.col("h"))
    counts = ws.table(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(lettered).alias("least")), "counts")
    each = min(sample_rows, max(LEAST_ROWS, ALL_ROWS // max(1, counts.count())))
    every = counts.select("lang", "least", F.ceil(F.col("n") / each).alias("k"))
    taken = lookup_join(rows, every, ["lang"], "inner").where((F.pmod("h", "k") == 0) | (F.col("h") == F.col("least"))).select("lang", "t", "h")
    taken = taken.dropDuplicates(["lang", "h"])  # a repeated row counts once, so that its repetitions don't enlarge the sample

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for lang, text, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                if not has_letter(raw):
                    continue
                parts = [raw]
                for k, size in enumerate(PASSAGES):
                    if len(text) > size:
                        at = (h >> (8 * k)) % (len(text) - size)
                        parts.append(text[at : at + size].encode())
                for x in features(parts):
                    at = np.nonzero(x)[0]
                    out.append((lang, h, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "h", "bins", "x"), map(list, zip(*out, strict=True)), strict=True)) if out else {"lang": [], "h": [], "bins": [], "x": []},
                                             schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("bins", pa.binary()), ("x", pa.binary())]))

    found = sorted(taken.mapInArrow(thrifty(run), "lang string, h long, bins binary, x binary").collect())
    if not found:
        return None
    return Model(Rows([row["bins"] for row in found], [row["x"] for row in found]), [row["lang"] for row in found], docs.sparkSession)


def predict(docs: DataFrame, model: Model | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of each row with lang_pred and score; und and 0 where the text is null or has no letter, or there is no model.

    A text is judged by its own letters alone, so repeated rows get the same. Of equal votes the language with the
    greater sum of chances is chosen, of equal sums the first by name. An empty table gives no rows.
    """
    kept = docs.select(*keep)
    names = kept.columns
    if text_col not in names or kept.schema[text_col].dataType.typeName() != "string":
        kept = docs.select(*keep, F.col(text_col).cast("string").alias("text_to_judge"))
    at = kept.columns.index("text_to_judge") if len(kept.columns) > len(names) else names.index(text_col)

    def judge(texts: list[bytes]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        while todo:
            size, n = 0, 0
            while n < len(todo) and n < 128 and (not n or size + len(texts[todo[n]]) <= BATCH_BYTES):
                size, n = size + len(texts[todo[n]]), n + 1
            own, todo = todo[:n], todo[n:]
            for i, g, s in zip(own, *model.predict(features([texts[i] for i in own])), strict=True):
                lang[i], score[i] = g, s
        return lang, score

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                lang, score = judge([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(thrifty(run), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    model = fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return predict(docs, model, [F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")
