"""Operator 4: mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, fresh, lookup_join, small_enough

#: Default targets: a value's share of tokens to this power, made to add up to 1, so that small ones gain.
TEMPER = 0.9
#: Rounds of raking at most, and the largest relative error of a marginal at which it ends before.
ROUNDS, TOLERANCE = 12, 1e-10
#: Of a marginal that is further from its target after the last round, a warning tells.
RESIDUAL = 0.01
#: The share of all tokens that the pipeline's sample holds, in expectation.
KEEP = 0.9
#: Words from which a document's form is `short` no more, and `long`.
SHORT, LONG = 50, 1000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(text: Column, words: Column) -> Column:
    """The form of a text, which stands for a topic where the table has none."""
    return F.when(words == 0, "empty").when(F.contains(text, F.lit(" | ")), "table").when(words < SHORT, "short").when(words < LONG, "prose").otherwise("long")


def _value(column: Column) -> Column:
    """A category as a key that is never null: null is the empty string, others begin with =."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def tempered(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """(dimension, share): each value's share of tokens to a power, scaled to add up to 1."""
    marginal = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("p")).where("p > 0")
    return marginal.crossJoin(F.broadcast(marginal.agg(F.sum("p").alias("all")))).select(dimension, (F.col("p") / F.col("all")).alias("share"))


def rake(ws: Workspace, cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """cells with weight: tokens scaled until the sums along each dimension have the target shares; and the residual.

    cells has a row per combination of the targets' dimensions with its tokens; a target has (dimension,
    share), and values without a share get weight 0. Each round scales by one dimension after another and
    is written; sums are grouped with partial sums and joined back, so a value with most cells is no hot
    task, and only marginals of a counted size are broadcast. The residual is the greatest relative error that a
    value's sum had in the last round before it was scaled: of targets that contradict each other it stays large.
    """
    small = {d: small_enough(t) for d, t in targets.items()}
    now = ws.table(cells.withColumn("weight", F.col("tokens").cast("double")), "rake-0")
    total, residual = cells.agg(F.sum("tokens")).first()[0] or 0, 0.0
    for turn in range(1, rounds + 1):
        step, error = now, []
        for d, target in targets.items():
            sums = step.groupBy(d).agg(F.sum("weight").alias("sum_")).join(target, d)
            factor = sums.select(d, F.when(F.col("sum_") > 0, F.col("share") * total / F.col("sum_")).otherwise(0.0).alias("factor_"))
            step = step.join(F.broadcast(factor) if small[d] else factor, d, "left")
            step = step.withColumn("weight", F.col("weight") * F.coalesce("factor_", F.lit(0.0))).withColumn(f"error_{d}", F.abs(F.coalesce("factor_", F.lit(1.0)) - 1)).drop("factor_")
            error.append(F.max(f"error_{d}"))
        now = ws.table(step, f"rake-{turn}")
        worst = now.agg(*error).first()
        now = now.select(*cells.columns, "weight")
        ws.drop(f"rake-{turn - 1}")
        residual = max(e or 0.0 for e in worst)
        if residual <= tolerance:
            break
    return now, residual


def scale_for(ratios: DataFrame, keep: float) -> float:
    """The factor by which the ratios, cut at 1, keep that share of the tokens of cells with weight.

    Cells whose ratio reaches 1 are whole, and the others make up the rest: each round is one sum over
    the cells, and the factor grows until no further cell gets whole.
    """
    weighty = ratios.where("weight > 0")
    want = keep * (weighty.agg(F.sum("tokens")).first()[0] or 0)
    scale, whole = 0.0, 0
    while True:
        full = F.col("ratio") * F.lit(scale) >= 1
        n, tokens, weight = weighty.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight or (scale and n == whole):
            return scale
        scale, whole = max(scale, (want - (tokens or 0)) / weight), n


def mixing_weights(docs: DataFrame, dimensions: dict[str, Column | Callable[[Column], Column]], tokens: Column, id_col: str = "doc_id", targets: dict[str, DataFrame] | None = None,
                   temper: float = TEMPER, rounds: int = ROUNDS, salt: str = "mix", keep: float | None = None, text_col: str = "text", max_residual: float | None = None) -> DataFrame:
    """docs with n_tokens, probability (of being sampled) and sampled.

    dimensions names the marginals and gives their columns, or functions of the column of tokens; targets has (value, share) tables for some,
    the others get tempered shares. Raked weights over tokens give each combination's ratio, and a
    document's probability is its ratio over the largest, so the expected sample has the targets' shares
    as nearly as raking met them. A document is sampled if a number made of its id's digest is below its
    probability: rows of equal id share their fate, and runs agree. Null values are a category of their
    own, null ids the id `null`; documents without tokens carry no weight and aren't sampled; an empty
    table gives no rows; other columns pass through, whatever their names.

    A marginal that raking leaves further from its target than RESIDUAL is told in a warning, and than max_residual,
    if given, in a ValueError.

    With keep, the probability is min(1, scale * ratio) instead, and scale_for makes the expected sample
    hold that share of all tokens: combinations under their targets are kept whole, and however rare they
    are, don't shrink the others. Null ids are then drawn by a hash of text_col.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    names = {d: fresh(docs, f"_d{i}") for i, d in enumerate(dimensions)}
    n, p = fresh(docs, "n_tokens"), fresh(docs, "probability")
    counted = docs.select("*", tokens.alias(n))  # apart, so that tokens are counted once for all that follows from them
    keyed = counted.select("*", *(_value(c(F.col(n)) if callable(c) else c).alias(names[d]) for d, c in dimensions.items()))
    cells = ws.table(keyed.groupBy(*names.values()).agg(F.sum(n).alias("tokens")), "cells")
    own = {}
    for d, name in names.items():
        given = (targets or {}).get(d)
        own[name] = ws.table(given.select(_value(F.col("value")).alias(name), "share") if given is not None else tempered(cells, name, temper), f"target-{name}")
    raked, residual = rake(ws, cells, own, rounds)
    if max_residual is not None and residual > max_residual:
        raise ValueError(f"the targets can't be met: a marginal is {residual:.3g} from its share after {rounds} rounds")
    if residual > RESIDUAL:
        warnings.warn(f"a marginal is {residual:.3g} from its target share after {rounds} rounds of raking", stacklevel=2)
    ratios = raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    if keep is None:
        most = ratios.agg(F.max("ratio")).first()[0] or 1.0
        scaled = F.col("ratio") / most
    else:
        scaled = F.least(F.lit(1.0), F.col("ratio") * scale_for(ratios, keep))
    chance = ws.table(ratios.select(*names.values(), scaled.alias(p)), "chance")
    joined = lookup_join(keyed, chance, list(names.values()), "left")
    unnamed = F.lit("null") if keep is None else F.concat(F.lit("null:"), F.xxhash64(text_col).cast("string"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), unnamed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    chosen = (F.col(n) > 0) & (drawn < F.col(p))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(n), F.when(F.col(n) > 0, F.col(p)).otherwise(0.0).alias(p), chosen.alias(fresh(docs, "sampled")))


def _dimensions(docs: DataFrame) -> dict[str, Column | Callable[[Column], Column]]:
    """source, lang and form; a column that docs lacks is one category."""
    given = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    return {**given, "form": lambda words: form(F.col("text"), words)}


def mixed(docs: DataFrame) -> DataFrame:
    """The sampled rows of docs (doc_id, text; lang and source if it has them), about KEEP of the tokens, with the columns that docs has."""
    weighed = mixing_weights(docs, _dimensions(docs), word_count(F.col("text")), keep=KEEP)
    return weighed.where(F.col(weighed.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = docs.select("doc_id", "source", "lang", "text", word_count(F.col("text")).alias("n_words"))
    # the texts are read once: what follows from them is written without them
    narrow = Workspace(spark).table(counted.select("doc_id", "source", "lang", "n_words", form(F.col("text"), F.col("n_words")).alias("form")), "counted")
    found = mixing_weights(narrow, {"source": F.col("source"), "lang": F.col("lang"), "form": F.col("form")}, F.col("n_words"))
    return found.select("doc_id", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


_STEP = "{w} * {d}_share * total / sum({w}) OVER (PARTITION BY {d})"
OP4_SQL = f"""
WITH RECURSIVE counted AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS s, coalesce('=' || lang, '') AS l, n_tokens,
    '=' || CASE WHEN n_tokens = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens < {SHORT} THEN 'short' WHEN n_tokens < {LONG} THEN 'prose' ELSE 'long' END AS t FROM counted),
cells AS MATERIALIZED (SELECT s, l, t, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{', '.join(f"{x}_of AS MATERIALIZED (SELECT {x}, p / sum(p) OVER () AS {x}_share FROM (SELECT {x}, pow(sum(tokens), {TEMPER}) AS p FROM cells GROUP BY {x}))" for x in "slt")},
base AS MATERIALIZED (SELECT s, l, t, tokens, s_share, l_share, t_share, sum(tokens) OVER () AS total FROM cells JOIN s_of USING (s) JOIN l_of USING (l) JOIN t_of USING (t)),
raked(turn, s, l, t, w) AS (
    SELECT 0, s, l, t, tokens FROM base
    UNION ALL
    SELECT turn + 1, s, l, t, {_STEP.format(w='w2', d='t')} FROM (
        SELECT *, {_STEP.format(w='w1', d='l')} AS w2 FROM (
            SELECT *, {_STEP.format(w='w', d='s')} AS w1 FROM raked JOIN base USING (s, l, t) WHERE turn < {ROUNDS}))),
ratio AS (SELECT s, l, t, w / tokens AS r FROM raked JOIN base USING (s, l, t) WHERE turn = {ROUNDS}),
chance AS (SELECT s, l, t, r / max(r) OVER () AS p FROM ratio)
SELECT doc_id, n_tokens, round(coalesce(p, 0.0), 6) AS probability,
       n_tokens > 0 AND ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::UBIGINT / 4294967296.0 < p AS sampled
FROM d LEFT JOIN chance USING (s, l, t)
"""
