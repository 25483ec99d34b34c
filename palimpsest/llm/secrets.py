"""Operator 7: secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, lookup_join

#: The kinds' patterns in Java's syntax, the group that holds the secret, its least length. A run
#: that is too short can't hold a longer match of access or hex, so their lengths stand in the pattern.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own candidates: long runs with lower case, upper case and a digit, kept if one owner alone has them.
OWNED = ("owned", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
#: Secrets that more owners than this have are widely copied examples.
MAX_OWNERS = 2


def _matches(text: Column, number: int, kind: tuple) -> Column:
    """One kind's matches in order: the code points before each since the last (gap), its length, the secret's hash, whether it counts.

    Spark has no function for the places of all matches; find_secrets adds them up. The texts between and
    the matches are the input of one transform, so each pattern runs over a text so often, however many matches there are.
    """
    _, pattern, group, least = kind
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def one(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x["1"], pattern, group) if group else x["1"]
        good = F.length(value) >= least
        if kind is OWNED:
            good = good & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
        return F.struct(F.lit(number).alias("kind"), i.alias("nth"), F.length(x["0"]).alias("gap"), F.length(x["1"]).alias("length"), F.sha2(value, 256).alias("hash"), good.alias("good"))

    none = F.array().cast("array<struct<kind:int,nth:int,gap:int,length:int,hash:string,good:boolean>>")
    # the text after the last match has no match of its own
    zipped = F.filter(F.arrays_zip(between.alias("0"), hits.alias("1")), lambda x: x["1"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(zipped, one)).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str | None = None,
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row per document: its id, and spans: array of (start, kind, end, hash, repositories, owners).

    start and end count code points, end exclusive; kind counts KINDS and then OWNED; repositories and owners
    count the different ones in the whole corpus that have a secret of that hash. Without owner_col a
    repository's owner is its name up to the first slash. Base spans always stay; OWNED ones stay if exactly
    one owner has the secret and they touch no base span. A null text counts as empty; null repositories and
    owners aren't counted, so a secret that only rows without an owner have is no owner's; repeated rows give a
    row each, equal starts go by kind; an empty table gives none; other columns aren't read.

    Texts are read once and matches shuffled by document, so work grows with the text and, but for a sort, with
    the matches. Counting is by (hash, repository) and (hash, owner) after partial sums, so a secret that
    a third of the corpus shares costs no more than its repositories.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repository = F.col(repository_col).cast("string")
    owner = F.col(owner_col).cast("string") if owner_col else F.substring_index(repository, "/", 1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), repository.alias("repository"), owner.alias("owner"),
                       F.concat(*(_matches(text, n, k) for n, k in enumerate((*KINDS, OWNED)))).alias("matches"))
    rows = ws.table(rows, "matches")
    every = rows.where(F.size("matches") > 0).select("row", "repository", "owner", F.explode("matches").alias("m")).select("row", "repository", "owner", "m.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    placed = every.select("row", "repository", "owner", "kind", (end - F.col("length")).alias("start"), end.alias("end"), "hash", "good").where("good")
    # a base span stands at its start, another at its end and before base spans there: the furthest base end so far tells whether they touch
    base = F.col("kind") < len(KINDS)
    order = Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), F.desc("kind"))
    furthest = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = placed.withColumn("furthest", furthest).where(base | F.col("furthest").isNull() | (F.col("furthest") <= F.col("start")))
    each = ws.table(each.select("row", "repository", "owner", "start", "kind", "end", "hash"), "spans")
    known = each.groupBy("hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"))
    known = ws.table(known, "ownership")
    judged = lookup_join(each.select("row", "start", "kind", "end", "hash"), known, ["hash"], "inner")
    judged = judged.where((F.col("kind") < len(KINDS)) | (F.col("owners") == 1))
    found = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "repositories", "owners"))).alias("spans"))
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.select("row", "id").join(found, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column, names: tuple) -> Column:
    name = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    names = tuple(k[0] for k in (*KINDS, OWNED))
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", *(count(n).alias(f"n_{k[0]}") for n, k in enumerate((*KINDS, OWNED))), F.sha2(_listed(base, names), 256).alias("base_sha256"), _listed(F.col("spans"), names).alias("spans"),
        F.size(F.filter("spans", lambda s: s["owners"] > MAX_OWNERS)).cast("long").alias("n_widely_copied"),
        F.size(F.filter("spans", lambda s: s["owners"] <= MAX_OWNERS)).cast("long").alias("n_owner_specific"))


def _sql_spans(number: int, kind: tuple) -> str:
    _, pattern, group, least = kind
    p = pattern.replace("'", "''")
    more = " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')" if kind is OWNED else ""
    return f"""SELECT id, source, {number} AS kind, s, s + length(h) AS e, v FROM (
        SELECT id, source, unnest(regexp_extract_all(t, '{p}')) AS h, unnest(regexp_extract_all(t, '{p}', {group})) AS v,
               unnest(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i:
                   CAST(list_sum(list_transform((string_split_regex(t, '{p}'))[1:i], lambda x: length(x))) AS BIGINT)
                   + coalesce(CAST(list_sum(list_transform((regexp_extract_all(t, '{p}'))[1:i - 1], lambda x: length(x))) AS BIGINT), 0))) AS s
        FROM d WHERE regexp_matches(t, '{p}')) WHERE length(v) >= {least}{more}"""


OP7_SQL = f"""
WITH d AS (SELECT doc_id AS id, source, coalesce(text, '') AS t FROM documents),
raw AS MATERIALIZED ({' UNION ALL '.join(_sql_spans(n, k) for n, k in enumerate((*KINDS, OWNED)))}),
apart AS (SELECT * FROM raw WHERE kind < {len(KINDS)} OR NOT EXISTS (
    SELECT 1 FROM raw b WHERE b.id = raw.id AND b.kind < {len(KINDS)} AND b.s < raw.e AND raw.s < b.e)),
known AS (SELECT v, count(DISTINCT string_split(source, '/')[1]) AS owners FROM apart GROUP BY v),
spans AS (SELECT id, kind, s, e, owners, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || s || ':' || e AS label
          FROM apart JOIN known USING (v) WHERE kind < {len(KINDS)} OR owners = 1),
by_doc AS (SELECT id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, count(*) FILTER (kind = 3) AS o,
                  string_agg(label, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg(label, ',' ORDER BY s, kind, e) AS every,
                  count(*) FILTER (owners > {MAX_OWNERS}) AS w, count(*) FILTER (owners <= {MAX_OWNERS}) AS x FROM spans GROUP BY id)
SELECT d.id AS doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(o, 0) AS n_owned,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(w, 0) AS n_widely_copied, coalesce(x, 0) AS n_owner_specific
FROM d LEFT JOIN by_doc USING (id)
"""
