"""Change data capture over change records: whole transactions in commit order, slots, limits, text, apply.

A change is (lsn, xid, op, columns); a commit is (xid, csn). All steps are grouped aggregates, joins and
ordered running sums, so they hold for any number of transactions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import quote
from palimpsest.operators.order import last_before, numbered, running


def commits(changes: DataFrame) -> DataFrame:
    """(xid, csn, n_changes) of the transactions that weren't aborted; csn is that of the last change."""
    return changes.groupBy("xid").agg(F.max("lsn").alias("csn"), F.count("*").alias("n_changes"), F.bool_or("aborted").alias("gone")).where(~F.col("gone")).drop("gone")


def reassemble(changes: DataFrame) -> DataFrame:
    """changes (xid, lsn, ...) by transaction: each with its place in it, nth, in order of arrival. A transaction of any size stays spread."""
    return numbered(changes, ["xid"], ["lsn"])


def after_slot(committed: DataFrame, confirmed_csn: int) -> DataFrame:
    return committed.where(F.col("csn") > confirmed_csn)


def in_commit_order(committed: DataFrame) -> DataFrame:
    """committed with position, and before: output rows (changes, BEGIN and COMMIT) of all transactions before."""
    return running(committed, [F.col("csn"), F.col("xid")], F.col("n_changes") + 2)


def up_to(ordered: DataFrame, csn: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Transactions up to and with csn; of those, all that begin before n_rows output rows are out, so the last is whole."""
    found = ordered if csn is None else ordered.where(F.col("csn") <= csn)
    return found if n_rows is None else found.where(F.col("before") < n_rows)


def _tuple(columns: dict[str, str], prefix: str, skip_nulls: bool) -> Column:
    parts = []
    for name, kind in columns.items():
        c = F.col(name)
        shown = F.when(c.isNull(), None if skip_nulls else "null").otherwise(quote(c) if kind == "text" else c.cast("string"))
        parts.append(F.concat(F.lit(f"{name}[{kind}]:"), shown))
    return F.concat_ws(" ", F.lit(prefix), *parts) if prefix else F.concat_ws(" ", *parts)


def change_text(relation: str, columns: dict[str, str], key: list[str], skip_nulls: bool = False) -> Column:
    """A change as a line of text, made of expressions over the schema."""
    old = _tuple({c: columns[c] for c in key}, "", skip_nulls)
    new = _tuple(columns, "", skip_nulls)
    head = F.concat(F.lit(f"table {relation} "), F.col("op"), F.lit(": "))
    return F.concat(head, F.when(F.col("op") == "INSERT", new).when(F.col("op") == "UPDATE", F.concat(F.lit("old-key: "), old, F.lit(" new-tuple: "), new))
                    .when(F.coalesce(old, F.lit("")) == "", "(no-tuple-data)").otherwise(old))


@dataclass(frozen=True)
class Plugin:
    """What a decoded transaction gives out: an expression over its xid and csn at its begin and commit, and one over each change."""

    begin: Column
    change: Column
    commit: Column


def text_plugin(relation: str, columns: dict[str, str], key: list[str], include_xids: bool = True, skip_nulls: bool = False) -> Plugin:
    """Changes as lines of text; BEGIN and COMMIT carry the xid unless include_xids is off."""
    edge = lambda word: F.concat(F.lit(f"{word} "), F.col("xid").cast("string")) if include_xids else F.lit(word)
    return Plugin(edge("BEGIN"), change_text(relation, columns, key, skip_nulls), edge("COMMIT"))


def decode(changes: DataFrame, committed: DataFrame, plugin: Plugin, skip_empty: bool = False) -> DataFrame:
    """(csn, xid, line, text): begin, the changes and commit of each transaction; line counts from 0 within it.

    Transactions without changes give begin and commit alone, or nothing if skip_empty. Rows stay rows, so a
    transaction may have any number of changes.
    """
    whole = committed.where("n_changes > 0") if skip_empty else committed
    rows = reassemble(changes.join(whole.select("xid", "csn"), "xid")).select("csn", "xid", F.col("nth").cast("int").alias("line"), plugin.change.alias("text"))
    begin = whole.select("csn", "xid", F.lit(0).alias("line"), plugin.begin.alias("text"))
    commit = whole.select("csn", "xid", (F.col("n_changes") + 1).cast("int").alias("line"), plugin.commit.alias("text"))
    return begin.unionByName(rows).unionByName(commit)


def with_schema_version(changes: DataFrame, dictionary: DataFrame, table: str = "table_id", missing: str = "error") -> DataFrame:
    """changes with table_csn and definition: the newest dictionary row of their table whose table_csn is strictly below their lsn.

    A change without such a row is an error; with missing="null" it stays with nulls. Both are put in one
    order by table and position, so neither the dictionary nor a table's changes are gathered anywhere.
    """
    held = F.struct(*[c for c in changes.columns])
    rows = changes.select(F.col(table).alias("_table"), F.col("lsn").alias("_pos"), F.lit(0).alias("_kind"), held.alias("_change"),
                          F.lit(None).cast(dictionary.schema["table_csn"].dataType).alias("table_csn"), F.lit(None).cast(dictionary.schema["definition"].dataType).alias("definition"))
    versions = dictionary.select(F.col(table).alias("_table"), F.col("table_csn").cast("long").alias("_pos"), F.lit(1).alias("_kind"),
                                 F.lit(None).cast(rows.schema["_change"].dataType).alias("_change"), "table_csn", "definition")
    version = F.when(F.col("_kind") == 1, F.struct("table_csn", "definition"))
    found = last_before(rows.unionByName(versions), ["_table"], ["_pos", "_kind"], version, "_version").where("_kind = 0")
    if missing == "error":
        lost = F.raise_error(F.concat(F.lit("no visible definition of table "), F.coalesce(F.col("_table").cast("string"), F.lit("null")), F.lit(" at "), F.col("_pos").cast("string")))
        found = found.withColumn("_version", F.when(F.col("_version").isNull(), lost).otherwise(F.col("_version")))
    return found.select("_change.*", "_version.table_csn", "_version.definition")


def apply_changes(changes: DataFrame, committed: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The final row of each key: its last committed change, unless that deletes it. Applying twice changes nothing."""
    last = changes.join(committed.select("xid"), "xid", "left_semi").groupBy(key).agg(F.max_by(F.struct("op", *payload), "lsn").alias("r"))
    return last.where("r.op <> 'DELETE'").select(key, *[f"r.{c}" for c in payload])
