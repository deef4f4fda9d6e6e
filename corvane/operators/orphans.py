"""References to records that do not exist: direct and inherited orphans.

The foreign keys form a graph of tables. A reference is a *direct* orphan if its key names no
row, names only rows that were written later, or names a row that was deleted and not written
again. Children of an orphaned record are *inherited* orphans. The cascade runs down the graph by
semi-joins: over an acyclic graph as one lazy plan of as many steps as the graph is deep, over a
cyclic one as a loop to the fixpoint with a checkpoint in each round.

Nothing is collected. The target side of each join is first reduced to one row a key, so a key
that very many rows refer to is one row there; on the referring side adaptive execution splits
the partition of such a key, as the outer join allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import checkpointed
from corvane.tables import key_of

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.id``; tombstones of ``kind`` delete parent rows."""

    child: str
    column: str
    parent: str
    kind: str | None = None


#: The references of the code index.
INDEX_KEYS = (
    ForeignKey("symbols", "file_id", "files", "file"),
    ForeignKey("chunks", "symbol_id", "symbols", "symbol"),
)

#: The column that says when a row of the table was written.
WRITTEN_AT = {"files": "last_indexed_at", "symbols": "indexed_at", "chunks": "indexed_at"}


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 in UTC of a timestamp, or of ISO text with ``Z``, an offset or none."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "string":
        text = F.trim(c)
        zoned = F.when(text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
        return F.unix_micros(F.try_to_timestamp(zoned))
    if kind == "timestamp":
        return F.unix_micros(c)
    ntz = f"CAST(`{column}` AS TIMESTAMP_NTZ)"
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, {ntz})")


def _references(table: DataFrame, fk: ForeignKey, written: str) -> DataFrame:
    return table.select(
        F.col("id").alias("row_id"), key_of(fk.column).alias("key"), micros(table, written).alias("at")
    ).where(F.col("key").isNotNull() & F.col("row_id").isNotNull())


def direct_orphans(
    refs: DataFrame, targets: DataFrame, deleted: DataFrame | None
) -> DataFrame:
    """Rows of ``refs(row_id, key, at)`` without a valid target, with the reason.

    ``targets(key, at)`` may have many rows a key, ``deleted(key, at)`` too. A null ``at`` of a
    reference or of all rows of a target decides nothing about order: such a reference is an
    orphan only if its target is missing or deleted.
    """
    known = targets.groupBy("key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.lit(True).alias("there"))
    if deleted is not None:
        gone = deleted.groupBy("key").agg(F.max("at").alias("deleted_at"))
        known = known.join(gone, "key", "left")
    else:
        known = known.withColumn("deleted_at", F.lit(None).cast("bigint"))
    dead = F.col("deleted_at").isNotNull() & (
        F.col("last_at").isNull() | (F.col("last_at") < F.col("deleted_at"))
    )
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(dead, "deleted")
        .when(F.col("first_at") > F.col("at"), "late")
    )
    return (
        refs.join(known, "key", "left")
        .select("row_id", "key", "at", reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def _depth(keys: Sequence[ForeignKey]) -> int | None:
    """Longest path of the foreign-key graph in edges; None if it has a cycle."""

    def walk(table: str, path: tuple[str, ...]) -> int | None:
        most = 0
        for fk in keys:
            if fk.parent == table:
                if fk.child in path:
                    return None
                below = walk(fk.child, (*path, fk.child))
                if below is None:
                    return None
                most = max(most, 1 + below)
        return most

    depths = [walk(t, (t,)) for t in {fk.parent for fk in keys}]
    return None if None in depths else max(depths, default=0)


def orphans(
    tables: Mapping[str, DataFrame],
    keys: Sequence[ForeignKey] = INDEX_KEYS,
    tombstones: DataFrame | None = None,
    written_at: Mapping[str, str] = WRITTEN_AT,
) -> DataFrame:
    """All orphan references: ``ref_table, ref_column, row_id, period, kind, reason, hops``.

    ``kind`` is ``direct`` (``hops`` 0) or ``inherited`` (``hops`` 1 or more: the number of
    references between this row and the record that is an orphan itself). Rows of one id count as
    one record; if one of them is an orphan, the record is. A row that is a direct orphan is not
    listed as inherited too. ``period`` is the month in which the referring row was written, null
    if unknown. ``tombstones`` has ``kind, key, deleted_at``. Null or empty keys refer to nothing,
    rows without id cannot be named; both are left out. Empty tables give empty results.
    """
    stones = None
    if tombstones is not None:
        stones = tombstones.select(
            F.lower(F.trim("kind")).alias("kind"), key_of("key").alias("key"), micros(tombstones, "deleted_at").alias("at")
        )
    refs, found = {}, []
    for fk in keys:
        child, parent = tables[fk.child], tables[fk.parent]
        refs[fk] = _references(child, fk, written_at[fk.child])
        targets = parent.select(key_of("id").alias("key"), micros(parent, written_at[fk.parent]).alias("at"))
        targets = targets.where(F.col("key").isNotNull())
        deleted = None
        if stones is not None and fk.kind is not None:
            deleted = stones.where((F.col("kind") == fk.kind) & F.col("key").isNotNull()).select("key", "at")
        found.append(_named(direct_orphans(refs[fk], targets, deleted), fk, 0))
    direct = _union(found)
    depth = _depth(keys)
    if depth is None:
        return _to_fixpoint(direct, refs, keys)
    frontier, levels = direct, [direct]
    for hops in range(1, depth):
        # A child can only be found below a table that is a child itself.
        below = [_below(refs[fk], frontier, fk, hops) for fk in keys if any(up.child == fk.parent for up in keys)]
        if not below:
            break
        frontier = _union(below)
        levels.append(frontier)
    return _nearest(_union(levels))


def _below(refs: DataFrame, frontier: DataFrame, fk: ForeignKey, hops: int) -> DataFrame:
    """The rows of ``fk.child`` that refer to a record of the frontier: one step of the cascade."""
    bad = frontier.where(F.col("ref_table") == fk.parent).select(key_of("row_id").alias("key")).distinct()
    hit = refs.join(bad, "key", "left_semi").withColumn("reason", F.lit("parent is an orphan"))
    return _named(hit, fk, hops)


def _nearest(levels: DataFrame) -> DataFrame:
    """Each record once, as it was found with the fewest hops; it is direct if that is none."""
    best = levels.groupBy("ref_table", "ref_column", "row_id").agg(F.min(F.struct("hops", "period", "reason")).alias("v"))
    kind = F.when(F.col("v.hops") == 0, "direct").otherwise("inherited")
    return best.select(
        "ref_table", "ref_column", "row_id", F.col("v.period").alias("period"), kind.alias("kind"), F.col("v.reason").alias("reason"), F.col("v.hops").alias("hops")
    )


def _to_fixpoint(direct: DataFrame, refs: Mapping[ForeignKey, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """The cascade over a cyclic key graph: rounds until no record is new, a checkpoint in each."""
    names = ["ref_table", "ref_column", "row_id"]
    frontier = found = checkpointed(direct)
    hops = 0
    while not frontier.isEmpty():
        hops += 1
        below = _union([_below(refs[fk], frontier, fk, hops) for fk in keys])
        frontier = checkpointed(below.join(found.select(*names), names, "left_anti"))
        found = checkpointed(found.unionByName(frontier))
    return _nearest(found)


def _named(df: DataFrame, fk: ForeignKey, hops: int) -> DataFrame:
    """One row for each record, however many rows it has: the earliest period and least reason."""
    period = F.expr(f"date_format(timestampadd(MICROSECOND, at, {_EPOCH}), 'yyyy-MM')")
    return (
        df.select("row_id", period.alias("period"), "reason")
        .groupBy("row_id")
        .agg(F.min(F.struct("period", "reason")).alias("v"))
        .select(
            F.lit(fk.child).alias("ref_table"),
            F.lit(fk.column).alias("ref_column"),
            "row_id",
            F.col("v.period").alias("period"),
            F.col("v.reason").alias("reason"),
            F.lit(hops).alias("hops"),
        )
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references by referring table, column, month, kind and reason."""
    return found.groupBy("ref_table", "ref_column", "period", "kind", "reason").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
