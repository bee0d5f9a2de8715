"""Edges with the state of both their ends, and messages along them: the vertex-centred form of joins and aggregations.

A *state* is any table with a vertex column; what else it has is the vertex's state. It may hold a vertex in several rows told apart
by further key columns (``by``), so that a large state need not be one row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of a table that is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row takes in a hashed relation beside its columns.
ROW_BYTES = 32


def lookup(rows: DataFrame, table: DataFrame, on: str | Sequence[str], limit: int | None = BROADCAST_BYTES, missing: object = 0) -> DataFrame:
    """``rows`` with the columns of ``table``, whose key ``on`` is unique; ``missing`` where a key isn't there (None: null).

    The table is counted once: up to ``limit`` bytes it is broadcast, beyond it both sides shuffle by the key. With ``limit=None``
    nothing is counted and no job runs: Spark decides from what it measures while it runs.
    """
    on = [on] if isinstance(on, str) else list(on)
    own = [c for c in table.columns if c not in on]
    if limit is not None:
        table = table.hint("broadcast") if table_bytes(table) <= limit else table.hint("merge")
    found = rows.join(table, on, "left").select(*rows.columns, *own)
    return found if missing is None else found.withColumns({c: F.coalesce(c, F.lit(missing).cast(table.schema[c].dataType)) for c in own})


def table_bytes(table: DataFrame) -> int:
    """Bytes that a table of numbers takes when it is broadcast, from its row count."""
    return table.count() * (ROW_BYTES + 8 * len(table.columns))


def triplets(edges: DataFrame, state: DataFrame, src: str = "src", dst: str = "dst", key: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """``edges`` with structs ``src_state`` and ``dst_state``: two outer lookups of one layout, null where a vertex has no state.

    With ``by``, an edge comes once for each row of its source's state, beside the row of its target's that agrees on ``by``.
    Rows of an edge meet the state of a hub through a join that Spark splits when it is skewed.
    """
    by = list(by)
    packed = state.select(F.col(key).alias("__v"), *by, F.struct(*[c for c in state.columns if c not in (key, *by)]).alias("__state"))
    at = lambda end, name: packed.select(F.col("__v").alias(end), *by, F.col("__state").alias(name))
    found = edges.join(at(src, "src_state"), src, "left").join(at(dst, "dst_state"), [dst, *by], "left")
    return found.select(*edges.columns, *by, "src_state", "dst_state")


def aggregate_messages(
    edges: DataFrame, merge: Mapping[str, Callable[[Column], Column]], to_src: Mapping[str, Column] | None = None, to_dst: Mapping[str, Column] | None = None,
    state: DataFrame | None = None, src: str = "src", dst: str = "dst", key: str = "v", by: Sequence[str] = (), where: Column | None = None, shares: int = 1,
) -> DataFrame:
    """``(v, *merge)``: what each vertex has received along its edges.

    ``to_src`` and ``to_dst`` name the columns sent to either end, as expressions over the edge's columns and, if there is a ``state``, over
    ``src_state`` and ``dst_state``. ``merge`` names an aggregate for each of them that can be applied to its own results (``F.sum``, ``F.max``,
    ``F.bit_or``, a flattened list ...). Spark merges the messages of a task before they are shuffled. ``shares`` > 1 merges a receiver's
    messages in so many shares first, for aggregates that don't shrink what they merge. ``where`` says which triplets send at all.
    A vertex without a message isn't in the result.
    """
    found = triplets(edges, state, src, dst, key, by) if state is not None else edges
    found = found if where is None else found.where(where)
    send = [(end, columns) for end, columns in ((src, to_src), (dst, to_dst)) if columns]
    if not send:
        raise ValueError("nothing is sent: give to_src or to_dst")
    share = [F.pmod(F.xxhash64(src, dst), F.lit(shares)).alias("__share")] if shares > 1 else []
    message = lambda end, columns: [F.col(end).alias(key), *[columns[name].alias(name) for name in merge], *share]
    if len(send) == 1:
        messages = found.select(*message(*send[0]))
    else:
        messages = found.select(F.explode(F.array(*[F.struct(*message(*s)) for s in send])).alias("__m")).select("__m.*")
    if shares > 1:
        messages = messages.groupBy(key, "__share").agg(*[f(F.col(name)).alias(name) for name, f in merge.items()])
    return messages.groupBy(key).agg(*[f(F.col(name)).alias(name) for name, f in merge.items()])


__all__ = ["BROADCAST_BYTES", "lookup", "table_bytes", "triplets", "aggregate_messages"]
