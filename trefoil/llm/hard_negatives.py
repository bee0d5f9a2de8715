"""Hard negatives by a vector-approximation file.

Vectors become whole numbers; each dimension is cut into at most ``CELLS`` cells with edges at its quantiles, and a row is approximated by a
byte per dimension. For an anchor and a row, the edges looked up in the cell table bound their inner product from below and above. Two passes
over a grid of anchor shares x row shares use the bounds: the first finds each anchor's best rows of its own label, the second the best rows of other labels
within each positive's window. In both, only rows that may still enter a list are scored exactly, in integers; a cell of the grid
gives the few best of its rows, and Spark ranks them. Shares are dealt by hash and bounded by ``SHARE_ROWS`` and ``SHARE_ANCHORS``, so neither tasks nor driver hold all.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do empty vectors. Rows equal in id, label and
vector count once; rows of one id that differ stand for themselves, and none is a positive of its own id. Components beyond the shorter
of two vectors count nothing. Equal scores rank by smaller id, then label and content. A positive score below zero has no window that holds anything. Scores are exact while
they fit 64 bits. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.session import materialize

#: Fixed values of the relation: how many positives and negatives, and the window's bounds in hundredths of the positive score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: A component's scale, and the labels that are turned.
SCALE, TURNED, LABELS = 256, 7, 10
#: Cells of a dimension; a cell number is a byte.
CELLS = 256
#: Most rows and anchors of one share, and the fewest rows that make another share worth its while.
SHARE_ROWS, SHARE_ANCHORS, LEAST_ROWS = 1 << 17, 1 << 12, 256
#: Anchors and rows that one step of a task bounds at once.
STEP_ANCHORS, STEP_ROWS = 64, 1 << 14


def vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, q)`` of the rows that take part: turned labels, whole-number components."""
    held = lambda x: F.greatest(F.least(x, F.lit(2.0**52)), F.lit(-(2.0**52)))  # noqa: E731  far beyond any component whose scores fit 64 bits
    whole = F.transform("embedding", lambda x: F.floor(held(F.lit(float(SCALE)) * x.cast("double"))).cast("bigint"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.pmod("vec_id", F.lit(TURNED)) == 0, F.pmod(F.col("label").cast("bigint") + 1, F.lit(LABELS))).otherwise(F.col("label").cast("bigint"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)).where(sound)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), whole.alias("q")).distinct()


def cell_table(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Cell edges by dimension, ``(dimensions, cells + 1)``: approximate quantiles between the exact least and greatest value.

    One row per dimension reaches the driver, whatever the number of vectors.
    """
    by = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d")
    found = by.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", [i / cells for i in range(1, cells)], F.lit(2000)).alias("at")).orderBy("d").collect()
    edges = np.array([[r.least, *r["at"], r.most + 1] for r in found], dtype=np.int64).reshape(-1, cells + 1)
    return np.maximum.accumulate(edges, axis=1)


def approximate(q: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component: ``edges[d, c] <= q < edges[d, c + 1]``."""
    return np.stack([np.searchsorted(edges[d, 1:-1], q[:, d], side="right") for d in range(len(edges))], axis=1).astype(np.uint8)


class Approximations:
    """A share of the file: cells, exact vectors, ids and labels, rows in the order of id; and the cell table's centres and half widths."""

    def __init__(self, table: pa.Table, edges: np.ndarray):
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.q = padded(table.column("q"), len(edges))
        self.cells = approximate(self.q, edges)
        low, high = edges[:, :-1].astype(np.float32), (edges[:, 1:] - 1).astype(np.float32)
        self.centre, self.half = (low + high) / 2, np.maximum(high - low, 0) / 2

    def bounds(self, anchors: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each anchor's score with the rows ``at``, by looking up their cells' edges; widened by what rounding may cost."""
        d = np.arange(self.cells.shape[1])
        a = anchors.astype(np.float32)
        middle = a @ self.centre[d, self.cells[at]].T
        radius = np.abs(a) @ self.half[d, self.cells[at]].T
        slack = 1 + 1e-5 * (np.abs(a) @ np.abs(self.centre).max(axis=1))[:, None]
        return middle - radius * 1.0001 - slack, middle + radius * 1.0001 + slack

    def exact(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.q[rows] @ anchor


def padded(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    """Lists of whole numbers as a matrix, zeros where a list is shorter."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dimensions).all():
        return flat.reshape(-1, dimensions).astype(np.int64)
    out = np.zeros((len(size), dimensions), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _best(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` places that come first: higher scores, then smaller ids."""
    return np.lexsort((ids, -scores))[:most]


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value, or less than any if there are not so many."""
    return np.partition(values, -k)[-k] if len(values) >= k else -np.inf


def best_of_label(anchors: dict[str, np.ndarray], file: Approximations) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, positive_id, score)``, in columns for each anchor: the best rows of its own label in this share."""
    order = np.argsort(file.labels, kind="stable")
    for label in np.unique(anchors["label"]):
        own = order[np.searchsorted(file.labels[order], label) : np.searchsorted(file.labels[order], label, side="right")]
        mine = np.flatnonzero(anchors["label"] == label)
        if not len(own):
            continue
        for start in range(0, len(mine), STEP_ANCHORS):
            step = mine[start : start + STEP_ANCHORS]
            parts = [file.bounds(anchors["q"][step], own[i : i + STEP_ROWS]) for i in range(0, len(own), STEP_ROWS)]
            low, high = (np.concatenate([p[i] for p in parts], axis=1) for i in (0, 1))
            for k, lower, upper in zip(step, low, high, strict=True):
                others = file.ids[own] != anchors["vec_id"][k]
                near = np.flatnonzero(others & (upper >= _kth(lower[others], POSITIVES)))
                scores = file.exact(anchors["q"][k], own[near])
                best = _best(file.ids[own[near]], scores, POSITIVES)
                yield np.full(len(best), anchors["key"][k]), file.ids[own[near[best]]], scores[best]


def best_in_windows(anchors: dict[str, np.ndarray], file: Approximations) -> Iterator[tuple[np.ndarray, ...]]:
    """``(anchor, positive's place, negative_id, score)``, in columns for each window: its best rows of other labels in this share."""
    n = len(anchors["vec_id"])
    for start in range(0, n, STEP_ANCHORS):
        step = range(start, min(start + STEP_ANCHORS, n))
        q = anchors["q"][start : start + STEP_ANCHORS]
        parts = [file.bounds(q, slice(i, i + STEP_ROWS)) for i in range(0, len(file.ids), STEP_ROWS)]
        low, high = (np.concatenate([p[i] for p in parts], axis=1) for i in (0, 1))
        for k, lower, upper in zip(step, low, high, strict=True):
            others = file.labels != anchors["label"][k]
            wanted: list[tuple[int, np.ndarray]] = []
            for place, score in enumerate(anchors["scores"][k]):
                least, most = LOW * score / 100, HIGH * score / 100
                may = others & (upper >= least) & (lower <= most)
                sure = may & (lower >= least) & (upper <= most)
                wanted.append((place, np.flatnonzero(may & (upper >= _kth(lower[sure], NEGATIVES)))))
            near = np.unique(np.concatenate([rows for _, rows in wanted]))
            exact = file.exact(anchors["q"][k], near)
            for place, rows in wanted:
                scores = exact[np.searchsorted(near, rows)]
                positive = int(anchors["scores"][k][place])
                inside = (LOW * positive <= 100 * scores) & (100 * scores <= HIGH * positive)
                rows, scores = rows[inside], scores[inside]
                best = _best(file.ids[rows], scores, NEGATIVES)
                yield np.full(len(best), anchors["key"][k]), np.full(len(best), place), file.ids[rows[best]], scores[best]


def _shares(rows: DataFrame) -> tuple[int, int]:
    """How many shares of anchors and of rows the grid has."""
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.pmod("vec_id", F.lit(100)) == 0).alias("anchors")).first()
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-n.anchors // SHARE_ANCHORS), 1), max(-(-n.rows // SHARE_ROWS), min(most, -(-n.rows // LEAST_ROWS)), 1)


def _grid(anchors: DataFrame, rows: DataFrame, shares: tuple[int, int], work, schema: str, edges: np.ndarray) -> DataFrame:
    """``work(anchors of a share, approximations of a share)`` for every cell of the grid; each anchor goes to one row of cells, each row to one column."""
    a, r = shares
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")).alias("cell")
    columns = F.explode(F.sequence(F.lit(0), F.lit(r - 1)))
    left = anchors.withColumn("__j", columns).withColumn("cell", cell(F.pmod(F.xxhash64("key"), F.lit(a)), F.col("__j"))).drop("__j")
    lines = F.explode(F.sequence(F.lit(0), F.lit(a - 1)))
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns], lines.alias("__i")).withColumn("cell", cell(F.col("__i"), F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(r)))).drop("__i")
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    out = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])

    def one(of: pa.Table, share: pa.Table) -> pa.Table:
        if not of.num_rows or not share.num_rows:
            return out.empty_table()
        file = Approximations(share.sort_by([("vec_id", "ascending"), ("label", "ascending")]), edges)
        known = {"vec_id": of.column("vec_id").to_numpy(), "label": of.column("label").to_numpy(), "key": of.column("key").to_numpy(), "q": padded(of.column("q"), len(edges))}
        if "scores" in of.column_names:
            known["scores"] = of.column("scores").to_pylist()
        found = list(work(known, file))
        return pa.table([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(zip(*found), out, strict=True)], schema=out) if found else out.empty_table()

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(one, schema)


def mine(embeddings: DataFrame) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: each positive's first negatives within its window."""
    rows = materialize(vectors(embeddings), "vectors")
    edges = cell_table(rows)
    shares = _shares(rows)
    anchors = rows.where(F.pmod("vec_id", F.lit(100)) == 0).withColumn("key", F.xxhash64("vec_id", "label", "q"))
    first = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    found = _grid(anchors, rows, shares, best_of_label, "key bigint, other bigint, score bigint", edges)
    found = materialize(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= POSITIVES).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("positives")), "positives")
    asking = anchors.join(found, "key").withColumn("scores", F.col("positives.score"))
    kept = asking.select("key", F.col("vec_id").alias("anchor_id"), "positives")
    near = _grid(asking.drop("positives"), rows, shares, best_in_windows, "key bigint, place int, negative_id bigint, negative_score bigint", edges)
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    positive = F.element_at("positives", F.col("place") + 1)
    return best.join(kept, "key").select("anchor_id", positive["other"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")
