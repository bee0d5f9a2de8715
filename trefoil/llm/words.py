"""Arrow and numpy helpers used inside tasks: words, word characters, hashes, byte-bounded slices."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.session import materialize

#: Bytes of text that one step of a task works on; longer texts are a step of their own.
SLICE_BYTES = 4 << 20
#: Rows that Spark puts into one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000
#: Row numbers that are broadcast at most, about 32 bytes each.
REMOVED_ROWS = 2_000_000
#: Multiplier of the rolling word hash (odd, 64 bits).
ROLL = np.uint64(0x9E3779B97F4A7C15)


def whole_hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of all the characters of each word, however long: a polynomial in ROLL, mixed with the length."""
    h = np.zeros(len(start), dtype=np.uint64)
    filled = np.flatnonzero(size > 0)
    if len(filled):
        ends = np.cumsum(size[filled])
        place = np.arange(ends[-1]) - np.repeat(ends - size[filled], size[filled])
        power = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(int(size.max()), ROLL))])
        term = points[np.repeat(start[filled], size[filled]) + place].astype(np.uint64) * power[place]
        h[filled] = np.add.reduceat(term, ends - size[filled])
    h = (h ^ (h >> np.uint64(29))) * ROLL + size.astype(np.uint64)
    return h ^ (h >> np.uint64(32))


def stratified(rows: DataFrame, label: str, most: int, chars: int) -> list[tuple[str, object, float]]:
    """``(text, label, weight)`` of about ``most`` distinct texts of each value of ``label``, drawn by a hash of the text; ``weight`` is how many distinct texts a drawn one stands for.

    Copies count as one text, however many there are, so they neither crowd out others nor shrink the sample. No text is passed over for its length:
    of one over ``chars`` characters a stretch of that many is drawn, at a place given by the hash.
    Labels are few; the sample is bounded by labels x 2 * ``most`` x ``chars``.
    """
    h = F.xxhash64("text")
    rows = rows.select("text", F.col(label).alias("label"), "doc_id").where(~held_out()).where("label is not null and text is not null").select("text", "label", h.alias("h"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()}
    if not counts:
        return []
    share = lambda n: (1 << 30) if n <= most else int(most / n * (1 << 30))
    limit = F.element_at(F.create_map(*[x for label, n in counts.items() for x in (F.lit(label), F.lit(share(n)))]), F.col("label"))
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < limit)
    at = F.when(F.length("text") > chars, 1 + F.pmod(F.shiftright("h", 30), F.length("text") - chars)).otherwise(F.lit(1)).cast("int")
    drawn = drawn.select(F.substring("text", at, F.lit(chars)).alias("text"), "label", "h").dropDuplicates(["label", "h"])
    some = drawn.limit(2 * most * len(counts)).collect()
    seen = {label: sum(r.label == label for r in some) for label in counts}
    return sorted(((r.text, r.label, counts[r.label] / seen[r.label]) for r in some), key=lambda r: (str(r[1]), r[0]))


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """``rows`` whose whole-number ``key`` isn't among those of ``removed``, which are written and counted once: up to REMOVED_ROWS of them are broadcast, so that texts stay where they are; beyond, both sides shuffle by the key."""
    removed = materialize(removed.select(key).distinct(), "removed")
    return rows.join(removed.hint("broadcast") if removed.count() <= REMOVED_ROWS else removed.hint("merge"), key, "left_anti")


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches held to BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def held_out(doc_id="doc_id"):
    """The fold that nothing is learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Words (runs of anything but ASCII white space) of each text: codes of all words in order, the distinct words, and each text's bounds among the codes."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.not_equal(flat, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    words = flat.filter(full).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, kept[ends]


def strings(words: pa.StringArray) -> np.ndarray:
    """The words as an object array, which is faster than Arrow's list of them."""
    return words.to_numpy(zero_copy_only=False)


def characters(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and each word's bounds."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(strings(words))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum(size)])


def one_blas_thread() -> None:
    """Keep numpy's matrix products of this worker on one thread: Spark runs a task per core already. Without a bundled OpenBLAS nothing happens."""
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


_tables: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _tables["letters"]


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds; 0 for empty segments."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]


def prefix_hashes(points: np.ndarray, start: np.ndarray, size: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(k, hash of the first k characters)`` for k up to ``longest``; shorter words repeat their whole hash."""
    h = np.zeros(len(start), dtype=np.uint64)
    last = max(len(points) - 1, 0)
    for k in range(longest):
        c = points[np.minimum(start + k, last)].astype(np.uint64) if len(points) else np.zeros(len(start), dtype=np.uint64)
        h = np.where(size > k, (h ^ c) * ROLL + np.uint64(k + 1), h)
        yield k + 1, h
