"""Near-duplicates by SimHash, found through a byte-position inverted index with count filtering.

A fingerprint has 64 bits over hashed word shingles. Two fingerprints that differ in at most 4 bits share at least
4 of their 8 positional bytes, the guaranteed minimum. One byte alone is a posting of a 256th of the corpus, so
postings are keyed by three positional bytes at once: 20 triples are chosen so that any 4 of the 8 positions
contain one, and a pair that reaches the minimum meets in some posting. In a posting the shared positional bytes
of a pair are tallied, pairs under the minimum are dropped, and the rest are verified by counting differing bits.

Within a posting links are found by flooding: a fingerprint is compared with those no link has reached yet, so a
large group of near copies yields a spanning tree and never all its pairs, while every link between different
components is found. Postings over ``OVERSIZE`` are first dealt out anew by a fourth byte, which loses nothing
because linked pairs share four, and what is still oversize then by three half bytes of the other four.

Defined results: null and word-less texts have fingerprint zero and link like any other; equal texts share a
fingerprint, which enters the index once however many copies it has; rows with a null doc_id link like any other but
never name a component (a component of such rows only has a null name); only the named columns are read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.llm.components import connected
from trefoil.llm.words import bounded_batches, slices, without
from trefoil.session import materialize

SEED, SHINGLE, BITS = 42, 4, 4
#: Bytes that two linked fingerprints share at least.
SHARED = 8 - BITS
#: Fingerprints in a posting above which it is dealt out by a further byte.
OVERSIZE = 20_000
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14


def _triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions such that any four positions contain one: three parts, all triples inside a part or with two in a part and one in the next."""
    parts = [{0, 1, 2}, {3, 4, 5}, {6, 7}]
    fits = lambda t: any(len(t & parts[i]) == 3 or (len(t & parts[i]) == 2 and len(t & parts[(i + 1) % 3]) == 1) for i in range(3))
    return [t for t in combinations(range(8), 3) if fits(set(t))]


TRIPLES = _triples()


def fingerprint(text: str | None) -> int:
    """The text's SimHash, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    first, last = starts[:n], ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    of = xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        h = np.array([of(norm[a:b], SEED) for a, b in zip(first[i : i + CHUNK].tolist(), last[i : i + CHUNK].tolist(), strict=True)], dtype=">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with the fingerprint as a signed bigint ``fp``."""
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kinds = dict(given.dtypes)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                prints = np.fromiter(map(fingerprint, part.column("text").to_pylist()), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(prints.view(np.int64))], [*columns, "fp"])

    return bounded_batches(given).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], "fp bigint"]))


def _byte(i: int):
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))


def postings(nodes: DataFrame) -> DataFrame:
    """``(kind, key, fp)``: each distinct fingerprint under its 20 keys of three positional bytes."""
    keys = [F.struct(F.lit(k).alias("kind"), F.shiftleft(_byte(a), 16).bitwiseOR(F.shiftleft(_byte(b), 8)).bitwiseOR(_byte(c)).alias("key")) for k, (a, b, c) in enumerate(TRIPLES)]
    return nodes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.kind", "k.key", "fp")


def _by_fourth_byte(rows: DataFrame) -> DataFrame:
    """Rows of three-byte postings under a fourth byte, five keys each, with the other four bytes as ``rest``."""
    table = []
    for k, t in enumerate(TRIPLES):
        for i in set(range(8)) - set(t):
            table.append((k, 8 * k + i, 8 * i, *[8 * r for r in sorted(set(range(8)) - {*t, i})]))
    deal = rows.sparkSession.createDataFrame(table, "kind int, dealt int, at int, r0 int, r1 int, r2 int, r3 int")
    byte = lambda at: f"(shiftrightunsigned(fp, {at}) & 255L)"
    rest = " | ".join(f"shiftleft({byte(f'r{i}')}, {8 * i})" for i in range(4))
    return rows.join(F.broadcast(deal), "kind").select((F.col("dealt") + len(TRIPLES)).alias("kind"), F.expr(f"shiftleft(key, 8) | {byte('at')}").alias("key"), "fp", F.expr(rest).alias("rest"))


def _by_nibbles(rows: DataFrame) -> DataFrame:
    """Rows of four-byte postings under three of the eight half bytes of ``rest``: linked pairs share four of these, too, so the same 20 triples hold."""
    nibble = lambda i: f"(shiftrightunsigned(rest, {4 * i}) & 15L)"
    keys = [F.expr(f"struct(kind * {len(TRIPLES)} + {1000 + k} as kind, shiftleft(key, 12) | shiftleft({nibble(a)}, 8) | shiftleft({nibble(b)}, 4) | {nibble(c)} as key)") for k, (a, b, c) in enumerate(TRIPLES)]
    return rows.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.kind", "k.key", "fp")


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: first the tally of shared positional bytes, then the differing bits of what is left."""
    differ = np.atleast_1d(np.bitwise_xor(a, b))
    tally = (differ[..., None].view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1)
    out = tally >= SHARED
    out[out] = np.bitwise_count(differ[out]) <= BITS
    return out


def flood(left: np.ndarray) -> list[np.ndarray]:
    """Links that span the components of one posting's fingerprints."""
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = linked(left, at)
            found = left[near]
            out.append(np.stack([np.full(len(found), at), found], axis=1))
            queue.extend(found)
            left = left[~near]
    return out


def _posting_links(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Links of consecutive whole postings."""
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    out = []
    for m in np.unique(size[(size > 1) & (size <= 12)]):
        rows = start[size == m][:, None] + np.arange(m)
        for i, j in combinations(range(m), 2):
            ok = linked(fp[rows[:, i]], fp[rows[:, j]])
            out.append(np.stack([fp[rows[ok, i]], fp[rows[ok, j]]], axis=1))
    for s, m in zip(start[size > 12], size[size > 12], strict=True):
        out += flood(fp[s : s + m])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by posting; the last posting of a batch waits for the next batch."""
    wait: list[list[np.ndarray]] = []

    def emit(parts):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        if found := [x for x in _posting_links(cols[0], cols[1], cols[2].view(np.uint64)) if len(x)]:
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if wait and (wait[-1][0][-1], wait[-1][1][-1]) != (cols[0][0], cols[1][0]):
            yield from emit(wait)
            wait = []
        breaks = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        if len(breaks):
            cut = breaks[-1] + 1
            yield from emit([*wait, [c[:cut] for c in cols]])
            wait, cols = [], [c[cut:] for c in cols]
        wait.append(cols)
    if wait:
        yield from emit(wait)


def links(nodes: DataFrame) -> DataFrame:
    """``(u, v)``: links that connect the fingerprints of ``nodes(fp)`` as all pairs of at most 4 differing bits would."""
    scan = lambda rows: rows.select("kind", "key", "fp").repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_scan, "u bigint, v bigint")
    rows, found = postings(nodes), []
    for deal in (_by_fourth_byte, _by_nibbles):
        big = materialize(rows.groupBy("kind", "key").count().where(F.col("count") > OVERSIZE).select("kind", "key"), "oversize")
        if big.isEmpty():
            break
        found.append(scan(rows.join(big, ["kind", "key"], "left_anti")))
        rows = deal(rows.join(big, ["kind", "key"], "left_semi"))
    return reduce(DataFrame.unionByName, [*found, scan(rows)])


def _clusters(prints: DataFrame) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint; fingerprints with the same root reach each other."""
    nodes = materialize(prints.select("fp").distinct(), "nodes")
    found = connected(links(nodes).distinct())
    return nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def _least(prints: DataFrame, key) -> DataFrame:
    """``(fp, least)``: the least key among all rows that a fingerprint's rows reach."""
    own = prints.groupBy("fp").agg(F.min(key).alias("least")).join(_clusters(prints), "fp")
    return own.select("fp", "root").join(own.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per document; a component's name is the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(_least(prints, F.col("doc_id")), "fp").select("doc_id", hexed.alias("fingerprint"), F.col("least").alias("component_id"))


def representatives(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` (``doc_id`` and ``text`` among them) of one row of each component: that with the smallest id, null ids last.

    Rows, not ids, are kept or dropped: rows that share an id but not a text are told apart, and so are rows without an id. Of
    several rows with the smallest id the one whose columns have the smallest hash stays, so the choice doesn't depend on their order.
    """
    rows = materialize(fingerprints(docs, columns).withColumn("__row", F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*columns).alias("hash"), F.col("__row").alias("row"))
    slim = rows.select("fp", "__row", key.alias("key"))
    removed = slim.join(_least(slim, F.col("key")), "fp").where(F.col("__row") != F.col("least.row")).select("__row")
    return without(rows, removed, "__row").select(*columns)
