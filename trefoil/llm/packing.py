"""Best-fit packing of token pieces into sequences by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus's size) goes to the driver.
There large lengths are rounded up within groups of equal cardinality, the few sizes that are left are packed by a
configuration linear program with column generation, the configurations are filled with actual lengths, and the
rest, small lengths among them, go best-fit in descending order into the room that is left. The plan speaks of
runs of equal sequences, so its size depends on the capacity and not on the corpus. Spark then ranks the pieces of
each length and looks up each rank's place.

Defined results: null and empty texts are one piece, the end id alone; texts over the capacity are cut, all pieces
but the last being full; repeated rows are packed each on its own; only the named columns are read; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.llm.words import bounded_batches, slices, split, strings
from trefoil.session import materialize

CAPACITY, END_ID = 2048, 0
#: Lengths above a share of the capacity are large; they are rounded within so many groups. Each of these cuts is tried, and the plan with the fewest sequences holds (at 1 nothing is large and all lengths go best-fit).
LARGE_SHARES, GROUPS = (1 / 3, 1 / 6, 1), 80
#: Pivots of the configuration program.
MOST_STEPS = 1500
#: Words whose ids a task remembers.
REMEMBERED = 400_000


#: A word of one token that stands between the words of an encoded line.
SEPARATOR = "|"
#: Letters, case of ASCII folded, whose lower case is one letter.
PLAIN_LETTERS = "a-zÀ-ÖØ-öø-ÿ"
#: What a text has that is encoded as it stands: combining marks, the start of a special token.
ODD = r"\p{M}|<\|"


class WordEncoder:
    """Token ids of texts, word by word: for tokenizers that lower-case, drop white space and never reach across it, so that each distinct word need be encoded once only."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def learn(self, words: list[str]) -> np.ndarray:
        """Place of each word's ids, after encoding the new ones."""
        if len(self.place) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.place]
        plain, odd = [w for w in new if SEPARATOR not in w], [w for w in new if SEPARATOR in w]
        apart = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        found = [*self._joined(plain), (np.array([i for x in apart for i in x], dtype=np.uint32), np.fromiter(map(len, apart), dtype=np.int64, count=len(apart)))]
        if new:
            self.place.update(zip([*plain, *odd], range(len(self.place), len(self.place) + len(new)), strict=True))
            self.ids = np.concatenate([self.ids, *[ids for ids, _ in found]])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate([size for _, size in found]))])
        return np.fromiter((self.place[w] for w in words), dtype=np.int64, count=len(words))

    def _joined(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, and how many each word has, of words without the separator, from long lines of words between separators: far fewer calls."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            between = ids == self.separator
            at = np.flatnonzero(between)
            if len(at) != len(some) - 1:
                raise ValueError("the tokenizer doesn't keep words apart at white space")
            out.append((ids[~between], np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the texts' bounds among them."""
        texts = pc.fill_null(texts, "")
        # fewer distinct words, same ids: ASCII case is folded anyhow, and these letters never join what follows them. Not where a mark may join a
        # letter before its case is folded, which the tokenizer does first, nor where a special token may stand
        fewer = pc.replace_substring_regex(pc.ascii_lower(texts), f"([{PLAIN_LETTERS}])([.,])", r"\1 \2")
        texts = pc.if_else(pc.match_substring_regex(texts, ODD), texts, fewer)
        codes, words, bounds = split(texts)
        place = self.learn(strings(words).tolist())
        start, size = self.bounds[place], np.diff(self.bounds)[place] if len(place) else np.zeros(0, dtype=np.int64)
        each = size[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        source = np.repeat(start[codes] - ends[:-1], each) + np.arange(ends[-1])
        text = np.repeat(np.arange(len(bounds) - 1), ends[bounds[1:]] - ends[bounds[:-1]])
        out_bounds = ends[bounds] + np.arange(len(bounds))
        out = np.full(out_bounds[-1], END_ID, dtype="<u4")
        out[np.arange(ends[-1]) + text] = self.ids[source]
        return out, out_bounds


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, columns: tuple[str, ...] = ("doc_id",), keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``columns``, ``piece``, ``start``, ``length``, ``ids_crc32`` and with ``keep_ids`` the ``ids`` themselves.

    ``tokenizer`` is the path of a tokenizers file that splits at white space, present on every executor.
    """
    given = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kinds = dict(given.dtypes)
    names = [*columns, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches):
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encoder.encode(part.column("text"))
                total = np.diff(bounds)
                many = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                at = bounds[:-1][row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [*[part.column(c).take(pa.array(row)) for c in columns], pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    shape = [*[f"`{c}` {kinds[c]}" for c in columns], "piece int", "start bigint", "length bigint", "ids_crc32 bigint", *(["ids array<int>"] if keep_ids else [])]
    return bounded_batches(given).mapInArrow(run, ", ".join(shape))


def _groups(lengths: list[int], counts: dict[int, int], groups: int) -> list[tuple[int, list[int]]]:
    """Descending lengths in runs of about equal cardinality: (rounded size, its lengths). A length that fills a run has its own."""
    share = sum(counts[x] for x in lengths) / groups if len(lengths) > groups else 0
    out: list[tuple[int, list[int]]] = []
    held = 0
    for x in lengths:
        if not out or held + counts[x] > share:
            out.append((x, []))
            held = 0
        out[-1][1].append(x)
        held += counts[x]
    return out


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The dearest pattern of sizes within the capacity, and its price: a table by size and capacity, read backwards."""
    best = [np.zeros(capacity + 1)]
    for s, p in zip(sizes, price, strict=True):
        row = best[-1].copy()
        if p > 0:
            for copies in range(1, capacity // s + 1):
                np.maximum(row[copies * s :], best[-1][: -copies * s] + copies * p, out=row[copies * s :])
        best.append(row)
    pattern, c = np.zeros(len(sizes)), capacity
    for i in range(len(sizes), 0, -1):
        if best[i][c] > best[i - 1][c]:
            s, p = sizes[i - 1], price[i - 1]
            copies = max(range(1, c // s + 1), key=lambda k: best[i - 1][c - k * s] + k * p)  # noqa: B023
            pattern[i - 1], c = copies, c - copies * s
    return pattern, float(best[-1][capacity])


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how often to use each, rounded down from the configuration program's optimum."""
    k = len(sizes)
    if not k:
        return []
    size, d = np.array(sizes), np.array(demand, dtype=float)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1 / columns.diagonal())
    x = inverse @ d
    for _ in range(min(40 * k, MOST_STEPS)):
        price = inverse.sum(axis=0)
        pattern, value = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-4:
            break
        move = inverse @ pattern
        ratio = np.where(move > 1e-9, np.maximum(x, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        # one column changed, so one pivot changes the inverse
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        x = inverse @ d
    return [(columns[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] >= 1 - 1e-9]


class _Room:
    """Runs of equal sequences ``[first, count, used, slots]`` by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.order, self.done, self.next = capacity, {}, [], [], 0

    def put(self, run: list) -> None:
        room = self.capacity - run[2]
        if not room:
            self.done.append(run)
            return
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.order, room)
        self.by_room[room].append(run)

    def open(self, count: int) -> list:
        run = [self.next, count, 0, []]
        self.next += count
        return run

    def take(self, length: int) -> list | None:
        """A run with the least room that fits."""
        i = bisect_left(self.order, length)
        if i == len(self.order):
            return None
        room = self.order[i]
        run = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.order.pop(i)
        return run

    def runs(self) -> list[list]:
        return [*self.done, *(run for some in self.by_room.values() for run in some)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """The best of the plans by :data:`LARGE_SHARES`; never more sequences than best-fit in descending order takes."""
    many = lambda places: max((first + b - a for _, a, b, first, _ in places), default=0)
    return min((plan_with(counts, share, capacity, groups) for share in LARGE_SHARES), key=many)


def plan_with(counts: dict[int, int], large_share: float, capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts`` pieces of each length: rows ``(length, first rank, last rank + 1, sequence of the first, offset)``.

    Ranks of a length count from 0 and are all covered once; sequences are numbered from 0 without gaps.
    """
    left, used, out = dict(counts), dict.fromkeys(counts, 0), []
    room = _Room(capacity)

    def fill(run: list, length: int) -> list:
        run[3].append((length, used[length], run[2]))
        used[length] += run[1]
        left[length] -= run[1]
        run[2] += length
        return run

    if left.get(capacity):
        room.put(fill(room.open(left[capacity]), capacity))
    large = sorted((x for x, n in left.items() if n and capacity * large_share < x < capacity), reverse=True)
    grouped = _groups(large, left, groups)
    rounded = len(grouped) < len(large)
    for pattern, times in configurations([s for s, _ in grouped], [sum(left[x] for x in xs) for _, xs in grouped], capacity):
        # actual lengths: slots take the longest ones their group still has, the last one what fits the room that
        # rounding has left best; a run of equal sequences ends where one of its lengths does
        slots = [g for g, copies in enumerate(pattern) for _ in range(copies)]
        while times:
            need: dict[int, int] = {}
            for at, g in enumerate(slots):
                # where lengths were rounded, all the room that the others have left is the last slot's
                final = rounded and at == len(slots) - 1
                most = capacity - sum(x * n for x, n in need.items()) if final else grouped[g][0]
                x = next((x for x in large[bisect_left(large, -most, key=lambda y: -y) :] if left[x] > need.get(x, 0)), None)
                if x is not None:
                    need[x] = need.get(x, 0) + 1
            if len(need) < min(2, len(slots)) and sum(need.values()) < len(slots):
                break
            some = min(times, *(left[x] // n for x, n in need.items()))
            run = room.open(some)
            for x, n in need.items():
                for _ in range(n):
                    fill(run, x)
            room.put(run)
            times -= some
    for x in sorted((x for x, n in left.items() if n), reverse=True):
        while left[x]:
            run = room.take(x)
            if run is None:
                run = room.open(-(-left[x] // (capacity // x)))
            if run[1] > left[x]:
                rest = [run[0] + left[x], run[1] - left[x], run[2], [(y, rank + left[x], at) for y, rank, at in run[3]]]
                run = [run[0], left[x], run[2], list(run[3])]
                room.put(rest)
            room.put(fill(run, x))
    for first, count, _, slots in room.runs():
        out += [(length, rank, rank + count, first, at) for length, rank, at in slots]
    return sorted(out)


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``pieces`` with each one's ``rank`` among those of its length. A hash of the row numbers ``__row`` deals a length out in shares, whatever the ids are: about as many as the most frequent length's shares have pieces, so neither ranking a share nor summing the shares is much work."""
    deal = 1 + isqrt(max(counts.values(), default=0))
    dealt = pieces.withColumn("__share", F.pmod(F.xxhash64("__row"), F.lit(deal)))
    before = dealt.groupBy("length", "__share").count().withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("length", "__share").orderBy("__row")) - 1
    return dealt.withColumn("rank", place).join(before.drop("count"), ["length", "__share"]).withColumn("rank", F.col("rank") + F.coalesce("__before", F.lit(0))).drop("__share", "__before", "__row")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    # numbers are written with the rows, so that a task that runs again finds the same ones
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    places = plan(counts, capacity)
    table = np.array(places or [(0, 0, 0, 0, 0)], dtype=np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))

    def look_up(batches):
        order, rows = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = rows[np.searchsorted(order, length << 44 | rank, side="right") - 1]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*[batch.schema.names[i] for i in kept], "sequence_id", "offset"])

    given = ranked(pieces, counts)
    given = given.withColumn("rank", F.col("rank").cast("bigint"))
    shape = [f"`{n}` {t}" for n, t in given.dtypes if n != "rank"]
    return given.mapInArrow(look_up, ", ".join([*shape, "sequence_id bigint", "offset bigint"]))


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with their ``ids``; a group has at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
