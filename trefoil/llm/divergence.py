"""Source divergence audit: how far the sources of a language differ in their terms, by DuckDB over shards.

Tasks cut their texts into terms, about ``COUNT_BYTES`` of text at a time, and count them with DuckDB before anything is shuffled: one row for each language and
term, with the sources that have it. Rows then go to shards by a hash of language and term, one shard a partition: it holds every count of
its terms, so DuckDB there drops terms that too few documents have and adds up the rest. Spark adds the shards' totals by group and language. In a second
pass each shard gets all groups and works out probabilities, its best terms of each group and its part of each pair's sum; Spark merges sums and rankings.

A pair's sum runs over all kept terms, also those that neither source has: a shard sums over the terms that the first source has, once over all and once
over those that the second lacks, and counts those that both have; what is left is one constant times a count. So work grows with the counts that there are, not with terms x sources.

All arithmetic is on whole numbers: 128 bits where a count is scaled, else 64.

Defined results: null text, language and source are ''. A document is a row, so repeated rows count again. A group without terms is judged by the smoothed
zero counts; a language without kept terms has 0 for each pair. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trefoil.llm.words import bounded_batches, slices, split
from trefoil.session import materialize

#: What a term is, the letters that fold, the documents a term needs, the scale, the added count, the places of a term ranking.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS, SCALE, ADDED, PLACES = 10, 1_000_000_000, 2, 10
#: Bytes of text that a task counts at once; a longer text is counted by itself.
COUNT_BYTES = 16 << 20

COUNTS = "lang string, term string, docs bigint, sources array<string>, ns array<bigint>"
KEPT = "lang string, source string, term string, n bigint, n_lang bigint, first int"
SUMS = "lang string, source string, part string, item string, value bigint, lacking bigint, shared bigint"

#: A scaled probability, and how far two of them are apart.
P = f"(1 + CAST(CAST({SCALE} AS HUGEINT) * ({{n}} + {ADDED}) // ({{total}} + {ADDED} * v) AS BIGINT))"
APART = "({p} - {q}) * ({p} - {q}) // ({p} + {q})"

COUNT_TERMS = """
WITH per AS (SELECT doc, term, count(*) n FROM words GROUP BY ALL),
own AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) n, count(*) docs FROM per JOIN rows USING (doc) GROUP BY ALL)
SELECT lang, term, CAST(sum(docs) AS BIGINT) docs, list(source) sources, list(n) ns FROM own GROUP BY lang, term"""
KEEP = f"""
WITH enough AS (SELECT lang, term FROM part GROUP BY ALL HAVING sum(docs) >= {MIN_DOCUMENTS}),
single AS (SELECT lang, term, unnest(sources) source, unnest(ns) n FROM part JOIN enough USING (lang, term)),
c AS (SELECT lang, term, source, sum(n) n FROM single GROUP BY ALL)
SELECT lang, source, term, n, sum(n) OVER w n_lang, CAST(min(source) OVER w = source AS INT) first FROM c WINDOW w AS (PARTITION BY lang, term)"""
SUM_SHARD = f"""
WITH g AS MATERIALIZED (SELECT lang, source, total, v, lang_total, {P.format(n=0, total="total")} zero FROM part WHERE term IS NULL AND v > 0),
c AS (SELECT lang, source, term, n, n_lang FROM part WHERE term IS NOT NULL),
k AS MATERIALIZED (SELECT lang, source, term, {P.format(n="n", total="total")} p, {P.format(n="n_lang", total="lang_total")} q FROM c JOIN g USING (lang, source)),
ranked AS (SELECT lang, source, term item, {APART.format(p="p", q="q")} value FROM k WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {PLACES}),
met AS (SELECT a.lang, a.source, h.source item, a.p p, coalesce(b.p, h.zero) q, b.p IS NULL lacks FROM k a JOIN g h ON h.lang = a.lang AND h.source <> a.source LEFT JOIN k b ON b.lang = a.lang AND b.term = a.term AND b.source = h.source),
pairs AS (SELECT lang, source, item, {APART.format(p="p", q="q")} value, lacks FROM met)
SELECT lang, source, 'term' part, item, value, 0 lacking, 0 shared FROM ranked
UNION ALL SELECT lang, source, 'pair', item, sum(value), coalesce(sum(value) FILTER (lacks), 0), count(*) FILTER (NOT lacks) FROM pairs GROUP BY ALL"""

#: Bytes as terms see them: letters fold, all that parts terms is a space, and what is beyond ASCII stays.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _duckdb():
    """A database in this task's memory, on its one thread."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def terms(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Codes of all terms in order, the distinct terms, and each text's bounds among the codes."""
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    folded = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(_BYTES)
    return split(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(folded)))


def _count_texts(pieces: list[pa.RecordBatch]) -> pa.Table:
    """One row for each language and term of these texts. DuckDB counts codes; strings come back for what is left."""
    table = pa.Table.from_batches(pieces).combine_chunks()
    codes, words, bounds = terms(table.column("text").chunk(0))
    lang, source = (table.column(c).chunk(0).dictionary_encode() for c in ("lang", "source"))
    with _duckdb() as con:
        con.register("words", pa.table({"doc": np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(bounds)), "term": codes.astype(np.int32)}))
        con.register("rows", pa.table({"doc": np.arange(table.num_rows, dtype=np.int32), "lang": lang.indices, "source": source.indices}))
        found = con.sql(COUNT_TERMS).to_arrow_table().combine_chunks()
    if not found.num_rows:
        return _schema(COUNTS).empty_table()
    column = lambda name: found.column(name).chunk(0)
    sources = pa.ListArray.from_arrays(column("sources").offsets.cast(pa.int32()), source.dictionary.take(column("sources").flatten()))
    return pa.table([lang.dictionary.take(column("lang")), words.take(column("term")), column("docs"), sources, column("ns")], schema=_schema(COUNTS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for piece in slices(batch):
            if held and size + piece.nbytes > COUNT_BYTES:
                yield from _count_texts(held).to_batches(1 << 16)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if size:
        yield from _count_texts(held).to_batches(1 << 16)


def _by_shard(rows: DataFrame, shards: int, sql: str, fields: str) -> DataFrame:
    """``sql`` over ``part``, the rows of a shard of languages and terms; a row with a ``shard`` goes to that one. Each shard is a partition of its own."""
    if "shard" not in rows.columns:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with _duckdb() as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            con.execute("CREATE TEMP TABLE part AS SELECT * FROM arriving")
            yield from con.sql(sql).to_arrow_table().cast(_schema(fields)).to_batches(1 << 16)

    return rows.repartitionById(shards, F.col("shard")).mapInArrow(run, fields)


def kept_counts(docs: DataFrame, shards: int) -> DataFrame:
    """``(lang, source, term, n, n_lang, first)``: counts of terms that enough documents of the language have; ``first`` marks one row of each term and language."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return _by_shard(bounded_batches(texts).mapInArrow(_count, COUNTS), shards, KEEP, KEPT)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, own, v, lang_total)`` of every group that occurs: its kept occurrences and terms, the language's terms and occurrences."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)


def audit(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``; part ``pair`` ranks a source's distances to all others, part ``term`` its most telling terms."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = materialize(kept_counts(docs, shards), "kept-terms")
    groups = materialize(group_totals(docs, kept), "groups")
    lacks = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard")
    terms_of = kept.select(shard, "lang", "source", "term", "n", "n_lang", *lacks(("total", "bigint"), ("v", "bigint"), ("lang_total", "bigint")))
    everywhere = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", *lacks(("term", "string"), ("n", "bigint"), ("n_lang", "bigint")), "total", "v", "lang_total")
    sums = materialize(_by_shard(terms_of.unionByName(everywhere), shards, SUM_SHARD, SUMS), "shard-sums")

    zero = F.expr(f"1 + {SCALE * ADDED} div greatest(total + {ADDED} * v, 1)")
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("own").alias(f"own_{name}"), zero.alias(f"zero_{name}"))
    met = sums.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("lacking").alias("lacking"), F.sum("shared").alias("shared"))
    back = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("lacking").alias("lacking_back"))
    both = side("source").join(side("item"), "lang").where("source <> item").join(groups.select("lang", "v").distinct(), "lang")
    both = both.join(met.drop("lacking"), ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left").na.fill(0)
    neither = F.expr("(v - own_source - own_item + shared) * ((zero_source - zero_item) * (zero_source - zero_item) div (zero_source + zero_item))")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("lacking_back") + neither).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    terms = sums.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= PLACES)
    return pairs.select("*", rank).unionByName(terms)
