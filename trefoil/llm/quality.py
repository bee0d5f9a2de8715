"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failures are stored as bits of ``fail_bits`` beside the
measurements. A policy is a named, versioned mask of rules: applying it, comparing versions and ablating single
rules are then bitwise operations on one small column, without reading a text again. Built-in functions only.

Windows of three words are compared by a 64-bit hash within one text.

Defined results: null, empty and word-less texts have zero words and counts, and fail ``too_few_words``; very
long texts are read whole; repeated rows are judged each on its own; only the named columns are read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trefoil.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rules in bit order: name and condition over the measurements that a document fails by. Bits are never reused.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "5 * n_dup_lines > 2 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "no_letters": "10 * n_letters < 3 * word_chars",
}
#: Policies: the rules that a version enforces. A new version is a new entry.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "no_letters"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: tuple[str, ...]) -> int:
    """The bits of ``rules`` together."""
    return sum(bit(r) for r in set(rules))


def _repeat_words() -> F.Column:
    """Words covered by windows that occur twice or more, from ``windows`` (hashes in order) sorted with their places."""
    same = lambda k: (F.col("placed")[k]["h"] == F.get("placed", k + 1)["h"]) | (F.col("placed")[k]["h"] == F.get("placed", k - 1)["h"])
    again = F.filter(F.sequence(F.lit(0), F.size("placed") - 1), lambda k: F.coalesce(same(k), F.get("placed", k + 1)["h"] == F.col("placed")[k]["h"], F.get("placed", k - 1)["h"] == F.col("placed")[k]["h"]))
    covered = F.flatten(F.transform(again, lambda k: F.array(F.col("placed")[k]["i"], F.col("placed")[k]["i"] + 1, F.col("placed")[k]["i"] + 2)))
    return F.when(F.size("placed") > 0, F.size(F.array_distinct(covered)).cast("long")).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` and the measurements that rules are made of. Each array is built once, in its own projection."""
    text = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    bare = F.regexp_replace("__text", rf"^{SPACE}|{SPACE}$", "")
    words = text.select(*columns, "__text", F.when(F.length(bare) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")).alias("words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2])
    windows = F.when(F.size("words") > 2, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        *columns, F.size("words").cast("long").alias("n_words"), F.array_join("words", "").alias("joined"), F.length(F.regexp_replace("__text", rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"), windows.alias("windows"),
    )
    # most texts repeat no window; only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sized = counted.select(
        *columns, "n_words", F.length("joined").cast("long").alias("word_chars"), "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("joined", r"[^\pL]+", "")).cast("long").alias("n_letters"), F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("placed"),
    )
    return sized.withColumn("n_repeat_words", _repeat_words()).drop("placed")


def ledger(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements with ``fail_bits``, stored: policies read this small table, and no filter on it reaches the texts."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("long")
    return materialize(measure(docs, columns).withColumn("fail_bits", bits), "ledger")


def apply_policy(ledger: DataFrame, rules: tuple[str, ...], name: str = "kept") -> DataFrame:
    """The ledger with boolean ``name``: whether a document passes all of ``rules``."""
    return ledger.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(rules))) == 0)


def ablations(ledger: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """One row per policy and rule, from one aggregation: documents, failures of the rule, documents that fail it alone (and would come back without it), kept ones, and the union of all failed bits."""
    rows = []
    for name, rules in policies.items():
        for rule in rules:
            rows.append((name, rule, mask(rules), bit(rule)))
    table = ledger.sparkSession.createDataFrame(rows, "policy string, rule string, mask bigint, bit bigint")
    per_bits = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    found = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return per_bits.join(F.broadcast(table)).groupBy("policy", "rule").agg(
        F.sum("n").alias("documents"),
        F.sum(F.when(found.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(found == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(found == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.bit_or(found).alias("any_failed"),
    )
