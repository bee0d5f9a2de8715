"""Adjacency in blocks: ``(v, block, nbrs[, tags])``, the neighbours of v within one range of ids, ascending, with their direction tags.

No row grows with a vertex's degree: a block has at most ``2 ** bits`` neighbours, however many v has. Two vertices' common
neighbours are found block by block, by a join on the block and a merge of two short sorted arrays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trefoil.functions.classify import TRIAD_CLASSES, flip, tag_of, triad_code
from trefoil.operators.messages import aggregate_messages, triplets

#: Ids of a block: 2 ** BITS.
BITS = 12


def blocked(relation: DataFrame, bits: int = BITS) -> DataFrame:
    """Blocks of a distinct ``(v, nbr[, tag])`` relation. Rows are dealt by vertex and block, so a hub's neighbours don't meet in one task."""
    tags = "tag" in relation.columns
    item = F.struct("nbr", "tag") if tags else F.col("nbr")
    found = relation.groupBy("v", F.shiftright("nbr", bits).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return found.select("v", "block", *([F.col("items.nbr").alias("nbrs"), F.col("items.tag").alias("tags")] if tags else [F.col("items").alias("nbrs")]))


def both_ends(oriented: DataFrame) -> DataFrame:
    """``(v, nbr[, tag])`` of pairs ``(a, b[, mask])``, each from either end; masks are from the smaller id, tags from the owner."""
    a, b = F.col("a"), F.col("b")
    tag = lambda v, nbr: [owner_tag(v, nbr).alias("tag")] if "mask" in oriented.columns else []
    ends = F.explode(F.array(F.struct(a.alias("v"), b.alias("nbr"), *tag(a, b)), F.struct(b.alias("v"), a.alias("nbr"), *tag(b, a))))
    return oriented.select(ends.alias("e")).select("e.*")


def upper_ends(oriented: DataFrame) -> DataFrame:
    """``(v, nbr[, tag])`` of oriented pairs, each from its lower end."""
    tag = [owner_tag(F.col("a"), F.col("b")).alias("tag")] if "mask" in oriented.columns else []
    return oriented.select(F.col("a").alias("v"), F.col("b").alias("nbr"), *tag)


def owner_tag(v: Column, nbr: Column) -> Column:
    """The tag that v's row has for nbr, from the pair's ``mask``."""
    return tag_of(F.when(v < nbr, F.col("mask")).otherwise(flip(F.col("mask"))))


def common(one: Column, other: Column) -> Column:
    """How many neighbours two blocks share; 0 if either isn't there."""
    return F.coalesce(F.size(F.array_intersect(one["nbrs"], other["nbrs"])), F.lit(0)).cast("long")


def merged_codes(mask: Column, one: Column, other: Column) -> Column:
    """The class code of each neighbour that two blocks share: a merge of the two by neighbour, tags along. ``mask`` is the pair's, seen from the owner of ``one``."""
    tags = lambda block: F.map_from_arrays(block["nbrs"], block["tags"])
    met = F.map_zip_with(tags(one), tags(other), lambda _, s, t: F.when(s.isNotNull() & t.isNotNull(), triad_code(mask, t + 1, s + 1)))
    return F.when(F.arrays_overlap(one["nbrs"], other["nbrs"]), F.filter(F.map_values(met), lambda c: c.isNotNull()))


def common_by_block(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(a, b, common)`` for each pair and block of its first end that the second has, too. Put the end with fewer neighbours first."""
    found = triplets(pairs.select("a", "b"), blocks, "a", "b", by=["block"]).where("src_state is not null and dst_state is not null")
    return found.select("a", "b", common(F.col("src_state"), F.col("dst_state")).alias("common"))


def class_messages(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(v, *TRIAD_CLASSES)``: each pair ``(a, b, mask)`` sends b the class counts of the triangles it forms with the neighbours that both ends have in ``blocks``.

    Counts are made within the blocks and added up before the shuffle; no triangle is ever a row. ``mask`` is from the smaller id.
    """
    seen = F.when(F.col("a") < F.col("b"), F.col("mask")).otherwise(flip(F.col("mask")))
    met = triplets(pairs.select("a", "b", seen.alias("mask")), blocks, "a", "b", by=["block"]).where("src_state is not null and dst_state is not null")
    coded = met.select("a", "b", merged_codes(F.col("mask"), F.col("src_state"), F.col("dst_state")).alias("codes")).where("codes is not null")
    of = lambda code: F.size(F.filter("codes", lambda c: c == code)).cast("long")
    counts = {name: of(code) for code, name in enumerate(TRIAD_CLASSES)}
    return aggregate_messages(coded, {name: F.sum for name in TRIAD_CLASSES}, to_dst=counts, src="a", dst="b")


__all__ = ["BITS", "blocked", "both_ends", "upper_ends", "owner_tag", "common", "merged_codes", "common_by_block", "class_messages"]
