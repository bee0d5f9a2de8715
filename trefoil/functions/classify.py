"""Column expressions for direction masks and triad classes.

A mask describes an unordered vertex pair as seen from its first member: 1 = first to second,
2 = second to first, 3 = both ways.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven classes of three mutually adjacent vertices, in code order.
TRIAD_CLASSES = ("Trans", "OutRecip", "InRecip", "Cycle", "OneRecip", "TwoRecip", "ThreeRecip")
#: A neighbour's tag as seen from the vertex that owns the adjacency row.
TAG_OUT, TAG_IN, TAG_BOTH = 0, 1, 2


def direction_bit(src: Column, dst: Column) -> Column:
    """1 if the edge runs from the lower to the higher id, else 2; OR these per pair to get its mask."""
    return F.when(src < dst, F.lit(1)).otherwise(F.lit(2))


def flip(mask: Column) -> Column:
    """The mask of the same pair seen from its second member."""
    return F.when(mask == 3, F.lit(3)).otherwise(F.lit(3) - mask)


def tag_of(mask: Column) -> Column:
    """Mask (from the owner's side) to tag: 1 -> OUT, 2 -> IN, 3 -> BOTH."""
    return (mask - 1).cast("tinyint")


def reciprocal_pairs(xy: Column, yz: Column, xz: Column) -> Column:
    """How many of the three pairs are joined both ways."""
    return sum(((m == 3).cast("int") for m in (xy, yz, xz)), F.lit(0))


def _one_reciprocal(first: Column, second: Column) -> Column:
    """Class by the two masks that the vertex off the reciprocal pair has towards the pair's members."""
    return F.when((first == 1) & (second == 1), F.lit(1)).when((first == 2) & (second == 2), F.lit(2)).otherwise(F.lit(4))


def triad_code(xy: Column, yz: Column, xz: Column) -> Column:
    """Class code 0..6 of the triangle x, y, z from its pair masks; symmetric in the order of the vertices."""
    both = reciprocal_pairs(xy, yz, xz)
    cyclic = ((xy == 1) & (yz == 1) & (xz == 2)) | ((xy == 2) & (yz == 2) & (xz == 1))
    return (
        F.when(both == 3, F.lit(6))
        .when(both == 2, F.lit(5))
        .when(both == 0, F.when(cyclic, F.lit(3)).otherwise(F.lit(0)))
        .when(xy == 3, _one_reciprocal(flip(xz), flip(yz)))
        .when(yz == 3, _one_reciprocal(xy, xz))
        .otherwise(_one_reciprocal(flip(xy), yz))
        .cast("int")
    )


def triad_name(code: Column) -> Column:
    """The class's name."""
    return F.element_at(F.array(*map(F.lit, TRIAD_CLASSES)), code + 1)
