"""trefoil: triangle analytics and training-data operators on PySpark DataFrames."""

from trefoil.plans.algorithms import triad_census, triangle_count

__all__ = ["triad_census", "triangle_count"]
