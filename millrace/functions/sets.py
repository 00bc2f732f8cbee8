"""Similarities of sets held as arrays without repetitions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(use, **values: Column) -> Column:
    """use(struct of the values), each worked out once a row: what is named twice, or within a lambda, is else worked out each time."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union; 0 if either is empty. The union's size follows from the others, as nothing is repeated."""
    sizes = lambda x: F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("both"))
    share = lambda s: F.when((s["a"] > 0) & (s["b"] > 0), s["both"] / (s["a"] + s["b"] - s["both"])).otherwise(F.lit(0.0))
    return bound(lambda x: share(x["n"]), n=bound(sizes, a=a, b=b))


def overlap(a: Column, b: Column) -> Column:
    """Share of the first that is in the second."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
