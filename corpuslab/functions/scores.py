"""Logits to predictions."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def predicted_class(logits: Column) -> Column:
    """Arg max of two logits; a tie is class 0."""
    return (F.get(logits, F.lit(1)) > F.get(logits, F.lit(0))).cast("int")


def positive_probability(logits: Column) -> Column:
    """Softmax of two logits, second class; no overflow for large logits."""
    return 1.0 / (1.0 + F.exp(F.get(logits, F.lit(0)) - F.get(logits, F.lit(1))))
