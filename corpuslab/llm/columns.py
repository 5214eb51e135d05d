"""Names of columns that operators add, where the input has such names already."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add: its own replace them."""
    own = {n.lower() for n in names}
    return df.drop(*(c for c in df.columns if c.lower() in own))


def fresh(df: DataFrame, name: str) -> str:
    """A name like `name` that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(df: DataFrame, own: list[str], used: list[str]) -> tuple[DataFrame, list[str]]:
    """`df` in a shape in which names in `own` are free, and the columns to select afterwards.

    Where an extra column has such a name, whole rows travel in a struct beside the columns used."""
    names = {n.lower() for n in own}
    if not any(c.lower() in names for c in df.columns if c not in used):
        return df, [f"`{c}`" for c in df.columns]
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_whole"), *used), ["_whole.*"]
