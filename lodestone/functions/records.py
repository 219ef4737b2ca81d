"""Names and addresses of records normalised together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import addresses, names, text
from lodestone.functions.dialect import apply


def normalized(df: DataFrame, name: str = "business_name", address: str = "business_address", country: str = "country", *, costs: dict[str, float] | None = None) -> DataFrame:
    """``df`` with the outputs of both normalisers; its columns of those names give way.

    ``costs``: word costs of the whole corpus (``text.word_costs``), by which glued web names are cut into words.
    What needs Python is evaluated first, below all rule layers: one normaliser after the other would put a Python
    step between their layers, which Spark's planner resolves by writing the lower ones out over and over.
    """
    out = [*names.OUTPUTS, *addresses.OUTPUTS]
    df = df.drop(*out)
    own = df.columns
    both = df.withColumns({"_in_name": names.prepared(F.col(name), costs), "_in_address": addresses.nfkd(F.col(address))})
    return apply(both, [*names.program("_in_name"), *addresses.program("_in_address", country)]).select(*own, *out)
