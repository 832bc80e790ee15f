"""The whole way from texts to belief states as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import normalize as nz
from ..operators import relations as rel


def normalized(texts: DataFrame) -> DataFrame:
    """Normalised claims of texts (ord, source_id, text) in the form that relations take."""
    n = nz.normalize_claims(cl.extract_claims(texts).where("reason is null")).where("reason_none is null")
    return n.select("ord", "claim_id", "context_id", "subject", "predicate", "metric", "value", "unit", F.lit("supports").alias("polarity"), F.col("claim_subtype").alias("subtype"))


def beliefs_of_texts(texts: DataFrame) -> DataFrame:
    """The claims are asked for by several branches, so they are kept (memory, then disk); a lost part is made anew."""
    return rel.beliefs(normalized(texts).persist())
