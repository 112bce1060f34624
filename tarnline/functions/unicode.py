"""Unicode forms that Spark has no function for, as vectorised functions over Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC without soft hyphens; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t).replace("­", ""), na_action="ignore")
