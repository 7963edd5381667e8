"""Unicode composition of names, which the JVM expressions of Spark do not offer."""

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def compose_nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))
