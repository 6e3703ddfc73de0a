"""Unicode normalisation, which the JVM functions of Spark SQL lack: Arrow batches through the standard library."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _batch(change: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def each(values: pd.Series) -> pd.Series:
        return values.map(change, na_action="ignore")

    return each


def nfc(text: Column) -> Column:
    return _batch(lambda x: unicodedata.normalize("NFC", x))(text)


def folded(text: Column) -> Column:
    """Compatibility form without case; white space goes."""
    return F.regexp_replace(_batch(lambda x: unicodedata.normalize("NFKC", x).casefold())(text), r"(?U)\s+", "")


def semantic_form(text: Column) -> Column:
    """The form in which claims are compared: compatibility form, no case, no white space, area units in one spelling."""
    return F.replace(F.replace(folded(text), F.lit("平方米"), F.lit("m2")), F.lit("平方毫米"), F.lit("mm2"))


def folded_each(texts: Column) -> Column:
    """`semantic_form` of each text of an array."""

    @F.pandas_udf("array<string>")
    def each(values: pd.Series) -> pd.Series:
        return values.map(lambda texts: [unicodedata.normalize("NFKC", t).casefold() for t in texts], na_action="ignore")

    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.transform(each(texts), lambda x: F.replace(F.replace(bare(x), F.lit("平方米"), F.lit("m2")), F.lit("平方毫米"), F.lit("mm2")))


def fact_form(text: Column) -> Column:
    """The form in which facts are compared: compatibility form, no case, no white space, one way to say that something is not needed."""
    return F.replace(folded(text), F.lit("无需"), F.lit("不需要"))
