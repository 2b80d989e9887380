"""The library's functions by name, for use in SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquery.functions import parsers as P
from strataquery.functions.fuzzy import jaro_winkler_udf


@F.pandas_udf(T.ArrayType(T.StringType()))
def custom_elements_udf(html: pd.Series) -> pd.Series:
    """Null for null."""
    return html.map(lambda x: None if x is None else P.custom_elements(x))


@F.udtf(returnType="kind string, name string, parent string, line int, end_line int", useArrow=False)
class CodeSymbols:
    """Rows of code_symbols for one text: SELECT ... FROM t, LATERAL code_symbols(t.text, 'cs')."""

    def eval(self, text: str, language: str) -> Iterator[tuple]:
        for kind, name, parent, line, end_line, *_ in P.code_symbols(text, language) if text else ():
            yield kind, name, parent, line, end_line


@F.pandas_udf(T.StringType())
def sql_objects_udf(text: pd.Series) -> pd.Series:
    """What a SQL text creates, as a JSON list of [kind, schema, name]; null for null."""
    return text.map(lambda x: None if x is None else json.dumps([[k, s, n] for k, n, s, *_ in P.sql_symbols(x) if k != "column"]))


FUNCTIONS = {"jaro_winkler": jaro_winkler_udf, "custom_elements": custom_elements_udf, "sql_objects": sql_objects_udf}
TABLE_FUNCTIONS = {"code_symbols": CodeSymbols}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session's SQL and returns their names."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return [*FUNCTIONS, *TABLE_FUNCTIONS]
