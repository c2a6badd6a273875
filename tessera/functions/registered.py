"""The operators over texts as functions of SQL: kinds and risks of statements, scripts and facts as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import code_facts, lexer

#: Functions of a statement's text, by name: what they give, and its type.
SCALARS = {
    "sql_kind": (lexer.classify, T.StringType()),
    "sql_read_only": (lexer.is_read_only, T.BooleanType()),
    "sql_risks": (lexer.risks, T.ArrayType(T.StringType())),
    "sql_binds": (lexer.binds, T.ArrayType(T.StringType())),
}


class SplitScript:
    def eval(self, text: str):
        yield from lexer.split_script(text or "")


class CodeFacts:
    def eval(self, unit: str, text: str):
        yield from code_facts.extract(unit or "", text or "")


def _over_texts(f):
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: f(t or ""))

    return run


def register(spark: SparkSession) -> None:
    """Makes them known to SQL: sql_kind, sql_read_only, sql_risks, sql_binds; split_script and code_facts in FROM, after LATERAL for a column."""
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.pandas_udf(_over_texts(f), kind))
    spark.udtf.register("split_script", F.udtf(SplitScript, returnType="statement string, kind string, line int"))
    spark.udtf.register("code_facts", F.udtf(CodeFacts, returnType=code_facts.FACTS))
