"""SQL names for the functions that Spark lacks: register_all(spark), then use them in spark.sql()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusmill.functions import text as tx
from corpusmill.functions.phrases import phrases
from corpusmill.operators import code
from corpusmill.operators.extract import _PAIR


def _parsed(test):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: test(c or "", code._imports(c)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, BooleanType())


def _clean(source: str, modules: list[str] | None) -> bool:
    return modules is not None and not {m.split(".")[0] for m in modules} & set(phrases("code_deny")) and not any(w in source for w in phrases("code_words"))


def _good(source: str, modules: list[str] | None) -> bool:
    return any(m.startswith(tuple(phrases("code_allow"))) for m in modules or ())


@F.udtf(returnType="prompt string, response string")
class QuestionAnswers:
    """Question and answer pairs of one text, before the quality test."""

    def eval(self, text: str):
        import re

        for q, a in re.findall(_PAIR, text or ""):
            yield q.strip(), a.strip()


def register_all(spark: SparkSession) -> None:
    for name, f in (
        ("normalize_text", tx.normalize_text),
        ("correct_by_dict", tx.correct_by_dict),
        ("nfkc", tx.nfkc),
        ("unescape_html", tx.unescape_html),
        ("strip_accents", tx.strip_accents),
        ("docstrings", code.docstrings),
        ("imports", code.imports),
        ("is_clean_code", _parsed(_clean)),
        ("uses_good_libraries", _parsed(_good)),
    ):
        spark.udf.register(name, f)
    spark.udtf.register("question_answers", QuestionAnswers)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION count_of(t STRING, p STRING) RETURNS BIGINT
        RETURN (length(t) - length(replace(t, p, ''))) div length(p)"""
    )
