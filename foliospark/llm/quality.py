"""Quality: supervised subword embeddings of words, word pairs and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import subword

SETTINGS = subword.Settings(grams=(3, 4), pairs=True, dim=8, lower=False)
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS) -> subword.Model:
    return subword.fit(docs, labels, "quality", ~held_out(F.col("doc_id")), settings)


def scored(docs: DataFrame, model: subword.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row; null text counts as empty."""
    score = subword.score_column(docs, model, F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
