"""A bounded sample of labelled rows for the classifiers.

Per label value, the rows of the learning fold whose hashed doc_id is smallest,
at most ``per_class`` of them, among texts of at most ``max_chars`` code points
(both documented parameters of the classifiers). Labels other than 0 and 1 and
null ids are passed over; of several labels of one doc_id the largest counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slim, small_batches


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray, float]:
    """Texts, their labels, and the log odds of label 1 in the whole learning fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(~held_out(4)).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class ids are broadcast.
    texts = slim(docs).join(F.broadcast(chosen), "doc_id").where(F.char_length("text").between(1, max_chars))
    found = texts.orderBy(*order, "text").limit(2 * per_class).select("text", "y").collect()
    odds = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    return [r["text"] for r in found], np.array([r["y"] for r in found], dtype=np.float64), odds


def scored(docs: DataFrame, score_texts, threshold: float) -> DataFrame:
    """(_row, score, predicted) for every row; ``score_texts`` maps a list of texts to scores."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(["" if t is None else t for t in texts]), dtype="float64")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), score(F.col("text").cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
