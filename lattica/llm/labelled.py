"""A bounded sample of labelled texts, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _least(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """At most `most` rows, those with the least hash of their columns. All but about as many are left out before any are sorted."""
    hashed = rows.withColumn("_at", F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order])), 1, 8), 16, 10).cast("long"))
    # the hashes are even, so this share leaves `most` rows but for one case in millions, and then a few less
    share = min(1.0, (most + 6 * most**0.5) / max(rows.count(), 1))
    return hashed.filter(F.col("_at") <= int(share * (1 << 32))).orderBy("_at", *order).limit(most).drop("_at")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y): at most `most` labelled texts, chosen by hashes of their id, label and text. Rows of labels are (doc_id, label).

    Labels that are null don't count, nor does a null doc_id; a doc_id with several labels counts with each of its distinct
    ones, one with several texts with each distinct text. First as many labels as texts are chosen, then of their
    texts the keys; both are so few that they are broadcast, so no table of texts is exchanged.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").distinct()
    chosen = F.broadcast(_least(marked, most, "doc_id", "y"))
    summed = docs.select("doc_id", F.xxhash64("text").alias("sum"), "text")
    keys = F.broadcast(_least(summed.drop("text").join(chosen, "doc_id").distinct(), most, "doc_id", "y", "sum"))
    return summed.join(keys, ["doc_id", "sum"]).groupBy("doc_id", "y", "sum").agg(F.first("text").alias("text")).select("text", "y")
