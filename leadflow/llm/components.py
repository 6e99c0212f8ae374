"""Connected components by repeated joins, a stored table after every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b); comp is the smallest id
    that can be reached. A step takes the smallest label among the neighbours,
    then jumps to that label's own label, so long chains halve with each step.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "cc-links")
    labels = materialize(both.groupBy(F.col("a").alias("id"))
                         .agg(F.least(F.col("id"), F.min("b")).alias("comp")), "cc-labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("near_id"))
                .agg(F.min("comp").alias("near")))
        step = (labels.join(near, F.col("id") == F.col("near_id"))
                .select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")))
        up = labels.select(F.col("id").alias("up_id"), F.col("comp").alias("up"))
        new = materialize(step.join(up, F.col("comp") == F.col("up_id"), "left")
                          .select("id", "old", F.least("comp", "up").alias("comp")), "cc-labels")
        labels = new.select("id", "comp")
        if new.filter("old <> comp").isEmpty():
            return labels
