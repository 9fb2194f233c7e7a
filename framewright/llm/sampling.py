"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 32


def labelled_sample(labels: DataFrame, size: int, chosen) -> DataFrame:
    """At most ``size`` documents of ``labels`` (doc_id, label) with one label each, chosen by a hash of the doc_id.

    ``chosen`` aggregates several labels of a document into one. The hash is held against the share that is wanted
    first, so tasks hand over about ``size`` rows together, however many there are. Null ids and labels are passed over.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(chosen("label").cast("int").alias("label"))
    total = known.count()
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN))
    some = known.where(mark < int(_SPAN * min(1.0, 1.25 * size / max(total, 1))))
    rows = some.orderBy(mark, "doc_id").limit(size).collect()
    picked = [(r["doc_id"], r["label"]) for r in rows]
    return labels.sparkSession.createDataFrame(picked, "doc_id long, label int")
