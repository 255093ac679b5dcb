"""A bounded sample of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id: str = "doc_id"):
    """Rows kept out of training: crc32 of the id as text leaves no remainder by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(id, text, label) for at most ``per_class`` rows of each label 0 and 1.

    The rows with the smallest hash of their id are taken, so the sample is the
    same however the table is stored.  Its ids are broadcast: at most
    ``2 * per_class`` of them.  Ids with more than one label, null labels and
    rows that are held out are left out; of a repeated document id one text is
    taken.  ``fold=False`` draws from all labelled rows.
    """
    one = labels.select(F.col(f"`{id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("_label"))
    one = one.where("_id is not null and _label in (0, 1)")
    if fold:
        one = one.where(~held_out("_id"))
    one = one.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    some = [one.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    texts = docs.select(F.col(f"`{id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    chosen = texts.join(F.broadcast(some[0].unionByName(some[1])), "_id")
    return chosen.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_id", "_text", "_label")
