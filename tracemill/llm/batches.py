"""Small shared pieces of the corpus operators.

Arrow batches of texts are bounded by Spark's own spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set);
nothing here changes the session. Ids never pass through pandas, where a null would turn a batch of longs into
floats: they stay on the JVM's side, or travel as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, whatever their names hold."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def id_text(name: str = "doc_id") -> Column:
    """An id as text, exact at any size; null stays null."""
    return F.col(name).cast("long").cast("string")
