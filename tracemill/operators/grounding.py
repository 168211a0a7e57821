"""Measurements of replies against their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import claims as C


def unsupported(replies: DataFrame, evidence: DataFrame, by: list[str], key: str, text: str = "text", all_sentences: bool = False) -> DataFrame:
    """(keys, key, measurements, caveat): replies with measurements whose number none of their evidence (same keys) has.

    Both sides meet on (keys, number), so a key with much evidence is spread over its numbers. The evidence's numbers
    are made distinct before they travel. Null texts have no numbers and claim nothing; a null key has no evidence.
    """
    known = evidence.select(*by, F.explode(C.numbers(F.col(text))).alias("number")).distinct()
    told = replies.select(*by, key, F.posexplode(C.claimed(F.col(text), all_sentences)).alias("at", "m")).select(*by, key, "at", "m.shown", "m.number")
    open_ = told.join(known, [*by, "number"], "left_anti").groupBy(*by, key).agg(F.sort_array(F.collect_list(F.struct("at", "shown")))["shown"].alias("measurements"))
    return open_.withColumn("caveat", F.concat(F.lit(C.CAVEAT), F.array_join("measurements", ", "), F.lit(C.CAVEAT_END)))
