import os

from pyspark.sql import functions as F

from tracemill.streaming import jobs


def test_deltas_in_any_order(spark, tmp_path):
    text = "the quick brown fox"
    deltas = [(1, i, c) for i, c in enumerate(text)] + [(2, 0, "ab"), (2, 2, "cd"), (2, 5, "lost")]
    for part in (deltas[5:], deltas[:5], [(1, 0, "late")]):
        spark.createDataFrame(part, "answer_id long, offset long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("answer_id long, offset long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = jobs.to_end(jobs.assembled(stream))
    whole = {r["answer_id"]: r["text"] for r in got.groupBy("answer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("length", "text"))), lambda x: x["text"]), "").alias("text")).collect()}
    assert whole == {1: text, 2: "abcd"}


def test_routes_once(spark, tmp_path):
    rows = [(1, True), (2, False), (3, None)], [(4, False)], [(5, True)]
    for part in rows:
        spark.createDataFrame(part, "id int, brief boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("id int, brief boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    held = lambda side: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/{side}").collect())
    run = lambda: jobs.routed(read(), F.col("brief"), f"{tmp_path}/saved", f"{tmp_path}/live", f"{tmp_path}/log")
    run()
    assert (held("saved"), held("live")) == ([2, 3, 4], [1, 5])
    for name in os.listdir(f"{tmp_path}/log/commits"):
        if name.strip(".").startswith("2"):
            os.remove(f"{tmp_path}/log/commits/{name}")  # as if it failed after both were written
    run()
    assert (held("saved"), held("live")) == ([2, 3, 4], [1, 5])
