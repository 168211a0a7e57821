from pyspark.sql import functions as F

from tracemill.functions import keys as K

#: Names that some Mac codes must have, of each kind of key.
MAC_NAMES = {36: "Enter", 76: "Enter", 48: "Tab", 51: "Backspace", 117: "Delete", 53: "Escape", 55: "Meta", 96: "F5", 122: "F1", 123: "ArrowLeft", 126: "ArrowUp", 0: "a", 6: "z", 12: "q", 46: "m", 29: "0", 25: "9", 82: "0", 92: "9", 65: ".", 69: "+"}


def test_names_by_platform(spark):
    assert {c: K.MAC.get(c) for c in MAC_NAMES} == MAC_NAMES
    assert sum(len(n) == 1 and n.isalpha() for n in K.MAC.values()) == 26
    rows = [(8, "", "mac", "c"), (8, "", "Mac", "c"), (8, "", "windows", "Backspace"), (8, "", None, "Backspace"), (8, "", "beos", "Backspace"), (51, "", "mac", "Backspace"), (0, "", "mac", "a"), (200, "Q", "mac", "q"), (200, "\x1a", "mac", "z"), (None, None, "mac", None)]
    d = spark.createDataFrame(rows, "code int, c string, p string, want string")
    got = d.select(K.key_name(F.col("code"), F.col("c"), F.col("p")).alias("name"), "want").collect()
    assert [r["name"] for r in got] == [r["want"] for r in got]
