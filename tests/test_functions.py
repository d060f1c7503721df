import re
from urllib.parse import quote

from pyspark.sql import functions as F

from outlog.functions import text, vectors


CASES = ["", "a", "a b", "[ts] [INFO] hello world 42", "x  y", "é ü ß 😀 ~*+/ & = ?", "trailing ", " lead",
         "Order placed for 3 items of cheese which costs 3", "a\tb", "%7E literal", "plus+sign"]


def test_template_and_parse_match_python(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "s string")
    got = df.select("s", text.template("s").alias("t"), text.common_log_message("s").alias("m"),
                    text.percent_encode("s").alias("e")).collect()
    for r in got:
        assert r["t"] == "".join(re.findall("[a-zA-Z]+", r["s"]))
        assert r["m"] == " ".join(r["s"].split(" ")[2:])
        assert r["e"] == quote(r["s"])


def test_strip_and_bool(spark):
    df = spark.createDataFrame([(" \t a b \n", "True"), ("x", "false"), ("y", "")], "s string, b string")
    got = df.select(text.clean_whitespace("s").alias("s"), text.parse_bool("b").alias("b")).collect()
    assert [r["s"] for r in got] == ["a b", "x", "y"]
    assert [r["b"] for r in got] == [True, False, False]


def test_to_str_lists_and_fill(spark):
    df = spark.createDataFrame([([1, 2], None)], "a array<int>, b string")
    r = df.select(text.to_str("a", df.schema["a"].dataType).alias("a"), text.fill_empty("b").alias("b")).first()
    assert r["a"] == "1 2" and r["b"] == "EMPTY"


def test_vector_functions(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.euclidean("a", "b").alias("d"), vectors.cosine_distance("a", "b").alias("c")).collect()
    assert got[0]["d"] == 5.0 and abs(got[0]["c"] - 1.0) < 1e-12
    assert got[1]["c"] is None        # zero-length vector
    assert vectors.learning_rate(0, 0) == 0.0 and vectors.learning_rate(10, 5) == 0.5


def test_hash_vector_deterministic(spark):
    df = spark.createDataFrame([("abc",), ("abc",), ("abd",)], "w string")
    got = [r[0] for r in df.select(vectors.hash_vector("w", 4, 1)).collect()]
    assert got[0] == got[1] and got[0] != got[2]
    assert all(-0.125 <= x < 0.125 for x in got[0])
