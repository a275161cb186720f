"""The SQL functions give what the DataFrame functions of the same things give."""

import random

from pyspark.sql import functions as F

from plumbline.functions import sql
from plumbline.functions import text as t
from plumbline.operators import normalize as n
from plumbline.operators.aggregate import missing_safe_avg


def test_names(spark):
    sql.register(spark)
    names = ["OpenAI: GPT-4.5&nbsp;(High)", "a &#233;&#x1F600; &#0;&#55296;&#1114112;&bogus; &amp;lt; b", "Moonshot AI/Kimi.2 &AMP;", "z.ai: x.5 .y", "it's \\ \"q\"", "", None, "thinking", "x thinking", "Ünï 3.5.7"]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    got = df.select(F.expr("normal_name(s)"), t.normalize_name(F.col("s")), F.expr("without_ending(normal_name(s))"), t.strip_suffix(t.normalize_name(F.col("s")))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got) and got[0][0] == "openai gpt 4.5 high"


def test_curves_and_means(spark):
    sql.register(spark)
    r = random.Random(1)
    pick = lambda: r.choice([None, float("nan"), float("inf"), 0.0, 1.0, 50.0, r.uniform(-20, 120)])
    rows = [(pick(), r.choice([None, 10.0, 20.0]), r.choice([20.0, 90.0]), r.random() < 0.5, pick(), pick(), pick()) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, low double, high double, up boolean, a double, b double, c double")
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    x, low, high, up = (F.col(k) for k in ("x", "low", "high", "up"))
    pairs = [
        (F.expr("linear_score(x, low, high, up)"), n.linear_curve(x, low, high, up)),
        (F.expr("tail_score(x, low, high, up)"), n.tail_curve(x, low, high, up)),
        (F.expr("fraction_score(x)"), n.as_score(x)),
        (F.expr("known_mean(array(a, b, c), array(0.2D, 0.5D, 0.3D))"), missing_safe_avg({k: F.col(k) for k in weights}, weights).value),
        (F.expr("known_mean(array(a), array(0D))"), F.lit(50.0)),
    ]
    for row in df.select(*[F.struct(a, b) for a, b in pairs]).collect():
        for a, b in row:
            assert (a is None and b is None) or a == b or (a != a and b != b) or abs(a - b) < 1e-9, row
