"""How many longer texts begin with a value, without forming pairs."""

import random

from pyspark.sql import functions as F

from docloom.operators.joins import explained, prefixed


def test_equals_brute_force(spark):
    rng = random.Random(1)
    some = lambda n: ["".join(rng.choice(["a", "b", "é", "\U0010ffff", "\x00", "ÿ"]) for _ in range(rng.randrange(6))) for _ in range(n)]
    values, texts = some(120), some(400)
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "v string")
    got = {r.v: r.n for r in prefixed(frame(values), frame(texts), "v").collect()}
    assert got == {v: sum(t.startswith(v) and t != v for t in set(texts)) for v in set(values)}
    assert prefixed(frame([]).limit(0), frame(texts), "v").count() == 0


def test_a_million_commands_with_one_beginning(spark):
    head = "show interface statistics of the device "
    commands = spark.range(0, 1_000_000, 1, 8).select(F.concat(F.lit(head), F.format_string("%06d", "id")).alias("v"))
    values = commands.unionByName(spark.createDataFrame([(head,), (head + "12345",), ("short",)], "v string"))
    got = {r.v: r.explained for r in explained(values, commands.limit(0), commands, "v").where("explained or length(v) < 46").collect()}
    assert got == {head: True, head + "12345": True, "short": False}
    assert prefixed(values.where(F.length("v") < 45), commands, "v").where(F.length("v") == len(head)).first().n == 1_000_000
