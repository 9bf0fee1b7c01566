from gaugeworks.functions import repeats
from pyspark.sql import functions as F


def test_only_repeated_keys_are_shuffled(spark, monkeypatch):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (3, None), (None, "z"), (None, "z")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    want = [(1, "a"), (1, "b"), (2, "a"), (3, None)]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, repeats.without_repeats(df, "id").collect()), key=key) == want
    assert repeats.without_repeats(df.limit(0), "id").count() == 0
    got = repeats.once_per_key(df, "id", lambda x: x.select("id", F.length("t").alias("n")))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, 1), (2, 1), (3, None)]
    # more repeated keys than may be broadcast: the general way, the same rows
    monkeypatch.setattr(repeats, "MOST_REPEATED", 1)
    assert sorted(map(tuple, repeats.without_repeats(df, "id").collect()), key=key) == want
