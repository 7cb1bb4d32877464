"""What larger tables hold and the small ones don't: empty events, decimals between two doubles, ties, several files."""

import duckdb
import pandas as pd

from tidemark.plans import REGISTRY

#: event_id, user_id, event_type, ts, value
ROWS = [
    (0, 1, "view", "2024-01-05 10:00:00.000000", 10.0),
    (1, 1, "error", "2024-01-06 10:00:00.000000", 0.0),
    (2, 1, "view", "2024-01-07 10:00:00.000000", 2.5),
]
#: Ends that lie half-way between two roundings as decimals, but not as doubles, or as products, or the other way round.
TIES = [
    (3, 2, "click", "2024-01-20 13:54:59.563500", 137.33),
    (4, 2, "error", "2024-01-01 01:38:15.375000", 7.78),
    (5, 2, "error", "2024-01-02 03:54:01.685000", 46.53),
    (6, 2, "error", "2024-01-06 17:39:49.175000", 123.06),
]


def both(spark, tmp_path, name, rows):
    """The rows of the query and of its SQL over the given events, floats as they are."""
    events = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts", "value"]).astype({"ts": "datetime64[us]"})
    at = f"{tmp_path}/events.parquet"
    spark.createDataFrame(events).selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp_ntz) ts", "value").coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{at}/*.parquet'")
    got, want = REGISTRY[name].run(spark, str(tmp_path)).toPandas(), con.execute(REGISTRY[name].sql).df()
    plain = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    return plain(got), plain(want)


def test_gap_merge_keeps_empty_events_and_rounds_as_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "label_gap_merge", [*ROWS, *TIES])
    assert got == want and len(got) == 3 + len(TIES)


def test_reviewed_merge_keeps_empty_events_and_rounds_as_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "reviewed_merge", [*ROWS, *TIES])
    assert got == want and len(got) == 3 + len(TIES)


def test_located_times_are_printed_as_c_does(spark, tmp_path):
    got, want = both(spark, tmp_path, "timeline_locate", [*ROWS, *TIES])
    assert got == want


def test_an_empty_event_makes_its_scene_weight_nan_as_in_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "overlap_weights", [*ROWS, *TIES])
    assert got == want and ("1", "nan") in got


def test_running_turns_of_rows_that_come_late(spark, tmp_path):
    import random

    from tidemark.streaming import streams

    draw = random.Random(4)
    start = pd.Timestamp("2024-01-01")
    rows = [(i, draw.randrange(6), draw.choice(["click"] * 6 + ["view"]), start + pd.Timedelta(seconds=t), 1.0) for i, t in enumerate(draw.sample(range(10**6), 300))]
    rows += [(1000 + i, 9, "view", start + pd.Timedelta(seconds=i), 1.0) for i in range(40)]  # one type only
    draw.shuffle(rows)
    for i in range(12):  # files in no order of time, eight a batch
        events = pd.DataFrame(rows[i::12], columns=["event_id", "user_id", "event_type", "ts", "value"]).astype({"ts": "datetime64[us]"})
        spark.createDataFrame(events).selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp_ntz) ts", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(REGISTRY["stream_running_turns"].sql).fetchall())
    assert sorted(tuple(r) for r in REGISTRY["stream_running_turns"].run(spark, str(tmp_path)).collect()) == want
    # a group's rows in several Arrow batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        one = streams.running_turns(streams.event_stream(spark, f"{tmp_path}/events.parquet", 100))
        assert sorted((r.user_id, r.event_type, r.run) for r in streams.drained(one, "update").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_thresholds_of_a_long_scene_need_no_pair_of_all_events(spark):
    import time

    from tidemark.operators import decoding

    frames = spark.range(40_000).selectExpr("0 scene", "'a' label", "id frame", "if(id % 2 = 0, 0.9, 0.1) p")
    gold = spark.range(20_000).selectExpr("0 scene", "'a' label", "cast(2 * id as double) onset", "cast(2 * id + 1 as double) off")
    began = time.time()
    (r,) = decoding.class_thresholds(frames, gold, [0.5, 0.95], 0.3)[0].collect()
    assert (r.threshold, r.tp, r.fp, r.fn) == (0.5, 20_000, 0, 0)
    assert time.time() - began < 90  # all pairs are 400 million


def test_ranks_of_copies_zero_vectors_and_unknown_labels_equal_sql(spark, tmp_path, monkeypatch):
    import numpy as np

    from tidemark.operators import similarity

    rng = np.random.default_rng(5)
    one = rng.normal(size=(150, 8)).astype("float32")
    one[7] = 0
    rows = [(k * 1000 + i * 5, None if i % 11 == 0 else int(i % 4), one[i].tolist()) for k in range(4) for i in range(150)]
    rows += [(9900, 77, one[3].tolist())]  # its label is nowhere else
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(REGISTRY["recall_at_k"].sql).fetchall())
    for n in (similarity.ROWS, 16):  # many blocks, too
        monkeypatch.setattr(similarity, "ROWS", n)
        assert sorted(tuple(r) for r in REGISTRY["recall_at_k"].run(spark, str(tmp_path)).collect()) == want


def test_strongest_segments_of_a_long_recording(spark):
    import time

    from tidemark.operators import decoding

    frames = spark.range(20_000).selectExpr("0 scene", "id frame", "case when id between 5000 and 5999 then 0.9 when id between 9000 and 9999 then 0.8 else 0.1 end p")
    began = time.time()
    assert sorted(tuple(r)[1:] for r in decoding.strongest(frames, ["scene"], 3, 0.6, 0.2).collect()) == [(5000, 6000, 0.9), (9000, 10000, 0.8)]
    assert time.time() - began < 60  # a step that works out its ends for every frame takes hours


def test_vote_over_many_turns():
    import random
    import time

    from tidemark.operators import matching as M

    draw = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    turns = [[draw.choice(words) if draw.random() < 0.1 else w for w in words] for _ in range(150)]
    began = time.time()
    assert M.vote(turns) == words
    assert time.time() - began < 8  # 22,500 pairs of 10,000 cells each take longer, cell by cell
    assert M.word_distance(words, turns[0]) == M.aligned_words(words, turns[0])[1] == sum(a != b for a, b in zip(words, turns[0]))
