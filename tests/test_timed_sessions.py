import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexspark.streaming import sessions, timed_sessions

DDL = "session_id long, seq long, ts timestamp, kind string, composing boolean, menu boolean, full_roman boolean, has_code boolean, text string"
START = datetime.datetime(2024, 1, 1, 8)
KINDS = ("letter", "shift_letter", "tab", "space", "select", "escape", "nav", "punct", "apostrophe", "release", "digit")


def events(rng, count=240, sessions_=7):
    out = []
    for i in range(count):
        text = rng.choice([".", ",", "食", "ab", "?"])
        out.append((rng.randrange(sessions_), i, START + datetime.timedelta(seconds=20 * i), rng.choice(KINDS), *(rng.random() < 0.5 for _ in range(4)), text))
    return out


def arrive(rng, rows, late=15):
    """In an order in which no event comes behind more than `late` others that are younger."""
    return [r for _, r in sorted((i + rng.uniform(0, late), r) for i, r in enumerate(rows))]


FLUSH = (10**6, 10**6, START + datetime.timedelta(days=2), "letter", False, False, False, False, "")


@pytest.fixture
def stream(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert zone == "UTC"

    def put(name, rows):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    def run():
        source = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = timed_sessions.session_stream(source, "10 minutes", "1 hour")
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    yield put, run, lambda: spark.read.schema(timed_sessions._OUT).parquet(f"{tmp_path}/out")
    spark.conf.set(provider, before)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def batch(spark, rows):
    df = sessions.session_states(spark.createDataFrame(rows, DDL))
    return sorted(tuple(r) for r in df.select("session_id", "seq", "capitalise_next", "selecting", F.coalesce("last_text", F.lit(""))).collect())


def told(df):
    return sorted(tuple(r) for r in df.where("session_id < 1000000").select("session_id", "seq", "capitalise_next", "selecting", F.coalesce("last_text", F.lit(""))).collect())


def test_shuffled_and_late_events_give_the_batch_result_over_a_restart(spark, stream):
    put, run, out = stream
    rng = random.Random(3)
    rows = events(rng)
    coming = arrive(rng, rows)
    assert coming != rows
    put("a", coming[:80])
    put("b", coming[80:130])
    run()
    early = told(out())
    assert 0 < len(early) < 130  # what the watermark hasn't passed still waits
    put("c", coming[130:])  # goes on from the checkpoint
    put("d", [FLUSH])
    query = run()
    assert told(out()) == batch(spark, rows)
    left = [p for p in query.recentProgress if p.stateOperators][-1].stateOperators[0]
    assert left.numRowsTotal <= 8  # sessions that are idle have left; the last event alone waits


def test_idle_sessions_begin_anew(spark, stream):
    put, run, out = stream
    first = [(1, 0, START, "space", True, True, True, False, "食")]
    again = [(1, 1, START + datetime.timedelta(hours=3), "letter", True, False, False, False, "")]
    put("a", first)
    put("b", again)
    put("c", [FLUSH])
    run()
    got = {r.seq: (r.capitalise_next, r.selecting, r.last_text) for r in out().where("session_id = 1").collect()}
    assert got == {0: (False, False, "食"), 1: (True, False, None)}
