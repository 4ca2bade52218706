"""Sessions in batch against a plain reading, and the stream against the batch."""

import datetime as dt
import random

import pytest

from loomgraph.streaming.sessions import session_lives, session_stream, streaming_settings

T0 = dt.datetime(2024, 3, 1, 22, 0)
SCHEMA = "session_id string, ts timestamp, seq long, kind string, question string, answer string"


def turns():
    r = random.Random(4)
    rows, at = [], T0
    for seq in range(900):
        at += dt.timedelta(minutes=r.choice([0, 1, 7, 30]))
        rows.append((r.choice("abcd") if seq % 3 else "hot", at, seq, "clear" if r.random() < 0.06 else r.choice(["turn", None]), f"q{seq}", None if seq % 5 == 0 else f"a{seq}"))
    rows += [("exact", T0, 1, "turn", "x", "y"), ("exact", T0 + dt.timedelta(minutes=120), 2, "turn", "x2", "y"), ("exact", T0 + dt.timedelta(minutes=240, seconds=1), 3, "turn", "x3", "y")]
    rows += [("only", T0, 1, "clear", None, None), (None, T0, 1, "turn", "x", "y"), ("late", None, 1, "turn", "x", "y")]
    return rows


def plain(rows, ttl=120, keep=6):
    now = max(x[1] for x in rows if x[1] and x[0])
    out, alive = [], {}
    end = lambda s, cause: out.append((s, *alive.pop(s)[:3], cause, tuple(alive_recent.pop(s)[-keep:])))
    alive_recent = {}
    for s, ts, seq, kind, q, a in sorted((x for x in rows if x[0] and x[1]), key=lambda x: (x[1], x[2])):
        if s in alive and ts - alive[s][1] > dt.timedelta(minutes=ttl):
            end(s, "expired")
        if kind == "clear":
            if s in alive:
                end(s, "cleared")
            continue
        first, _, n = alive.get(s, (ts, ts, 0))
        alive[s] = (first, ts, n + 1)
        alive_recent.setdefault(s, []).append((seq, q, a))
    for s in list(alive):
        end(s, "expired" if now - alive[s][1] > dt.timedelta(minutes=ttl) else "live")
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r["session_id"], r["started"], r["last_active"], r["turns"], r["cause"], tuple(tuple(x) for x in r["recent"])) for r in df.collect()), key=str)


def test_lives_equal_a_plain_reading(spark):
    rows = turns()
    assert as_rows(session_lives(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)
    assert as_rows(session_lives(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("batches", [1, 7])
def test_stream_equals_batch(spark, tmp_path, batches):
    """The ended lives, however the input is divided; two late rows push the watermark beyond every session."""
    rows = sorted((x for x in turns() if x[0] and x[1]), key=lambda x: (x[1], x[2]))
    last = rows[-1][1]
    far = [("z-end", last + dt.timedelta(days=k), k, "turn", "q", "a") for k in (3, 6)]
    step = -(-len(rows) // batches)
    for i, part in enumerate([rows[a : a + step] for a in range(0, len(rows), step)] + [[x] for x in far]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/b={i:03}")
    for k, v in streaming_settings().items():
        spark.conf.set(k, v)
    # one file for each batch, in the order of their folders
    for i in range(batches + 2):
        query = (
            session_stream(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/b=00[0-{i}]")).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    got = [x for x in as_rows(spark.read.parquet(f"{tmp_path}/out")) if x[0] != "z-end"]
    want = [(*x[:4], "expired" if x[4] == "live" else x[4], x[5]) for x in plain(rows)]
    assert got == sorted(want, key=str)
