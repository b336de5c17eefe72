"""Drift stream: last revisions equal a sort of all captures, whatever the order of arrival."""

import datetime as dt
import itertools
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

CAPTURES = [  # url, hour, fingerprint, batch that delivers it
    ("a", 1, "x", 0), ("a", 2, "x", 1), ("a", 3, "y", 2), ("a", 3, "y", 2), ("b", 1, "z", 1), (None, 2, "x", 0), ("a", None, "w", 1),
    ("b", 2, "z", 0), ("b", 3, None, 2)]


def at(hour):
    return None if hour is None else dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)


def deliver(folder, name, batch, rows):
    """One more file of fingerprints, as a micro-batch of the extraction writes it."""
    import pathlib
    path = pathlib.Path(folder, "fingerprints", f"batch_id={batch}")
    path.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"url": pa.array([r[0] for r in rows], pa.string()), "captured_at": pa.array([at(r[1]) for r in rows], pa.timestamp("us", "UTC")),
                             "fp": pa.array([r[2] for r in rows], pa.string())}), path / f"{name}.parquet")


def run(spark, folder, checkpoint, **options):
    from pagelens.streaming import drift_stream
    rows = []
    q = (drift_stream(spark, folder, **options).writeStream.foreachBatch(lambda df, _: rows.extend(tuple(r) for r in df.collect()))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return rows


def expected():
    out, key = {}, lambda c: (c[1] if c[1] is not None else -1, c[3], c[2] or "")
    for url in {c[0] for c in CAPTURES}:
        last = None
        for hour, _, fp in sorted({key(c) for c in CAPTURES if c[0] == url}):
            out[url, hour, fp] = "first" if last is None else "same" if fp == last else "changed"
            last = fp
    return out


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_order_of_arrival_does_not_matter(spark, order):
    out, ck = tempfile.mkdtemp(prefix="pagelens-drift-"), tempfile.mkdtemp(prefix="pagelens-drift-ck-")
    best = {}
    for turn, batch in enumerate(order):  # the same checkpoint: state goes on over restarts
        deliver(out, f"part-{turn}", batch, [c for c in CAPTURES if c[3] == batch])
        for url, when, fp, status, revision in run(spark, out, ck):
            hour = -1 if when is None else next(c[1] for c in CAPTURES if c[1] is not None and at(c[1]).timestamp() == when.timestamp())
            key = (url, hour, fp)
            assert revision > best.get(key, ("", 0))[1]
            best[key] = (status, revision)
    assert {k: v[0] for k, v in best.items()} == expected()


def test_captures_behind_the_horizon_are_late(spark):
    out, ck = tempfile.mkdtemp(prefix="pagelens-drift-"), tempfile.mkdtemp(prefix="pagelens-drift-ck-")
    deliver(out, "a", 0, [("a", h, "x" if h < 30 else "y", 0) for h in (1, 2, 30, 40)])
    first = run(spark, out, ck, horizon="12 hours")
    assert sorted((r[3], r[4]) for r in first) == [("changed", 1), ("first", 1), ("same", 1), ("same", 1)]
    deliver(out, "b", 1, [("a", 0, "q", 1), ("a", 35, "x", 1)])
    second = run(spark, out, ck, horizon="12 hours")
    # hour 0 is older than the newest capture behind the horizon; hour 35 turns hour 40's status
    assert sorted((r[1].astimezone(dt.timezone.utc).day * 24 + r[1].astimezone(dt.timezone.utc).hour - 24, r[3], r[4]) for r in second) == [
        (0, "late", 1), (35, "changed", 1), (40, "changed", 2)]
