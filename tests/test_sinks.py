"""The sampled sink over batches that are run again and streams that are stopped and go on."""

import random
import shutil

import pytest

from wayline.streaming.sinks import read_sampled, sampled_sink

SCHEMA = "seq_id long, us long, x string"


def drawn(n, seed=0):
    r, at = random.Random(seed), 0
    out = []
    for i in range(n):
        at += r.randrange(1, 9)
        out.append((r.choice([1, 1, 2, 3]), at, f"row {i}"))
    return out


def want(rows, n):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r[1]):
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] % n == 0:
            out.append(r)
    return sorted(out)


def test_batches_that_are_run_again(spark, tmp_path):
    rows, path = drawn(90), str(tmp_path / "out")
    write = sampled_sink(path, 4, span=10)
    cuts = [0, 20, 21, 60, 90]
    for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = spark.createDataFrame(rows[a:z], SCHEMA)
        write(batch, b)
        if b == 1:  # stopped between rows and counters, with a counter's write unfinished
            (tmp_path / f"out/counters/batch={b}/_SUCCESS").unlink()
            write(batch, b)
        if b == 2:  # stopped before the counters, then run again, twice
            shutil.rmtree(tmp_path / f"out/counters/batch={b}")
            write(batch, b)
            write(batch, b)
    assert sorted(map(tuple, read_sampled(spark, path, SCHEMA).collect())) == want(rows, 4)


def test_a_stream_that_is_stopped_and_goes_on(spark, tmp_path):
    rows = drawn(60, 1)
    for i in range(6):
        spark.createDataFrame(rows[10 * i : 10 * i + 10], SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    calls = []

    def failing(write, at):
        def run(batch, i):
            write(batch, i)
            calls.append(i)
            if i == at:  # all is written, but Spark never hears of it
                raise RuntimeError("stopped")

        return run

    def go(f):
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
        q = df.writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    write = sampled_sink(f"{tmp_path}/out", 3, span=10)
    for at in (1, 4):
        with pytest.raises(Exception, match="stopped"):
            go(failing(write, at))
    go(failing(write, None))
    assert calls.count(1) == 2 and calls.count(4) == 2 and set(calls) == set(range(6))
    got = sorted(map(tuple, read_sampled(spark, f"{tmp_path}/out", SCHEMA).collect()))
    # files may come in any order: a batch is one file, and within it rows are by time
    order = [spark.read.json(f).orderBy("us").collect() for f in read_order(tmp_path)]
    seen, expected = {}, []
    for r in (r for batch in order for r in batch):
        seen[r.seq_id] = seen.get(r.seq_id, 0) + 1
        if seen[r.seq_id] % 3 == 0:
            expected.append((r.seq_id, r.us, r.x))
    assert got == sorted(expected) and len(got) > 10


def read_order(tmp_path):
    """The files of the stream's batches, from the source's log in the checkpoint."""
    import json

    found = {}
    for log in (tmp_path / "check/sources/0").iterdir():
        for line in log.read_text().splitlines() if log.name.isdigit() else []:
            if line.startswith("{"):
                entry = json.loads(line)
                found[entry["batchId"]] = entry["path"]
    return [found[b] for b in sorted(found)]


def test_n_must_be_positive():
    with pytest.raises(ValueError):
        sampled_sink("x", 0)
