"""The committing sink, pushdown into the endpoint, ordered release, fork choice, places and runs of numbers."""

import hashlib
import json
import os
import random
import threading
from http.server import HTTPServer
from pathlib import Path

import pytest
from chainloom.operators import forks, integrity, latest
from chainloom.schemas import STAGED
from chainloom.sources import rpc, staged_sink
from chainloom.sources.staging import StagingError
from chainloom.streaming import ordered
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_chain import Endpoint, payload


def staged(spark, numbers, chain=5, size=200):
    q = random.Random(1)
    text = lambda: "".join(q.choice("abcdefgh") for _ in range(size))
    return spark.createDataFrame([(chain, n, f"0x{n}", 86_400 * 400 * (n // 10), text(), "[]", "[]", "[]") for n in numbers], STAGED)


def test_sink_commits_named_checked_files(spark, tmp_path):
    uri = f"file://{tmp_path}/s"
    files = staged_sink.write(staged(spark, range(1, 61), size=2000).union(staged(spark, range(3, 9), 6)), uri, max_file_bytes=1)
    rows = files.collect()
    assert sum(r.n_blocks for r in rows) == 66 and {r.chain_id for r in rows} == {5, 6}
    for r in rows:
        path = Path(r.file.removeprefix("file://"))
        assert path.name == f"blocks_{r.start_block}_{r.end_block}.parquet" and f"chain_{r.chain_id}/year={1970 + 400 * (r.start_block // 10) // 365}" in r.file
        assert hashlib.sha256(path.read_bytes()).hexdigest() == r.sha256 and path.stat().st_size == r.bytes and r.n_blocks == r.end_block - r.start_block + 1
    assert staged_sink.committed(spark, uri).count() == 66 and staged_sink.orphans(spark, uri).count() == 0
    later = staged_sink.committed(spark, uri, 50)
    assert {r.block_number for r in later.collect()} == set(range(50, 61))
    means = {r.chain_id: r.mean_bytes for r in staged_sink.mean_block_bytes(files).collect()}
    assert means == {5: 2006.0, 6: 206.0}
    feet = {r.path.rpartition("/")[2]: tuple(r)[1:] for r in staged_sink.footers(staged_sink.listed(spark, f"{uri}/data")).collect()}
    assert len(feet) == len({r.file.rpartition("/")[2] for r in rows}) and set(feet.values()) == {(r.chain_id, r.start_block, r.end_block, r.n_blocks, r.bytes) for r in rows}
    assert staged_sink.overlapping(files, 4, 5).where("chain_id = 6").count() >= 1
    staged_sink.write(staged(spark, range(61, 70)), uri)  # another write is added
    assert staged_sink.committed(spark, uri).count() == 75 and len(staged_sink.committed(spark, uri, 65).inputFiles()) == 1
    assert staged_sink.committed(spark, f"file://{tmp_path}/none").count() == 0


def test_sink_rolls_files_by_bytes(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(staged_sink, "GROUP_BYTES", 4000)
    rows = staged(spark, range(1, 41), size=1000).orderBy("block_number").toArrow()
    task = staged_sink.TaskFiles(f"file://{tmp_path}", rows.schema, 3000, False)
    for b in rows.to_batches(max_chunksize=7):
        task.add(b)
    task.end()
    assert len(task.done) > 5 and [f["start_block"] for f in task.done][1:] == [f["end_block"] + 1 for f in task.done][:-1]
    with pytest.raises(StagingError):
        task.add(pa.RecordBatch.from_pylist([{c: None for c in rows.schema.names}], rows.schema))


@pytest.mark.parametrize(("numbers", "gaps", "fails"), [([1, 2, 4], "fail", True), ([1, 2, 4], "allow", False), ([1, 2, 2, 3], "allow", True), ([], "fail", False)])
def test_sink_checks_numbers(spark, tmp_path, numbers, gaps, fails):
    uri = f"file://{tmp_path}/s"
    staged_sink.write(staged(spark, [7], 9), uri)
    if fails:
        with pytest.raises(Exception, match="after"):
            staged_sink.write(staged(spark, numbers), uri, gaps)
        assert staged_sink.committed(spark, uri).count() == 1 and staged_sink.orphans(spark, uri).count() == 0
    else:
        assert staged_sink.write(staged(spark, numbers), uri, gaps).agg(F.sum("n_blocks")).first()[0] == 1 + len(numbers)


def test_killed_tasks_leave_nothing_that_is_read(spark, tmp_path):
    """A task dies in the middle of its rows, on every attempt; others of the same write have ended before."""
    uri = f"file://{tmp_path}/s"
    staged_sink.write(staged(spark, range(1, 4)), uri)

    def dies(batches):
        for b in batches:
            yield b
            if 90 in b.column("block_number").to_pylist():
                os._exit(9)

    spark.dataSource.register(staged_sink.ChainStaged)
    rows = staged(spark, range(50, 91)).repartitionByRange(4, "block_number").sortWithinPartitions("block_number").mapInArrow(dies, STAGED)
    with pytest.raises(Exception):  # noqa: B017
        rows.write.format("chain_staged").option("path", uri).mode("append").save()
    assert {r.block_number for r in staged_sink.committed(spark, uri).collect()} == {1, 2, 3}
    staged_sink.write(staged(spark, range(50, 91)), uri)
    assert staged_sink.committed(spark, uri).count() == 44


def test_pushdown_asks_for_what_is_wanted(spark):
    asked = []

    class Counting(Endpoint):
        def one(self, call):
            if call["method"] == rpc.METHODS["block"] and call["id"] != 1 or call["method"] == rpc.METHODS["block"] and call["params"][0] != "0x0":
                asked.append(int(call["params"][0], 16))
            return {"id": call["id"], "result": {"eth_blockNumber": hex(500), "eth_chainId": "0x5"}.get(call["method"]) or payload(int(call["params"][0], 16) if isinstance(call["params"][0], str) else 0)[{v: k for k, v in rpc.METHODS.items()}[call["method"]]]}

    server = HTTPServer(("127.0.0.1", 0), Counting)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rpc.pushing(spark)
        load = lambda **more: spark.read.format("chain_rpc").options(url=f"http://127.0.0.1:{server.server_port}", start=1, end=400, blocks_per_call=4, **more).load()
        number = F.col("block_number")
        for condition, want in ((number.isin(7, 8, 9, 20, 900), [7, 8, 9, 20]), ((number >= 390) & (number < 400), list(range(390, 400))), ((number > 10) & (number <= 12) & (F.col("chain_id") == 5), [11, 12]), (number == 3, [3]), (F.col("chain_id") == 6, []), ((number == 3) & F.col("error").isNotNull(), [])):
            asked.clear()
            got = sorted(r.block_number for r in load().where(condition).select("block_number").collect())
            assert got == want and sorted(asked) == (want or ([3] if "3" in str(condition) else []))
        asked.clear()
        assert load(blocks_per_task=400, memory_mb=1).agg(F.sum("block_number")).first()[0] == 400 * 401 // 2 and sorted(asked) == list(range(1, 401))
    finally:
        server.shutdown()
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        spark.dataSource.register(rpc.ChainRpc)


def brute_chain(headers):
    by = {}
    for c, n, h, p in headers:
        if n is not None and h is not None:
            by.setdefault((c, h), (n, p))
    up = lambda c, h: (c, by[c, h][1]) if (c, by[c, h][1]) in by and by[c, by[c, h][1]][0] == by[c, h][0] - 1 else None
    on = set()
    for c in {c for c, _ in by}:
        at = (c, min((-n, h) for (d, h), (n, _) in by.items() if d == c)[1])
        while at:
            on.add(at)
            at = up(*at)
    off = {}
    for x in set(by) - on:
        at = up(*x)
        while at and at not in on:
            at = up(*at)
        off[x] = at and at[1]
    return on, off


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forks(spark, seed):
    q = random.Random(seed)
    rows = []
    for n in range(60):
        for k in range(q.choice([0, 1, 1, 1, 2, 3])):
            rows += [(c, n, f"h{n}.{k}", f"h{n - 1}.{q.choice([0, 0, 0, 1, 2])}") for c in (1, 2) if q.random() < 0.95]
    rows += [*rows[:5], (3, 4, "x", "y"), (1, None, "h", "h"), (1, 3, None, None), (4, 7, "self", "self")]
    df = spark.createDataFrame(rows, "chain_id long, block_number long, hash string, parent_hash string").repartition(3)
    on, off = brute_chain(rows)
    chain = forks.canonical(df)
    assert sorted((r.chain_id, r.hash) for r in chain.collect()) == sorted(on)
    found = forks.orphans(df, chain)
    assert {(r.chain_id, r.hash): r.ancestor_hash for r in found.collect()} == off
    assert forks.branches(found).agg(F.sum("n_orphans")).first()[0] == (len(off) or None)
    head = spark.createDataFrame([(1, q.choice(sorted(h for c, h in off if c == 1)))], "chain_id long, hash string")
    assert forks.canonical(df, head).where("chain_id <> 1").count() == 0
    assert forks.canonical(df.limit(0)).count() == 0 and forks.orphans(df.limit(0), chain.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=20))
def test_runs(numbers):
    import numpy as np

    found = ordered.runs(np.array(numbers, np.int64))
    assert [n for a, b in found for n in range(a, b + 1)] == sorted(set(numbers)) and all(y[0] > x[1] + 1 for x, y in zip(found, found[1:]))
    assert ordered.merged([(n, n) for n in numbers]) == found


def test_places_chunks_and_islands(spark):
    q = random.Random(4)
    numbers = q.sample(range(2000), 700)
    df = spark.createDataFrame([(1, n) for n in numbers] + [(2, n) for n in (5, 6, 6, 9)] + [(None, 1), (2, None)], "chain_id long, block_number long").repartition(5)
    one = df.where("chain_id = 1")
    assert {r.block_number: r.position for r in latest.numbered(one, "block_number").collect()} == {n: k for k, n in enumerate(sorted(numbers))}
    sizes = [r["count"] for r in latest.chunked(one, "block_number", 64).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [64] * 10 + [60] and latest.chunked(one, "block_number", 0).select("chunk").distinct().count() == 1
    import numpy as np

    want = [(1, *r) for r in ordered.runs(np.array(numbers))] + [(2, 5, 6), (2, 9, 9)]
    assert sorted(map(tuple, integrity.islands(df).collect())) == want
    assert integrity.islands(df.limit(0)).count() == 0


def test_ordered_release(spark, tmp_path):
    """Files come shuffled, one a batch, with repeats; ranges come out in order, over a restart too."""
    source, check = tmp_path / "in", str(tmp_path / "check")
    parts = [range(10, 15), range(0, 5), range(5, 10), range(3, 12), range(20, 25), range(15, 20)]
    table = staged(spark, range(0, 40))

    def put(k, numbers, chain=5):
        rows = staged(spark, numbers, chain)
        rows.coalesce(1).write.mode("append").parquet(str(source))
        for f in source.glob("part-*.parquet"):
            if f.name.startswith("part-"):
                os.utime(f.rename(source / f"file{k}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))

    seen, gaps = [], []

    def run():
        stream = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = ordered.publish_in_order(
            stream, lambda c, a, b: table.where(F.col("block_number").between(a, b)).withColumn("chain_id", F.lit(c)), lambda rows, c, a, b: seen.append((c, a, b, sorted(r.block_number for r in rows.collect()))), check, report=lambda *x: gaps.append(x), patience=0.0
        )
        query.awaitTermination()
        assert query.exception() is None

    for k, p in enumerate(parts[:4]):
        put(k, p)
    put(8, [0, 2], 6)
    run()
    assert [(a, b) for c, a, b, _ in seen if c == 5] == [(0, 4), (5, 14)] and [(a, b) for c, a, b, _ in seen if c == 6] == [(0, 0)]
    put(10, parts[4])
    run()
    assert seen[-1][2] == 14 or seen[-1][0] == 6
    put(11, parts[5])
    run()
    mine = [n for c, _, _, numbers in seen if c == 5 for n in numbers]
    assert mine == list(range(25))
    assert (5, 0, 9) in gaps or (5, 5, 9) in gaps or (6, 1, 1) in gaps
