"""The search index, blooms as an index and the kept table of latest versions."""

import random
from pathlib import Path

import pytest
from chainloom.functions.keccak import block_blooms
from chainloom.operators import bloom_index, current
from chainloom.operators.latest import latest
from chainloom.plans import chainview as view
from chainloom.plans import search_index
from chainloom.plans.query_spec import search
from chainloom.queries import _address, _hash, _hex_logs, _hexed
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def scans(df):
    """(files read, rows scanned) of each file scan of a plan that has run, by the scan's own counters."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "FileSourceScanExec":
            metrics = node.metrics()
            found.append((metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value(), node.relation().location().rootPaths().mkString(",")))
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def tables(spark):
    return _hexed(view.blocks(spark, SF), view.transactions(spark, SF), view.logs(spark, SF))


def test_search_index(spark, tables, tmp_path):
    path = f"file://{tmp_path}/index"
    everything = search_index.entries(*tables)
    search_index.add(path, everything, 1)
    columns = ("type", "block_number", "hash")
    texts = ["321", "0321", _hash("104:6"), _hash("click"), _address("s7"), _address("nobody"), "0x12345678", "nothing", "0x", "99999999"]
    for text in texts:
        assert tuples(search_index.find(spark, path, text), *columns) == tuples(search(text, *tables), *columns), text
        assert search_index.find(spark, path, text, 2).count() == 0
    found = search_index.find(spark, path, _hash("104:6"), 1)
    found.collect()
    read = [rows for _, rows, place in scans(found) if place.endswith("/entries")]
    assert len(read) == 1 and 0 < read[0] * 5 <= everything.count()  # of all row groups only those with the key
    assert max(files for files, _, place in scans(found) if place.endswith("/entries")) > 1


def test_search_index_row_groups(spark, tmp_path):
    """Small row groups: a lookup reads one or two of them, an absent key between minima and maxima none or one page."""
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/index"
    rows = spark.range(200_000).select(F.concat(F.lit("0x"), F.sha2(F.col("id").cast("string"), 256)).alias("key"), F.lit(1).cast("bigint").alias("chain_id"), F.lit("transaction").alias("type"), F.col("id").alias("block_number"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    old, search_index.ROW_GROUP_BYTES = search_index.ROW_GROUP_BYTES, 256 << 10
    try:
        search_index.add(path, rows, 1)
    finally:
        search_index.ROW_GROUP_BYTES = old
    groups = sum(pq.ParquetFile(f).num_row_groups for f in Path(tmp_path).rglob("entries/**/*.parquet"))
    key = rows.where("block_number = 777").first().key
    found = search_index.find(spark, path, key)
    assert [r.block_number for r in found.collect()] == [777]
    read = [n for _, n, place in scans(found) if place.endswith("/entries")][0]
    assert groups > 20 and read <= 3 * 200_000 / groups
    absent = search_index.find(spark, path, "0x" + "7" * 64)
    assert absent.collect() == [] and [n for _, n, place in scans(absent) if place.endswith("/entries")] == [0]  # bloom filters


def test_search_index_batches(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    entry = lambda *rows: spark.createDataFrame(list(rows), search_index.ENTRY)
    a, b = "0x" + "a" * 64, "0x" + "b" * 64
    search_index.add(path, entry((a, 1, "transaction", 5, a), (b, 1, "transaction", 6, b), (a, 2, "transaction", 5, a)), 1)
    search_index.add(path, entry((b, 1, "transaction", 5, b)), 2, spark.createDataFrame([(1, 5), (1, 5)], "chain_id long, block_number long"))
    got = lambda text: tuples(search_index.find(spark, path, text), "chain_id", "block_number")
    assert got(a) == [(2, 5)] and got(b) == [(1, 5), (1, 6)]
    entry((a, 9, "transaction", 9, a)).write.parquet(f"{path}/entries/batch=3")  # a batch that died before its mark
    assert got(a) == [(2, 5)]
    search_index.add(path, entry((a, 3, "transaction", 7, a)), 3)
    assert got(a) == [(2, 5), (3, 7)]
    search_index.add(path, entry(), 4)
    assert got(a) == [(2, 5), (3, 7)]
    nulls = spark.createDataFrame([(1, None, None, None, None, "", None)], "chain_id long, block_number long, hash string, from_address string, to_address string, function_selector string, contract_address string")
    none = spark.createDataFrame([], "chain_id long, block_number long, hash string, transaction_hash string, topic_0 string")
    assert search_index.entries(none, nulls, none).count() == 0


def test_bloom_bits_and_probe(spark):
    rows = spark.createDataFrame([(1, n, "0x" + f"{n:040x}", "0x" + f"{n * n:064x}", "", "", "") for n in range(1, 40)], "chain_id long, block_number long, address string, topic_0 string, topic_1 string, topic_2 string, topic_3 string")
    blooms = block_blooms(rows).cache()
    for n in (1, 7, 39):
        hits = {r.block_number for r in blooms.where(bloom_index.may_hold(F.col("logs_bloom"), f"0x{n:040x}", f"0x{n * n:064x}")).collect()}
        assert n in hits and len(hits) < 4
    odd = spark.createDataFrame([("",), (None,), ("0x00",), ("0x" + "0" * 512,)], "b string").select("b", bloom_index.may_hold(F.col("b"), "0xab").alias("m"))
    assert [r.m for r in odd.collect()] == [True, True, True, False]


def test_bloom_index(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/logs"
    logs = _hex_logs(view.logs(spark, SF)).cache()
    blooms = block_blooms(logs)
    # some blocks have no header, some no bloom, some two headers
    headers = blooms.where("block_number % 50 <> 3").withColumn("logs_bloom", F.expr("CASE WHEN block_number % 50 = 4 THEN '' ELSE logs_bloom END"))
    bloom_index.write(logs, headers.union(headers.where("block_number % 50 = 5")), path, span=16)
    key = ("block_number", "log_index")
    users = [r.topic_1 for r in logs.select("topic_1").distinct().orderBy("topic_1").limit(3).collect()]
    address = logs.first().address
    for values in ({"topic_1": users[0]}, {"topic_1": users[1].upper().replace("0X", "0x"), "address": address}, {"address": address}, {"topic_1": "0x" + "9" * 64}, {}):
        want = logs
        for c, v in values.items():
            want = want.where(F.col(c) == v.lower())
        found = bloom_index.events(spark, path, 1, **values)
        assert tuples(found, *key) == tuples(want, *key)
        with monkeypatch.context() as m:
            m.setattr(bloom_index, "MAX_BLOCKS", 0)
            assert tuples(bloom_index.events(spark, path, 1, **values), *key) == tuples(want, *key)
    assert bloom_index.events(spark, path, 2, address=address).count() == 0
    with pytest.raises(ValueError):
        bloom_index.events(spark, path, 1, data="0x")
    rare = spark.createDataFrame([(1, 10_000_000 + n, 0, "d", f"0x{n:040x}", "", "", "", "") for n in range(200)], logs.schema)
    bloom_index.write(rare, block_blooms(rare), f"{path}2", span=4)
    found = bloom_index.events(spark, f"{path}2", 1, address=f"0x{77:040x}")
    assert [r.block_number for r in found.collect()] == [10_000_077]
    files = [n for n, _, place in scans(found) if place.endswith("/logs")]
    assert len(files) == 1 and files[0] <= 3  # of 50 folders


def versions(spark, q, n):
    return spark.createDataFrame([(q.randrange(3), q.choice([None, *range(40)]), q.choice([None, *range(1000)]), q.choice([0, 0, 1, None]), "x" * q.randrange(5)) for _ in range(n)], "chain_id long, block_number long, insert_timestamp long, is_deleted int, text string")


@pytest.mark.parametrize("seed", range(3))
def test_kept_latest_equals_latest(spark, tmp_path, seed):
    q, path = random.Random(seed), f"file://{tmp_path}/kept"
    keys, version = ["chain_id", "block_number"], ["insert_timestamp", "text"]
    seen = None
    for size in (150, 3, 0, 60):
        batch = versions(spark, q, size)
        seen = batch if seen is None else seen.union(batch)
        current.merge(path, batch, keys, version, buckets=8)
        columns = ("chain_id", "block_number", "insert_timestamp", "text")
        order = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert order(current.read(spark, path)) == order(latest(seen, keys, version))


def test_kept_latest_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = lambda *r: spark.createDataFrame(list(r), "chain_id long, block_number long, insert_timestamp long, is_deleted int")
    assert current.merge(path, rows(*[(1, n, 1, 0) for n in range(500)]), ["chain_id", "block_number"], buckets=16) == list(range(16))
    _, before = current.folders(spark, path)
    assert current.merge(path, rows(), ["chain_id", "block_number"]) == []
    touched = current.merge(path, rows((1, 7, 2, 1), (1, 7, 1, 0)), ["chain_id", "block_number"], buckets=99)
    commit, after = current.folders(spark, path)
    assert commit == 2 and len(touched) == 1 and len(after) == 16 and [b for b in after if after[b] != before[b]] == touched
    kept = current.read(spark, path)
    assert kept.count() == 499 and "Exchange" not in kept._jdf.queryExecution().executedPlan().toString() and "Window" not in kept._jdf.queryExecution().executedPlan().toString()
    current.merge(path, rows((1, 7, 1, 0)), ["chain_id", "block_number"])  # older than the tombstone
    assert current.read(spark, path).count() == 499
    current.merge(path, rows((1, 7, 3, 0)), ["chain_id", "block_number"])
    assert current.read(spark, path).count() == 500


def test_kept_latest_after_a_failure(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = lambda *r: spark.createDataFrame(list(r), "chain_id long, block_number long, insert_timestamp long, is_deleted int")
    keys = ["chain_id", "block_number"]
    with pytest.raises(ValueError):
        current.read(spark, path)
    current.merge(path, rows((1, 1, 1, 0)), keys, buckets=2)
    broken = rows((1, 1, 2, 0), (1, 2, 2, 0)).withColumn("block_number", F.expr("CASE WHEN block_number = 2 THEN raise_error('lost') ELSE block_number END").cast("long"))
    with pytest.raises(Exception, match="lost"):
        current.merge(path, broken, keys)
    assert tuples(current.read(spark, path), *keys, "insert_timestamp") == [(1, 1, 1)]
    current.merge(path, rows((1, 1, 2, 0), (1, 2, 2, 0)), keys)
    assert tuples(current.read(spark, path), *keys, "insert_timestamp") == [(1, 1, 2), (1, 2, 2)]
