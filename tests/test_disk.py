"""What queries leave on disk, and how wide the rows are that they shuffle."""

import re
import time
from pathlib import Path

import pytest
from chainloom import queries
from chainloom.operators import blocks as nesting
from chainloom.operators import current, forks, latest
from chainloom.plans import chainview as view
from chainloom.plans import search_index
from chainloom.scratch import shared_dir, written
from chainloom.sources import staged_sink, staging
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return set(re.findall(r"shuffle_\d+_\d+_0\.data", found))


def scratch_bytes(spark):
    base = Path(shared_dir(spark).removeprefix("file:")).parent
    return sum(f.stat().st_size for f in base.glob("chainloom-*/part-*.parquet"))


def test_shuffles_of_written_tables_are_freed(spark):
    before, mode = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    table = written(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).count())
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 7_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == mode


def test_merge_gives_its_batch_back(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text"), F.lit(0).alias("is_deleted"), F.lit(1).alias("insert_timestamp"))
    before = scratch_bytes(spark)
    current.merge(f"file://{tmp_path}/t", rows, ["id"], buckets=4)
    assert scratch_bytes(spark) - before < 20_000  # 32 bytes a row before
    assert current.read(spark, f"file://{tmp_path}/t").count() == 20_000


def test_versions_are_kept_as_line_items(spark):
    rows = view.line_items(spark, SF)
    assert all(c.startswith("l_") or c == "is_deleted" for c in rows.columns)
    # hashes and addresses are made of the version that was chosen, above the exchange
    plan = view.transactions(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("md5(") < plan.index("Window")
    assert "md5(" not in plan[plan.index("Window") :]
    stored = spark.read.parquet(queries.current_tx(spark, SF).inputFiles()[0])
    assert "l_suppkey" in stored.columns and "hash" not in stored.columns


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_dealt_is_assembled_by_ranges_in_one_exchange(spark):
    blocks = spark.createDataFrame([(1, n, f"h{n}") for n in (1, 2, 3, 3, 9)] + [(2, 1, "x"), (None, 1, "y"), (1, None, "z")], "chain_id long, block_number long, hash string")
    txs = spark.createDataFrame([(1, 3, 2, "b"), (1, 3, 1, "a"), (1, 2, 5, None), (1, 7, 1, "lost"), (2, 1, 1, "c"), (1, None, 1, "lost"), (None, 1, 1, "lost")], "chain_id long, block_number long, transaction_index long, hash string")
    got = nesting.dealt(blocks, transactions=txs)
    assert exchanges(got) == 1
    plain = lambda rows: sorted((str(r.chain_id), str(r.block_number), r.block.hash, [(t.transaction_index, t.hash) for t in r.transactions]) for r in rows)
    assert plain(got.collect()) == plain(nesting.assembled(blocks, transactions=txs).collect())
    numbers = [(r.chain_id or 0, r.block_number or 0) for r in got.collect()]
    assert numbers == sorted(numbers)


def test_nested_is_assembled_of_the_views(spark):
    want = nesting.assembled(view.blocks(spark, SF), transactions=view.transactions(spark, SF), logs=view.logs(spark, SF))
    got = view.nested(spark, SF)
    assert exchanges(got) == 1 and exchanges(want) > 3
    cols = lambda df, at: [f.name for f in (df.schema[at].dataType.elementType if at != "block" else df.schema[at].dataType).fields]
    for at in ("block", "transactions", "logs"):
        assert sorted(cols(got, at)) == sorted(cols(want, at))
    same = lambda df: df.select("block_number", "block.*", *[F.to_json(F.transform(k, lambda x: F.struct(*[x[c] for c in sorted(cols(got, k))]))).alias(f"{k}_json") for k in ("transactions", "logs")]).drop("chain_id")  # noqa: E731, B023
    assert sorted(map(str, same(got).collect())) == sorted(map(str, same(want).collect()))


def test_latest_in(spark):
    rows = spark.createDataFrame([([(1, 1, "a", False), (1, 2, "b", None), (2, 1, "c", True), (None, 1, "d", False), (None, 2, "e", False), (3, 5, "f", False), (3, 6, "g", True)],), ([],), (None,)], "v array<struct<k:int, at:int, x:string, is_deleted:boolean>>")
    found = [r.f for r in rows.select(F.sort_array("v").alias("v")).select(F.expr("v").alias("v")).withColumn("f", latest.latest_in("v", "k")).collect()]
    assert [None if f is None else [x.x for x in f] for f in found] == [["e", "b"], [], None]


def test_dealt_rows_are_staged_without_another_exchange(spark, tmp_path):
    nested = view.nested(spark, SF)
    files = staged_sink.write(staging.encoded(nested), f"file://{tmp_path}/a", gaps="allow", dealt=True)
    back = staged_sink.committed(spark, f"file://{tmp_path}/a")
    assert back.count() == nested.count() == files.agg(F.sum("n_blocks")).first()[0]
    mixed = staging.encoded(nested).repartition(3, "block_hash")
    with pytest.raises(Exception, match="after"):
        staged_sink.write(mixed, f"file://{tmp_path}/b", gaps="allow", dealt=True)
    assert staged_sink.manifest(spark, f"file://{tmp_path}/b").count() == 0


def test_round_trips_shuffle_no_texts(spark, monkeypatch):
    wide = []
    monkeypatch.setattr(nesting, "assembled", lambda *a, **k: wide.append(a))
    assert queries.staging_roundtrip(spark, SF).count() and queries.message_roundtrip(spark, SF).count() and not wide


def test_entries_scan_transactions_once_and_in_slices(spark, tmp_path, monkeypatch):
    tables = queries._hexed(view.blocks(spark, SF), view.transactions(spark, SF), view.logs(spark, SF))
    found = search_index.entries(*tables)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    both = spark.createDataFrame([(1, 5, "0xh", "0xa", "0xa", "", None), (1, 6, "0xi", None, "0xA", "0x", "0xB"), (1, 7, "0xj", "0xb", None, "0x1", "q")], "chain_id long, block_number long, hash string, from_address string, to_address string, function_selector string, contract_address string")
    none = spark.createDataFrame([], "chain_id long, block_number long, hash string, transaction_hash string, topic_0 string")
    own = search_index.entries(none, both, none)
    assert sorted((r.key, r.hash) for r in own.where("type = 'address'").collect()) == [("0xA", "0xi"), ("0xa", "0xh"), ("0xb", "0xj")]
    written_rows = {}
    for n in (1, 4, 16):
        search_index.add(f"file://{tmp_path}/{n}", found.unionByName(own), 1, slices=n)
        search_index.add(f"file://{tmp_path}/{n}", found.unionByName(own), 1, slices=n)  # a batch that is written again
        written_rows[n] = sorted(map(tuple, spark.read.schema(search_index.ENTRY).parquet(f"file://{tmp_path}/{n}/entries/batch=1").collect()))
    assert written_rows[1] == written_rows[4] == written_rows[16] == sorted(map(tuple, found.unionByName(own).collect()))
    sliced = []
    monkeypatch.setattr(search_index, "add", lambda *a, slices=1, **k: sliced.append(slices))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        queries.search_indexed(spark, SF).count()
    assert sliced == [4]


def test_rounds_of_forks_hold_ids_and_give_their_tables_back(spark, monkeypatch):
    made = []
    monkeypatch.setattr(forks, "written", lambda df: made.append(written(df)) or made[-1])
    headers = view.headers(spark, SF)
    chain = forks.canonical(headers)
    found = forks.orphans(headers, chain)
    assert len(made) > 10 and not any({"up", "hash"} <= {*t.columns} for t in made)
    held = {t._chainloom_path: spark.read.parquet(t._chainloom_path).count() for t in made}
    assert {p for p, n in held.items() if n} == {chain._chainloom_path, found._chainloom_path}
    assert held[chain._chainloom_path] + held[found._chainloom_path] == headers.select("chain_id", "hash").distinct().count()
    forest = forks.linked(headers)
    n = [t.count() for t in forest]
    shared = forks.canonical(headers, forest=forest)
    assert sorted(map(tuple, forks.orphans(headers, shared, forest).collect())) == sorted(map(tuple, found.collect()))
    assert [t.count() for t in forest] == n and all(n)
