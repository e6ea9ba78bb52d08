"""Chain operators: published vectors, case tables, plain versions, an endpoint, streams."""

import json
import random
import threading
from functools import reduce
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from chainloom import schemas
from chainloom.functions import abi, hexes, keccak
from chainloom.operators import bloom_index, integrity, latest, normalize, tokens
from chainloom.plans import routes
from chainloom.plans.query_spec import FieldError, QuerySpec, aliases, allowed, answer, envelope, kind_of, parse, validate
from chainloom.sources import rpc, staging
from chainloom.streaming import jobs, publish
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

@pytest.mark.parametrize(
    ("entity", "group_by", "sort_by", "aggregates", "error"),
    [
        ("blocks", ["miner"], "gas_used", [], None), ("logs", ["topic_3", "log_index"], "", [], None), ("traces", [], "subtraces", [], None), ("balances", ["token_type"], "n", ["count(*) as n"], None),
        ("transfers", ["to_address"], "most", ["max(amount) AS most", "min(amount) AS least"], None),
        # fixed values: the texts of errors
        ("receipts", [], "", [], "unknown entity: receipts"), ("traces", ["output", "colour"], "", [], "invalid group_by field 'colour' for entity 'traces'"),
        ("balances", ["owner"], "hash", [], "invalid sort_by field 'hash' for entity 'balances'"), ("blocks", ["miner"], "m", ["count(*) AS n"], "invalid sort_by field 'm' for entity 'blocks'"),
    ],
)
def test_fields(entity, group_by, sort_by, aggregates, error):
    if error is None:
        validate(entity, group_by, sort_by, aggregates)
    else:
        with pytest.raises(FieldError, match=error):
            validate(entity, group_by, sort_by, aggregates)


@pytest.mark.parametrize(
    ("given_", "names"),
    [
        ([], []), (["sum(gas)"], []), (["sum(gas) as  g", "min(nonce) AS n1"], ["g", "n1"]), (["sum(cast(gas AS bigint)) aS total"], ["total"]), (["count(distinct to_address) AS n", "max(gas)"], ["n"]),
    ],
)
def test_aliases(given_, names):
    assert aliases(given_) == names


def test_aggregates_are_checked():
    assert allowed("transactions", "sum(value) as total") == "sum(value) AS `total`"
    for bad in ("sum(secret) AS x", "java_method('a') AS x", "value AS x", "sum(value); drop", "(select 1) AS x"):
        with pytest.raises(FieldError):
            allowed("transactions", bad)


def test_parameters():
    spec = parse({"filter_event_name": ["Transfer", "x"], "group_by": ["address"], "limit": ["0"], "page": ["2"], "force_consistent_data": ["true"]})
    assert spec == QuerySpec(filters={"data": "Transfer"}, group_by=["address"], page=2, limit=5, force_consistent_data=True)
    assert [kind_of(x) for x in ("12", "0x" + "a" * 64, "0x" + "a" * 40, "0xa9059cbb", "zz")] == ["block", "hash", "address", "selector", "none"]


def test_decoding_needs_a_signature(spark):
    logs = spark.createDataFrame([(1, 1, 0, "0xC", "0x1", "0x")], "chain_id long, block_number long, log_index int, address string, topic_0 string, data string")
    for bad in (lambda: answer(logs, "logs", QuerySpec(decode=True)), lambda: routes.events_of(logs, QuerySpec(decode=True)), lambda: routes.events_of(logs, QuerySpec(decode=True), signature="0x1"), lambda: routes.events_of(logs, QuerySpec(), signature="f(uint7 pair)")):
        with pytest.raises(FieldError):
            bad()
    assert routes.events_of(logs, QuerySpec(), "0xc", "0x1").data.count() == 1 and routes.events_of(logs, QuerySpec(), "0xd", "0x1").data.count() == 0


def test_abi_of_dynamic_types(spark):
    word = lambda n: f"{n:064x}"
    text = "größe".encode()
    data = "0x" + word(96) + word(160) + word(7) + word(len(text)) + text.hex().ljust(64, "0") + word(3) + word(1) + word(2) + word(2**64)
    rows = spark.createDataFrame([(1, data), (2, data[:-10]), (3, "0x"), (4, "0x" + word(2**40) + word(2**255) + word(7)), (5, None)], "id int, data string")
    kinds = [("string", "s"), ("uint256[]", "v"), ("uint8", "n")]
    got = {r.id: r.m for r in rows.select("id", abi.values(F.col("data"), kinds, 3).alias("m")).collect()}
    assert got[1] == {"s": "größe", "v": json.dumps(["1", "2", "0x" + word(2**64)], separators=(",", ":")), "n": "7"}
    assert got[2]["v"] is None and got[2]["s"] == "größe" and got[4] == {"s": None, "v": None, "n": "7"}
    assert all(v is None for k in (3, 5) for v in got[k].values())
    raw = spark.createDataFrame([("0x" + word(32) + word(3) + "abcdef".ljust(64, "0"),)], "data string").select(abi.values(F.col("data"), [("bytes", "b")], 3).alias("m")).first().m
    assert raw == {"b": "0xabcdef"}


def test_keccak_vectors():
    assert keccak.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.keccak256(b"\x80").hex() == "56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421"
    assert keccak.event_topic("Transfer(address,address,uint256)") == "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak.call_selector("transfer(address,uint256)") == "0xa9059cbb"


def test_blooms(spark):
    r = random.Random(1)
    hexed = lambda n: "0x" + "".join(r.choice("0123456789abcdef") for _ in range(2 * n))
    rows = [(1, r.randint(1, 4), hexed(20), hexed(32), "", hexed(32) if k % 2 else "", "") for k in range(30)]
    got = keccak.block_blooms(spark.createDataFrame(rows, "chain_id long, block_number long, address string, topic_0 string, topic_1 string, topic_2 string, topic_3 string"))
    want = {}
    for _, number, *values in rows:
        for v in filter(None, values):
            h = keccak.keccak256(bytes.fromhex(v[2:]))
            for k in (0, 2, 4):
                want[number] = want.get(number, 0) | 1 << (int.from_bytes(h[k : k + 2], "big") & 2047)
    assert {x.block_number: x.logs_bloom for x in got.collect()} == {k: f"0x{v:0512x}" for k, v in want.items()}


def test_keccak_of_many():
    r = random.Random(2)
    messages = [r.randbytes(n) for n in [*range(300), 0, 135, 136, 137, 32, 32]]
    assert [bytes(h) for h in keccak.keccak256_all(messages)] == [keccak.keccak256(m) for m in messages]
    assert keccak.keccak256_all([]).shape == (0, 32)


def test_blooms_are_made_in_one_exchange(spark):
    schema = "chain_id long, block_number long, address string, topic_0 string, topic_1 string, topic_2 string, topic_3 string"
    rows = [(1, 1, None, "0x", "0xAb", "0xab", ""), (1, 2, "", "0xabc", "ab", "0xab\n", None), (1, 3, "0xab", "0xzz", "", "", ""), (None, None, "0xab", "", "", "", "")]
    got = keccak.block_blooms(spark.createDataFrame(rows, schema))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # a digit was looked up in a map that was built anew for each of 512 digits of a block
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "transform(" not in plan and "map_from_entries" not in plan
    bits = lambda *values: f"0x{reduce(lambda v, b: v | 1 << b, sum((bloom_index.bits_of(x) for x in values), []), 0):0512x}"
    assert {x.block_number: x.logs_bloom for x in got.collect()} == {1: bits("0x", "0xab"), 3: bits("0xab"), None: bits("0xab")}


def test_hex(spark):
    values = [None, "", "0x0", "0xzz", "0x", hex(2**63 - 1), hex(2**63), hex(2**64 - 1), hex(2**64), hex(2**256 - 1), hex(2**256), "0x000000000000000000001"]
    h = F.col("h")
    got = spark.createDataFrame([(v,) for v in values], "h string").select(hexes.to_u64(h).cast("string"), hexes.to_index(h), hexes.to_u256(h)).collect()
    assert [x[0] for x in got] == ["0", "0", "0", "0", "0", str(2**63 - 1), str(2**63), str(2**64 - 1), str(2**64 - 1), str(2**64 - 1), str(2**64 - 1), "1"]
    assert [x[1] for x in got] == [0, 0, 0, 0, 0, 2**63 - 1, None, None, None, None, None, 1]
    assert [x[2] for x in got] == ["0" * 64, "0" * 64, "0" * 64, None, None, f"{2**63 - 1:064x}", f"{2**63:064x}", f"{2**64 - 1:064x}", f"{2**64:064x}", "f" * 64, None, f"{1:064x}"]


def test_u256_sums(spark):
    r = random.Random(2)
    rows = [(k % 3, f"{r.getrandbits(250):064x}") for k in range(60)] + [(9, "f" * 64), (9, "f" * 64)]
    sums = spark.createDataFrame(rows, "k long, v string").groupBy("k").agg(*[s.alias(f"l{i}") for i, s in enumerate(hexes.sum_u256(F.col("v")))])
    got = {x.k: x.t for x in sums.select("k", hexes.carried([F.col(f"l{i}") for i in range(8)]).alias("t")).collect()}
    assert got == {k: f"{sum(int(v, 16) for j, v in rows if j == k):064x}" for k in range(3)} | {9: None}


def test_abi(spark):
    assert hexes.parameters("Transfer(address indexed from, address indexed, uint value)") == ("Transfer(address,address,uint256)", [("address", "from", True), ("address", "arg1", True), ("uint256", "value", False)])
    data = "0x" + "0" * 24 + "ab" * 20 + f"{77:064x}" + f"{1:064x}"
    words = spark.createDataFrame([(data,)], "d string").select(*[hexes.abi_static(hexes.abi_word(F.col("d"), i), k) for i, k in enumerate(["address", "uint256", "bool", "uint8"])]).first()
    assert tuple(words) == ("0x" + "ab" * 20, "77", "true", None)


VERSIONS = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 5), st.booleans(), st.integers(0, 3)), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None)
@given(VERSIONS)
def test_latest(spark, rows):
    schema = "k long, insert_timestamp long, is_deleted boolean, v long"
    got = latest.latest(spark.createDataFrame(rows, schema).dropDuplicates(["k", "insert_timestamp", "is_deleted"]), ["k"])
    again = latest.latest(got, ["k"])
    want = {k for k in {x[0] for x in rows} if not min((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))[2]}
    assert {x.k for x in got.collect()} == want == {x.k for x in again.collect()}


def brute_breaks(headers, start, end):
    """The scan over a dense array, pair by pair."""
    first = stop = None
    for n in range(start + 1, end + 1):
        if n in headers and n - 1 in headers:
            fits = headers[n][1] == headers[n - 1][0]
            if first is None and not fits:
                first = n - 1
            elif first is not None and fits:
                stop = n
                break
    return None if first is None else (first, max(headers) if stop is None else stop)


def test_breaks(spark):
    r = random.Random(3)
    rows, want = [], {}
    for chain in range(60):
        headers = {n: (f"h{n}", f"h{n - 1}" if r.random() < 0.8 else "other") for n in range(100, 115) if r.random() < 0.85}
        rows += [(chain, n, h, p) for n, (h, p) in headers.items()]
        if found := brute_breaks(headers, 100, 114):
            want[chain] = found
    got = integrity.breaks(spark.createDataFrame(rows, "chain_id long, block_number long, hash string, parent_hash string"))
    assert {x.chain_id: (x.hash_start, x.hash_end) for x in got.collect()} == want


@pytest.mark.parametrize(("last", "top", "want"), [(0, 700, (1, 101)), (0, 600, None), (500, 2000, (499, 599)), (500, 1098, None), (500, 1099, (499, 599))])
def test_window(last, top, want):
    assert jobs.reorg_window(last, top) == want


def payload(number):
    tx = {"hash": f"0xt{number}", "blockNumber": hex(number), "transactionIndex": "0x0", "from": "0xA", "to": None, "value": hex(2**255), "input": "0xa9059cbb00", "type": "0x2", "accessList": [{"storageKeys": ["0x1"], "address": "0x2"}]}
    bare = {"hash": f"0xu{number}", "blockNumber": hex(number), "transactionIndex": "0x1", "input": "0x1234567"}
    log = {"transactionHash": tx["hash"], "transactionIndex": "0x0", "logIndex": "0x0", "address": "0xC", "data": "0x", "topics": ["0x1", "0x2"]}
    return {
        "block": {"number": hex(number), "hash": f"0xh{number}", "parentHash": f"0xh{number - 1}", "timestamp": "0x5f5e100", "logsBloom": "0x01", "transactions": [tx, bare]},
        "receipts": [{"transactionHash": tx["hash"], "gasUsed": "0x5208", "contractAddress": None, "logs": [log]}],
        "traces": [{"action": {"callType": "call", "from": "0xA", "gas": "0x10"}, "result": {"gasUsed": "0x1"}, "transactionHash": tx["hash"], "transactionPosition": 0, "subtraces": 0, "traceAddress": [], "type": "call"}],
    }


def test_normalize(spark):
    rows = [(1, 5, *(json.dumps(payload(5)[k]) for k in ("block", "receipts")), None, json.dumps(payload(5)["traces"]), None), (1, 6, None, None, None, None, "lost"), (1, 7, '{"hash": "0x1"}', "[]", None, None, None)]
    raw = spark.createDataFrame(rows, schemas.RAW)
    b = normalize.blocks(raw).collect()
    assert [(x.block_number, x.transaction_count, x.miner, x.difficulty) for x in b] == [(5, 2, "", "0" * 64)]
    t, u = normalize.transactions(raw).orderBy("transaction_index").collect()
    assert (t.value, t.to_address, t.function_selector, int(t.gas_used), int(t.status), t.contract_address) == ("8" + "0" * 63, "", "0xa9059cbb", 21000, 0, None)
    assert (u.gas_used, u.status, u.function_selector, u.access_list) == (None, None, "", None) and t.access_list == '[{"address":"0x2","storageKeys":["0x1"]}]'
    (log,), (trace,) = normalize.logs(raw).collect(), normalize.traces(raw).collect()
    assert (log.topic_1, log.topic_2, log.block_hash) == ("0x2", "", "0xh5") and (trace.call_type, int(trace.gas), trace.trace_address) == ("call", 16, [])
    assert {x.block_number for x in normalize.malformed(raw).collect()} == {6, 7}
    for name, make in normalize.TABLES.items():
        assert make(raw).columns == schemas.default_columns(name)


def test_what_is_no_text_is_empty(spark):
    tx = {"hash": "0xt", "blockNumber": "0x5", "transactionIndex": "0x0", "from": 7, "to": {"a": 1}, "value": 12, "input": True, "accessList": [{"storageKeys": ["0x1"], "extra": {"b": 2, "a": "x:1,"}, "address": "0x2"}]}
    block = {"number": "0x5", "hash": "0xh", "miner": -3.5e2, "extraData": 'say "n":5, or {"n":6}', "transactions": [tx]}
    raw = spark.createDataFrame([(1, 5, json.dumps(block), "[]", None, None, None)], schemas.RAW)
    b, t = normalize.blocks(raw).first(), normalize.transactions(raw).first()
    assert (b.miner, b.extra_data, b.block_number) == ("", 'say "n":5, or {"n":6}', 5)
    assert (t.from_address, t.to_address, t.value, t.data, t.hash) == ("", "", "0" * 64, "", "0xt")
    assert t.access_list == '[{"address":"0x2","extra":{"a":"x:1,","b":""},"storageKeys":["0x1"]}]'


def test_transfers(spark):
    pad = lambda a: "0x" + "0" * 24 + a * 40
    word = lambda n: f"{n:064x}"
    plain, single, batch = (keccak.event_topic(s) for s in ("Transfer(address,address,uint256)", "TransferSingle(address,address,address,uint256,uint256)", "TransferBatch(address,address,address,uint256[],uint256[])"))
    rows = [
        ("0xT", plain, pad("a"), pad("b"), "", "0x" + word(2**200)), ("0xN", plain, pad("a"), pad("b"), "0x" + word(7), "0x"), ("0xM", single, pad("c"), pad("a"), pad("b"), "0x" + word(3) + word(40)),
        ("0xM", batch, pad("c"), pad("b"), pad("a"), "0x" + word(64) + word(160) + word(2) + word(3) + word(4) + word(2) + word(10) + word(6)), ("0xX", "0x1", "", "", "", "0x"),
    ]
    logs = spark.createDataFrame([(1, k, a, *ts, d, "0xh", k) for k, (a, *ts, d) in enumerate(rows)], "chain_id long, block_number long, address string, topic_0 string, topic_1 string, topic_2 string, topic_3 string, data string, transaction_hash string, log_index long").withColumn("block_timestamp", F.lit(None).cast("timestamp"))
    got = tokens.transfers(logs)
    a, b = "0x" + "a" * 40, "0x" + "b" * 40
    found = {(x.token_type, x.from_address, x.to_address, int(x.token_id, 16), int(x.amount, 16)) for x in got.collect()}
    assert found == {("erc20", a, b, 0, 2**200), ("erc721", a, b, 7, 1), ("erc1155", a, b, 3, 40), ("erc1155", b, a, 3, 10), ("erc1155", b, a, 4, 6)}
    held = {(x.owner, x.token_type, int(x.token_id, 16)): x.balance for x in tokens.balances(got).collect()}
    assert int(held[b, "erc1155", 3], 16) == 30 and held[a, "erc1155", 3] is None and int(held[b, "erc20", 0], 16) == 2**200


class Endpoint(BaseHTTPRequestHandler):
    failed: set = set()

    def one(self, call):
        method, params = call["method"], call["params"]
        kind = {v: k for k, v in rpc.METHODS.items()}.get(method)
        number = int(params[0], 16) if kind and isinstance(params[0], str) else 0
        if number == 8 and kind == "receipts" and number not in self.failed:
            self.failed.add(number)
            return {"id": call["id"], "error": {"code": -1, "message": "busy"}}
        if number == 9 and kind == "block":
            return {"id": call["id"], "error": {"code": -2, "message": "lost"}}
        if method == "eth_getTransactionByHash":
            found = {t["hash"]: t for n in range(13) for t in payload(n)["block"]["transactions"]}
            return {"id": call["id"], "result": found.get(params[0])}
        if method == "eth_getCode":
            return {"id": call["id"], "result": "0x60" if params[0] == "0xC" else "0x"}
        if kind == "block" and params[1] is False:
            block = payload(number)["block"]
            return {"id": call["id"], "result": block | {"transactions": [t["hash"] for t in block["transactions"]] + ["0xunknown"]}}
        return {"id": call["id"], "result": {"eth_blockNumber": hex(12), "eth_chainId": "0x5"}.get(method) or payload(number)[kind]}

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        out = json.dumps([self.one(c) for c in body] if isinstance(body, list) else self.one(body)).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rpc(spark, endpoint):
    spark.dataSource.register(rpc.ChainRpc)
    raw = spark.read.format("chain_rpc").options(url=endpoint, start=3, end=10, blocks_per_call=3, retries=1).load().collect()
    assert sorted((x.block_number, x.error is None, x.chain_id) for x in raw) == [(n, n != 9, 5) for n in range(3, 11)]
    assert all(x.receipts and x.traces and x.logs is None for x in raw if x.block_number != 9)


def test_headers_and_lookups(spark, endpoint):
    spark.dataSource.register(rpc.ChainRpc)
    headers = spark.read.format("chain_rpc").options(url=endpoint, start=1, end=4, bodies="false").load()
    assert all(x.receipts is None and x.logs is None and json.loads(x.block)["transactions"][0].startswith("0xt") for x in headers.collect())
    whole = normalize.transactions(rpc.filled(headers, {"url": endpoint}))
    assert sorted((x.block_number, x.transaction_index, x.hash) for x in whole.collect()) == sorted((n, i, f"0x{k}{n}") for n in range(1, 5) for i, k in enumerate("tu"))
    found = {x.hash: x.result for x in rpc.by_hash(spark.createDataFrame([("0xt3",), ("0xt3",), ("0xno",), (None,)], "hash string"), {"url": endpoint}).collect()}
    assert json.loads(found["0xt3"])["value"] == hex(2**255) and found["0xno"] is None and len(found) == 2
    code = {x.address: x.has_code for x in rpc.has_code(spark.createDataFrame([("0xC",), ("0xA",)], "address string"), {"url": endpoint}).collect()}
    assert code == {"0xC": True, "0xA": False}
    lost = rpc.by_hash(spark.createDataFrame([("0xt3",)], "hash string"), {"url": "http://127.0.0.1:1", "retries": "0"}).first()
    assert lost.result is None and "Error" in lost.error


def test_rpc_stream(spark, endpoint, tmp_path):
    seen = []
    query = jobs.poll(spark, {"url": endpoint, "start": "1", "lag": "5", "max_blocks_per_trigger": "4"}, lambda df, k: seen.append(sorted(x.block_number for x in df.collect())), str(tmp_path / "c"))
    try:
        for _ in range(120):
            if sum(map(len, seen)) >= 7:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert [n for s in seen for n in s] == list(range(1, 8)) and max(map(len, seen)) <= 4


def test_staging_and_stream(spark, tmp_path):
    from chainloom.operators.blocks import assembled
    from chainloom.streaming.publish import materialised, opened

    rows = [(5, n, *(json.dumps(payload(n)[k]) for k in ("block", "receipts")), None, json.dumps(payload(n)["traces"]), None) for n in range(1, 21)]
    raw = spark.createDataFrame(rows, schemas.RAW)
    nested = assembled(normalize.blocks(raw), **{k: normalize.TABLES[k](raw) for k in ("transactions", "logs", "traces")})
    files = staging.write(staging.encoded(nested), str(tmp_path / "staged"), rows_per_file=8)
    assert files.agg(F.sum("n_blocks")).first()[0] == 20 and staging.checksums(spark, str(tmp_path / "staged")).count() == files.count()
    assert staging.scan(spark, str(tmp_path / "staged"), 15).count() == 6
    back = staging.decoded(staging.scan(spark, str(tmp_path / "staged")))
    assert back.select(F.explode("transactions")).count() == 40
    cursors = jobs.Cursors(spark, str(tmp_path / "cursors"))
    cursors.set(5, "start", 4)
    jobs.publish_files(spark, str(tmp_path / "staged"), str(tmp_path / "sink"), str(tmp_path / "check"), cursors, 5, files_per_trigger=100).awaitTermination()
    records = spark.read.parquet(str(tmp_path / "sink"))
    assert [h.key for h in records.first().headers] == ["chain_id", "block_number", "is_reorg", "is_deleted", "type", "timestamp", "schema_version", "content-type"]
    assert {x.key.decode() for x in records.collect()} == {f"5:block_data:{n}" for n in range(4, 21)}
    tables = materialised(opened(records, back.schema), "transactions")
    assert tables.count() == 34 and cursors.get(5, "published_0") == 21 and cursors.get(5, "none") == 0
    assert jobs.next_block(materialised(opened(records, back.schema), "blocks"), 5, 7) == 21
    with pytest.raises(jobs.OrderError):
        jobs.checked(back.where("block_number <> 9"), 1)
    valid = integrity.validated(normalize.blocks(raw), normalize.transactions(raw), normalize.logs(raw))
    assert valid.where("valid").count() == 20 and integrity.contiguous(normalize.blocks(raw)).first().contiguous


def test_repair_and_reorganisation(spark, tmp_path):
    """Blocks 3 and 7 are wrong in the store: one has another hash, one lacks its transactions."""
    from chainloom.operators.blocks import assembled

    rows = [(5, n, *(json.dumps(payload(n)[k]) for k in ("block", "receipts")), None, json.dumps(payload(n)["traces"]), None) for n in range(1, 21)]
    raw = spark.createDataFrame(rows, schemas.RAW)
    right = {k: make(raw) for k, make in normalize.TABLES.items()}
    bad = F.col("block_number")
    kept = {k: right[k].where(bad != 7) for k in ("transactions", "logs", "traces")}
    tables = kept | {"blocks": right["blocks"].withColumn("hash", F.when(bad == 3, "0xother").otherwise(F.col("hash")))}
    asked = []

    def fetch(start, end):
        asked.append((start, end))
        part = {k: integrity.in_range(df, start, end) for k, df in right.items()}
        return assembled(part.pop("blocks"), **part)

    cursors = jobs.Cursors(spark, str(tmp_path / "cursors"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    run = lambda store: jobs.reorganise(store, cursors, 5, fetch, str(tmp_path / "reorg"), at, lag=2, size=10, now="1970-01-02 00:00:00")
    assert run(tables) == (3, 7) and asked == [(3, 7)] and cursors.get(5, "last_valid") == 7
    records = spark.read.parquet(str(tmp_path / "reorg"))
    opened_ = [publish.opened(records, fetch(3, 7).schema)]
    latest_ = latest.latest(publish.materialised(opened_[0], "transactions"), ["chain_id", "block_number", "hash"])
    assert sorted((x.block_number, x.hash) for x in latest_.collect()) == sorted((n, f"0x{k}{n}") for n in range(3, 8) for k in "tu")
    assert {x.hash for x in latest.latest(publish.materialised(opened_[0], "blocks"), ["chain_id", "block_number"]).collect()} == {f"0xh{n}" for n in range(3, 8)}
    assert run(right) is None and cursors.get(5, "last_valid") == 16
    by_number = lambda numbers: fetch(min(numbers), max(numbers)).where(F.col("block_number").isin(numbers))
    assert jobs.repair(tables, cursors, 5, [9, 4, 4, 12], by_number, str(tmp_path / "repair"), at, size=2) == 2 and cursors.get(5, "repaired") == 12
    assert spark.read.parquet(str(tmp_path / "repair")).count() == 6
    assert jobs.repair(tables, cursors, 5, [9, 12], by_number, str(tmp_path / "repair"), at) == 0
    assert jobs.repair(tables, cursors, 5, [9], by_number, str(tmp_path / "again"), at, skip_check=True) == 1 and cursors.get(5, "repaired") == 12
    with pytest.raises(jobs.OrderError):
        jobs.repair(tables, cursors, 5, [19, 40], by_number, str(tmp_path / "lost"), at)
    assert not (tmp_path / "lost").exists() and cursors.get(5, "repaired") == 12
    nested = fetch(1, 20)
    few = publish.wanted(nested, senders=["0xa"], addresses=["0xC"], topics=["0x9"])
    assert few.agg(F.sum(F.size("transactions")), F.sum(F.size("logs"))).first()[:] == (20, 0)
    watched, seen = publish.measured(nested, "written")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"blocks": 20, "transactions": 40, "logs": 20, "first_block": 1, "last_block": 20}
    strict = integrity.validated(right["blocks"], right["transactions"], right["logs"], "strict")
    assert strict.where("valid").count() == 0  # the payload's blooms aren't those of its logs


@pytest.mark.parametrize(("memory", "mean", "now", "want"), [(32 << 20, 32 << 10, 100, 999), (32 << 20, 1 << 20, 30, 30), (32 << 20, 1 << 20, 100, 32), (1, 1 << 20, 50, 10), (1, 0, 50, 50)])
def test_batch_size(memory, mean, now, want):
    assert staging.batch_size(memory, mean, now) == want


def test_answer(spark):
    rows = spark.createDataFrame([(1, k, "a" if k % 2 else "b", k, bool(k == 3)) for k in range(10)], "chain_id long, block_number long, address string, insert_timestamp long, is_deleted boolean").withColumns({"transaction_hash": F.lit("t"), "log_index": F.lit(0)})
    got = answer(rows, "logs", QuerySpec(filters={"address": "a"}, sort_by="block_number", sort_order="desc", limit=2, page=1, force_consistent_data=True))
    assert [x.block_number for x in got.data.collect()] == [5, 1] and tuple(got.meta.first()) == (4, 2)
    page = envelope(got, QuerySpec(page=1, limit=2), 1)
    assert page["meta"] == {"chain_id": 1, "page": 1, "limit": 2, "total_items": 4, "total_pages": 2} and [x["block_number"] for x in page["data"]] == [5, 1]
    assert {x.block_number for x in jobs.requested(spark, [5, 3, 3, 9], 4).collect()} == {5, 9}


def test_answers_on_256_bits(spark):
    """Sums, means, comparisons and filters on the library's own columns of 64 hex digits."""
    values = [(1, "a", 5), (2, "a", 2**255), (3, "b", 7), (4, "b", 0), (5, "c", 2**256 - 1), (6, "c", 1)]
    df = spark.createDataFrame([(1, n, 0, f"0x{n}", who, f"{v:064x}", f"{10 * v % 2**256:064x}") for n, who, v in values] + [(1, 7, 0, "0x7", "b", None, None)], "chain_id long, block_number long, transaction_index long, hash string, from_address string, value string, gas_price string")
    spec = QuerySpec(group_by=["from_address"], sort_by="total", sort_order="desc", limit=0, aggregates=["SUM(value) AS total", "avg(value) as mean", "MIN(value) AS least", "max(value) AS most", "sum(CASE WHEN value >= 7 AND 0 < gas_price THEN 1 ELSE 0 END) AS n", "COUNT(DISTINCT value) AS k", "COUNT(*) AS rows"])
    got = {r.from_address: tuple(r)[1:] for r in answer(df, "transactions", spec).aggregations.collect()}
    assert got["a"] == (str(2**255 + 5), (2**255 + 5) / 2, "5", str(2**255), 0, 2, 2) and got["b"] == ("7", 3.5, "0", "7", 1, 2, 3)
    assert got["c"][0] is None and got["c"][2:4] == ("1", str(2**256 - 1))  # beyond 256 bits
    for value, n in (("5", 1), (hex(2**255), 2), ("0x5", 1), (f"{7:064x}", 3), ("-1", None), ("x", None), (str(2**256), None)):
        found = [r.block_number for r in answer(df, "transactions", QuerySpec(filters={"value": value})).data.collect()]
        assert found == ([n] if n else [])
    for bad in ("sum(value * 2) AS x", "sum(CASE WHEN value > 1 THEN value ELSE 0 END) AS x"):
        with pytest.raises(FieldError, match="256-bit"):
            answer(df, "transactions", QuerySpec(aggregates=[bad]))
    page = answer(df, "transactions", QuerySpec(limit=0))
    assert page.data.count() == 5 and tuple(page.meta.first()) == (7, 2) and envelope(page, QuerySpec(limit=0), 1)["meta"]["limit"] == 5


def test_decimal_digits(spark):
    r = random.Random(9)
    numbers = [0, 1, 10**9 - 1, 10**9, 2**32, 2**64, 10**77, 2**256 - 1, *[r.getrandbits(r.choice([8, 60, 100, 200, 256])) for _ in range(40)]]
    got = spark.createDataFrame([(f"{n:064x}",) for n in numbers] + [(None,)], "x string").select(hexes.decimal_text(F.col("x"))).collect()
    assert [x[0] for x in got] == [*map(str, numbers), None]
    small = [0, 7, 2**32, 2**64 - 1, 10**37 + 3]
    digits = spark.createDataFrame([(str(n),) for n in small], "x string").select(hexes.u256_of_decimal(F.col("x").cast("decimal(38,0)"))).collect()
    assert [x[0] for x in digits] == [f"{n:064x}" for n in small]
    assert hexes.of_literal("0x10") == f"{16:064x}" and hexes.of_literal("1e3") is None


def test_balances_below_zero_stay(spark):
    rows = [("erc20", 1, "0xT", "0xa", "0xb", f"{5:064x}", f"{0:064x}"), ("erc20", 1, "0xT", "0xb", "0xc", f"{5:064x}", f"{0:064x}")]
    moved = spark.createDataFrame(rows, "token_type string, chain_id long, token_address string, from_address string, to_address string, amount string, token_id string")
    assert {r.owner: r.balance and int(r.balance, 16) for r in tokens.balances(moved, hide_zero=True).collect()} == {"0xa": None, "0xc": 5}


def test_bare_values_in_traces(spark):
    """Numbers and truth values where a text belongs are no texts; counts and positions stay numbers."""
    block = {"number": "0x5", "hash": "0xb5", "timestamp": "0x10"}
    rows = [{"action": {"callType": 7, "from": True, "to": "0xB", "gas": "0x10", "value": 3}, "result": {"gasUsed": "0x1", "output": -1.5e3}, "transactionHash": 3, "transactionPosition": 4, "subtraces": 2, "traceAddress": [0, 12], "type": "call", "error": False}]
    raw = spark.createDataFrame([(1, 5, json.dumps(block), None, None, json.dumps(rows), None), (1, 6, json.dumps(block | {"number": "0x6"}), None, None, None, None)], schemas.RAW)
    (x,) = normalize.traces(raw).collect()
    assert (x.call_type, x.from_address, x.to_address, x.output, x.transaction_hash, x.error, x.type) == ("", "", "0xB", "", "", "", "call")
    assert (x.transaction_index, x.subtraces, x.trace_address, x.gas, x.gas_used) == (4, 2, [0, 12], 16, 1)
    assert int(x.value, 16) == 0
