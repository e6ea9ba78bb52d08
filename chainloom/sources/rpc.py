"""Raw payloads over JSON-RPC, as a Spark data source: format "chain_rpc", in batch and as a stream.

    spark.dataSource.register(ChainRpc)
    spark.read.format("chain_rpc").option("url", ...).option("start", 1).option("end", 999).load()

Registered by `pushing`, predicates on block_number and chain_id decide what is asked for: a filter on ten numbers makes
calls for ten. A partition is a stretch of `blocks_per_task` numbers
(by default those of one call); the calls of a kind go out as one batch of `blocks_per_call`. With memory_mb the number of
blocks a call follows the bytes that the calls before it returned. Rows are keyed by number,
so their order doesn't matter. An error of a call is the error of its row, an error of a whole batch that of all its
rows; failed numbers are asked again up to `retries` times, then the row says what failed (or the task fails with
fail_on_error). bodies=false asks for headers with hashes of transactions only, and for nothing else; by_hash() then
finds the transactions. As a stream the offset is the next number, `lag` behind the head, at most max_blocks_per_trigger a time.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from chainloom.schemas import RAW
from chainloom.sources.staging import batch_size

ARROW = pa.schema([(name, pa.int64() if kind == "bigint" else pa.string()) for name, kind in (c.split(" ") for c in RAW.split(", "))])
METHODS = {"block": "eth_getBlockByNumber", "receipts": "eth_getBlockReceipts", "logs": "eth_getLogs", "traces": "trace_block"}


def calls(kind: str, numbers: list[int], bodies: bool = True) -> list[dict]:
    """The calls of a kind, one a number, with the number as identifier."""
    params = {"block": lambda h: [h, bodies], "receipts": lambda h: [h], "logs": lambda h: [{"fromBlock": h, "toBlock": h}], "traces": lambda h: [h]}[kind]
    return [{"jsonrpc": "2.0", "id": n, "method": METHODS[kind], "params": params(hex(n))} for n in numbers]


def post(url: str, body: object, timeout: float) -> object:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


@dataclass
class Settings:
    url: str
    chain_id: int
    blocks_per_call: int
    retries: int
    timeout: float
    fail_on_error: bool
    receipts: bool
    traces: bool
    bodies: bool = True
    kinds: tuple[str, ...] = ()
    memory: int = 0

    @classmethod
    def of(cls, options) -> Settings:
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        return cls(options["url"], int(options.get("chain_id", 0)), int(options.get("blocks_per_call", 10)), int(options.get("retries", 3)), float(options.get("timeout", 30)), flag("fail_on_error", "false"), flag("receipts", "true"), flag("traces", "true"), flag("bodies", "true"), memory=int(float(options.get("memory_mb", 0)) * (1 << 20)))

    def one(self, method: str, params: list) -> object:
        reply = post(self.url, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, self.timeout)
        if "error" in reply:
            raise RuntimeError(f"{method}: {reply['error']}")
        return reply["result"]

    def head(self) -> int:
        return int(self.one("eth_blockNumber", []), 16)

    def probed(self) -> Settings:
        """With the chain's id and the kinds that the endpoint serves: blocks always, receipts or else logs, traces if it can."""

        def serves(kind: str) -> bool:
            try:
                self.one(METHODS[kind], calls(kind, [0])[0]["params"])
                return True
            except (RuntimeError, OSError):
                return False

        if not serves("block"):
            raise RuntimeError(f"{METHODS['block']} isn't served")
        self.chain_id = self.chain_id or int(self.one("eth_chainId", []), 16)
        if not self.bodies:
            self.kinds = ("block",)
            return self
        second = "receipts" if self.receipts and serves("receipts") else "logs"
        if second == "logs" and not serves("logs"):
            raise RuntimeError("neither receipts nor logs are served")
        self.kinds = ("block", second, *(["traces"] if self.traces and serves("traces") else []))
        return self

    def fetch(self, numbers: list[int]) -> dict[int, dict[str, object]]:
        """Each number's payloads by kind, or its error."""
        found: dict[int, dict[str, object]] = {n: {} for n in numbers}
        for kind in self.kinds:
            try:
                replies = {r.get("id"): r for r in post(self.url, calls(kind, numbers, self.bodies), self.timeout)}
            except (OSError, ValueError, AttributeError) as e:
                replies = {n: {"error": f"{type(e).__name__}: {e}"} for n in numbers}
            for n in numbers:
                reply = replies.get(n, {"error": "no reply"})
                if "error" in reply or reply.get("result") is None:
                    found[n]["error"] = f"{METHODS[kind]}: {reply.get('error', 'null result')}"
                else:
                    found[n][kind] = reply["result"]
        return found

    def rows(self, numbers: list[int]) -> Iterator[tuple]:
        found = self.fetch(numbers)
        for k in range(1, self.retries + 1):
            if not (failed := [n for n in numbers if "error" in found[n]]):
                break
            time.sleep(0.1 * k)
            found |= self.fetch(failed)
        for n in numbers:
            if self.fail_on_error and "error" in found[n]:
                raise RuntimeError(f"block {n}: {found[n]['error']}")
            text = {k: json.dumps(v, separators=(",", ":")) for k, v in found[n].items() if k != "error"}
            yield self.chain_id, n, text.get("block"), text.get("receipts"), text.get("logs"), text.get("traces"), found[n].get("error")

    def batches(self, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """The rows of low .. high - 1, an Arrow batch a call; with a memory target the next call's size follows what came."""
        size, schema = max(1, self.blocks_per_call), ARROW
        while low < high:
            rows = list(self.rows(list(range(low, min(low + size, high)))))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            low += len(rows)
            if self.memory:
                size = batch_size(self.memory, sum(len(t or "") for row in rows for t in row[2:]) / len(rows), size)


def looked_up(keys: DataFrame, column: str, options: dict[str, str], method: str, params: Callable[[str], list], size: int = 100) -> DataFrame:
    """keys with `result` (JSON text, null if the endpoint has none) and `error`: one call a distinct key, `size` a batch.

    The distinct keys of a DataFrame are asked for by its tasks; failed ones are asked again up to `retries` times.
    """
    settings = Settings.of(options)

    def ask(wanted: list[str]) -> dict[str, tuple[str | None, str | None]]:
        body = [{"jsonrpc": "2.0", "id": i, "method": method, "params": params(k)} for i, k in enumerate(wanted)]
        try:
            replies = {r.get("id"): r for r in post(settings.url, body, settings.timeout)}
        except (OSError, ValueError, AttributeError) as e:
            return dict.fromkeys(wanted, (None, f"{type(e).__name__}: {e}"))
        of = lambda r: (None, f"{method}: {r['error']}") if "error" in r else (None if r.get("result") is None else json.dumps(r["result"], separators=(",", ":")), None)
        return {k: of(replies.get(i, {"error": "no reply"})) for i, k in enumerate(wanted)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted = b.column(0).to_pylist()
            for a in range(0, len(wanted), size):
                part = wanted[a : a + size]
                found = ask(part)
                for k in range(1, settings.retries + 1):
                    if not (failed := [x for x in part if found[x][1]]):
                        break
                    time.sleep(0.1 * k)
                    found |= ask(failed)
                if settings.fail_on_error and (failed := [x for x in part if found[x][1]]):
                    raise RuntimeError(f"{failed[0]}: {found[failed[0]][1]}")
                yield pa.record_batch([pa.array(part, pa.string()), pa.array([found[x][0] for x in part], pa.string()), pa.array([found[x][1] for x in part], pa.string())], names=[column, "result", "error"])

    distinct = keys.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    return distinct.mapInArrow(rows, f"`{column}` string, result string, error string")


def by_hash(hashes: DataFrame, options: dict[str, str], column: str = "hash") -> DataFrame:
    """Transactions by hash: `result` is the payload, without receipt or time of the block."""
    return looked_up(hashes, column, options, "eth_getTransactionByHash", lambda h: [h])


def has_code(addresses: DataFrame, options: dict[str, str], column: str = "address") -> DataFrame:
    """Whether an address is a contract's: column and has_code, null where the endpoint failed."""
    found = looked_up(addresses, column, options, "eth_getCode", lambda a: [a, "latest"])
    bare = F.regexp_replace("result", '"', "")
    return found.select(column, F.when(F.col("error").isNull(), F.coalesce(~bare.isin("0x", ""), F.lit(False))).alias("has_code"))


def filled(headers: DataFrame, options: dict[str, str]) -> DataFrame:
    """Raw rows of headers (bodies=false) with the transactions that are found by hash, in the order of the header's hashes.

    Hashes that the endpoint doesn't know are left out. A block is put together from its own transactions only.
    """
    hashes = headers.where("block is not null").select("chain_id", "block_number", F.posexplode(F.from_json(F.get_json_object("block", "$.transactions"), "array<string>")).alias("pos", "hash"))
    found = by_hash(hashes, options).where("result is not null").select("hash", "result")
    lists = hashes.join(found, "hash").groupBy("chain_id", "block_number").agg(F.array_sort(F.collect_list(F.struct("pos", "result"))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("items", F.array().cast("array<struct<pos:int,result:string>>")), lambda x: x["result"]), ","), F.lit("]"))
    joined = headers.join(lists, ["chain_id", "block_number"], "left")
    own = F.regexp_replace("block", r'"transactions"\s*:\s*\[[^\]]*\]', "\x00")
    return joined.withColumn("block", F.when(F.col("block").isNotNull(), F.replace(own, F.lit("\x00"), F.concat(F.lit('"transactions":'), body)))).drop("items")


@dataclass
class Stretch(InputPartition):
    low: int
    high: int


def stretches(start: int, end: int, size: int) -> list[Stretch]:
    """start .. end - 1 in stretches of size numbers."""
    return [Stretch(a, min(a + size, end)) for a in range(start, end, max(1, size))]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.settings = Settings.of(options).probed()
        self.low, self.high = int(options.get("start", 0)), (int(options["end"]) if "end" in options else self.settings.head()) + 1
        self.per_task = int(options.get("blocks_per_task", self.settings.blocks_per_call))
        self.only: set[int] | None = None

    def partitions(self):
        if self.only is None:
            found = stretches(self.low, self.high, self.per_task)
        else:
            found = []
            for n in sorted(n for n in self.only if self.low <= n < self.high):
                if found and found[-1].high == n and n - found[-1].low < self.per_task:
                    found[-1].high = n + 1
                else:
                    found.append(Stretch(n, n + 1))
        return found or [Stretch(0, 0)]

    def read(self, partition):
        yield from self.settings.batches(partition.low, partition.high)


class PushedReader(Reader):
    """A reader that takes predicates. Spark refuses one where pushing them is off, so it is a class of its own."""

    def pushFilters(self, filters: list[Filter]):
        """Take predicates on the number and the chain; both are whole, so those needn't be evaluated again."""
        for f in filters:
            column, value = f.attribute, getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in (("block_number",), ("chain_id",)):
                continue
            if column == ("chain_id",) and isinstance(f, (EqualTo, In)):
                if self.settings.chain_id not in (value if isinstance(f, In) else [value]):
                    self.only = set()
            elif column == ("block_number",) and isinstance(f, (EqualTo, In)):
                wanted = {v for v in (value if isinstance(f, In) else [value]) if v is not None}
                self.only = wanted if self.only is None else self.only & wanted
            elif column == ("block_number",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif column == ("block_number",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.settings = Settings.of(options).probed()
        self.start, self.lag, self.most = int(options.get("start", 0)), int(options.get("lag", 0)), int(options.get("max_blocks_per_trigger", 200))
        self.at: int | None = None

    def initialOffset(self):
        return {"next": self.start}

    def latestOffset(self):
        at = self.start if self.at is None else self.at
        self.at = max(at, min(at + self.most, self.settings.head() - self.lag + 1))
        return {"next": self.at}

    def partitions(self, start, end):
        self.at = max(self.at or 0, end["next"])  # after a restart the stream goes on from its checkpoint
        return stretches(start["next"], end["next"], self.settings.blocks_per_call)

    def read(self, partition):
        yield from self.settings.rows(list(range(partition.low, partition.high)))

    def commit(self, end):
        pass


class ChainRpc(DataSource):
    @classmethod
    def name(cls):
        return "chain_rpc"

    def schema(self):
        return RAW

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


class PushedRpc(ChainRpc):
    def reader(self, schema):
        return PushedReader(self.options)


def pushing(spark: SparkSession) -> None:
    """Register the source in the form that takes predicates, and let Spark push them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PushedRpc)
