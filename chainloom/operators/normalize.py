"""Raw payloads to the four tables.

A raw row holds all payloads of one block, so a transaction meets its receipt within the row: nothing is shuffled.
Missing text and what is no text is "", missing numbers are 0; without a receipt its columns are null, with one its missing numbers are 0.
Raw rows with an error or without a block give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom import schemas
from chainloom.functions.hexes import digits, selector, to_index, to_u64, to_u256, topic

#: A number or truth value of a key. Texts hold no bare quotes, so it can't stand inside one.
BARE = r'("%s[A-Za-z0-9]+"\s*:\s*)(?:-?[0-9][-+.0-9eE]*|true|false)(?=\s*[,}])'
#: Keys of a trace that have bare numbers.
TRACE_NUMBERS = "transactionPosition|subtraces|blockNumber"


def text(c: Column) -> Column:
    """A text; "" where it is missing or the payload has an object or a list."""
    return F.when(c.isNull() | c.rlike(r"^[\[{]"), "").otherwise(c)


def texts_only(payload: Column, numbers: str = "") -> Column:
    """A payload of texts in which bare numbers and truth values are "", as they are no quantities; keys of `numbers` keep theirs."""
    bare = BARE % (f'(?!(?:{numbers})")' if numbers else "")
    return F.when(payload.rlike(bare), F.regexp_replace(payload, bare, '$1""')).otherwise(payload)


def parsed(raw: DataFrame) -> DataFrame:
    """chain_id, b (block), receipts, logs and traces as structs; logs of receipts stand before a list of logs."""
    arrays = {"receipts": schemas.RAW_RECEIPT, "logs": schemas.RAW_LOG, "traces": schemas.RAW_TRACE}
    rows = raw.where("error is null and block is not null").select(
        F.col("chain_id").cast("bigint").alias("chain_id"), F.from_json(texts_only(F.col("block")), schemas.RAW_BLOCK).alias("b"),
        *[F.from_json(texts_only(F.col(k), TRACE_NUMBERS if k == "traces" else ""), T.ArrayType(v)).alias(k) for k, v in arrays.items()],
    )
    rows = rows.where("b.number is not null")
    from_receipts = F.flatten(F.transform("receipts", lambda r: F.coalesce(r["logs"], F.array().cast(T.ArrayType(schemas.RAW_LOG)))))
    return rows.select("chain_id", "b", "receipts", "traces", F.when(F.col("receipts").isNotNull(), from_receipts).otherwise(F.col("logs")).alias("logs"))


def block_time(b: Column) -> Column:
    return F.timestamp_seconds(to_index(b["timestamp"]))


def blocks(raw: DataFrame) -> DataFrame:
    b = F.col("b")
    plain = {"hash": "hash", "parent_hash": "parentHash", "nonce": "nonce", "sha3_uncles": "sha3Uncles", "mix_hash": "mixHash", "miner": "miner", "state_root": "stateRoot", "transactions_root": "transactionsRoot", "receipts_root": "receiptsRoot", "logs_bloom": "logsBloom", "extra_data": "extraData", "withdrawals_root": "withdrawalsRoot"}
    wide = {"difficulty": "difficulty", "total_difficulty": "totalDifficulty", "gas_limit": "gasLimit", "gas_used": "gasUsed"}
    columns = {k: text(b[v]) for k, v in plain.items()} | {k: to_u256(b[v]) for k, v in wide.items()}
    columns |= {"chain_id": F.col("chain_id"), "block_number": to_index(b["number"]), "block_timestamp": block_time(b), "size": to_u64(b["size"]), "base_fee_per_gas": to_u64(b["baseFeePerGas"])}
    columns["transaction_count"] = F.greatest(F.size(b["transactions"]), F.lit(0)).cast("bigint")
    return parsed(raw).select(*[columns[c].alias(c) for c in schemas.default_columns("blocks")])


def transactions(raw: DataFrame) -> DataFrame:
    receipts = F.col("receipts")

    def receipt_of(t: Column, i: Column) -> Column:
        """Receipts come in the order of transactions; where one doesn't, the last of its hash is searched."""
        here = F.get(receipts, i)
        others = F.filter(receipts, lambda r: r["transactionHash"] == t["hash"])
        return F.when(here["transactionHash"] == t["hash"], here).otherwise(F.get(others, F.size(others) - 1))

    bare = F.col("r")
    pairs = F.transform(F.col("b.transactions"), lambda t, i: F.struct(t.alias("t"), receipt_of(t, i).alias("r")))
    rows = parsed(raw).select("chain_id", block_time(F.col("b")).alias("block_timestamp"), F.inline(pairs)).where("t.hash is not null")
    t, has = F.col("t"), bare.isNotNull()
    plain = {"hash": "hash", "block_hash": "blockHash", "from_address": "from", "to_address": "to", "data": "input"}
    wide = {"value": "value", "gas_price": "gasPrice", "max_fee_per_gas": "maxFeePerGas", "max_priority_fee_per_gas": "maxPriorityFeePerGas", "max_fee_per_blob_gas": "maxFeePerBlobGas", "r": "r", "s": "s", "v": "v"}
    columns = {k: text(t[v]) for k, v in plain.items()} | {k: to_u256(t[v]) for k, v in wide.items()}
    columns |= {k: F.when(has, to_u64(bare[v])) for k, v in {"gas_used": "gasUsed", "cumulative_gas_used": "cumulativeGasUsed", "blob_gas_used": "blobGasUsed", "status": "status"}.items()}
    columns |= {k: F.when(has, to_u256(bare[v])) for k, v in {"effective_gas_price": "effectiveGasPrice", "blob_gas_price": "blobGasPrice"}.items()}
    columns |= {k: F.when(bare[v] != "", bare[v]) for k, v in {"contract_address": "contractAddress", "logs_bloom": "logsBloom"}.items()}
    columns |= {k: F.to_json(F.try_parse_json(t[v])) for k, v in (("access_list", "accessList"), ("authorization_list", "authorizationList"))}  # keys in order
    columns |= {
        "chain_id": F.col("chain_id"), "block_timestamp": F.col("block_timestamp"), "block_number": to_index(t["blockNumber"]), "transaction_index": to_index(t["transactionIndex"]),
        "nonce": to_u64(t["nonce"]), "gas": to_u64(t["gas"]), "transaction_type": (to_index(t["type"]) % 256), "function_selector": selector(text(t["input"])),
        "blob_versioned_hashes": F.transform(F.coalesce(t["blobVersionedHashes"], F.array().cast("array<string>")), text),
    }
    return rows.select(*[columns[c].alias(c) for c in schemas.default_columns("transactions")])


def _child(raw: DataFrame, name: str) -> tuple[DataFrame, dict[str, Column]]:
    b = F.col("b")
    rows = parsed(raw).select("chain_id", to_index(b["number"]).alias("block_number"), text(b["hash"]).alias("block_hash"), block_time(b).alias("block_timestamp"), F.explode(name).alias("x")).where("x is not null")
    return rows, {c: F.col(c) for c in ("chain_id", "block_number", "block_hash", "block_timestamp")}


def logs(raw: DataFrame) -> DataFrame:
    rows, columns = _child(raw, "logs")
    x = F.col("x")
    columns |= {"transaction_hash": text(x["transactionHash"]), "transaction_index": to_index(x["transactionIndex"]), "log_index": to_index(x["logIndex"]), "address": text(x["address"]), "data": text(x["data"])}
    columns |= {f"topic_{i}": topic(x["topics"], i) for i in range(4)}
    return rows.select(*[columns[c].alias(c) for c in schemas.default_columns("logs")])


def traces(raw: DataFrame) -> DataFrame:
    """transaction_index is the payload's position of the transaction."""
    rows, columns = _child(raw, "traces")
    x = F.col("x")
    a, r = x["action"], x["result"]
    columns |= {"transaction_hash": text(x["transactionHash"]), "transaction_index": F.coalesce(x["transactionPosition"], F.lit(0)), "subtraces": F.coalesce(x["subtraces"], F.lit(0))}
    columns |= {"trace_address": F.coalesce(x["traceAddress"], F.array().cast("array<bigint>")), "type": text(x["type"]), "error": text(x["error"]), "gas": to_u64(a["gas"]), "gas_used": to_u64(r["gasUsed"]), "value": to_u256(a["value"])}
    columns |= {"output": text(r["output"])} | {k: text(a[v]) for k, v in {"call_type": "callType", "from_address": "from", "to_address": "to", "input": "input", "author": "author", "reward_type": "rewardType", "refund_address": "refundAddress"}.items()}
    return rows.select(*[columns[c].alias(c) for c in schemas.default_columns("traces")])


TABLES = {"blocks": blocks, "transactions": transactions, "logs": logs, "traces": traces}


def malformed(raw: DataFrame) -> DataFrame:
    """Raw rows that give no block: a stated error, no block, or a block without a readable number."""
    number = F.get_json_object("block", "$.number")
    return raw.where(F.col("error").isNotNull() | F.col("block").isNull() | number.isNull() | digits(number).isNull()).select("chain_id", "block_number", "error")
