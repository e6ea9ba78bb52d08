"""Columns and types of the chain tables. Schemas are fixed: nothing is inferred from data.

256-bit quantities are strings of 64 lower-case hex digits: equality, order, minimum, joins and Parquet statistics then
work as they are. Block numbers and indexes are bigint; unsigned 64-bit quantities are decimal(20,0).
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns that queries may name, in fixed order; the last two of each stored entity are no part of a plain read.
ENTITIES: dict[str, tuple[str, ...]] = {
    "blocks": tuple(
        "chain_id block_number block_timestamp hash parent_hash sha3_uncles nonce mix_hash miner state_root transactions_root receipts_root logs_bloom size "
        "extra_data difficulty total_difficulty transaction_count gas_limit gas_used withdrawals_root base_fee_per_gas insert_timestamp sign".split()
    ),
    "transactions": tuple(
        "chain_id hash nonce block_hash block_number block_timestamp transaction_index from_address to_address value gas gas_price data function_selector max_fee_per_gas "
        "max_priority_fee_per_gas max_fee_per_blob_gas blob_versioned_hashes transaction_type r s v access_list authorization_list contract_address gas_used "
        "cumulative_gas_used effective_gas_price blob_gas_used blob_gas_price logs_bloom status insert_timestamp sign".split()
    ),
    "logs": tuple("chain_id block_number block_hash block_timestamp transaction_hash transaction_index log_index address data topic_0 topic_1 topic_2 topic_3 insert_timestamp sign".split()),
    "traces": tuple(
        "chain_id block_number block_hash block_timestamp transaction_hash transaction_index subtraces trace_address type call_type error from_address to_address gas gas_used "
        "input output value author reward_type refund_address insert_timestamp sign".split()
    ),
    "transfers": tuple("token_type chain_id token_address from_address to_address block_number block_timestamp transaction_hash token_id amount log_index insert_timestamp sign".split()),
    "balances": tuple("token_type chain_id owner address token_id balance".split()),
}

#: What identifies a row, whatever its version.
KEYS: dict[str, list[str]] = {
    "blocks": ["chain_id", "block_number"],
    "transactions": ["chain_id", "block_number", "hash"],
    "logs": ["chain_id", "block_number", "transaction_hash", "log_index"],
    "traces": ["chain_id", "block_number", "transaction_hash", "trace_address"],
    "transfers": ["chain_id", "block_number", "transaction_hash", "log_index", "token_id"],
}
#: The total order of plain reads.
ORDER: dict[str, list[str]] = {
    "blocks": ["block_number"],
    "transactions": ["block_number", "transaction_index"],
    "logs": ["block_number", "log_index"],
    "traces": ["block_number", "transaction_index", "trace_address"],
    "transfers": ["block_number", "log_index"],
    "balances": ["owner", "address", "token_id"],
}

#: 256-bit quantities of each entity, which its own tables hold as 64 hex digits.
WIDE: dict[str, frozenset[str]] = {
    "blocks": frozenset("difficulty total_difficulty gas_limit gas_used".split()),
    "transactions": frozenset("value gas_price max_fee_per_gas max_priority_fee_per_gas max_fee_per_blob_gas effective_gas_price blob_gas_price".split()),
    "traces": frozenset(("value",)),
    "transfers": frozenset(("token_id", "amount")),
    "balances": frozenset(("token_id", "balance")),
}

_DECIMAL = "size base_fee_per_gas nonce gas gas_used cumulative_gas_used blob_gas_used status"
_BIGINT = "chain_id block_number transaction_count transaction_index log_index subtraces transaction_type"


def _type(entity: str, name: str) -> T.DataType:
    if name in ("block_timestamp", "insert_timestamp"):
        return T.TimestampType()
    if name == "sign":
        return T.ByteType()
    if name in _BIGINT.split():
        return T.LongType()
    if name == "blob_versioned_hashes":
        return T.ArrayType(T.StringType())
    if name == "trace_address":
        return T.ArrayType(T.LongType())
    if name in _DECIMAL.split() and (entity, name) not in (("blocks", "nonce"), ("blocks", "gas_used")):
        return T.DecimalType(20, 0)
    return T.StringType()


def schema(entity: str) -> T.StructType:
    """The stored columns of an entity."""
    return T.StructType([T.StructField(c, _type(entity, c)) for c in ENTITIES[entity]])


def default_columns(entity: str) -> list[str]:
    """The columns of a plain read."""
    return [c for c in ENTITIES[entity] if c not in ("insert_timestamp", "sign")]


STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _strings(names: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names.split()] + [T.StructField(k, v) for k, v in more.items()])


#: Raw payloads; quantities are hex strings, so every scalar is read as a string and no digit is lost.
RAW_LOG = _strings("transactionHash transactionIndex logIndex address data", topics=T.ArrayType(T.StringType()))
RAW_RECEIPT = _strings("transactionHash contractAddress gasUsed cumulativeGasUsed effectiveGasPrice blobGasUsed blobGasPrice logsBloom status", logs=T.ArrayType(RAW_LOG))
RAW_TRANSACTION = _strings(
    "hash nonce blockHash blockNumber transactionIndex from to value gas gasPrice input maxFeePerGas maxPriorityFeePerGas maxFeePerBlobGas type r s v accessList authorizationList",
    blobVersionedHashes=T.ArrayType(T.StringType()),
)
RAW_BLOCK = _strings(
    "number hash parentHash timestamp nonce sha3Uncles mixHash miner stateRoot transactionsRoot receiptsRoot logsBloom size extraData difficulty totalDifficulty gasLimit gasUsed baseFeePerGas withdrawalsRoot",
    transactions=T.ArrayType(RAW_TRANSACTION),
)
RAW_TRACE = T.StructType(
    [
        T.StructField("action", _strings("callType from to gas input value author rewardType refundAddress")),
        T.StructField("result", _strings("gasUsed output")),
        *_strings("transactionHash type error", transactionPosition=T.LongType(), subtraces=T.LongType(), traceAddress=T.ArrayType(T.LongType())).fields,
    ]
)
#: What a source of raw payloads gives: a row a block, one JSON text for each kind, null where the kind wasn't asked for.
RAW = "chain_id bigint, block_number bigint, block string, receipts string, logs string, traces string, error string"
#: Staged files: a row a block.
STAGED = "chain_id bigint, block_number bigint, block_hash string, block_timestamp bigint, block_json string, transactions_json string, logs_json string, traces_json string"
