"""Token transfers out of logs, and what follows from them: balances, holders, token ids, wallets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.hexes import ZERO256, abi_word, carried, limbs
from chainloom.functions.keccak import event_topic
from chainloom.operators.integrity import in_range

ZERO_ADDRESS = "0x" + "0" * 40
KEY = ["token_type", "chain_id", "address", "token_id"]


def _address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, 27, 40)))


def transfers(logs: DataFrame) -> DataFrame:
    """Transfers of the three token standards. amount and token_id are 256-bit hex; a batch gives a row for each token."""
    kinds = {k: event_topic(s) for k, s in (("plain", "Transfer(address,address,uint256)"), ("single", "TransferSingle(address,address,address,uint256,uint256)"), ("batch", "TransferBatch(address,address,address,uint256[],uint256[])"))}
    topic, data = F.lower("topic_0"), F.col("data")
    item = lambda token, amount: F.struct(token.alias("token_id"), amount.alias("amount"))
    word = lambda i: F.lower(F.substring(data, F.lit(3) + F.lit(64) * i, F.lit(64)))
    small = lambda i: F.coalesce(F.conv(F.when(F.substring(word(i), 1, 56) == "0" * 56, F.substring(word(i), 57, 8)), 16, 10).cast("bigint"), F.lit(0))
    ids, amounts = (F.floor(small(F.lit(k)) / 32) for k in (0, 1))
    n = F.least(small(ids), small(amounts), F.floor(F.length(data) / 64))
    batch = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: item(word(ids + i), word(amounts + i))))
    one = F.lpad(F.lit("1"), 64, "0")
    plain = F.col("topic_3") == ""
    items = (
        F.when((topic == kinds["plain"]) & plain, F.array(item(F.lit(ZERO256), abi_word(data, 0))))
        .when(topic == kinds["plain"], F.array(item(F.lower(F.substring("topic_3", 3, 64)), one)))
        .when(topic == kinds["single"], F.array(item(abi_word(data, 0), abi_word(data, 1))))
        .when(topic == kinds["batch"], batch)
    )
    kind = F.when(topic != kinds["plain"], "erc1155").when(plain, "erc20").otherwise("erc721")
    shift = topic != kinds["plain"]
    return logs.where(topic.isin(list(kinds.values()))).select(
        kind.alias("token_type"), "chain_id", F.lower("address").alias("token_address"),
        F.when(shift, _address(F.col("topic_2"))).otherwise(_address(F.col("topic_1"))).alias("from_address"),
        F.when(shift, _address(F.col("topic_3"))).otherwise(_address(F.col("topic_2"))).alias("to_address"),
        "block_number", "block_timestamp", "transaction_hash", F.inline(items), "log_index",
    )


def movements(transfers: DataFrame) -> DataFrame:
    """Two rows a transfer: what comes in and what goes out, by owner; an owner's transfer to itself keeps both."""
    sides = F.array(F.struct(F.col("to_address").alias("owner"), F.lit(1).alias("way")), F.struct(F.col("from_address").alias("owner"), F.lit(-1).alias("way")))
    return transfers.select("token_type", "chain_id", F.col("token_address").alias("address"), "token_id", "amount", F.inline(sides))


def balances(transfers: DataFrame, hide_zero: bool = False) -> DataFrame:
    """owner's balance of each token. 256-bit hex amounts are summed by limbs; the zero address owns nothing.

    hide_zero leaves out balances of zero; null ones, which say that more went out than came in, stay.

    Sums are partial before the exchange, so a wallet with a third of all transfers is a few rows of it.
    """
    rows = movements(transfers).where(F.col("owner") != ZERO_ADDRESS)
    if dict(transfers.dtypes)["amount"] == "string":
        sums = [F.sum(v * F.col("way")).alias(f"__l{k}") for k, v in enumerate(limbs(F.col("amount")))]
        found = rows.groupBy(*KEY, "owner").agg(*sums).withColumn("balance", carried([F.col(f"__l{k}") for k in range(len(sums))]))
        zero = F.lit(ZERO256)
    else:
        found, zero = rows.groupBy(*KEY, "owner").agg(F.sum(F.col("amount") * F.col("way")).alias("balance")), F.lit(0)
    found = found.select("token_type", "chain_id", "owner", "address", "token_id", "balance")
    return found.where(F.col("balance").isNull() | (F.col("balance") != zero)) if hide_zero else found


def holders(balances: DataFrame, address: str) -> DataFrame:
    """Who holds a token, and how much of each token id."""
    return balances.where(F.col("address") == address).select("owner", "token_id", "balance", "token_type")


def token_ids(balances: DataFrame, address: str) -> DataFrame:
    """Token ids of a collection with the number of holders."""
    return balances.where(F.col("address") == address).groupBy("token_type", "token_id").agg(F.countDistinct("owner").alias("n_owners"))


def of_types(balances: DataFrame, token_types: Sequence[str] = (), hide_zero: bool = False) -> DataFrame:
    """Balances of token types (none given: all), without those of zero if asked for."""
    rows = balances.where(F.col("token_type").isin(*token_types)) if token_types else balances
    zero = ZERO256 if dict(balances.dtypes)["balance"] == "string" else 0
    return rows.where(F.col("balance") != F.lit(zero)) if hide_zero else rows


def filtered(
    transfers: DataFrame, token_types: Sequence[str] = (), token_address: str | None = None, wallet: str | None = None, start_block: int | None = None, end_block: int | None = None,
    start_time: str | None = None, end_time: str | None = None, token_ids: Sequence[object] = (), transaction_hash: str | None = None,
) -> DataFrame:
    """Transfers that pass all filters given; bounds are inclusive, times are ISO 8601 texts. Numbers, times and types reach the scan."""
    rows = in_range(transfers, start_block, end_block)
    time = rows.schema["block_timestamp"].dataType
    for bound, sign in ((start_time, ">="), (end_time, "<=")):
        if bound is not None:
            at = F.to_timestamp_ntz(F.lit(bound.removesuffix("Z"))) if time.typeName() == "timestamp_ntz" else F.lit(bound).cast("timestamp")
            rows = rows.where(F.col("block_timestamp") >= at if sign == ">=" else F.col("block_timestamp") <= at)
    if token_types:
        rows = rows.where(F.col("token_type").isin(*token_types))
    if token_ids:
        rows = rows.where(F.col("token_id").isin(*token_ids))
    for name, value in (("token_address", token_address), ("transaction_hash", transaction_hash)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows if wallet is None else of_wallet(rows, wallet)


def of_wallet(df: DataFrame, wallet: str, sender: str = "from_address", receiver: str = "to_address") -> DataFrame:
    """Rows that go out of or come in to a wallet; what it sends to itself is there once."""
    return df.where((F.col(sender) == wallet) | (F.col(receiver) == wallet))
