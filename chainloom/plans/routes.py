"""The routes of the query contract as functions over DataFrames: each gives an Answer, with filters, order and paging of
a QuerySpec. A signature is a text such as "transfer(address to, uint256 value)", or the selector or topic itself, which
can't be decoded: asking for that raises FieldError, as does decode where a route has no signature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions import abi
from chainloom.functions.hexes import selector
from chainloom.operators import tokens
from chainloom.plans.query_spec import Answer, FieldError, QuerySpec, answer, paged


def _by_signature(df: DataFrame, entity: str, signature: str, spec: QuerySpec, exact: F.Column, decode) -> Answer:
    if signature.startswith("0x"):
        if spec.decode:
            raise FieldError("a selector or topic can't be decoded; give the signature's text")
        return answer(df.where(exact == signature.lower()), entity, spec)
    try:
        rows = decode(df, signature)
    except ValueError as e:
        raise FieldError(str(e)) from e
    return answer(rows if spec.decode else rows.drop("decoded"), entity, replace(spec, decode=False))


def transactions_to(transactions: DataFrame, spec: QuerySpec, to: str, signature: str | None = None) -> Answer:
    """Transactions to a contract, all or those of one function."""
    rows = transactions.where(F.lower("to_address") == to.lower())
    if signature is None:
        return answer(rows, "transactions", spec)
    return _by_signature(rows, "transactions", signature, spec, F.lower(selector(F.col("data"))), abi.call)


def events_of(logs: DataFrame, spec: QuerySpec, contract: str | None = None, signature: str | None = None) -> Answer:
    """Events, of one contract or all, of one signature or all."""
    rows = logs if contract is None else logs.where(F.lower("address") == contract.lower())
    if signature is None:
        return answer(rows, "logs", spec)
    return _by_signature(rows, "logs", signature, spec, F.lower("topic_0"), abi.event)


def wallet_transactions(transactions: DataFrame, spec: QuerySpec, wallet: str) -> Answer:
    return answer(tokens.of_wallet(transactions, wallet), "transactions", spec)


def transfers(rows: DataFrame, spec: QuerySpec, **filters) -> Answer:
    """Transfers that pass tokens.filtered."""
    return answer(tokens.filtered(rows, **filters), "transfers", spec)


def balances(rows: DataFrame, spec: QuerySpec, owner: str, token_types: Sequence[str] = (), hide_zero: bool = True) -> Answer:
    """A wallet's balances. rows: tokens.balances of the transfers."""
    return answer(tokens.of_types(rows, token_types, hide_zero).where(F.col("owner") == owner), "balances", spec)


def holders(rows: DataFrame, spec: QuerySpec, address: str, token_types: Sequence[str] = (), hide_zero: bool = True) -> Answer:
    """Who holds a token."""
    return paged(tokens.holders(tokens.of_types(rows, token_types, hide_zero), address), spec, ["owner", "token_id"])


def token_ids(rows: DataFrame, spec: QuerySpec, address: str, token_types: Sequence[str] = (), hide_zero: bool = True) -> Answer:
    """The token ids of a collection with their number of holders."""
    return paged(tokens.token_ids(tokens.of_types(rows, token_types, hide_zero), address), spec, ["token_type", "token_id"])
