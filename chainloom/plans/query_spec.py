"""What a caller may ask of an entity, and the DataFrame that answers it.

Pages count from 0. A limit of 0 is the default. With aggregates or group_by the answer is in `aggregations` and `data`
stays empty. Fields are checked against the entity's columns before a plan is built, and aggregates may only use the
functions and columns listed here. Decoding needs a signature, so it belongs to the routes that have one (plans.routes).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.hexes import as_double, carried, decimal_text, of_literal, sum_u256
from chainloom.operators.latest import latest
from chainloom.schemas import ENTITIES, KEYS, ORDER, WIDE

DEFAULT_LIMIT = 5
FUNCTIONS = {"count", "sum", "avg", "min", "max", "approx_count_distinct", "coalesce", "abs", "round", "floor", "cast"}
WORDS = {"distinct", "case", "when", "then", "else", "end", "and", "or", "not", "is", "null", "in", "between", "as", "bigint", "double", "decimal", "string", "true", "false"}
ALIAS = re.compile(r"\s+as\s+([a-z_][a-z0-9_]*)", re.I)
TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)(\s*\()?|\d+(?:\.\d+)?|'[^'\\]*'|<=|>=|<>|!=|[-+*/%=<>(),])")


class FieldError(ValueError):
    """A field that the entity doesn't have, or an aggregate that isn't allowed."""


@dataclass
class QuerySpec:
    filters: dict[str, str] = field(default_factory=dict)
    group_by: list[str] = field(default_factory=list)
    sort_by: str = ""
    sort_order: str = "asc"
    page: int = 0
    limit: int = DEFAULT_LIMIT
    aggregates: list[str] = field(default_factory=list)
    decode: bool = False
    force_consistent_data: bool = False


def aliases(aggregates: Sequence[str]) -> list[str]:
    """The name of each aggregate that has one; the last AS counts, so a cast inside isn't taken for a name."""
    return [found[-1] for found in map(ALIAS.findall, aggregates) if found]


def parse(params: Mapping[str, Sequence[str]]) -> QuerySpec:
    """A QuerySpec of query parameters; of a filter's values the first counts, and filter_event_name is one on data."""
    first = lambda k, default="": next(iter(params.get(k, ())), default)
    filters = {k.removeprefix("filter_"): v[0] for k, v in params.items() if k.startswith("filter_") and v}
    if "event_name" in filters:
        filters["data"] = filters.pop("event_name")
    number = lambda k: int(first(k) or 0)
    flag = lambda k: first(k).lower() in ("true", "1", "on")
    return QuerySpec(filters, list(params.get("group_by", ())), first("sort_by"), first("sort_order") or "asc", number("page"), number("limit") or DEFAULT_LIMIT, list(params.get("aggregate", ())), flag("decode"), flag("force_consistent_data"))


def validate(entity: str, group_by: Sequence[str], sort_by: str, aggregates: Sequence[str]) -> None:
    """Raise FieldError for a field that is neither a column of the entity nor a name of an aggregate."""
    if entity not in ENTITIES:
        raise FieldError(f"unknown entity: {entity}")
    valid = {*ENTITIES[entity], *aliases(aggregates)}
    for what, names in (("group_by", group_by), ("sort_by", [sort_by] if sort_by else [])):
        for name in names:
            if name not in valid:
                raise FieldError(f"invalid {what} field '{name}' for entity '{entity}'. Valid fields are: {', '.join(sorted(valid))}")


def allowed(entity: str, aggregate: str) -> str:
    """The aggregate, if it has nothing but listed functions, words, columns of the entity, literals and a name."""
    body, name = aggregate, ""
    if found := list(ALIAS.finditer(aggregate)):
        if found[-1].end() == len(aggregate.rstrip()):
            body, name = aggregate[: found[-1].start()], found[-1][1]
    at, called = 0, False
    while at < len(body.rstrip()):
        m = TOKEN.match(body, at)
        if not m:
            raise FieldError(f"aggregate not allowed: {aggregate}")
        word = (m[1] or "").lower()
        if m[2] and word not in FUNCTIONS and word not in ("in", "and", "or", "not", "when", "then", "else"):
            raise FieldError(f"function not allowed in aggregate: {m[1]}")
        if word and not m[2] and word not in WORDS and m[1] not in ENTITIES[entity]:
            raise FieldError(f"unknown field '{m[1]}' in aggregate: {aggregate}")
        called |= bool(m[2]) and word in FUNCTIONS
        at = m.end()
    if not called:
        raise FieldError(f"no aggregate function: {aggregate}")
    return f"{body} AS `{name}`" if name else body


#: An aggregate of a single column, and a comparison of a column with a number, on either side.
WHOLE = re.compile(r"\s*(sum|avg|min|max)\s*\(\s*([a-z_0-9]+)\s*\)\s*(?:as\s+([a-z_][a-z0-9_]*)\s*)?", re.I)
COMPARED = re.compile(r"\b([a-z_][a-z0-9_]*)(\s*(?:<=|>=|<>|!=|=|<|>)\s*)(\d+)\b|\b(\d+)(\s*(?:<=|>=|<>|!=|=|<|>)\s*)([a-z_][a-z0-9_]*)\b", re.I)


def measured(df: DataFrame, entity: str, aggregate: str) -> tuple[Column, str | None]:
    """The column of an aggregate, and its name if it is a 256-bit number that is still to be written in decimal digits.

    On columns of 64 hex digits sums, minima and maxima are exact, a mean is a double, and a column is compared with a
    number by its digits; a sum beyond 256 bits is null. Other arithmetic on such columns is refused.
    """
    text = allowed(entity, aggregate)
    wide = {c for c in WIDE.get(entity, ()) if c in df.columns and df.schema[c].dataType.simpleString() == "string"}
    m = WHOLE.fullmatch(aggregate)
    if m and m[2] in wide:
        name, column = m[3] or aggregate.strip(), F.col(m[2])
        kind = m[1].lower()
        if kind == "avg":
            return (as_double(sum_u256(column)) / F.count(column)).alias(name), None
        return (carried(sum_u256(column)) if kind == "sum" else F.min(column) if kind == "min" else F.max(column)).alias(name), name

    def digits(found: re.Match) -> str:
        column, number = (found[1], found[3]) if found[1] else (found[6], found[4])
        if column not in wide:
            return found[0]
        return f"{column}{found[2]}'{of_literal(number)}'" if found[1] else f"'{of_literal(number)}'{found[5]}{column}"

    text = COMPARED.sub(digits, text)
    outside = re.sub(r"(?i)\b[a-z_0-9]+\s*(?:<=|>=|<>|!=|=|<|>)\s*'[0-9a-f]{64}'|'[0-9a-f]{64}'\s*(?:<=|>=|<>|!=|=|<|>)\s*[a-z_0-9]+|\bcount\s*\(\s*(?:distinct\s+)?[a-z_0-9]+\s*\)", "", text)
    for c in wide:
        if re.search(rf"\b{c}\b", outside.partition(" AS `")[0]):
            raise FieldError(f"arithmetic on the 256-bit field '{c}' isn't possible in: {aggregate}")
    return F.expr(text), None


@dataclass
class Answer:
    """data or aggregations, and what all pages hold together (a DataFrame of one row: total_items, total_pages)."""

    data: DataFrame | None
    aggregations: DataFrame | None
    meta: DataFrame


def answer(df: DataFrame, entity: str, spec: QuerySpec) -> Answer:
    """df (all versions of the entity, or its latest) as asked for; the order is made total by the entity's own order."""
    validate(entity, spec.group_by, spec.sort_by, spec.aggregates)
    if spec.decode:
        raise FieldError(f"'{entity}' can only be decoded by a signature")
    if spec.force_consistent_data and entity in KEYS and "is_deleted" in df.columns:
        df = latest(df, KEYS[entity])
    for name, value in spec.filters.items():
        if name not in ENTITIES[entity]:
            raise FieldError(f"invalid filter field '{name}' for entity '{entity}'")
        kind = df.schema[name].dataType
        wide = name in WIDE.get(entity, ()) and kind.simpleString() == "string"
        digits = value if wide and re.fullmatch("[0-9a-f]{64}", value) else of_literal(value) if wide else None
        df = df.where(F.lit(False) if wide and digits is None else F.col(name) == F.lit(digits if wide else value).cast(kind))
    grouped = bool(spec.group_by or spec.aggregates)
    decimal: list[str] = []
    if grouped:
        made = [measured(df, entity, a) for a in spec.aggregates]
        decimal = [name for _, name in made if name]
        df = df.groupBy(*spec.group_by).agg(*[c for c, _ in made]) if made else df.select(*spec.group_by).distinct()
    ties = spec.group_by if grouped else [c for c in ORDER[entity] if c in df.columns]
    found = paged(df, spec, ties)
    if not grouped:
        return found
    return Answer(None, found.data.withColumns({c: decimal_text(F.col(f"`{c}`")) for c in decimal}), found.meta)  # sorted by digits, written in decimal


def paged(df: DataFrame, spec: QuerySpec, ties: Sequence[str]) -> Answer:
    """A page of df in the order asked for, which `ties` make total; top-k by partial orders, never a whole sort in one task."""
    if spec.sort_by and spec.sort_by not in df.columns:
        raise FieldError(f"invalid sort_by field '{spec.sort_by}'")
    limit = spec.limit if spec.limit > 0 else DEFAULT_LIMIT
    total = df.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / limit))
    direction = F.desc if spec.sort_order.lower() == "desc" else F.asc
    order = [*([direction(spec.sort_by)] if spec.sort_by else []), *[F.asc(c) for c in ties if c != spec.sort_by]]
    page = (df.orderBy(*order) if order else df).offset(spec.page * limit).limit(limit)
    return Answer(page, None, total)


def envelope(found: Answer, spec: QuerySpec, chain_id: int) -> dict:
    """The response of a page: meta, and data or aggregations as lists of rows. Only the page's rows and one count are fetched."""
    total = found.meta.first()
    rows = found.data if found.data is not None else found.aggregations
    meta = {"chain_id": chain_id, "page": spec.page, "limit": spec.limit if spec.limit > 0 else DEFAULT_LIMIT, "total_items": total.total_items, "total_pages": total.total_pages}
    return {"meta": meta, "data" if found.data is not None else "aggregations": [r.asDict(True) for r in rows.collect()]}


def error(code: int, message: str, support_id: str = "") -> dict:
    """The response of a request that failed."""
    return {"code": code, "message": message, "support_id": support_id}


def kind_of(text: str) -> str:
    """What a search text names: block, hash (of a block or transaction, or an event's topic), address, selector or nothing."""
    if text.isdigit():
        return "block"
    if re.fullmatch(r"0x[0-9a-fA-F]+", text):
        return {66: "hash", 42: "address", 10: "selector"}.get(len(text), "none")
    return "none"


def search(text: str, blocks: DataFrame, transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """(type, block_number, hash) of what a search text finds; every branch is a filter of one table."""
    kind = kind_of(text)
    of = lambda df, what, number, key: df.select(F.lit(what).alias("type"), F.col(number).alias("block_number"), F.col(key).alias("hash"))
    if kind == "block":
        return of(blocks.where(F.col("block_number") == int(text)), "block", "block_number", "hash")
    if kind == "hash":
        found = of(blocks.where(F.col("hash") == text), "block", "block_number", "hash").unionAll(of(transactions.where(F.col("hash") == text), "transaction", "block_number", "hash"))
        return found.unionAll(of(logs.where(F.col("topic_0") == text), "event_signature", "block_number", "transaction_hash"))
    if kind == "selector":
        return of(transactions.where(F.col("function_selector") == text), "function_signature", "block_number", "hash")
    if kind == "address":
        made = of(transactions.where(F.col("contract_address") == text), "contract", "block_number", "hash")
        return made.unionAll(of(transactions.where((F.col("from_address") == text) | (F.col("to_address") == text)), "address", "block_number", "hash"))
    return of(blocks.where(F.lit(False)), "none", "block_number", "hash")
