"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other numbers or names has the same
template. Windows of template tokens are hash-joined with those of the benchmark; matches are grouped by document,
item and alignment (document position less item position); an alignment counts if it has enough windows and its slots
are consistent, that is every value of the item stands for one value of the document.

The benchmark's rows are broadcast only when their summed bytes are within `max_broadcast`; else both sides are
shuffled by window. Groups are (document, item, alignment), so no item or document, however common, is gathered.

Only windows of MIN_LITERALS literal tokens or more are joined and counted. Items that have too few of them count if the
whole item's template stands at an alignment. Copies of such items, and of items of under WINDOW tokens, are also found
by their literal tokens (`copies`), whole and in order. An item's first token may stand for a name where its text has it
after other words.

Null or empty texts and items match nothing. Repeated documents are each reported, repeated items too. Other columns of
either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import given, read

WINDOW, MIN_LITERALS, MIN_WINDOWS = 8, 4, 6
#: What a row of the benchmark and a token of it take in a hash table besides the token's text.
ROW_BYTES, TOKEN_BYTES = 160, 16
#: Typed placeholders, one control character each; texts lose these characters first.
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"
#: Units of measure and currency.
UNITS = "mm cm m km kg g mg lb lbs oz km/h mph ml l cl ft inch inches feet miles mile meters metres seconds minutes hours days weeks months years percent dollars euros cents pounds usd eur gbp hz khz mhz ghz kb mb gb tb".split()
PUNCTUATION = r"[.,;:!?\"'()\[\]{}«»„“”‘’…]+"


def template(text: Column) -> Column:
    """The tokens of a text, lower-case and without punctuation; numbers and names are marked, with their values."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x03]+", "")
    t = F.regexp_replace(t, r"([^\s.!?:…] )(?=\p{Lu}\p{Ll})", "$1" + NAME)
    numbers = F.regexp_replace(F.regexp_replace(t, r"(?<!\S)[^\s\d]*\d\S*", NUMBER + "$0"), NUMBER + r"(\S*)" + NAME, NUMBER + "$1")
    t = F.when(text.rlike("[0-9]"), numbers).otherwise(t)
    return F.array_remove(F.split(F.trim(F.lower(F.regexp_replace(t, PUNCTUATION, ""))), r"\s+"), "")


def kind(token: Column) -> Column:
    """The type's mark for placeholders, or else the token."""
    return F.when(token < "\x04", F.substring(token, 1, 1)).when(token.isin(UNITS), UNIT).otherwise(token)


def windows(rows: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """keep, tokens, pos, window (hash) for each WINDOW tokens of a text."""
    rows = given(rows, keep, tokens=template(text)).where(F.size("tokens") >= WINDOW)
    rows = given(rows, [*keep, "tokens"], h=F.transform("tokens", lambda x: F.xxhash64(kind(x))))
    of = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)]))
    return rows.select(*keep, "tokens", F.posexplode(F.slice(of, 1, F.size("h") - (WINDOW - 1))).alias("pos", "window"))


def is_literal(token: Column) -> Column:
    return (token >= "\x04") & ~token.isin(UNITS)


def items_of(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """item, tokens, named (whether the first token begins like a name), usable (windows with enough literals), scarce."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    rows = given(rows, ["item"], tokens=template(F.col("text")), named=F.coalesce(F.col("text").rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}"), F.lit(False))).where(F.size("tokens") > 0)
    starts = F.when(F.size("tokens") >= WINDOW, F.sequence(F.lit(0), F.size("tokens") - WINDOW)).otherwise(F.array().cast("array<int>"))
    literals = lambda i: F.size(F.filter(F.slice("tokens", i + 1, WINDOW), is_literal))
    rows = given(rows, ["item", "tokens", "named"], usable=F.size(F.filter(starts, lambda i: literals(i) >= MIN_LITERALS)))
    return rows.withColumn("scarce", F.col("usable") < F.greatest(F.lit(1), F.least(F.lit(MIN_WINDOWS), F.size("tokens") - (WINDOW - 1))))


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of items with enough literals. Form 1 has the first token as a name: its first window, or all of a scarce item.

    item_tokens: of the window, or for scarce items the whole item, which then begins at item_at.
    """
    named = F.concat(F.array(F.concat(F.lit(NAME), F.get("tokens", F.lit(0)))), F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))))
    forms = items.where(F.size("tokens") >= WINDOW).withColumn("form", F.lit(0))
    forms = forms.union(forms.where(F.col("named") & (F.get("tokens", F.lit(0)) >= "\x04")).select("item", named.alias("tokens"), "named", "usable", "scarce", F.lit(1).alias("form")))
    keep = ["item", "tokens", "usable", "scarce", "form"]
    rows = given(forms, keep, h=F.transform("tokens", lambda x: F.xxhash64(kind(x))))
    of = F.transform("h", lambda x, i: F.xxhash64(x, *[F.get("h", i + j) for j in range(1, WINDOW)]))
    rows = rows.select(*keep, F.posexplode(F.slice(of, 1, F.size("h") - (WINDOW - 1))).alias("item_pos", "window"))
    cut = F.slice("tokens", F.col("item_pos") + 1, WINDOW)
    first = (F.col("form") == 1) & (F.col("item_pos") == 0)
    rows = rows.where((F.size(F.filter(cut, is_literal)) + first.cast("int") >= MIN_LITERALS) & (F.col("scarce") | (F.col("form") == 0) | first))
    scarce = F.col("scarce")
    return rows.select(
        "item", "item_pos", "window", scarce, F.when(scarce, F.col("form")).otherwise(0).alias("form"), F.when(scarce, F.col("tokens")).otherwise(cut).alias("item_tokens"),
        F.when(scarce, 0).otherwise(F.col("item_pos")).alias("item_at"), F.col("usable").alias("n_item_windows"),
    )


def table_bytes(tokens: str) -> Column:
    """About what the rows of a group take in a hash table, 0 for none."""
    of = F.aggregate(tokens, F.lit(ROW_BYTES).cast("long"), lambda s, x: s + F.octet_length(x) + TOKEN_BYTES)
    return F.coalesce(F.sum(of), F.lit(0))


def copies(docs: DataFrame, items: DataFrame, max_broadcast: int) -> DataFrame | None:
    """Rows (doc, item, n_windows, n_item_windows, n_slots) of documents that hold all tokens of a short or scarce item, in order.

    Joined by the item's first WINDOW literal tokens, or all of a shorter one; then all of its tokens are compared.
    """
    literal = lambda x: F.translate(x, NUMBER + NAME + UNIT, "")
    slots = F.array_distinct(F.filter("tokens", lambda x: ~is_literal(x)))
    items = items.where("scarce").select("item", F.transform("tokens", literal).alias("item_tokens"), F.greatest(F.col("usable"), F.lit(1)).alias("n"), F.size(slots).alias("n_slots"))
    items = items.withColumn("length", F.least(F.size("item_tokens"), F.lit(WINDOW)))
    sizes = {x["length"]: x["size"] for x in items.groupBy("length").agg(table_bytes("item_tokens").alias("size")).collect()}
    if not sizes:
        return None
    heads = items.withColumn("key", F.xxhash64(F.slice("item_tokens", 1, WINDOW)))
    if sum(sizes.values()) <= max_broadcast:
        heads = F.broadcast(heads)
    rows = given(docs, ["doc"], tokens=F.transform(template(F.col("text")), literal))
    none = F.array().cast("array<struct<pos:int,length:int,key:bigint>>")

    def keys(k: int) -> Column:
        at = lambda i: F.struct(i.alias("pos"), F.lit(k).alias("length"), F.xxhash64(F.slice("tokens", i + 1, k)).alias("key"))
        return F.when(F.size("tokens") >= k, F.transform(F.sequence(F.lit(0), F.size("tokens") - k), at)).otherwise(none)

    rows = rows.select("doc", "tokens", F.inline(F.concat(*map(keys, sorted(sizes)))))
    same = F.slice("tokens", F.col("pos") + 1, F.size("item_tokens")) == F.col("item_tokens")
    return rows.join(heads, ["length", "key"]).where(same).select("doc", "item", F.col("n").alias("n_windows"), F.col("n").alias("n_item_windows"), "n_slots").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_broadcast: int = 64 << 20) -> DataFrame:
    """Rows (doc id, item id, n_windows, n_item_windows, n_slots) of documents that hold an item or a variant of it.

    n_item_windows counts the windows with enough literals, 1 for an item that has none. max_broadcast is in bytes of the
    benchmark's rows with their tokens, of windows and of short or scarce items each.
    """
    items = items_of(benchmark, item_col, item_text)
    theirs = item_windows(items)
    if theirs.agg(table_bytes("item_tokens")).first()[0] <= max_broadcast:
        theirs = F.broadcast(theirs)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    ours = windows(docs, ["doc"], F.col("text"))
    shift = F.col("pos") - F.col("item_pos")
    cut = F.slice("tokens", shift + F.col("item_at") + 1, F.size("item_tokens"))
    met = ours.join(theirs, "window").where(shift + F.col("item_at") >= 0)
    pairs = F.arrays_zip(F.col("item_tokens").alias("a"), cut.alias("b"))
    met = met.select("doc", "item", "form", "scarce", shift.alias("shift"), "item_pos", "n_item_windows", pairs.alias("pairs"))
    met = met.where(F.forall("pairs", lambda x: F.coalesce(kind(x["a"]) == kind(x["b"]), F.lit(False))))
    slots = F.filter("pairs", lambda x: (x["a"] < "\x04") | x["a"].isin(UNITS))
    aligned = met.groupBy("doc", "item", "form", "shift").agg(
        F.size(F.collect_set("item_pos")).alias("n_windows"), F.max("n_item_windows").alias("n_item_windows"), F.max("scarce").alias("scarce"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("slots"),
    )
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    enough = F.col("scarce") | (F.col("n_windows") >= F.least(F.lit(MIN_WINDOWS), F.col("n_item_windows")))
    found = aligned.where(consistent & enough).select("doc", "item", "n_windows", "n_item_windows", F.size("slots").alias("n_slots"))
    whole = copies(docs, items, max_broadcast)
    return (
        (found if whole is None else found.union(whole))
        .groupBy("doc", "item")
        .agg(*[F.max(c).cast("long").alias(c) for c in ("n_windows", "n_item_windows", "n_slots")])
        .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_item_windows", "n_slots")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
