"""Line-first cleaning with DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that loses
too large a share of its words is rejected. Everything happens within a row: no shuffle, whatever the size.

Null or empty text: no words, no lines, base_failed. Ties and repeated rows: each row is judged alone. Columns of the
input other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACES, given, read, words

#: Symbols of the base rules.
SYMBOLS = "#*$%&|<>"
#: Phrases of notices, menus and appeals in English, German, French and Spanish; a dot stands for a letter with an accent.
PHRASES = [
    r"all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)|licensed under the|released under the|subscribe to our|sign up for|click here|share (this|on)|javascript (is|must be)",
    r"alle rechte vorbehalten|datenschutz(erkl.rung|hinweise)|nutzungsbedingungen|cookie-(richtlinie|einstellungen)|newsletter abonnieren|hier klicken|klicken sie hier",
    r"tous droits r.serv.s|politique de (confidentialit|cookies)|mentions l.gales|conditions (g.n.rales )?d.utilisation|abonnez-vous|cliquez ici|partager sur",
    r"todos los derechos reservados|pol.tica de (privacidad|cookies)|aviso legal|t.rminos (de uso|y condiciones)|suscr.bete|haga? clic aqu|compartir en",
]
BOILERPLATE = rf"(?i)(^\s*©|(^|[^a-z])({'|'.join(PHRASES)}))"
POSITION_BITS = 26
MIN_WORDS, MAX_REPEATED, MIN_KEPT = 50, 50, 60


def repeated_words(w: Column, h: Column) -> Column:
    """How many words lie in 3-word windows found twice or more. w: words, h: their hashes (columns of the row).

    Windows are sorted as one long each, hash above position, so that equal ones are neighbours: n log n for any text.
    Neighbours of equal hash count only if their words are equal. Where neighbours of equal hash have other words, or
    positions don't fit, windows are sorted again by hash and words, which keeps equal ones neighbours whatever the hash.
    """
    n = F.size(w)
    at = lambda a, i: F.get(a, i)
    low = F.lit((1 << POSITION_BITS) - 1)
    keys = F.when(
        (n >= 3) & (n <= 1 << POSITION_BITS),
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))),
    )

    def near(a: Column, b: Column) -> Column:
        return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)

    def equal(a: Column, b: Column) -> Column:
        p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        return (at(w, p) == at(w, q)) & (at(w, p + 1) == at(w, q + 1)) & (at(w, p + 2) == at(w, q + 2))

    def ends(k: Column, hit: Column, pos: Callable[[Column], Column]) -> Column:
        """Words covered by the windows at each j of hit and by their right neighbours."""
        starts = F.sort_array(F.array_distinct(F.concat(F.transform(hit, lambda j: pos(at(k, j))), F.transform(hit, lambda j: pos(at(k, j + 1))))))
        return F.transform(F.array(starts), covered)[0]

    def by_hash(k: Column) -> Column:
        """Neighbours of equal hash are found in one walk; the rest looks at these only."""
        hit = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: near(at(k, j), at(k, j + 1)))
        mixed = lambda x: F.exists(x, lambda j: ~equal(at(k, j), at(k, j + 1)))
        return F.transform(F.array(hit), lambda x: F.when(mixed(x), by_words()).otherwise(ends(k, x, lambda a: a.bitwiseAND(low))))[0]

    def window(i: Column) -> Column:
        parts = [at(w, i + j).alias(f"w{j}") for j in range(3)]
        return F.struct(F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)).alias("h"), *parts, i.cast("long").alias("pos"))

    def counted_by_words(k: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
        hit = F.filter(F.sequence(F.lit(0), F.size(k) - 1), lambda j: same(at(k, j), at(k, j + 1)))
        return F.transform(F.array(hit), lambda x: ends(k, x, lambda a: a["pos"]))[0]

    def by_words() -> Column:
        found = F.array(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
        return F.transform(found, counted_by_words)[0]

    def covered(p: Column) -> Column:
        ahead = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(ahead, F.lit(3).cast("long"), lambda s, x: s + x))

    found = F.transform(F.array(keys), by_hash)[0]
    found = F.when(n > 1 << POSITION_BITS, by_words()).otherwise(found)
    return F.coalesce(found, F.lit(0).cast("long"))


def line_passes(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word."""
    bare = F.trim(line)
    n = F.length(bare)
    symbols = n - F.length(F.translate(bare, SYMBOLS + "{}[]\\^~=_@", ""))
    shouts = F.length(F.regexp_replace(bare, r"[^!]+", ""))
    separators = n - F.length(F.translate(bare, "|»›•·", ""))
    ended = bare.rlike(r"[.!?…:;,)\]\"'”»]$")
    n_words = F.size(F.split(bare, SPACE))
    return (
        (symbols * 12 <= n)
        & (shouts * 3 <= n_words)
        & ~((separators >= 2) & (separators * 4 >= n_words))
        & (ended | (n_words >= 8))
        & ~bare.rlike(BOILERPLATE)
    )


def rate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, clean_text (passing lines, repeated ones too), the base figures, base_failed and kept.

    What is kept is judged by distinct passing lines, so that a line that is said again and again saves no document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = given(docs.select(F.col(id_col).alias("id"), text.alias("t")), ["id", "t"], w=words(F.col("t")), lines=F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    rows = given(rows, ["id", "t", "w", "lines"], h=F.transform("w", lambda x: F.xxhash64(x)), good=F.filter("lines", line_passes))
    chars = F.length(F.translate("t", SPACES, "")).cast("long")
    n_words = F.size("w").cast("long")
    rows = given(
        rows,
        ["id"],
        clean_text=F.array_join("good", "\n"),
        n_words=n_words,
        word_chars=chars,
        n_symbols=(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("w"), F.col("h")),
        good_chars=F.length(F.translate(F.array_join(F.array_distinct("good"), ""), SPACES, "")).cast("long"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select(
        F.col("id").alias(id_col), "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("good_chars") >= MIN_KEPT * F.col("word_chars"))).alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_lines(read(spark, sf_dir, "documents")).drop("clean_text")
