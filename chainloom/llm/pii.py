"""Personal data by a semi-Markov conditional random field, above fixed base patterns.

Tokens of a region are segmented into entities of at most MAX_TOKENS tokens and other tokens. A candidate segment is
scored by features of the whole span (shape, digits, checksum, letter mix, randomness, the words before it), label by
label; bounded-entity dynamic programming finds the best segmentation, boundaries and types together. A segment has
a digit or @, or is the token after a cue word of secrets (`password=correcthorse`), so only regions around such characters
and words are decoded; other segments are never candidates. Weights are
fitted by conditional likelihood on generated sentences (`examples`), deterministic and the same on every machine.

Base spans always stay; the field's spans are added where they overlap none. Null text counts as empty: no spans.
Repeated rows are each judged alone; other columns are ignored. Regions reach to white space and don't overlap; a token
of any length is a candidate, segments of several tokens have at most MAX_CHARS characters, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS, "secret", "id"]
MAX_TOKENS, MAX_CHARS, REGION, N_WEIGHTS, N_FEATURES = 9, 120, 160, 4096, 16
#: Texts whose masked forms are held as Python strings at once.
MASKED_ROWS = 500
LOCAL = "".join(map(chr, range(128)))
LOCAL = "".join(c for c in LOCAL if c.isalnum() or c in "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
TRIGGER = re.compile("[0-9@]")
TOKEN = re.compile(r"[A-Za-z0-9_%+@](?:[A-Za-z0-9._%+@/-]*[A-Za-z0-9_%@/])?|[^\s]")
#: Words that announce a kind.
CUES = {
    "secret": "password passwd pwd pass secret token key apikey api_key api access auth bearer credential".split(),
    "phone": "phone tel call fax mobile cell telefon".split(),
    "id": "ssn social passport iban nif dni licence license".split(),
    "ip": "ip host server address".split(),
    "card": "card visa mastercard credit".split(),
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws}
#: What a region stands around.
HINT = re.compile(rf"[0-9@]|(?<![^\W_])(?:{'|'.join(CUES['secret'])})(?![^\W_])", re.I)
MARKS = "=:\"'({["


def cue_of(word: str) -> str | None:
    """The kind that a lower-case word, or its last part, announces."""
    return CUE_OF.get(word) or CUE_OF.get(word.rpartition("_")[2])


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind, then start. Emails are found from their @, so long runs stay linear."""
    found: list[tuple[str, int, int]] = []
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(LOCAL))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", free)
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def shape(span: str) -> str:
    """Digits as 9, letters as a or A, runs collapsed."""
    out = []
    for c in span:
        k = "9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


@lru_cache(1 << 14)
def weight_of(feature: str) -> int:
    """The place of a feature's weights."""
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=2).digest(), "little") % N_WEIGHTS


def features(tokens: list[tuple[str, int, int]], i: int, j: int, text: str) -> list[int]:
    """Hashed features of the span of tokens i .. j - 1 and of what stands before it."""
    span = text[tokens[i][1] : tokens[j - 1][2]]
    digits = NOT_DIGIT.sub("", span)
    letters = sum(c.isalpha() for c in span)
    form = shape(span)
    tally = [span.count(c) for c in set(span)]
    spread = -sum(n / len(span) * math.log2(n / len(span)) for n in tally)
    before = [t[0].lower() for t in tokens[max(0, i - 5) : i] if t[0] not in MARKS][-2:]
    cue = next((c for w in reversed(before) if (c := cue_of(w))), "none")
    sign = next((t[0] for t in reversed(tokens[max(0, i - 2) : i]) if t[0] in "=:"), "")
    n = len(digits)
    mixed = min(6, len(form) // 3)
    named = [
        "b", f"s{form[:14]}", f"n{min(n, 20)}", f"l{min(len(span) // 4, 12)}", f"k{j - i}", f"c{cue}", f"c{cue}{sign}",
        f"m{n > 0}{letters > 0}{'@' in span}{span.isascii()}", f"r{int(2 * spread)}", f"x{mixed}", f"u{span.isupper()}{mixed}",
        f"d{'@' in span}{'.' in span.partition('@')[2]}", f"v{16 <= n <= 19 and luhn(digits)}{letters > 0}", f"p{'+' in span[:1]}{8 <= n <= 15}{letters > 0}",
        f"h{len(span) >= 16}{letters > 0}{n > 0}{all(c in '0123456789abcdef' for c in span)}", f"q{len(span) >= 16}{span[:4] if span[:4].isupper() else ''}",
    ]
    return [*map(weight_of, named)]


class Region:
    """Tokens of a stretch of text and its candidate segments."""

    def __init__(self, text: str, low: int, high: int):
        self.text = text
        self.tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text, low, high)]
        n = len(self.tokens)
        hot = [bool(TRIGGER.search(t)) for t, _, _ in self.tokens]
        self.spans, cued = [], False
        for i in range(n):
            word = self.tokens[i][0]
            if cued and not hot[i] and word[0].isalnum():
                self.spans.append((i, i + 1))
            cued = cue_of(word.lower()) == "secret" or cued and word in MARKS
            if not (hot[i] or self.tokens[i][0] in "(+"):
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                if j > i + 1 and "\n" in text[self.tokens[j - 2][2] : self.tokens[j - 1][1]]:
                    break
                if hot[j - 1] and (j == i + 1 or self.tokens[j - 1][2] - self.tokens[i][1] <= MAX_CHARS):
                    self.spans.append((i, j))
        self.active = np.array([features(self.tokens, i, j, text) for i, j in self.spans], np.int64).reshape(-1, N_FEATURES)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of each span under each label but the first; other tokens score 0."""
        return weights[self.active].sum(1) if len(self.spans) else np.zeros((0, len(LABELS) - 1))

    def best(self, weights: np.ndarray) -> list[tuple[str, int, int]]:
        """The entities of the best segmentation."""
        scores, n = self.scores(weights), len(self.tokens)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        ending: dict[int, list[int]] = {}
        for k, (_, j) in enumerate(self.spans):
            ending.setdefault(j, []).append(k)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending.get(j, ()):
                label = int(scores[k].argmax())
                if (v := value[self.spans[k][0]] + float(scores[k, label])) > value[j]:
                    value[j], back[j] = v, (k, label)
        found, j = [], n
        while j:
            if back[j] is None:
                j -= 1
                continue
            k, label = back[j]
            i = self.spans[k][0]
            found.append((LABELS[1 + label], self.tokens[i][1], self.tokens[j - 1][2]))
            j = i
        return found[::-1]

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each (span, label), by the forward and backward sums over segmentations."""
        scores, n = self.scores(weights), len(self.tokens)
        total = np.logaddexp.reduce(scores, 1) if len(self.spans) else np.zeros(0)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        order = sorted(range(len(self.spans)), key=lambda k: self.spans[k][1])
        at = 0
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            while at < len(order) and self.spans[order[at]][1] == j:
                ahead[j] = np.logaddexp(ahead[j], ahead[self.spans[order[at]][0]] + total[order[at]])
                at += 1
        starting: dict[int, list[int]] = {}
        for k, (i, _) in enumerate(self.spans):
            starting.setdefault(i, []).append(k)
        for i in range(n - 1, -1, -1):
            behind[i] = behind[i + 1]
            for k in starting.get(i, ()):
                behind[i] = np.logaddexp(behind[i], behind[self.spans[k][1]] + total[k])
        outer = np.array([ahead[i] + behind[j] - ahead[n] for i, j in self.spans])
        return np.exp(scores + outer[:, None])


def examples(n: int = 3000, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with their entities: every kind in several forms, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "ou", "sch", "ción", "é"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def card(sep: str) -> str:
        d = r.choice("3456") + digits(14)
        d = next(d + c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def no_card() -> str:
        d = r.choice("0123456789") + digits(14)
        return next(d + c for c in digits(1) + "01" if not luhn(d + c))

    def long() -> str:
        """Web tokens and long keys."""
        chars = upper + upper.lower() + "0189"
        return r.choice([f"eyJ{some(chars, 33)}.eyJ{some(chars, r.randint(60, 600))}.{some(chars, 43)}", some("0123456789abcdef", r.choice([128, 256])), some(chars + "_-", r.randint(130, 900)) + "7"])

    fours = lambda v: " ".join(v[i : i + 4] for i in range(0, len(v), 4))
    forms = {
        "email": lambda: f"{word()}.{digits(2)}@{r.choice(['mail', 'post'])}{digits(1)}.example.{r.choice(['com', 'org', 'net'])}" if r.random() < 0.6 else f"{some('abcdefgh', 5)}{digits(2)}@{some('xyzuvw', 5)}.de",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: card(r.choice(["", " ", "-"])),
        "phone": lambda: r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(30, 49)} {digits(3)} {digits(7)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
        "secret": lambda: r.choice([some("0123456789abcdef", r.choice([18, 32, 40])), "AKIA" + some(upper, 16), "ghp_" + some(upper + "abcdefgh0189", 36), "sk_live_" + some("abcdefgh0189ABC", 24)]) if r.random() < 0.7 else long(),
        "passphrase": lambda: some("abcdefghijklmnoprstuw", r.randint(7, 16)),
        "id": lambda: r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"DE{digits(20)}", f"GB{digits(2)}ABCD{digits(14)}", fours(f"DE{digits(20)}"), fours(f"MT{digits(2)}MALT{digits(23)}"), fours(f"NO{digits(13)}")]),
    }
    lead = {"secret": ["password=", 'token = "', "api_key: ", "secret ", "Authorization: Bearer ", "", ""], "passphrase": ["password=", 'passwd = "', "pwd: ", "secret=", "password: "], "phone": ["call ", "phone: ", "", ""], "id": ["SSN ", "ssn: ", "IBAN ", "passport "]}
    plain = [
        lambda: str(r.randint(1900, 2030)), lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"Version {r.randint(1, 3)}.0.", lambda: f"{r.randint(1, 999)},{digits(3)}",
        lambda: f"{r.randint(1, 9999)}", lambda: f"${r.randint(1, 99)}.{digits(2)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2024)}", lambda: f"20{digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"item {digits(6)}", lambda: f"@{word()}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{r.randint(2, 90)}%", lambda: f"page {digits(2)}",
        lambda: no_card(), lambda: no_card(), lambda: no_card(),
        lambda: f"{digits(3)} {digits(2)} {digits(3)}", lambda: f"{word()}{r.randint(2, 9)}", lambda: f"MP{r.randint(3, 4)}", lambda: f"{r.randint(10, 400)}km", lambda: f"#{digits(5)}", lambda: f"{digits(9)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}",
        *[lambda: f"{r.choice(CUES['secret'])} {word()}"] * 4,
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 2)):
            text += " " if text else ""
            if r.random() < 0.45:
                text += r.choice(plain)()
            else:
                kind = r.choice(list(forms))
                opening = r.choice(lead.get(kind, [""]))
                value = forms[kind]()
                spans.append(("secret" if kind == "passphrase" else kind, len(text) + len(opening), len(text) + len(opening) + len(value)))
                text += opening + value + ('"' if opening.endswith('"') else "")
            text += r.choice([".", ",", "", ""]) + " " + " ".join(word() for _ in range(r.randint(1, 4)))
        out.append((text, spans))
    return out


@lru_cache(1)
def model() -> np.ndarray:
    """Weights (feature, label but the first), by adaptive gradient steps on the regularised conditional likelihood."""
    data = []
    for text, spans in examples():
        region = Region(text, 0, len(text))
        gold = np.zeros((len(region.spans), len(LABELS) - 1))
        at = {(s, e): k for k, s, e in spans}
        for row, (i, j) in enumerate(region.spans):
            if kind := at.get((region.tokens[i][1], region.tokens[j - 1][2])):
                gold[row, LABELS.index(kind) - 1] = 1
        if len(region.spans):
            data.append((region, gold))
    weights, squares = np.zeros((N_WEIGHTS, len(LABELS) - 1)), np.full((N_WEIGHTS, len(LABELS) - 1), 1e-2)
    for _ in range(8):
        for region, gold in data:
            step = gold - region.expected(weights)
            change = np.zeros_like(weights)
            np.add.at(change, region.active.ravel(), np.repeat(step, region.active.shape[1], 0))
            rows = np.unique(region.active)
            change = change[rows] - 1e-3 * weights[rows]
            squares[rows] += change**2
            weights[rows] += 0.3 * change / np.sqrt(squares[rows])
    return weights


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers and cue words, REGION / 4 characters either side, to the nearest white space; none overlap."""
    reach, low, high = REGION // 4, None, 0
    for m in HINT.finditer(text):
        if low is not None and m.end() + reach <= high:
            continue
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        while a > high and not text[a - 1].isspace():
            a -= 1
        if low is None or a > high:
            if low is not None:
                yield low, high
            low = a
        high = max(high, b)
        while high < len(text) and not text[high].isspace():
            high += 1
    if low is not None:
        yield low, high


def found_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans (base and the field's), each by kind as listed, then start."""
    base = base_spans(text)
    starts, ends = zip(*sorted((s, e) for _, s, e in base)) if base else ((), ())
    reach = [0, *accumulate(ends, max)]  # the furthest end of the first k base spans
    added = []
    for low, high in regions(text):
        for span in Region(text, low, high).best(weights):
            if reach[bisect_left(starts, span[2])] <= span[1]:
                added.append(span)
    return base, sorted({*base, *added}, key=lambda x: (LABELS.index(x[0]), x[1], x[2]))


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by base kind, base_sha256, spans and n_added of each row."""
    weights = model() if weights is None else weights
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                base, spans = found_spans(text.as_py() or "", weights)
                kinds = [k for k, _, _ in base]
                out.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = zip(*out) if out else [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]))], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kept.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return kept.mapInArrow(rows, schema).withColumnRenamed("id", id_col)


def masked(docs: DataFrame, weights: np.ndarray | None = None, text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; columns and their order stay."""
    weights = model() if weights is None else weights

    def one(text):
        if text is None or not HINT.search(text):
            return text
        out, at = [], 0
        for kind, s, e in sorted(found_spans(text, weights)[1], key=lambda x: (x[1], -x[2])):
            if e > at:
                out += [text[at : max(s, at)], f"<{kind}>" if s >= at else ""]
                at = e
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    @lean
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([pa.array([one(t.as_py()) for t in texts[k : k + MASKED_ROWS]], texts.type) for k in range(0, max(1, len(texts)), MASKED_ROWS)])

    return docs.withColumn(text_col, mask(text_col))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents")).drop("n_added")
