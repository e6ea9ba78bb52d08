"""Plain versions of the operators, by definition, for small tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import public_tokenizers
import regex
import sentencepiece
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, n=13):
    """{doc_id: (n_words, n_removed, sha256)} for rows of distinct ids."""
    least = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(d, least.get(k, d))
    out = {}
    for d, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def token_ids(text, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def base_pii(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, text or "") if ok(m[0])]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen, at = defaultdict(int), set()
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])] += 1
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            at |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(at), len(w) < 50 or 100 * len(at) > 50 * len(w)


def jaccard(docs, n=4, percent=85):
    """{doc_id: (n_shingles, component_id, number of other sets that its set links with)}"""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, text in docs:
        w = words((text or "").translate(lower))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    near = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
                if sets[a] != sets[b]:
                    near[a].add(frozenset(sets[b]))
                    near[b].add(frozenset(sets[a]))
    return {d: (len(s), root(d), len(near[d])) for d, s in sets.items()}


UNITS = set("mm cm m km kg g mg lb lbs oz km/h mph ml l cl ft inch inches feet miles mile meters metres seconds minutes hours days weeks months years percent dollars euros cents pounds usd eur gbp hz khz mhz ghz kb mb gb tb".split())
BLANK = "\x20\t\n\x0b\f\r"


def template(text):
    """(kind, value) of each token by the rules of templates; kinds are "#" numbers, "@" names, "u" units, or the word."""
    text = re.sub("[\x01-\x03]", "", text or "")
    out = []
    for m in re.finditer(f"[^{BLANK}]+", text):
        word, before = m[0], text[max(0, m.start() - 2) : m.start()]
        named = len(before) == 2 and before[1] == " " and before[0] not in BLANK + ".!?:…" and regex.match(r"\p{Lu}\p{Ll}", word)
        kind = "#" if re.search("[0-9]", word) else "@" if named else ""
        value = re.sub(r"[.,;:!?\"'()\[\]{}«»„“”‘’…]+", "", word).lower()
        if value or kind:
            out.append((kind or ("u" if value in UNITS else value), value))
    return out


def contaminated(docs, items, window=8, literals=4, enough=6):
    """{(doc row, item row): n_windows} by comparing every item with every place of every document."""
    literal = lambda t: t[0] not in ("#", "@", "u")
    out = {}
    theirs = []
    for item, text in items:
        t = template(text)
        rich = lambda ts, i, more=0: sum(map(literal, ts[i : i + window])) + more >= literals
        places = range(len(t) - window + 1)
        usable = sum(rich(t, i) for i in places)
        scarce = usable < max(1, min(enough, len(t) - window + 1))
        named = bool(t) and t[0][0] not in ("#", "@") and regex.match(r"[^\p{L}\p{N}]*\p{Lu}\p{Ll}", text)
        forms = [t] + ([[("@", t[0][1]), *t[1:]]] if named else [])
        cuts = [(i, f, i) for f, ts in enumerate(forms) for i in places if rich(ts, i, f and i == 0) and (scarce or not f or i == 0)]
        theirs.append((item, t, forms, cuts, usable, scarce))
    for d, text in docs:
        mine = template(text)
        at = defaultdict(list)
        for i in range(len(mine) - window + 1):
            at[tuple(k for k, _ in mine[i : i + window])].append(i)
        for item, t, forms, cuts, usable, scarce in theirs:
            met = defaultdict(set)
            for i, f, _ in cuts:
                for p in at[tuple(k for k, _ in forms[f][i : i + window])]:
                    met[p - i, f if scarce else 0].add((i, f))
            for (shift, f), found in met.items():
                whole = [(0, len(t))] if scarce else [(i, i + window) for i, _ in found]
                slots = set()
                fits = True
                for a, b in whole:
                    ours = mine[shift + a : shift + b] if shift + a >= 0 else []
                    form = forms[f] if scarce else None
                    for k in range(b - a):
                        x = form[a + k] if scarce else next((forms[g][a + k] for i, g in found if i == a), None)
                        if k >= len(ours) or (scarce and ours[k][0] != x[0]):
                            fits = False
                            break
                        if not literal(x):
                            slots.add((x, ours[k]))
                n = len({i for i, _ in found})
                if fits and len(slots) == len({a for a, _ in slots}) and (scarce or n >= min(enough, usable)):
                    out[d, item] = max(n, out.get((d, item), 0))
            values = [v for _, v in t]
            if scarce and t and any([v for _, v in mine[p : p + len(t)]] == values for p in range(len(mine))):
                out[d, item] = max(usable, 1, out.get((d, item), 0))
    return out


def vector_codes(rows, n_parts=8, n_entries=16, rounds=6):
    """([(vec_id, code, error, label_error)], codebooks_sha256) of rows (vec_id, vector, label) whose vectors are kept, by Python's integers."""
    kept = [(d, [math.floor(4096 * x) for x in v], label) for d, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // n_parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    first = sorted(kept, key=lambda x: (x[0] is None, x[0], x[1]))[:n_entries]
    books = [[part(v, p) for _, v, _ in first] for p in range(n_parts)]
    nearest = lambda v, p: min((far(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        owned = [[[] for _ in first] for _ in range(n_parts)]
        for _, v, _ in kept:
            for p in range(n_parts):
                owned[p][nearest(v, p)[1]].append(part(v, p))
        books = [[[sum(c) // len(vs) for c in zip(*vs)] if vs else e for vs, e in zip(owned[p], books[p])] for p in range(n_parts)]
    out, sums = [], defaultdict(int)
    for d, v, label in kept:
        found = [nearest(v, p) for p in range(n_parts)]
        out.append((d, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
        sums[label] += out[-1][2]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(d, c, e, sums[label]) for d, c, e, label in out], hashlib.sha256(text.encode()).hexdigest()


def token_bytes(text):
    """(id, bytes) of each token of both sides, or None; byte-level letters by the library's own decoder table."""
    if not text:
        return None
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own}
    for b in range(256):
        if b not in own:
            letters[chr(256 + len(letters) - len(own))] = b
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in s.encode(text):
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def alignment(docs):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products)], by comparing the ranges of all tokens of a group."""
    found, holders = [], defaultdict(int)
    for d, text in docs:
        sides = token_bytes(text)
        links, groups = [], []
        if sides:
            spans = [[], []]
            for side, out in zip(sides, spans):
                at = 0
                for i, x in side:
                    out.append((i, at, at + len(x)))
                    at += len(x)
            ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            low, x, y = 0, 0, 0
            for e in ends:
                u, v = x, y
                while x < len(spans[0]) and spans[0][x][2] <= e:
                    x += 1
                while y < len(spans[1]) and spans[1][y][2] <= e:
                    y += 1
                groups.append((spans[0][u:x], spans[1][v:y]))
                links += [(i, j) for i, s, t in spans[0][u:x] for j, p, q in spans[1][v:y] if max(s, p) < min(t, q)]
        for pair in set(links):
            holders[pair] += 1
        found.append((d, sides, groups, links))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    out = []
    for d, sides, groups, links in found:
        text = ";".join(",".join(str(i) for i, _, _ in x) + "|" + ",".join(str(i) for i, _, _ in y) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if sides else ""
        n_a, n_b = map(len, sides or ((), ()))
        out.append((d, n_a, n_b, len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), digest, sum(len(x) * len(y) for x, y in groups)))
    return out
