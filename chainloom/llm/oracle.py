"""SQL of the text queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .quality_rules import MAX_REPEATED, MIN_KEPT, MIN_WORDS
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
TEXT = "coalesce(text, '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bare_length(text: str) -> str:
    """Length without the separators of words."""
    return rf"length(regexp_replace({text}, '[\x20\x09-\x0D]', '', 'g'))"


def count_of(letters: str, text: str) -> str:
    """How many characters of a class a text has; letters: the inside of a bracket."""
    return f"length(regexp_replace({text}, '[^{letters}]', '', 'g'))"


OP1 = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, {WORDS.format(TEXT)} AS w FROM documents)),
windows AS (
  SELECT doc_id, pos, word, CASE WHEN lead(word, 12) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS passage
  FROM words),
firsts AS (SELECT passage, min(doc_id) AS first_doc FROM windows WHERE passage IS NOT NULL GROUP BY passage),
marked AS (SELECT w.doc_id, pos, word, coalesce(first_doc < w.doc_id, false) AS starts FROM windows w LEFT JOIN firsts f ON w.passage = f.passage),
judged AS (
  SELECT doc_id, pos, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS removed
  FROM marked)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""

OP7 = rf"""
WITH texts AS (SELECT doc_id, {TEXT} AS t, {WORDS.format(TEXT)} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS three
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
starts AS (SELECT doc_id, pos, three IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, three) > 1 AS again FROM windows),
inside AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS repeated FROM starts),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE repeated) AS n FROM inside GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
worded AS (SELECT doc_id, line, trim(line, ' ') AS bare FROM lines WHERE {bare_length("line")} > 0),
rated AS (
  SELECT doc_id, line, len(regexp_split_to_array(bare, '[\x20\x09-\x0D]+')) AS n_words, length(bare) AS n,
    {count_of(r"#*$%&|<>{}\[\]\\^~=_@", "bare")} AS symbols, {count_of("!", "bare")} AS shouts, {count_of("|»›•·", "bare")} AS separators,
    regexp_matches(bare, '[.!?…:;,)\]"''”»](\r|\x{{85}}|\x{{2028}}|\x{{2029}})?$') AS ended,
    regexp_matches(bare, '(?i)(^\s*©|(^|[^a-z])(all rights reserved|cookie (policy|settings)|privacy policy|terms of (use|service)|licensed under the|released under the|subscribe to our|sign up for|click here|share (this|on)|javascript (is|must be)|alle rechte vorbehalten|datenschutz(erkl.rung|hinweise)|nutzungsbedingungen|cookie-(richtlinie|einstellungen)|newsletter abonnieren|hier klicken|klicken sie hier|tous droits r.serv.s|politique de (confidentialit|cookies)|mentions l.gales|conditions (g.n.rales )?d.utilisation|abonnez-vous|cliquez ici|partager sur|todos los derechos reservados|pol.tica de (privacidad|cookies)|aviso legal|t.rminos (de uso|y condiciones)|suscr.bete|haga? clic aqu|compartir en))') AS boilerplate
  FROM worded),
passing AS (
  SELECT DISTINCT doc_id, line FROM rated
  WHERE symbols * 12 <= n AND shouts * 3 <= n_words AND NOT (separators >= 2 AND separators * 4 >= n_words) AND (ended OR n_words >= 8) AND NOT boilerplate),
good AS (SELECT doc_id, sum({bare_length("line")}) AS chars FROM passing GROUP BY doc_id),
duplicates AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
figures AS (
  SELECT t.doc_id, len(w) AS n_words, {bare_length("t.t")} AS word_chars, {count_of("#*$%&|<>", "t.t")} AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(g.chars, 0) AS good_chars
  FROM texts t LEFT JOIN duplicates d ON t.doc_id = d.doc_id LEFT JOIN repeats r ON t.doc_id = r.doc_id LEFT JOIN good g ON t.doc_id = g.doc_id),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * good_chars >= {MIN_KEPT} * word_chars AS kept
FROM failed
"""

OP8 = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
lasts AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < response THEN response END AS refers_to
FROM lasts
"""

OP9 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS.format(f"translate({TEXT}, '{UPPER}', '{LOWER}')")} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
shingles AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle
  FROM words),
grams AS (SELECT DISTINCT doc_id, shingle FROM shingles WHERE pos <= greatest(1, n - 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
classes AS (SELECT doc_id, md5(string_agg(shingle, ' ' ORDER BY shingle)) AS class FROM grams GROUP BY doc_id),
degrees AS (
  SELECT e.a, count(DISTINCT y.class) AS n FROM edges e JOIN classes x ON e.a = x.doc_id JOIN classes y ON e.b = y.doc_id
  WHERE x.class <> y.class GROUP BY e.a),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a)
SELECT r.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id, coalesce(max(d.n), 0) AS n_links
FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id LEFT JOIN degrees d ON r.doc_id = d.a GROUP BY r.doc_id
"""

OP13 = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {WORDS.format(f"translate({TEXT}, '{UPPER}', '{LOWER}')")} AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM texts),
shingles AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS shingle
  FROM words),
grams AS (SELECT DISTINCT doc_id, shingle FROM shingles WHERE pos <= greatest(1, n - 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a)
SELECT r.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id, min(r.other) = r.doc_id AS kept
FROM reached r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""


def op11(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> str:
    """Rounds of Lloyd on 8 components a part, unrolled: the nearest entry of each part, then the floors of the means."""
    far = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = f"SELECT p.vec_id, p.part, arg_min(b.entry, {far} * {entries} + b.entry) AS entry, min({far}) AS far FROM parts p JOIN {{}} b ON p.part = b.part GROUP BY p.vec_id, p.part"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, k AS part, v[k * len(v) // {parts} + 1 : (k + 1) * len(v) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS k)),
book0 AS MATERIALIZED (
  SELECT part, r - 1 AS entry, v FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS r FROM parts) WHERE r <= {entries})"""]  # fmt: skip
    for k in range(rounds):
        steps.append(f"""
near{k} AS MATERIALIZED ({nearest.format(f"book{k}")}),
means{k} AS (
  SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS v
  FROM (SELECT part, entry, place, CAST(sum(x) AS DOUBLE) AS total, count(*) AS n
    FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM parts JOIN near{k} USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""WITH {",".join(steps)},
last AS MATERIALIZED ({nearest.format(f"book{rounds}")}),
codes AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', l.entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM kept k JOIN last l ON k.vec_id = l.vec_id GROUP BY k.vec_id, k.label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest
"""


ORACLE_SQL = {"op1_substring_dedup": OP1, "op7_quality_rules": OP7, "op8_warc": OP8, "op9_jaccard_join": OP9, "op11_vector_codes": op11(), "op13_near_duplicates": OP13}
