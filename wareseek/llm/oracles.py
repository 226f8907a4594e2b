"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _located(kind: int, pattern: str, group: int = 0) -> str:
    """Matches with their places: a match starts after the pieces and matches before it."""
    return f"""
  SELECT doc_id, {kind} AS kind, body,
         (sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) - size)::BIGINT AS s,
         sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e
  FROM (SELECT doc_id, i, length(gaps[i]) AS gap, length(found[i]) AS size, bodies[i] AS body
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps,
                           regexp_extract_all(text, '{pattern}') AS found,
                           regexp_extract_all(text, '{pattern}', {group}) AS bodies FROM d)))"""


#: c * log2(c) in millionths, for counts c from 0 to the window's 20 characters.
_WEIGHTS = "list_transform(range(0, 21), lambda c: CASE WHEN c > 0 THEN round(c * log2(c) * 1e6) ELSE 0 END)"

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, kind, s, e FROM ({_located(0, _ASSIGN, 2)}) WHERE length(body) >= 12
  UNION ALL SELECT doc_id, kind, s, e FROM ({_located(1, 'AKIA[A-Z0-9]+')}) WHERE e - s >= 18
  UNION ALL SELECT doc_id, kind, s, e FROM ({_located(2, '[0-9a-f]+')}) WHERE e - s >= 16
),
runs AS (
  SELECT doc_id, body, s FROM ({_located(3, '[A-Za-z0-9+/_=-]{20,}')})
  WHERE regexp_matches(body, '[0-9]')
    AND NOT regexp_matches(body, '(?i)example|sample|dummy|placeholder|changeme|xxxx')
    AND NOT regexp_matches(body, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
    AND NOT regexp_matches(body, '^sha(1|256|384|512)-')
    AND NOT regexp_matches(body, '0123456789|abcdefghijkl|ABCDEFGHIJKL')
),
windows AS (
  SELECT doc_id, s, i, substring(body, i, 20) AS part FROM (SELECT *, unnest(range(1, length(body) - 18)) AS i FROM runs)
),
weighed AS (
  SELECT doc_id, s, i, part, sum(weight) AS weight
  FROM (SELECT doc_id, s, i, any_value(part) AS part, c, ({_WEIGHTS})[count(*) + 1] AS weight
        FROM (SELECT *, unnest(string_split(part, '')) AS c FROM windows) GROUP BY doc_id, s, i, c)
  GROUP BY doc_id, s, i, part
),
high AS (
  SELECT doc_id, s, i, i - lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) AS step FROM weighed
  WHERE CASE WHEN regexp_full_match(part, '[0-9a-fA-F]+')
             THEN weight <= floor(20 * (log2(20) - 3.0) * 1e6) AND length(regexp_replace(part, '[^0-9]', '', 'g')) >= 3
             ELSE weight <= floor(20 * (log2(20) - 3.75) * 1e6) AND regexp_matches(part, '[0-9]')
                  AND regexp_matches(part, '[A-Z]') AND regexp_matches(part, '[a-z]') END
),
islands AS (
  SELECT doc_id, s, i, count(*) FILTER (step IS NULL OR step > 20) OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM high
),
added AS (
  SELECT doc_id, 3 AS kind, s + min(i) - 1 AS s, s + max(i) + 19 AS e FROM islands GROUP BY doc_id, islands.s, island
),
every AS (
  SELECT doc_id, kind, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS span, s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added)
),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
         coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
         string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM every GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN listed USING (doc_id)"""

#: Control strings whose first character gets a backslash behind it.
_CONTROLS = (
    "<|", "<s>", "</s>", "<unk>", "<pad>", "<mask>", "<<SYS>>", "<</SYS>>",
    "[INST]", "[/INST]", "[CLS]", "[SEP]", "[PAD]", "[MASK]",
)


def _written(column: str) -> str:
    """Length of an escaped text."""
    parts = [f"length({column})", f"length({column}) - length(replace({column}, '\\', ''))"]
    for control in _CONTROLS:
        lower = f"lower({column})"
        parts.append(f"(length({lower}) - length(replace({lower}, '{control.lower()}', ''))) // {len(control)}")
    return " + ".join(f"({p})" for p in parts)


OP5 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, sum(length('<|turn|><|text|><|end|>') + {_written('role')} + {_written('text')}) OVER before AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM turns WINDOW before AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS part
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w)
),
firsts AS (SELECT part, min(doc_id) AS first FROM windows GROUP BY part),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (part) WHERE first < doc_id
),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w)
  ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
),
reached(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT w.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM w JOIN reached ON a = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id GROUP BY w.doc_id"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format("text")} AS words FROM d),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
repeated AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY 1
),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
),
f AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (n_dup_lines > 4 AND 2 * n_dup_lines > n_lines)::BIGINT
             + 16 * (5 * n_exclaims > n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 63 = 0 AS kept, failed
FROM f"""

OP8_ABLATIONS = f"""
WITH ledger AS ({OP8}),
rules(rule, bit) AS (
  VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8), ('exclamations', 16), ('long_words', 32)
)
SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & 63 = bit) AS n_only
FROM ledger CROSS JOIN rules GROUP BY rule"""

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '{_ITEM_TERM}') AS terms
  FROM documents
),
sizes AS (SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_SMALL.format("text")}, '{_ITEM_TERM}')) AS term FROM benchmark),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM items) GROUP BY r, doc_id, n, term
),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term
),
scored AS (
  SELECT item_id, r, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term), sizes GROUP BY item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_SMALL.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
),
lang_n AS (SELECT lang, sum(c)::HUGEINT AS n FROM counts GROUP BY lang),
p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN kept ON n.lang = kept.lang JOIN v ON v.lang = n.lang
       LEFT JOIN counts ON counts.lang = n.lang AND counts.source = n.source AND counts.term = kept.term
),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (any_value(n) + 2 * any_value(v)) AS q
  FROM counts JOIN lang_n USING (lang) JOIN v USING (lang) GROUP BY lang, term
),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM n a JOIN n b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
