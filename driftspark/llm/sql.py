"""SQL twins of the corpus queries, for DuckDB.

Left out: token ids (op5, op8), XXH64 fingerprints (op6), trained classifiers (op10) and the
pipeline, which SQL cannot express; and disclosure over regular expressions with positions
(op4), which is tested against brute force.
"""

from __future__ import annotations

from driftspark.llm import quality as ql
from driftspark.llm.common import LOWER, UPPER, WORD
from driftspark.llm.mixing import KEY_BITS, MAX_EPOCHS, SEED, WEIGHTS
from driftspark.llm.queries import DAYS, FIRST_DAY, LONGEST_NAME

WEIGHT = f"([{', '.join(map(str, WEIGHTS))}])[(i % {len(WEIGHTS)}) + 1]"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         ('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {KEY_BITS // 4}))::BIGINT AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, {WEIGHT}::DOUBLE AS w FROM sources
), walked AS (
  SELECT *, row_number() OVER walk AS nth,
         (sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS} * source_size) OVER (
            ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per
  FROM weighed WINDOW walk AS (ORDER BY source_size / w, i)
), settled AS (
  SELECT *, {MAX_EPOCHS} * source_size < per * w AS stops FROM walked
), targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN ({MAX_EPOCHS} * source_size)::DOUBLE
              ELSE least((arg_min(per, nth) FILTER (NOT stops) OVER ()) * w, ({MAX_EPOCHS} * source_size)::DOUBLE)
         END AS target
  FROM settled
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS times FROM placed
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (times * size + greatest(0, least(floor(target) - times * source_size - ahead, size)))::BIGINT AS taken
FROM epochs
"""

EXACT_DEDUP = f"""
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
), ranked AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM texts
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text: every byte and eight shifts, one after another."""
    shifts = ", ".join(["-1"] * 8)
    return (
        f"xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({text}, ''),"
        f" lambda ch: [ascii(ch)::BIGINT, {shifts}])), lambda c, e: CASE WHEN e >= 0 THEN xor(c, e)"
        " WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    )


def _leaf(text: str) -> str:
    part = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _rising(name: str, base: str) -> str:
    """All levels of the trees over (tree, pos, nodes, h) of ``base``: every three make one."""
    return f"""{name} AS (
  SELECT 0 AS lvl, tree, pos, nodes, h FROM {base}
  UNION ALL
  SELECT lvl + 1, tree, pos // 3, (nodes + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM {name} WHERE nodes > 1 GROUP BY lvl, tree, pos // 3, nodes
)"""


def _folding(name: str, levels: str, base: str) -> str:
    """(id, tree, pos, lvl, node, siblings) of ``base``, folded along ``levels`` to the top."""
    run = f"FROM {levels} r WHERE r.lvl = f.lvl AND r.tree = f.tree AND r.pos // 3 = f.pos // 3 AND r.pos"
    before = f"coalesce((SELECT string_agg(h, '' ORDER BY pos) {run} < f.pos), '')"
    after = f"coalesce((SELECT string_agg(h, '' ORDER BY pos) {run} > f.pos), '')"
    return f"""{name} AS (
  SELECT id, tree, pos, 0 AS lvl, node, siblings, nodes FROM {base}
  UNION ALL
  SELECT id, tree, pos // 3, lvl + 1, sha256({before} || node || {after}), siblings || {before} || {after}, (nodes + 2) // 3
  FROM {name} f WHERE nodes > 1
)"""


MANIFEST = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, source, row_number() OVER () AS id, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, leaf AS h,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS nodes
  FROM found
), {_rising("low", "leaves")}, subroots AS (
  SELECT 0 AS tree, tree AS pos, count(*) OVER () AS nodes, h FROM low WHERE nodes = 1
), {_rising("high", "subroots")}, starts AS (
  SELECT id, tree, pos, nodes, now AS node, '' AS siblings FROM leaves
), {_folding("inside", "low", "starts")}, middles AS (
  SELECT f.id, 0 AS tree, f.tree AS pos, s.nodes, f.node, f.siblings
  FROM inside f JOIN subroots s ON s.pos = f.tree WHERE f.nodes = 1
), {_folding("outside", "high", "middles")}
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(o.siblings) AS proof_sha256,
       o.node AS folded_root, o.node = r.h AS verified
FROM leaves l JOIN outside o ON o.id = l.id AND o.nodes = 1 JOIN subroots s ON s.pos = l.tree
JOIN high r ON r.nodes = 1
"""


def _edit(cost: str, letter: str, line: str, then: str) -> str:
    return f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a, 'r': {line} || {then}.r}}"


def _cheapest(state: str, wanted: str) -> str:
    """The best of deleting, keeping and reroling a row in a grammar state, by cost, then audit."""
    role = {"u": "user", "a": "assistant"}[wanted]
    offers = [_edit("2", "D", "''", f"w.{state}")]
    for initial in (wanted, "s") if state == "e" else (wanted,):
        keep = _edit("d.extra", "K", "chr(10) || d.role || ':' || d.text", f"w.{initial}")
        offers.append(f"CASE WHEN NOT d.gone AND d.initial = '{initial}' THEN {keep} END")
    rerole = _edit("1 + d.extra", "R", f"chr(10) || '{role}:' || d.text", f"w.{wanted}")
    offers.append(f"CASE WHEN NOT d.gone THEN {rerole} END")
    return f"list_min([{', '.join(offers)}]) AS {state}"


def _inserted(state: str, wanted: str, then: str) -> str:
    role = {"u": "user", "a": "assistant"}[wanted]
    line = f"chr(10) || '{role}:'"
    return f"list_min([{state}, {_edit('5', 'I', line, then)}]) AS {state}"


REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM keyed WHERE kind <> 0
), placed AS (
  SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), d AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM judged
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM d GROUP BY conv_id
), ends AS (
  SELECT {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS nothing, {{'c': 5::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS one,
         {{'c': 10::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS two
), w AS (
  SELECT conv_id, n + 1 AS i, nothing AS e, two AS s, one AS u, nothing AS a FROM totals, ends
  UNION ALL
  SELECT conv_id, i, {_inserted("e", "u", "u")}, {_inserted("s", "u", "u")}, u, a FROM (
    SELECT conv_id, i, e, s, {_inserted("u", "a", "a")}, {_inserted("a", "u", "u")} FROM (
      SELECT d.conv_id, d.i, {_cheapest("e", "u")}, {_cheapest("s", "u")}, {_cheapest("u", "a")}, {_cheapest("a", "u")}
      FROM w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i - 1
    )
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.e.c, 0) AS cost,
       coalesce(w.e.a, '') AS audit, sha256(coalesce(w.e.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1
"""


# Every kind: its expression, the group that is its value, and the least length of that value.
SECRET_KINDS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]


def _secrets() -> str:
    """Where matches lie: what stands between them and they themselves, added up."""
    cut = """SELECT row, {place} AS place, '{kind}' AS kind, {least} AS least,
         unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap,
         unnest(regexp_extract_all(text, '{pattern}')) AS hit,
         unnest(regexp_extract_all(text, '{pattern}', {group})) AS value,
         generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS nth
  FROM texts WHERE regexp_matches(text, '{pattern}')"""
    cuts = "\n  UNION ALL\n  ".join(
        cut.format(place=i, kind=k, least=n, pattern=p, group=g) for i, (k, p, g, n) in enumerate(SECRET_KINDS)
    )
    base = [k for k, *_ in SECRET_KINDS[:3]]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    totals = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), cuts AS (
  {cuts}
), placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, place ORDER BY nth) AS until FROM cuts
), found AS (
  SELECT row, place, kind, until - length(hit) AS start, concat_ws(':', kind, until - length(hit), until) AS span
  FROM placed WHERE length(value) >= least
), per_row AS (
  SELECT row, {counts}, string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(base)}) AS base,
         string_agg(span, ',' ORDER BY start, place) AS spans
  FROM found GROUP BY row
)
SELECT doc_id, {totals}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_row USING (row)
"""


def _any_of(signs: str) -> str:
    return "[" + "".join("\\" + c if ord(c) < 128 else c for c in signs).replace("'", "''") + "]"


SPACE = r"[\x20\x09-\x0D]"
# What Python's split() leaves together.
UNBROKEN = r"[^\x09-\x0D\x1C-\x1F\x{85}\p{Z}]+"
QUALITY = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT row, regexp_extract_all(text, '{WORD}') AS w FROM texts)
), windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, a) AS often FROM (
    SELECT row, i, [word, {", ".join(f"lead(word, {k}) OVER near" for k in range(1, ql.WINDOW))}] AS a,
           lead(i, {ql.WINDOW - 1}) OVER near AS final
    FROM words WINDOW near AS (PARTITION BY row ORDER BY i)
  ) WHERE final IS NOT NULL
), repeated AS (
  SELECT row, count(*) FILTER (hit) AS n_repeat_words FROM (
    SELECT w.row, coalesce(bool_or(often > 1) OVER (PARTITION BY w.row ORDER BY w.i
             ROWS BETWEEN {ql.WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS hit
    FROM words w LEFT JOIN windows USING (row, i)
  ) GROUP BY row
), lines AS (
  SELECT row, line, regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', '') AS body
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{WORD}')
), seen AS (
  SELECT *, lower(body) AS low, len(regexp_extract_all(body, '{UNBROKEN}')) AS n,
         len(regexp_extract_all(lower(body), '{ql.BOILERPLATE.pattern}')) AS phrases,
         len(regexp_extract_all(body, '{ql.SEPARATORS.pattern}')) + 1 AS parts,
         regexp_matches(body, '{_any_of("".join(ql.ENDINGS))}$') AS ended,
         len(regexp_extract_all(body, '[\\p{{P}}\\p{{S}}]')) AS marks,
         length(regexp_extract(body, '^[\\p{{P}}\\p{{S}}]*')) + length(regexp_extract(body, '[\\p{{P}}\\p{{S}}]*$')) AS outer_marks,
         length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars
  FROM lines
), judged AS (
  SELECT *, coalesce(
      (phrases > 0 AND n <= {ql.BOILERPLATE_WORDS} * phrases) OR (parts > 3 AND n <= 4 * parts)
      OR (n <= {ql.NAVIGATION_WORDS} AND NOT ended
          AND regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])({ql.NAVIGATION.pattern[3:-3]})([^\\p{{L}}\\p{{N}}_]|$)'))
      OR (marks > {ql.MOST_MARKS}::DOUBLE * length(body) AND NOT (ended AND marks < length(body)
          AND outer_marks <= {ql.OUTER_MARKS} AND marks - outer_marks <= {ql.MOST_MARKS}::DOUBLE * length(body)))
      OR (n < {ql.FRAGMENT_WORDS} AND NOT ended), false) AS fails
  FROM seen
), per_text AS (
  SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS lines_removed,
         coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS chars_removed
  FROM judged GROUP BY row
), counted AS (
  SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n_words,
         length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '{_any_of(ql.SYMBOLS)}')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lines_removed, 0) AS lines_removed, coalesce(chars_removed, 0) AS chars_removed
  FROM texts LEFT JOIN repeated USING (row) LEFT JOIN per_text USING (row)
), verdicts AS (
  SELECT *, n_words < {ql.LEAST_WORDS} OR 100 * n_repeat_words > {ql.MOST_REPEATED_PERCENT} * n_words AS base_failed
  FROM counted
)
SELECT *, NOT base_failed AND chars_removed <= {ql.MOST_LOST}::DOUBLE * word_chars AS kept FROM verdicts
"""

URL_FILTERS = f"""
WITH pages_at AS (
  SELECT page_id, (DATE '{FIRST_DAY}' + ((page_id * 37 % {DAYS} + {DAYS}) % {DAYS})::INT)::DATE AS fetched,
         lower(regexp_replace(regexp_replace(regexp_replace(
           regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\\]*)', 1),
           '^.*@', ''), ':[0-9]*$', ''), '\\.$', '')) AS host
  FROM pages
), visits AS (
  SELECT DISTINCT host, fetched FROM pages_at WHERE host <> '' AND fetched IS NOT NULL
), named AS (
  SELECT DISTINCT host, array_to_string(labels[i:], '.') AS entry
  FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i
        FROM (SELECT DISTINCT host, string_split(host, '.') AS labels FROM visits))
), listed AS (
  SELECT entry, length(entry) * 3 + 10 AS step, ascii(entry) % 40 AS shift,
         CASE WHEN length(entry) % 2 = 0 THEN 'adult' ELSE 'malware' END AS category
  FROM (SELECT DISTINCT entry FROM named)
  WHERE contains(entry, '.') AND length(entry) <= {LONGEST_NAME} AND length(entry) % 3 > 0
), log AS (
  SELECT entry, category, (DATE '{FIRST_DAY}' + (nth * step + shift)::INT)::DATE AS day, nth % 2 = 0 AS added
  FROM (SELECT *, unnest(range(0, {DAYS} // step + 1)) AS nth FROM listed)
), changes AS (
  SELECT *, lead(day) OVER (PARTITION BY entry, category ORDER BY day) AS until
  FROM (SELECT entry, category, day, min(added) AS added FROM log GROUP BY ALL)
), active AS (
  SELECT host, fetched, count(*) AS n_active,
         min({{'nearest': -length(entry), 'category': category, 'entry': entry}}) AS top
  FROM visits JOIN named USING (host) JOIN changes USING (entry)
  WHERE added AND fetched >= day AND (until IS NULL OR fetched < until)
  GROUP BY host, fetched
)
SELECT page_id, host, fetched, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS blocked,
       top.entry AS entry, top.category AS category
FROM pages_at LEFT JOIN active USING (host, fetched)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": MIXING,
        "op2_secrets": _secrets(),
        "op3_exact_dedup": EXACT_DEDUP,
        "op7_quality": QUALITY,
        "op9_url_filters": URL_FILTERS,
        "op12_manifest": MANIFEST,
        "op13_conversation_repair": REPAIR,
    }
