"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10)) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def mix_ctes(docs: str) -> str:
    """The mix over the relation `docs`, as CTEs that end in `mixed`. A child is full if its part of its
    siblings' pool reaches its cap; filling one can only raise the others' parts, so the rounds are exact when
    they are as many as there are children: written here as one pass over children by cap / weight."""
    levels = [("d", "0", "domain"), ("l", "domain", "lang"), ("s", "domain, lang", "source")]
    weights = {
        "domain": "CASE domain WHEN 'hub' THEN 2 WHEN 'even' THEN 5 WHEN 'odd' THEN 3 ELSE 1 END",
        "lang": "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END",
        "source": "CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END",
    }
    out = rf"""
mix_rows AS (
  SELECT doc_id AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN source = 'src0' THEN 'hub'
              WHEN right(regexp_extract(coalesce(source, ''), '(\d+)$', 1), 1) IN ('1','3','5','7','9') THEN 'odd' ELSE 'even' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM {docs}),
mix_used AS (SELECT * FROM mix_rows WHERE tokens > 0),
mix_leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (3 * sum(tokens))::BIGINT AS cap FROM mix_used GROUP BY ALL),
mix_root AS (SELECT least(sum(tokens)::BIGINT // 2, sum(cap)::BIGINT) AS pool FROM mix_leaf)"""
    above = "mix_root"
    for name, parent, node in levels:
        keys = [k for k in parent.split(", ") if k != "0"]
        by = ", ".join([*keys, node])
        on = " AND ".join(f"n.{k} = p.{k}" for k in keys) or "TRUE"
        part = ", ".join(keys) or "1"
        out += f""",
mix_n{name} AS (SELECT {by}, sum(cap)::BIGINT AS cap, any_value({weights[node]})::BIGINT AS w FROM mix_leaf GROUP BY {by}),
mix_o{name} AS (
  SELECT n.*, p.pool, sum(n.w) OVER (PARTITION BY {', '.join(f'n.{k}' for k in keys) or '1'} ORDER BY n.cap / n.w DESC, n.{node} DESC) AS w_left,
         coalesce(sum(n.cap) OVER (PARTITION BY {', '.join(f'n.{k}' for k in keys) or '1'} ORDER BY n.cap / n.w, n.{node} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM mix_n{name} n JOIN {above} p ON {on}),
mix_f{name} AS (SELECT *, cap::HUGEINT * w_left <= w::HUGEINT * (pool - used) AS is_full FROM mix_o{name}),
mix_b{name} AS (
  SELECT {by}, CASE WHEN is_full THEN cap ELSE
    ((pool - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {part}), 0))::HUGEINT * w // sum(w) FILTER (NOT is_full) OVER (PARTITION BY {part}))::BIGINT END AS pool
  FROM mix_f{name})"""
        above = f"mix_b{name}"
    return out + """,
mix_budget AS (SELECT l.domain, l.lang, l.source, l.tokens AS leaf_tokens, b.pool AS budget FROM mix_leaf l JOIN mix_bs b USING (domain, lang, source)),
mix_slots AS (
  SELECT r.*, b.leaf_tokens, b.budget, e.epoch FROM mix_used r JOIN mix_budget b USING (domain, lang, source),
         (SELECT unnest(range(0, 3)) AS epoch) e WHERE e.epoch * b.leaf_tokens < b.budget),
mix_order AS (
  SELECT *, epoch * leaf_tokens + sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('7:' || epoch || ':' || id), id, tokens)
            - sum(tokens) OVER (PARTITION BY domain, lang, source, epoch, id, tokens) AS before FROM mix_slots),
mixed AS (SELECT id AS doc_id, domain, lang, source, tokens::INT AS tokens, epoch::BIGINT AS epoch, budget FROM mix_order WHERE before < budget)"""


MIX = f"WITH {mix_ctes('documents')}\nSELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epoch, budget FROM mixed"


#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: All pairs that share a shingle, then the smallest document reachable. A label only has to pass documents above
#: it, as the smallest of a component does everywhere.
def _linked(size: int, columns: str) -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+{size - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common c JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION SELECT l.b, r.low FROM reach r JOIN both_ways l ON l.a = r.node WHERE r.low < l.b)
SELECT node AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(low) AS component_id{columns}
FROM reach LEFT JOIN size ON doc_id = node GROUP BY node
"""


NEAR = _linked(4, ", node = min(low) AS kept")
JOIN = _linked(5, "")

#: Every window of 50 bytes with the smallest document that has it; overlapping and touching spans are one run.
REPEATS = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, p, b[p + 1:p + 50] AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS p FROM raw)),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS low FROM windows) WHERE low < doc_id),
run AS (SELECT doc_id, p, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS run
        FROM (SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -51) + 50)::INT AS gap FROM hit)),
span AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM run GROUP BY doc_id, run),
stays AS (
  SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS f, s AS t FROM span
  UNION ALL SELECT doc_id, octet_length(b), coalesce(last_end, 0), octet_length(b) FROM raw LEFT JOIN (SELECT doc_id, max(e) AS last_end FROM span GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(hex(b[f + 1:t]), '' ORDER BY f, t) AS h FROM stays JOIN raw USING (doc_id) WHERE t > f GROUP BY doc_id),
removed AS (SELECT doc_id, sum(e - s) AS n, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

#: Every window of an item's size that shares a shingle with it, by the shingles' counts; a shorter document is one window.
LEAKS = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k, greatest(len(w) - 4, 1) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT item_id, n, k, m, s, count(*) AS c
         FROM (SELECT item_id, n, k, m, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, m + 1)) AS p FROM i)) GROUP BY ALL),
place AS (SELECT doc_id, k, p, words, array_to_string(w[p:p + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, len(w) AS words, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
met AS (SELECT doc_id, item_id, least(n, words) AS n, m, least(m, words - k + 1) AS own, c, s, unnest(range(greatest(p - m + 1, 1), least(p, greatest(words - n, 0) + 1) + 1)) AS start FROM place JOIN item USING (k, s)),
bag AS (SELECT doc_id, item_id, n, m, own, start, least(count(*), any_value(c)) AS common FROM met GROUP BY doc_id, item_id, n, m, own, start, s),
scored AS (SELECT doc_id, item_id, n, start, sum(common)::BIGINT / (m + own - sum(common)::BIGINT) AS similarity FROM bag GROUP BY doc_id, item_id, n, m, own, start)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT - 1 AS start_word, any_value(n)::BIGINT AS n_words, count(*) AS n_windows
FROM scored WHERE 100 * similarity >= 80 GROUP BY doc_id, item_id
"""


def _step(best: str, cost: int | str, audit: str) -> str:
    """A path in `best` (nine digits of cost, then the audit) after more cost and audit; null stays null."""
    return f"lpad((left({best}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({best}, 10) || '{audit}'"


def _kept(state: str, before: tuple[str, str, str, str]) -> str:
    """The cheapest path that retains the turn as `state`; `before` has what is inserted after each of the states."""
    ways = [f"{_step(f'w{e}', 2 * len(i), i + 'K')}" for e, i in enumerate(before)], [f"{_step(f'w{e}', 2 + 2 * len(i), i + 'R')}" for e, i in enumerate(before)]
    kept = f"CASE WHEN r = '{state}' THEN least({', '.join(ways[0])}) ELSE least({', '.join(ways[1])}) END"
    return f"CASE WHEN fault IN (1, 2) THEN NULL WHEN fault = 3 THEN (SELECT {_step('x', 1, '')} FROM (SELECT {kept} AS x)) ELSE {kept} END"


_TRIMMED = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

#: crc32 by its table, then the faults, then a path per state (w0: nothing retained, w1: s, w2: u, w3: a) turn by
#: turn; least() skips nulls, and strings of nine digits and an audit order as (cost, audit) do.
REPAIR = rf"""
WITH RECURSIVE crc_bits AS (
  SELECT i::BIGINT AS i, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tbl FROM crc_bits WHERE k = 8),
t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM t, (SELECT unnest([0, 1]) AS c) WHERE k <> 0 AND (c = 0 OR k = 3)),
placed AS (
  SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN {_TRIMMED} = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right({_TRIMMED}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS two FROM placed),
path AS (
  SELECT conv_id, 0::BIGINT AS turns, '000000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM (SELECT DISTINCT conv_id FROM faults)
  UNION ALL
  SELECT p.conv_id, f.i, {_step('w0', 3, 'D')},
         least({_step('w1', 3, 'D')}, CASE WHEN r = 's' AND fault IN (0, 3) THEN {_step('w0', '(fault = 3)::INT', 'K')} END),
         least({_step('w2', 3, 'D')}, {_kept('u', ('', '', 'I', ''))}),
         least({_step('w3', 3, 'D')}, {_kept('a', ('I', 'I', '', 'I'))})
  FROM path p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.turns + 1),
best AS (
  SELECT conv_id, least(w0, {_step('w1', 4, 'II')}, {_step('w2', 2, 'I')}, w3) AS w
  FROM path SEMI JOIN (SELECT conv_id AS c, max(i) AS n FROM faults GROUP BY ALL) ON c IS NOT DISTINCT FROM conv_id AND n = turns),
letters AS (
  SELECT conv_id, p, op, count(*) FILTER (op <> 'I') OVER run AS i, count(*) FILTER (op <> 'D') OVER run AS o
  FROM (SELECT conv_id, unnest(string_split(substr(w, 10), '')) AS op, generate_subscripts(string_split(substr(w, 10), ''), 1) AS p FROM best) WINDOW run AS (PARTITION BY conv_id ORDER BY p)),
lines AS (
  SELECT l.conv_id, p, o, op, f.role, f.text, max(CASE WHEN o = 1 AND op = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM letters l LEFT JOIN faults f ON op <> 'I' AND f.i = l.i AND f.conv_id IS NOT DISTINCT FROM l.conv_id WHERE op <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha
  FROM lines GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(w, 9)::BIGINT, 0) AS cost, coalesce(substr(w, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Counts as 128-bit integers; every group has every kept term of its language.
DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
word AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(w.n, 0)::HUGEINT AS n
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM word GROUP BY ALL) w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM n JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY lang, term) JOIN v USING (lang)),
near AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN near n ON n.lang = a.lang AND n.source = a.source AND n.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 10
"""
