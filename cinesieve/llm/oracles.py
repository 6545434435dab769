"""SQL for those numbered queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from cinesieve.llm import chat, clusters, infill, quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"

_FAILS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)
_MASK = quality.POLICIES[quality.POLICY]
_NAMES = ", ".join(f"({1 << r.bit}, '{r.name}')" for r in quality.RULES if _MASK >> r.bit & 1)
QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
repeats AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeats, range(3) r(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
len(list_filter(lines, lambda x: regexp_matches(x, '{quality.BULLET}'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{quality.ELLIPSIS}'))) AS n_ellipses
FROM w LEFT JOIN covered USING (rid)), b AS (SELECT *, CAST({_FAILS} AS BIGINT) AS fail_bits FROM m),
kept AS (SELECT flag, only_rule, (SELECT count(*) FROM b WHERE fail_bits & {_MASK} IN (0, flag)) AS n_kept_without FROM (VALUES {_NAMES}) v(flag, only_rule))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.BASE} <> 0 AS base_failed, fail_bits & {_MASK} = 0 AS kept, fail_bits, only_rule, n_kept_without
FROM b LEFT JOIN kept ON fail_bits & {_MASK} = flag"""


def _quoted(pattern: str) -> str:
    """The first group's any case as classes of ASCII letters; no possessive marks; quotes doubled."""
    if pattern.startswith("(?i:"):
        head, _, rest = pattern.removeprefix("(?i:").partition("))")
        pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + rest
    return pattern.replace("}+", "}").replace("'", "''")


#: The pem rule where no possessive marks are known: what comes after a run can't begin as the run does, so that there is one
#: way to match. A body's first run follows the fields after a mark or with a slash, as a field takes all letters and digits.
_RUN, _SHORT = "[A-Za-z0-9/][A-Za-z0-9+/]{15,}={0,2}", "[A-Za-z0-9/][A-Za-z0-9+/]{0,14}={0,2}"
_B = secrets._BETWEEN
_FIELDS = rf"(?:{_B}+(?:Proc-Type|DEK-Info):\x20?[A-Za-z0-9-]+,[A-Za-z0-9]+)+"
_BODY = rf"(?:{_FIELDS}(?:{_B}+[A-Za-z0-9/]|/)|{_B}*[A-Za-z0-9/])[A-Za-z0-9+/]{{15,}}={{0,2}}(?:{_B}*{_RUN})*(?:{_B}+{_SHORT})?"
_PEM = rf"{secrets._HEADER}(?:(?:[^-]|-[^-])*-----END [A-Z ]{{0,40}}PRIVATE KEY-----|{_BODY})?"


def _spans(number: int, rule: secrets.Rule, source: str) -> str:
    p = _PEM.replace("'", "''") if rule.kind == "pem" else _quoted(rule.pattern)
    found = f"regexp_extract_all(t, '{p}')"
    return f"""SELECT rid, {number} AS kind, a + before AS start, a + before + length(m) AS stop FROM (
SELECT rid, m, part, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i) AS a, coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT rid, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(parts) AS part, unnest(gaps[1:len(ms)]) AS gap
FROM (SELECT rid, {found} AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS parts, string_split_regex(t, '{p}') AS gaps FROM {source}) WHERE len(ms) > 0)) WHERE length(part) >= {rule.least}"""


def _all_spans(source: str) -> str:
    return " UNION ALL ".join(_spans(i, r, source) for i, r in enumerate(_RULES))


_RULES = secrets.RULE_SETS[secrets.VERSION]
_KINDS = "CASE kind " + " ".join(f"WHEN {i} THEN '{r.kind}'" for i, r in enumerate(_RULES)) + " END"
_LIST = f"string_agg({_KINDS} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind)"
_BASE = f"kind < {len(secrets.BASE_RULES)}"
#: The second version: runs of overlapping spans as one mask each, the rest as it is; its spans are what is left.
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS MATERIALIZED ({_all_spans("d")}),
j AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.BASE_RULES))}, {_LIST} FILTER ({_BASE}) AS base, {_LIST} AS spans FROM s GROUP BY rid),
runs AS (SELECT rid, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY rid ORDER BY start, kind) AS run
FROM (SELECT *, start >= coalesce(max(stop) OVER (PARTITION BY rid ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS apart FROM s)) GROUP BY rid, run),
cut AS (SELECT rid, start, stop, coalesce(lag(stop) OVER (PARTITION BY rid ORDER BY start), 0) AS since FROM runs),
masked AS MATERIALIZED (SELECT rid, any_value(doc_id) AS doc_id, string_agg(substr(t, CAST(since + 1 AS BIGINT), CAST(start - since AS BIGINT)) || '{secrets.MASK}', '' ORDER BY start) || substr(any_value(t), CAST(max(stop) + 1 AS BIGINT)) AS t FROM cut JOIN d USING (rid) GROUP BY rid),
remaining AS (SELECT m.doc_id, count(*) AS n_left FROM ({_all_spans("masked")}) JOIN masked m USING (rid) GROUP BY m.doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_left, 0) AS n_left
FROM d LEFT JOIN j USING (rid) LEFT JOIN remaining r ON r.doc_id IS NOT DISTINCT FROM d.doc_id"""


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}"


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, md5(text) AS {table}_text, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM ({_words(table, key)})"""


CONTAINMENT = f"""WITH items AS (SELECT *, count(*) OVER (PARTITION BY item_id, benchmark_text) AS n FROM ({_shingles("benchmark", "item_id")})), lengths AS (SELECT DISTINCT len(string_split(s, ' ')) AS k FROM items WHERE len(string_split(s, ' ')) < 5),
texts AS ({_shingles("documents", "doc_id")} UNION SELECT doc_id, md5(text), array_to_string(w[i:i + k - 1], ' ') FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM ({_words("documents", "doc_id")}), lengths)),
pairs AS (SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_item, count(*) / any_value(n) AS containment FROM texts JOIN items USING (s) GROUP BY doc_id, documents_text, item_id, benchmark_text HAVING count(*) >= 0.8 * any_value(n) - 1e-9)
SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY containment DESC, n_shared DESC) = 1"""

_SAID = "'</s>[INST] ok [/INST]'"
_ESCAPED = r"regexp_replace({0}, '(</?|\[/?)(\\*)(s>|INST\]|CTX\])', '\1\\\2\3', 'g')"
_ORDER = "PARTITION BY conv_id ORDER BY idx"
_MOST = chat.BUDGET - chat.HISTORY_BUDGET
_REPEATS = " + ".join(f"CASE WHEN NOT lag(sys, {h}, true) OVER w AND s - lag(s, {h}) OVER w <= least({chat.HISTORY_BUDGET}, {chat.BUDGET} - sys_tok - span_tok) THEN lag(ctx, {h}) OVER w ELSE 0 END" for h in range(1, chat.HISTORY + 1))
CHAT = rf"""WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', {_SAID}), (-7, 1, 'assistant', {_SAID})),
a AS (SELECT *, '{chat.FRESH}' || {_ESCAPED.format("role")} || '{chat.MIDDLE}' || {_ESCAPED.format("text")} || '{chat.STOP}' AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM r),
b AS (SELECT *, strlen(said) AS tok, length(said) AS chars, length(said) - 1 AS ctx, idx = 1 AND role = 'system' AND strlen(said) <= {_MOST // 2} AS sys FROM a),
c AS (SELECT *, max(CASE WHEN sys THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_tok, max(CASE WHEN sys THEN ctx ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_ctx,
sum(CASE WHEN sys THEN 0 ELSE tok END) OVER ({_ORDER}) AS e FROM b),
d AS (SELECT *, CASE WHEN sys THEN e ELSE e - tok END AS s, {_MOST} - sys_tok AS room FROM c),
f AS (SELECT *, s // ({chat.BLOCK} * room) AS block FROM d),
walk AS (SELECT conv_id, idx, block, s AS since, true AS opens FROM f WHERE idx = 1 UNION ALL
SELECT f.conv_id, f.idx, f.block, CASE WHEN f.block <> walk.block OR e - since > room THEN s ELSE since END, f.block <> walk.block OR e - since > room FROM walk JOIN f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.idx = walk.idx + 1),
g AS (SELECT f.*, opens, sum(CAST(opens AS INT)) OVER (PARTITION BY f.conv_id ORDER BY f.idx) AS span FROM f JOIN walk ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.idx = walk.idx),
h AS (SELECT *, max(e) OVER (PARTITION BY conv_id, span) - min(s) OVER (PARTITION BY conv_id, span) AS span_tok FROM g),
k AS (SELECT *, {_REPEATS} AS repeated, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM h WINDOW w AS ({_ORDER}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY idx)) AS loss_sha256,
CAST(sum(chars + CASE WHEN opens AND span > 1 THEN sys_ctx + repeated ELSE 0 END) AS BIGINT) AS formatted_chars, CAST(max(span) AS BIGINT) AS n_windows FROM k GROUP BY conv_id"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
EQUAL = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, {_LOWERED} AS t FROM documents)"""


def _lloyd(k: int, rounds: int, dimensions: int, seed: int) -> str:
    """Every round compares every vector with every centroid and sums all vectors up."""
    scaled = f"list_transform(embedding, lambda x: {clusters.SCALE} * CAST(x AS DOUBLE))"
    nearest = "arg_min({c}.i, (list_sum(list_transform(range(1, {n}), lambda j: (v.x[j] - {c}.x[j]) * (v.x[j] - {c}.x[j]))), {c}.i)) AS i, min(list_sum(list_transform(range(1, {n}), lambda j: (v.x[j] - {c}.x[j]) * (v.x[j] - {c}.x[j])))) AS d"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(s, lambda x: CAST(floor(x) AS BIGINT)) AS x FROM (SELECT vec_id, {scaled} AS s FROM embeddings)
WHERE len(s) = {dimensions} AND len(list_filter(s, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {clusters.LARGEST})) = {dimensions})""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS i, x FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, {nearest.format(c=f'c{r}', n=dimensions + 1)} FROM v, c{r} GROUP BY rid)")
        if r < rounds:
            # the floor of the mean in whole numbers, as // rounds towards zero
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.i, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT i, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x
FROM (SELECT i, j, CAST(sum(v.x[j]) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {dimensions + 1}) p(j) GROUP BY i, j) GROUP BY i) m USING (i))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.i AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.i = a.i"""


#: The same statement over the whole table, and the texts read back by the places of the marks.
INFILL = f"""SELECT id AS doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, s - 4) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
ELSE substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, 4, p - 4) END) AS restored_sha256
FROM (SELECT *, strpos(output, '{infill.PREFIX}') AS p, strpos(output, '{infill.SUFFIX}') AS s, strpos(output, '{infill.MIDDLE}') AS m FROM ({infill.sql("(SELECT doc_id AS id, text FROM documents)")}))"""

ORACLE_SQL = {"op1_chat_windows": CHAT, "op2_secret_scan": SECRETS, "op7_benchmark_containment": CONTAINMENT, "op9_quality_ledger": QUALITY, "op11_radix_dedup": EQUAL, "op12_delta_lloyd": _lloyd(8, 10, clusters.DIMENSIONS, clusters.SEED), "op13_infill": INFILL}
