"""ANSI SQL for the queries, for DuckDB over the same tables. Written apart from the expressions they check."""

from __future__ import annotations

from tracewright.functions.text import CLAUSE_OPENERS, CLAUSE_OPENERS_AFTER_COMMA

W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NOT_WORD = r"[^\p{L}\p{M}\p{N}\p{Pc}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def lines(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10))"


def clean(x: str) -> str:
    return strip(rf"regexp_replace({x}, '^[{W}]*(?:[-*][{W}]+|\p{{Nd}}+[).{W}-]+)', '')")


def kept(parts: str, how) -> str:
    return f"list_filter(list_transform({parts}, lambda u: {how('u')}), lambda u: u <> '')"


def split_lines(x: str) -> str:
    return kept(lines(x), clean)


def split_sentences(x: str) -> str:
    return kept(f"regexp_extract_all({x}, '[^.!?]+[.!?]|[^.!?]+$')", strip)


def split_numbered(x: str) -> str:
    return f"CASE WHEN len({split_lines(x)}) > 1 THEN {split_lines(x)} ELSE {split_sentences(x)} END"


def split_clauses(x: str) -> str:
    """No lookahead in RE2: mark word ends first, then replace separators by a control character."""
    free, comma = "|".join(CLAUSE_OPENERS), "|".join(CLAUSE_OPENERS_AFTER_COMMA)
    marked = f"regexp_replace(l, '({NOT_WORD})', chr(2) || '\\1', 'g') || chr(2)"
    sep = rf"(?:\x02?,(?:\x02?[{W}])*|\x02?[{W}](?:\x02?[{W}])*)"
    pattern = rf"(?i){sep}({free})\x02|\x02?,(?:\x02?[{W}])*({comma})\x02"
    cut = f"string_split(regexp_replace({marked}, '{pattern}', chr(1) || '\\1\\2' || chr(2), 'g'), chr(1))"
    return f"flatten(list_transform({split_lines(x)}, lambda l: " + kept(cut, lambda u: strip(f"replace({u}, chr(2), '')")) + "))"


def join(x: str, sep: str) -> str:
    return f"coalesce(array_to_string({x}, {sep}), CASE WHEN {x} IS NOT NULL THEN '' END)"


def json_string(x: str) -> str:
    code = "unicode(c)"
    hex4 = lambda n: f"format('\\u{{:04x}}', ({n})::INT)"
    escaped = (
        f"CASE {code} WHEN 34 THEN '\\\"' WHEN 92 THEN '\\\\' WHEN 10 THEN '\\n' WHEN 13 THEN '\\r' WHEN 9 THEN '\\t' WHEN 8 THEN '\\b' WHEN 12 THEN '\\f' "
        f"ELSE CASE WHEN {code} BETWEEN 32 AND 126 THEN c WHEN {code} < 65536 THEN {hex4(code)} "
        f"ELSE {hex4(f'55296 + (({code} - 65536) >> 10)')} || {hex4(f'56320 + (({code} - 65536) & 1023)')} END END"
    )
    return f"'\"' || {join(f'list_transform(regexp_extract_all({x}, ' + repr('(?s).') + f'), lambda c: {escaped})', repr(''))} || '\"'"


def row_id(round_id: str, question: str, depth: str, s: str, e: str) -> str:
    body = f"'{{\"depth\": ' || {depth} || ', \"question\": ' || {json_string(question)} || ', \"removed_end_index\": ' || {e} || ', \"removed_start_index\": ' || {s} || ', \"round_id\": ' || {json_string(round_id)} || '}}'"
    return f"'pt-' || substr(sha256({body}), 1, 16)"


def context(q: str, units: str) -> str:
    return f"'Question:' || chr(10) || {q} || CASE WHEN len({units}) > 0 THEN chr(10) || array_to_string({units}, chr(10)) ELSE '' END"


BODY = f"""concat_ws(chr(10) || chr(10), nullif({strip('context')}, ''), {strip("coalesce(question, 'None')")},
 CASE WHEN len(choices) > 0 THEN 'Options:' || chr(10) || array_to_string(list_transform(choices, lambda c: '(' || coalesce(c.label, 'None') || ') ' || coalesce(c.text, 'None')), chr(10)) END)"""

ATTEMPTS = f"""t AS (SELECT run_no, first_value(question) OVER (PARTITION BY run_no ORDER BY pruning_depth, row_no) AS question, generated_trace AS trace, row_number() OVER (PARTITION BY run_no ORDER BY pruning_depth, row_no) - 1 AS n FROM transitions),
a AS (SELECT run_no AS question_id, (n // 2)::INT AS depth, (n % 2 + 1)::INT AS attempt, question, trace, {split_numbered('trace')} AS units, (run_no % 2)::INT AS s, (run_no % 2 * 3)::INT AS e FROM t),
j AS (SELECT *, CASE WHEN NOT coalesce(len(units) BETWEEN 3 AND 6, false) THEN 'rejected_unit_count' WHEN e + 1 >= len(units) THEN 'rejected_no_span' ELSE 'accepted' END AS status FROM a WHERE depth < 2 AND attempt <= 2),
w AS (SELECT * FROM j WHERE status = 'accepted' QUALIFY row_number() OVER (PARTITION BY question_id, depth ORDER BY attempt) = 1)"""

REPLAY = f"""{ATTEMPTS},
r AS (SELECT *, first_value(question) OVER (PARTITION BY question_id ORDER BY depth) AS q, row_number() OVER (PARTITION BY question_id ORDER BY depth) - 1 AS k,
  coalesce(flatten(list(list_concat(units[1:s], [units[e + 2]])) OVER (PARTITION BY question_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS accepted FROM w),
c AS (SELECT question_id, q AS question, {context('q', 'accepted')} AS ctx, trace, units, depth, attempt, s, e FROM r WHERE k = depth)"""


LOG = f"""WITH {ATTEMPTS}, h AS (SELECT question_id, depth, list_concat(units[1:s], [units[e + 2]]) AS d FROM w),
o AS (SELECT j.*, (SELECT flatten(list(h.d ORDER BY h.depth)) FROM h WHERE h.question_id = j.question_id AND h.depth < j.depth) AS got, (SELECT min(attempt) FROM w WHERE w.question_id = j.question_id AND w.depth = j.depth) AS won,
  (SELECT count(*) FROM w WHERE w.question_id = j.question_id AND w.depth < j.depth) AS done, (SELECT max(attempt) FROM j AS k WHERE k.question_id = j.question_id AND k.depth = j.depth) AS last FROM j),
x AS (SELECT *, {context('question', 'coalesce(got, [])')} AS context, won IS NULL AND attempt = last AS stopped FROM o WHERE done = depth AND (won IS NULL OR attempt <= won))"""


def flat(source: str, round_id: str, key: str = "question_id") -> str:
    return f"""SELECT {key} AS question_id, {row_id(round_id, 'question', 'depth', 's', 'e')} AS id, question, ctx AS context_before_generation, trace AS generated_trace,
 array_to_string(units, '|') AS generated_units, ctx || CASE WHEN s > 0 THEN chr(10) || array_to_string(units[1:s], chr(10)) ELSE '' END AS input_x, units[e + 2] AS target_y,
 depth::INT AS pruning_depth, 'gen' AS generator_model, 'judge' AS decision_model, array_to_string(units[s + 1:e + 1], '|') AS removed_span, s AS removed_start_index,
 e AS removed_end_index, 'filler' AS decision_reason, attempt::INT AS retry_attempts FROM {source}"""


DIRECT = """d AS (SELECT row_no AS question_id, question, context_before_generation AS ctx, generated_trace AS trace, generated_units AS units, pruning_depth AS depth, metadata.retry_attempts AS attempt,
 metadata.removed_start_index AS s, metadata.removed_end_index AS e, round_id FROM transitions WHERE metadata.removed_start_index >= 0 AND metadata.removed_end_index >= metadata.removed_start_index AND metadata.removed_end_index + 1 < len(generated_units))"""


def exploded(table: str, key: str, units: str, no: str = "unit_no", name: str = "unit") -> str:
    return f"SELECT {key}, (n - 1)::INT AS {no}, u[n] AS {name} FROM (SELECT {key}, u, unnest(range(1, len(u) + 1)) AS n FROM (SELECT {key}, {units} AS u FROM {table}))"


CONTINUED = "|| chr(10) || chr(10) || 'Continue with the next useful reasoning step:'"

DECISION = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_orderkey % 6 AS how FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
 how IN (0, 1) AND l_returnflag IN ('R', 'A') AS has_removal,
 CASE WHEN how IN (0, 1) THEN CASE l_linenumber WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 7 THEN NULL WHEN 4 THEN NULL ELSE l_linenumber - 2 END END::INT AS removed_start_index,
 CASE WHEN how IN (0, 1) THEN l_partkey % 3 END::INT AS removed_end_index,
 CASE WHEN how IN (0, 1) THEN CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'None' ELSE 'a "b"' END WHEN how IN (2, 3) THEN 'Decision model did not return JSON.' WHEN how = 4 THEN 'Decision model returned invalid JSON.' END AS reason,
 how IN (0, 1) AND l_linestatus = 'F' AS can_continue_after_skip FROM p"""
DECISION = DECISION.replace("how IN (0, 1)", "how IN (0, 1, 5)")

ORACLE: dict[str, str] = {
    "src_text_lines": f"SELECT doc_id, line_no::BIGINT AS ord, {strip('line')} AS question FROM ({exploded('documents', 'doc_id', lines('text'), 'line_no', 'line')}) WHERE {strip('line')} <> ''",
    "source_limit": f"""WITH q AS (SELECT question_id AS ord, {strip("coalesce(question, 'None')")} AS question FROM questions), k AS (SELECT *, row_number() OVER (ORDER BY ord) AS n, count(*) OVER () AS m FROM q WHERE question <> '')
 SELECT 'first' AS kept, ord, question FROM k WHERE n <= 25 UNION ALL SELECT 'all_but_last', ord, question FROM k WHERE n <= m - 100""",
    "pick_by_index": "SELECT question_id AS ord, question FROM questions ORDER BY question_id LIMIT 1 OFFSET 11",
    "src_jsonl_field": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'None') AS question FROM events WHERE trim(props) <> '' AND coalesce(trim(json_extract_string(props, '$.k')), 'None') <> ''",
    "spectrum_question": f"SELECT question_id, {BODY} AS body FROM questions",
    "clean_unit": f"SELECT doc_id, line_no, {clean('line')} AS unit FROM ({exploded('documents', 'doc_id', lines('text'), 'line_no', 'line')})",
    "split_lines": exploded("documents", "doc_id", split_lines("text")),
    "split_sentences": exploded("documents", "doc_id", split_sentences("text")),
    "split_clauses": exploded("documents", "doc_id", split_clauses("text")),
    "split_numbered_or_lines": exploded("transitions", "row_no", split_numbered("generated_trace")),
    "unit_count_gate": f"SELECT row_no, len(u)::INT AS n_units FROM (SELECT row_no, {split_numbered('generated_trace')} AS u FROM transitions) WHERE len(u) BETWEEN 3 AND 6",
    "newline_stop": "SELECT row_no, (length(generated_trace) - length(replace(generated_trace, chr(10), '')))::INT AS newlines, array_to_string(string_split(generated_trace, chr(10))[1:3], chr(10)) AS stopped FROM transitions",
    "parse_decision": f"WITH {DECISION}",
    "decision_valid": """SELECT l_returnflag, l_linestatus, l_linenumber, l_partkey % 3 AS end_index, count(*) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F' AND l_linenumber < 7 AND l_linenumber >= 2
 AND l_partkey % 3 >= l_linenumber - 2 AND l_partkey % 3 + 1 < l_quantity) AS valid, count(*) AS replies FROM lineitem GROUP BY ALL""",
    "decision_prompt": f"""SELECT row_no, 'v=t1 {{json}}' || chr(10) || 'Q: ' || question || chr(10) || 'C: ' || context_before_generation || chr(10) || {join("list_transform(u, lambda x, i: (i - 1) || ': ' || x)", 'chr(10)')} || chr(10) AS prompt
 FROM (SELECT row_no, question, context_before_generation, {split_numbered('generated_trace')} AS u FROM transitions)""",
    "format_context": f"SELECT row_no, {context('question', 'generated_units')} AS context FROM transitions",
    "advance_context": "SELECT row_no, array_to_string(list_concat(metadata.removed_span, generated_units[1:metadata.removed_start_index], [generated_units[metadata.removed_end_index + 2]]), '|') AS accepted FROM transitions WHERE len(generated_units) > metadata.removed_end_index + 1",
    "transition_rows": f"WITH {DIRECT} {flat('d', 'round_id')}",
    "prompt_completion": f"WITH {DIRECT} SELECT question_id, input_x {CONTINUED} AS prompt, target_y AS completion FROM ({flat('d', 'round_id')})",
    "stable_row_id": f"SELECT row_no, {row_id('round_id', 'question', 'pruning_depth', 'metadata.removed_start_index', 'metadata.removed_end_index')} AS made_id FROM transitions",
    "broken_targets": "SELECT row_no, target_y, generated_units[metadata.removed_end_index + 2] AS expected_target FROM transitions WHERE generated_units IS NOT NULL AND target_y IS DISTINCT FROM generated_units[metadata.removed_end_index + 2]",
    "depth_gaps": "SELECT run_no, count(DISTINCT pruning_depth) AS depths, max(pruning_depth) AS deepest FROM transitions WHERE generated_trace IS NOT NULL AND length(target_y) > 0 GROUP BY run_no HAVING count(DISTINCT pruning_depth) <> max(pruning_depth) + 1",
    "first_valid_attempt": f"WITH {ATTEMPTS} SELECT question_id, depth, attempt, trace, len(units)::INT AS n_units FROM w",
    "replay_rows": f"WITH {REPLAY} {flat('c', repr('r-test'))}",
    "training_rows": f"WITH {REPLAY} SELECT question_id, pruning_depth, input_x {CONTINUED} AS prompt, target_y AS completion FROM ({flat('c', repr('r-test'))})",
    "context_invariant": """WITH n AS (SELECT *, lead(context_before_generation) OVER (PARTITION BY run_no ORDER BY pruning_depth, row_no) AS next_context FROM transitions)
 SELECT run_no, pruning_depth, row_no, next_context FROM n WHERE next_context IS NOT NULL AND next_context IS DISTINCT FROM input_x || chr(10) || target_y""",
    "audit_status": f"""{LOG} SELECT question_id, depth, attempt, status, coalesce(len(units), -1)::INT AS n_units, context, CASE WHEN status = 'accepted' THEN {row_id(repr('r-test'), 'question', 'depth', 's', 'e')} END AS row_id,
 CASE WHEN status = 'accepted' THEN context || coalesce(chr(10) || nullif(array_to_string(units[1:s], chr(10)), ''), '') || chr(10) || units[e + 2] END AS next_context, stopped FROM x""",
    "mark_removed_units": "SELECT row_no, array_to_string(list_transform(generated_units, lambda u, i: CASE WHEN i - 1 BETWEEN metadata.removed_start_index AND metadata.removed_end_index THEN '  ✗' ELSE '   ' END || ' ' || (i - 1) || ': ' || u), chr(10)) AS shown FROM transitions",
    "model_card": """WITH m AS (SELECT round_id, string_agg('- rows_at_' || pruning_depth || ': ' || n, chr(10) ORDER BY pruning_depth) AS listed FROM (SELECT round_id, pruning_depth, count(*) AS n FROM transitions GROUP BY ALL) GROUP BY round_id)
 SELECT round_id, '# ' || round_id || chr(10) || chr(10) || '## Lineage' || chr(10) || chr(10) || '- parent_model_id: ' || generator_model || chr(10) || '- data_revision: ' || coalesce(generator_model_revision, 'None') || chr(10) || '- judge: ' || decision_model
 || chr(10) || chr(10) || '## Evaluation Results' || chr(10) || chr(10) || coalesce(listed, '- no evaluation metrics recorded') || chr(10) || chr(10) || '## Acceptance Reason' || chr(10) || chr(10) || 'accepted' || chr(10) AS card FROM rounds LEFT JOIN m USING (round_id)""",
    "camelize_map": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber > 2 THEN 'maxOutputTokens=' || l_partkey || ',' ELSE '' END || 'temperature=0.5,topK=' || l_linenumber AS settings FROM lineitem",
    "extract_reply_text": "SELECT training_id, CASE WHEN training_id % 7 = 0 THEN '' ELSE coalesce(completion, '') || coalesce(completion, '') END AS reply FROM training",
    "error_message": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN text WHEN doc_id % 2 = 0 THEN '{\"error\":{\"message\":\"\"}}' ELSE substr(text, 1, 500) END AS message FROM documents",
}
ORACLE["row_contract"] = f"""WITH t AS (SELECT *, generated_units AS u, metadata.removed_start_index AS s, metadata.removed_end_index AS e, {split_numbered('generated_trace')} AS v FROM transitions),
b AS (SELECT *, coalesce(s >= 0 AND e >= s AND e + 1 < len(u), false) AS ok FROM t)
SELECT pruning_depth, count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(u[e + 2] = target_y, false)) AS bad_target, count(*) FILTER (WHERE NOT ok) AS bad_span,
 count(*) FILTER (WHERE NOT coalesce(ok AND context_before_generation || CASE WHEN s > 0 THEN chr(10) || array_to_string(u[1:s], chr(10)) ELSE '' END = input_x, false)) AS bad_input,
 count(*) FILTER (WHERE v IS DISTINCT FROM u) AS bad_units FROM b GROUP BY pruning_depth"""
ORACLE["round_summary"] = f"SELECT depth, status, count(*) AS attempts, count(DISTINCT question_id) AS questions FROM ({ORACLE['audit_status']}) GROUP BY ALL"
ORACLE["frontier_loop"] = ORACLE["replay_rows"]
#: A live loop also asks where no answer is stored.
ORACLE["frontier_log"] = ORACLE["audit_status"].replace("j AS (SELECT *, CASE", """g AS (SELECT q.question_id, d.depth, n.attempt, q.question, a.trace, a.units, q.s, q.e FROM (SELECT DISTINCT question_id, question, s, e FROM a) AS q
 CROSS JOIN (VALUES (0), (1)) AS d(depth) CROSS JOIN (VALUES (1), (2)) AS n(attempt) LEFT JOIN a ON a.question_id = q.question_id AND a.depth = d.depth AND a.attempt = n.attempt),
j AS (SELECT *, CASE""").replace("AS status FROM a WHERE", "AS status FROM g WHERE")


def _part(name: str, body: str) -> str:
    return f"'{name}:' || chr(10) || coalesce(nullif({body}, ''), '-')"


_DECISION = "'removal true, units ' || s || ' to ' || e || ', goes on true, because: filler'"
_MARKED = "array_to_string(list_transform(units, lambda u, i: CASE WHEN i - 1 BETWEEN s AND e THEN '  ✗' ELSE '   ' END || ' ' || (i - 1) || ': ' || u), chr(10))"
_NUMBERED = "array_to_string(list_transform(units, lambda u, i: (i - 1) || ': ' || u), chr(10))"
_NEXT = "context || coalesce(chr(10) || nullif(array_to_string(units[1:s], chr(10)), ''), '') || chr(10) || units[e + 2]"
ORACLE["stage_report"] = f"""{LOG}, y AS (SELECT *, status = 'accepted' AS ok, {row_id(repr('r-test'), 'question', 'depth', 's', 'e')} AS made FROM x)
SELECT question_id, depth, attempt, concat_ws(chr(10), '== depth ' || depth || ', attempt ' || attempt || ' ==', {_part('question', 'question')}, {_part('context', 'context')}, {_part('trace', 'trace')},
 {_part('units', f'CASE WHEN ok THEN {_MARKED} ELSE {_NUMBERED} END')}, {_part('decision', _DECISION)},
 'outcome: ' || CASE status WHEN 'rejected_unit_count' THEN 'rejected: it has ' || coalesce(len(units)::VARCHAR, '-') || ' units' WHEN 'rejected_no_span' THEN 'rejected: no span that can go with a unit behind it' ELSE 'accepted as row ' || made END,
 CASE WHEN ok THEN {_part('target', 'units[e + 2]')} END, CASE WHEN ok THEN {_part('next context', _NEXT)} END,
 CASE WHEN stopped THEN 'no attempt left: the question stops at this depth' END) AS report FROM y"""
