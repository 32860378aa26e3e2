"""DuckDB SQL with the same results as ``vouchwell.plans.queries``.

Nothing comes from the library: values stand in ``sql_values``, and the logic is written anew.
"""

from __future__ import annotations

from vouchwell.plans import sql_values as V

SPACE = f"[{V.SPACE_CLASS}]"
_ELLIPSES = r"^(\.\.\.|…)+|(\.\.\.|…)+$"
_C = V.SPACE_CLASS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def _normal(x: str) -> str:
    straight = f"translate(coalesce({x}, ''), '’‘“”', '''''\"\"')"
    return f"trim({_collapse(straight)}, ' ')"


def _canonical(x: str) -> str:
    bare = f"regexp_replace({_normal(x)}, {_q(_ELLIPSES)}, '', 'g')"
    return f"lower(trim({bare}, {_q(V.TRIMMED_MARKS)}))"


def _lines(x: str) -> str:
    whole = f"regexp_replace({x}, {_q(V.LINE_END)}, chr(10), 'g')"
    return f"CASE WHEN length({x}) = 0 THEN []::VARCHAR[] ELSE string_split(regexp_replace({whole}, '\\n\\z', ''), chr(10)) END"


def half_even(x: str, digits: int) -> str:
    """A column rounded on its exact value: the product's error is found by halves of its bits."""
    s = f"CAST(1e{digits} AS DOUBLE)"
    up = f"(134217729.0::DOUBLE * {x} - (134217729.0::DOUBLE * {x} - {x}))"
    over = f"(({x} * {s} - floor({x} * {s}) - 0.5::DOUBLE) + (({up} * {s} - {x} * {s}) + ({x} - {up}) * {s}))"
    return f"(floor({x} * {s}) + CASE WHEN {over} > 0 OR ({over} = 0 AND floor({x} * {s}) % 2 = 1) THEN 1 ELSE 0 END) / {s}"


def _rule(claim: str, quote: str, modes) -> str:
    def has(x, words):
        padded = f"' ' || {_collapse(f'lower({x})')} || ' '"
        return "(" + " OR ".join(f"contains({padded}, {_q(w)})" for w in words) + ")"

    def nums(x):
        return f"list_distinct(regexp_extract_all(replace({x}, ',', ''), '[0-9]+'))"

    whens = [f"WHEN {claim} = '' OR {quote} = '' THEN 'empty'"]
    whens += [f"WHEN {has(claim, w)} AND NOT {has(quote, w)} THEN '{n}'" for n, w in modes]
    whens.append(f"WHEN len(list_filter({nums(claim)}, lambda n: NOT list_contains({nums(quote)}, n))) > 0 THEN 'numbers'")
    return "CASE " + " ".join(whens) + " ELSE 'ok' END"


_TURNS = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS claim, a.text AS quote FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""

_SPANS = """spans AS (
  SELECT o_custkey, o_orderstatus, CAST(min(year(o_orderdate)) AS INT) AS start, CAST(max(year(o_orderdate)) AS INT) AS "end"
  FROM orders GROUP BY ALL)"""


def _matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _line_action() -> str:
    furniture = " ".join(f"WHEN {_matches('line', p)} THEN true" for p in V.FURNITURE)
    phone = f"WHEN {_matches('line', V.PHONE)} THEN length(regexp_replace(line, '[^0-9]', '', 'g')) >= {V.PHONE_DIGITS}"
    later = " ".join(f"WHEN {_matches('line', p)} THEN true" for p in V.FURNITURE_AFTER_PHONE)
    heads, lists, prose = (_list(x) for x in (V.HEADINGS, V.LIST_SECTIONS, V.PROSE_SECTIONS))
    return f"""
WITH apart AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {_lines("coalesce(text, '')")} AS l FROM documents)),
headed AS (
  SELECT *, CASE WHEN list_contains({heads}, lower(trim({_strip('line')}, ':'))) THEN lower(trim({_strip('line')}, ':')) END AS head,
         {_strip('line')} = '' AS blank, len(regexp_extract_all(line, '[^{_C}]+')) >= {V.PROSE_WORDS} AS prose FROM apart),
carried AS (
  SELECT *, last_value(head IGNORE NULLS) OVER w AS section, count(head) OVER w AS segment FROM headed
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ended AS (
  SELECT *, bool_or(head IS NULL AND (blank OR prose)) OVER (PARTITION BY doc_id, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) AS over FROM carried),
acted AS (
  SELECT doc_id, line, CASE
    WHEN list_contains({_list([*V.LIST_SECTIONS, *V.PROSE_SECTIONS, 'contact'])}, head) THEN 'removed'
    WHEN head IS NOT NULL THEN 'kept'
    WHEN list_contains({lists}, section) AND NOT over THEN 'removed'
    WHEN list_contains({prose}, section) AND blank THEN 'skipped'
    WHEN list_contains({prose}, section) THEN 'removed'
    WHEN NOT blank AND NOT {_matches('line', V.DATE_LINE)} AND (CASE {furniture} {phone} {later} ELSE false END) THEN 'removed'
    ELSE 'kept' END AS action FROM ended)
SELECT doc_id, action, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM acted GROUP BY doc_id, action"""


def _stems(x: str) -> str:
    words = f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9+#]+')), lambda w: length(w) > 2 AND NOT list_contains({_list(V.WEAK_WORDS)}, w))"
    cut = f"regexp_replace(w, '^(.{{{V.MIN_STEM},}}?)(?:{'|'.join(V.SUFFIXES)})$', '\\1')"
    return f"list_distinct(list_transform(list_transform({words}, lambda w: {cut}), lambda c: CASE WHEN rtrim(c, 'e') = '' THEN c ELSE rtrim(c, 'e') END))"


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '{V.TERM}')), lambda w: NOT list_contains({_list(V.STOPWORDS)}, w))"


_GUARD = "CASE " + " ".join(f"WHEN {_matches('said', p)} THEN '{k}'" for p, k in V.MESSAGES) + " END"
_NUMBERS = "list_distinct(regexp_extract_all(replace(coalesce(text, ''), ',', ''), '[0-9]+'))"
_FIRST_LINE = _strip(f"({_lines('t')})[1]")
_HTML = f"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'),
  '<[^>]+>', ' ', 'g'), '{SPACE}{{2,}}', ' ', 'g'), ' ')"""

ORACLE_SQL = {
    "verify_containment": f"""
WITH q AS (SELECT item_id, {_canonical('text')} AS needle FROM benchmark),
d AS (SELECT doc_id, lower({_normal('text')}) AS hay FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(hay, needle) WHERE length(needle) >= {V.MIN_SPAN_CHARS}""",
    "canonical_text": f"""
SELECT doc_id, md5({_normal('text')}) AS "normal", md5({_canonical('text')}) AS canonical,
       md5(trim(trim({_collapse('text')}, ' '), '"“” ')) AS tidy FROM documents""",
    "intake_floor": f"""
SELECT doc_id, CAST(length(t) AS BIGINT) AS n, CASE WHEN t = '' THEN 'empty' WHEN length(t) < 80 THEN 'short' END AS reason
FROM (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents)""",
    "derived_titles": f"""
SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE regexp_replace(substr(f, 1, 77), '\\s+$', '') || '...' END AS title
FROM (SELECT doc_id, {_FIRST_LINE} AS f FROM (SELECT doc_id, {_strip('text')} AS t FROM documents) WHERE t <> '')""",
    "line_classes": _line_action(),
    "html_plain": f"""
SELECT page_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n, length(t) >= 80 AS readable FROM (SELECT page_id, {_HTML} AS t FROM pages)""",
    "gate_turns": f"""
WITH {_TURNS}, c AS (SELECT conv_id, turn, {_strip('claim')} AS claim, {_strip('quote')} AS quote FROM turns),
g AS (SELECT conv_id, turn, {_rule('claim', 'quote', V.TURN_MODES)} AS rule FROM c) SELECT *, rule = 'ok' AS ok FROM g""",
    "guard_turns": f"""
SELECT conv_id, turn, {_GUARD} AS kind FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Hi Ada, ' || text
  WHEN 1 THEN text || ' I''d love to chat' ELSE text END AS said FROM conversations)""",
    "overlap_turns": f"""
WITH {_TURNS}, t AS (SELECT conv_id, turn, {_tokens('claim')} AS a, {_tokens('quote')} AS b FROM turns),
m AS (SELECT *, list_sort(list_filter(a, lambda w: list_contains(b, w))) AS shared_words FROM t)
SELECT conv_id, turn, len(shared_words) AS shared, len(a) AS terms, array_to_string(shared_words, ' ') AS words FROM m""",
    "source_emails": f"""
WITH e AS (SELECT source, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{V.EMAIL}'), lambda x: lower(x)))) AS email FROM documents)
SELECT source, count(DISTINCT email) AS emails, count(*) AS mentions FROM e GROUP BY source""",
    "repeated_lines": f"""
WITH l AS (SELECT doc_id, unnest({_lines("coalesce(text, '')")}) AS line FROM documents),
n AS (SELECT doc_id, line, count(*) AS c FROM l WHERE {_strip('line')} <> '' GROUP BY ALL HAVING c > 1)
SELECT doc_id, count(*) AS repeated, CAST(sum(c) AS BIGINT) AS copies FROM n GROUP BY doc_id""",
    "number_sets": f"""
SELECT doc_id, len(n) AS numbers, array_to_string(list_sort(n), ' ') AS sorted FROM (SELECT doc_id, {_NUMBERS} AS n FROM documents) WHERE len(n) > 0""",
    "stem_counts": f"""
SELECT conv_id, turn, len(s) AS stems, md5(array_to_string(list_sort(s), ' ')) AS digest FROM (SELECT conv_id, turn, {_stems('text')} AS s FROM conversations)""",
    "event_props": """
WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM p GROUP BY event_type""",
    "span_followed": f"""
WITH {_SPANS} SELECT s.*, EXISTS (SELECT 1 FROM spans o WHERE o.o_custkey = s.o_custkey AND o.o_orderstatus <> s.o_orderstatus
  AND o.start >= s."end") AS followed FROM spans s""",
    "span_summaries": f"""
WITH {_SPANS} SELECT o_custkey, string_agg(start || '-' || "end" || ': ' || o_orderstatus, chr(10) ORDER BY start, "end", o_orderstatus) AS summary
FROM spans GROUP BY o_custkey""",
    "event_owner": """
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT * FROM events WHERE event_type = 'signup')
SELECT p.event_id, p.user_id, s.event_id AS owner_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "evidence_rollup": """
WITH s AS (SELECT source, count(*) AS proposed, count(*) FILTER (quality = 1) AS kept, count(DISTINCT lang) FILTER (quality = 1) AS langs
  FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, proposed, kept,
       CASE WHEN kept > 0 THEN round_even(kept / proposed::DOUBLE * least(1.0::DOUBLE, langs / 4.0::DOUBLE) * 0.875::DOUBLE, 2) ELSE 0.0::DOUBLE END AS confidence,
       round_even((proposed - kept) / proposed::DOUBLE, 3) AS drop_rate FROM s""",
    "condition_rollup": """
WITH r AS (SELECT lang AS condition, source, count(*) AS claims, count(*) FILTER (quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT condition, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(good) AS BIGINT) AS verbatim, CAST(sum(claims - good) AS BIGINT) AS fabricated,
       count(*) FILTER (good = claims) AS fully_clean, count(*) FILTER (good = 0) AS fully_invented,
       round_even(CAST(sum(claims - good) AS DOUBLE) / sum(claims), 3) AS fabrication_rate FROM r GROUP BY condition""",
    "region_text": """
SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""",
    "latest_events": """
WITH r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM r WHERE n = 1 ORDER BY ts DESC, user_id LIMIT 8""",
    "label_differences": """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.v AS before, b.v AS now
FROM (SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels) a FULL JOIN (SELECT doc_id, CAST(n_chars > 500 AS BIGINT) AS v FROM documents) b USING (doc_id)
WHERE a.v IS DISTINCT FROM b.v""",
    "dated_spans": f"""
WITH {_SPANS} SELECT o_custkey, o_orderstatus, c_name AS label, start, "end", CAST(1 AS INT) AS line
FROM spans JOIN customer ON o_custkey = c_custkey""",
    "claim_verification": f"""
WITH p AS (SELECT doc_id, text FROM documents WHERE length(text) >= 80),
q AS (SELECT doc_id, {_canonical('substr(text, 5, 60)')} AS needle, lower({_normal('text')}) AS hay FROM p),
k AS (SELECT doc_id, CAST(length(needle) >= 12 AND contains(hay, needle) AS BIGINT) AS kept, length(needle) AS n FROM q),
s AS (SELECT *, kept / 3::DOUBLE * least(1::DOUBLE, kept / 4::DOUBLE) * CASE WHEN n >= 40 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS score FROM k)
SELECT doc_id AS profile_id, CAST(3 AS BIGINT) AS proposed, kept, {half_even('score', 2)} AS confidence FROM s""",
}
