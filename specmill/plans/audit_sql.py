"""The SQL counterparts of the audit queries, for DuckDB, composed of common table expressions."""

from __future__ import annotations

from specmill.functions.text import whitespace
from specmill.operators.corpus import CORPUS_SQL
from specmill.operators.references import PLAIN_DIGITS, WIDE_DIGITS
from specmill.rules import patterns as P
from specmill.rules.tables import (
    ALPHABET,
    CONCLUSIONS,
    FACET_LABELS,
    FACET_OTHER,
    FACET_UNSET,
    FIGURE,
    GLOSSARY,
    HEADING_FRAGMENT,
    HEADING_KEYWORDS,
    MAX_UPPERCASE_HEADING,
    MEASUREMENT_TOKENS,
    MIN_FRAGMENT,
    MIN_SHARED,
    MIN_TOKENS,
    NEAR_RELAXED,
    PRESENCE,
    PRESENCE_MESSAGES,
    RATES,
    RECOMMENDATION_PREFIXES,
    RECOMMENDATIONS,
    REPORT_TEXTS,
    REQUIRED_SECTIONS,
    SEVERITY_LABELS,
    TABLE,
    THRESHOLDS,
    UNIT_REASONS,
    VAGUE_DESCRIPTIONS,
    VAGUE_PHRASES,
)
from specmill.sinks.exports import CHECK_LABELS

WS = whitespace(r"\t-\r\x1c-\x20", "\\x{{{:x}}}")
WS_LINE = whitespace(r"\t\x0b-\r\x1c-\x20", "\\x{{{:x}}}")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def normalize(x: str) -> str:
    a = f"regexp_replace(" + strip(f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')") + f", '{WS_LINE}+', ' ', 'g')"
    b = f"regexp_replace({a}, ' *\\n *', chr(10), 'g')"
    return strip(f"regexp_replace({b}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def cleanup(x: str) -> str:
    a = f"regexp_replace({x}, '\\r\\n|[\\r\\x0b\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    return strip(f"regexp_replace({a}, '{WS_LINE}+\\n', chr(10), 'g')")


def first_line(x: str) -> str:
    return strip(f"split_part({strip(x)}, chr(10), 1)")


def join_blocks(blocks: str) -> str:
    return strip(f"CASE WHEN kind = 'pdf' THEN array_to_string({blocks}, chr(10) || chr(10)) ELSE array_to_string({blocks}, chr(10)) END")


def numbered(x: str) -> str:
    token = f"lower(regexp_replace(regexp_extract({x}, '^\\p{{Nd}}+\\.\\p{{Nd}}+{WS}+([^\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}]+)', 1), '^[.,;:()]+|[.,;:()]+$', '', 'g'))"
    units = ", ".join(q(t) for t in MEASUREMENT_TOKENS)
    return (
        f"(regexp_matches({x}, '^\\p{{Nd}}+\\.{WS}+') OR regexp_matches({x}, '^\\p{{Nd}}+(?:\\.\\p{{Nd}}+){{2,}}{WS}+') "
        f"OR (regexp_matches({x}, '^\\p{{Nd}}+\\.\\p{{Nd}}+{WS}+') AND {token} NOT IN ({units})))"
    )


_KEY = casefold(collapse(f"CASE WHEN {numbered('fl')} THEN regexp_replace(regexp_replace(fl, '^\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*', ''), '^[. ]+', '') ELSE fl END"))
CTE: dict[str, tuple[list[str], str]] = {}


def _add(name: str, needs: list[str], sql: str) -> None:
    CTE[name] = (needs, f"{name} AS ({sql})")


CTE["corpus"] = ([], CORPUS_SQL)
_add("blocks", ["corpus"], "SELECT doc_id, kind, len(blocks) AS n_blocks, unnest(blocks) AS block, unnest(range(len(blocks))) AS block_index FROM corpus")
_add("texts", ["corpus"], f"SELECT doc_id, {casefold(collapse(join_blocks('blocks')))} AS collapsed, {join_blocks('blocks')} AS full_text FROM corpus")
_add("block_lines", ["blocks"], "SELECT doc_id, block_index, string_split(block, chr(10)) AS ls FROM blocks")
_add("lines", ["block_lines"], "SELECT doc_id, block_index, unnest(ls) AS line, unnest(range(len(ls))) AS line_index FROM block_lines")
_add("stripped", ["blocks"], f"SELECT *, {strip('block')} AS body, {first_line('block')} AS fl FROM blocks")
_add(
    "titled", ["stripped"],
    f"SELECT *, CASE WHEN body = '' THEN NULL WHEN {numbered('fl')} THEN fl WHEN length(body) < {MAX_UPPERCASE_HEADING} AND body = upper(body) AND regexp_matches(body, '\\p{{L}}') THEN body "
    f"WHEN lower(body) IN ({', '.join(q(k) for k in HEADING_KEYWORDS)}) THEN body END AS title FROM stripped",
)
_add(
    "heads", ["titled"],
    "SELECT doc_id, n_blocks, title, block_index AS start_block, row_number() OVER (PARTITION BY doc_id ORDER BY block_index) - 1 AS section_ord, "
    "coalesce(lead(block_index) OVER (PARTITION BY doc_id ORDER BY block_index) - 1, n_blocks - 1) AS end_block, " + first_line("title") + " AS fl FROM titled WHERE title IS NOT NULL",
)
_add("leveled", ["heads"], f"SELECT *, CASE WHEN {numbered('title')} THEN len(string_split(regexp_extract(title, '^(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*)', 1), '.')) ELSE 1 END AS level, {_KEY} AS title_key FROM heads")
_add(
    "secs", ["leveled", "corpus"],
    "SELECT s.doc_id, s.section_ord, s.level, (SELECT max(p.section_ord) FROM leveled p WHERE p.doc_id = s.doc_id AND p.section_ord < s.section_ord AND p.level < s.level) AS parent_ord, s.start_block, s.end_block, "
    "coalesce((SELECT min(p.start_block) FROM leveled p WHERE p.doc_id = s.doc_id AND p.section_ord > s.section_ord AND p.level <= s.level) - 1, s.n_blocks - 1) AS subtree_end, s.title, s.title_key, "
    "array_to_string(c.blocks[s.start_block + 1 : s.end_block + 1], chr(10)) AS content_text FROM leveled s JOIN corpus c ON c.doc_id = s.doc_id",
)
_add(
    "rules", [],
    "SELECT * FROM (VALUES " + _values([(i, k, ws[0], n) for i, (k, ws) in enumerate(REQUIRED_SECTIONS) for n in dict.fromkeys(" ".join(w.split()).lower() for w in ws)]) + ") v(rule_ord, section_key, rule_title, title_key)",
)
_add("present", ["secs", "rules"], "SELECT s.doc_id, r.rule_ord, r.section_key, r.rule_title, min(s.section_ord) AS first_ord FROM secs s JOIN rules r ON r.title_key = s.title_key GROUP BY ALL")
_add("missing_sections", ["corpus", "present", "rules"], "SELECT c.doc_id, r.section_key, r.rule_title FROM corpus c CROSS JOIN (SELECT DISTINCT section_key, rule_title FROM rules) r WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.doc_id = c.doc_id AND p.section_key = r.section_key)")
_add("ranked", ["present"], "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_ord, rule_ord) - 1 AS place, row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord) - 1 AS rule_place FROM present")
_add(
    "violations", ["ranked"],
    "SELECT doc_id, min(a.place) AS position, arg_min(w.section_key, a.place) AS expected_key, arg_min(w.rule_title, a.place) AS expected_title, arg_min(a.section_key, a.place) AS found_key, arg_min(a.rule_title, a.place) AS found_title "
    "FROM ranked a JOIN ranked w USING (doc_id) WHERE a.place = w.rule_place AND a.section_key <> w.section_key GROUP BY doc_id",
)
_add("bodies", ["secs"], f"SELECT DISTINCT doc_id FROM secs WHERE NOT regexp_matches(content_text, '^{WS}*$')")
_add(
    "sources", ["secs", "bodies", "corpus"],
    f"SELECT doc_id, section_ord, title AS section_title, content_text AS t FROM secs UNION ALL SELECT doc_id, NULL, NULL, {join_blocks('blocks')} FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM bodies)",
)
_add("split", ["sources"], f"SELECT doc_id, section_ord, section_title, list_filter(string_split(regexp_replace({collapse('t')}, '([.!?…]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS fs FROM sources")
_add("raw_frags", ["split"], "SELECT doc_id, section_ord, section_title, unnest(fs) AS frag, unnest(range(len(fs))) AS frag_idx FROM split")
_add(
    "frags", ["raw_frags"],
    f"SELECT *, length(frag) < {MIN_FRAGMENT} OR (length(frag) < {HEADING_FRAGMENT} AND regexp_matches(frag, '^[\\p{{Nd}}.]+{WS}+[^ ]') AND NOT regexp_matches(frag, '[.!?…]$') AND NOT is_obligation) AS is_heading "
    f"FROM (SELECT *, {casefold('frag')} AS collapsed, regexp_matches({casefold('frag')}, {q(P.OBLIGATION)}) AS is_obligation FROM raw_frags)",
)
_add(
    "oblig", ["frags"],
    "SELECT * REPLACE (CASE WHEN length(frag) = length(collapsed) THEN substring(frag, marker_start + 1, length(marker)) ELSE marker END AS marker), marker_start + length(marker) AS marker_end FROM ("
    f"SELECT *, regexp_extract(collapsed, {q(P.OBLIGATION)}, 1) AS marker, length(regexp_extract(collapsed, {q('(?s)^(.*?' + P.OBLIGATION_BEFORE + ')' + P.OBLIGATION_WORD)}, 1)) AS marker_start, lower(frag) AS low FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, collapsed ORDER BY section_ord NULLS FIRST, frag_idx) AS rn FROM frags WHERE NOT is_heading AND is_obligation) WHERE rn = 1)",
)


def _has(pattern: str, column: str = "collapsed") -> str:
    return f"regexp_matches({column}, {q(P.re2(pattern))})"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(collapsed, {q(w)})" for w in words) + ")"


_add(
    "flags", ["oblig"],
    f"SELECT *, {_has(P.DIGIT, 'low')} AS number, contains(collapsed, '%') AS percent, {_has(P.TIME, 'low')} AS time, {_has(P.UNIT)} AS unit, {_has(P.COMPACT, 'low')} AS compact, {_has(P.COMPACT_LETTER, 'low')} AS letter, "
    f"{_any(THRESHOLDS)} AS threshold, {_any(RATES)} AS rate, {_has(P.RANGE_FROM_TO)} OR {_has(P.RANGE_DASH)} AS span, {_has(P.COMPARISON)} OR {_has(P.COMPARISON_NUMBERS)} AS comparison, "
    f"{_any([p.lower() for p in PRESENCE['acceptance_criteria_check'][1]])} AS acceptance, {_has(P.STANDALONE)} AS alone, {_has('°<S>*[cсfф]')} AS degree FROM oblig",
)
_add(
    "sig", ["flags"],
    "SELECT *, time OR unit OR compact OR letter OR (number AND rate) OR (span AND (percent OR degree)) AS linked, number OR percent OR time OR unit OR compact OR letter OR threshold OR rate OR acceptance OR comparison OR span AS verifiable, "
    "time OR unit OR compact OR letter OR alone AS has_unit, array_to_string(list_filter([CASE WHEN comparison THEN 'comparison' END, CASE WHEN time THEN 'duration' END, CASE WHEN number THEN 'number' END, CASE WHEN percent THEN 'percentage' END, "
    "CASE WHEN span THEN 'range' END, CASE WHEN rate THEN 'rate' END, CASE WHEN threshold THEN 'threshold' END, CASE WHEN unit OR compact OR letter THEN 'unit' END], lambda x: x IS NOT NULL), '|') AS tags FROM flags",
)
_add(
    "reasons", ["sig"],
    f"SELECT *, CASE WHEN linked THEN {q(UNIT_REASONS['linked'])} WHEN number AND has_unit THEN {q(UNIT_REASONS['both'])} WHEN number THEN {q(UNIT_REASONS['number'])} WHEN has_unit THEN {q(UNIT_REASONS['unit'])} ELSE {q(UNIT_REASONS['none'])} END AS reason, "
    "NOT linked AND (number OR has_unit) AS is_finding FROM sig",
)


def _norm(w: str) -> str:
    return " ".join(w.split()).lower()


_add("headings", [], "SELECT * FROM (VALUES " + _values([(c, _norm(h), h) for c, (hs, _) in PRESENCE.items() for h in {_norm(x): x for x in reversed(hs)}.values()]) + ") v(check_key, title_key, heading)")
_add("phrases", [], "SELECT * FROM (VALUES " + _values([(c, i, p, _norm(p)) for c, (_, ps) in PRESENCE.items() for i, p in enumerate(ps)]) + ") v(check_key, ord, phrase, norm)")
_add("by_heading", ["secs", "headings"], "SELECT s.doc_id, h.check_key, arg_min(h.heading, s.section_ord) AS heading FROM secs s JOIN headings h ON h.title_key = s.title_key GROUP BY ALL")
_add("by_phrase", ["texts", "phrases"], "SELECT t.doc_id, p.check_key, arg_min(p.phrase, p.ord) AS phrase, arg_min(p.norm, p.ord) AS norm FROM texts t JOIN phrases p ON contains(t.collapsed, p.norm) GROUP BY ALL")
_add(
    "presence", ["texts", "by_heading", "by_phrase"],
    "SELECT t.doc_id, k.check_key, h.heading IS NOT NULL OR p.phrase IS NOT NULL AS is_present, CASE WHEN h.heading IS NOT NULL THEN 'section_title' WHEN p.phrase IS NOT NULL THEN 'text_phrase' END AS match_type, coalesce(h.heading, p.phrase) AS matched_signal, "
    "CASE WHEN h.heading IS NULL AND p.phrase IS NOT NULL THEN trim(substring(t.collapsed, greatest(strpos(t.collapsed, p.norm) - 1 - 30, 0) + 1, least(strpos(t.collapsed, p.norm) - 1 + length(p.norm) + 120, length(t.collapsed)) - greatest(strpos(t.collapsed, p.norm) - 1 - 30, 0))) "
    "|| CASE WHEN strpos(t.collapsed, p.norm) - 1 + length(p.norm) + 120 < length(t.collapsed) THEN ' ...' ELSE '' END END AS excerpt "
    f"FROM texts t CROSS JOIN (VALUES {_values([(c,) for c in PRESENCE])}) k(check_key) LEFT JOIN by_heading h ON h.doc_id = t.doc_id AND h.check_key = k.check_key LEFT JOIN by_phrase p ON p.doc_id = t.doc_id AND p.check_key = k.check_key",
)


def _spans(name: str, rows: list[tuple[str, str]]) -> None:
    """Whole matches of (group, phrase); a match within a longer one of its group is dropped. In these
    dictionaries overlaps are always containments, so this is the greedy choice."""
    _add(f"{name}_words", [], "SELECT * FROM (VALUES " + _values(rows) + ") v(grp, phrase)")
    _add(f"{name}_gaps", ["texts", f"{name}_words"], f"SELECT t.doc_id, t.collapsed, w.grp, w.phrase, string_split(t.collapsed, w.phrase) AS gaps FROM texts t JOIN {name}_words w ON contains(t.collapsed, w.phrase)")
    _add(
        f"{name}_all", [f"{name}_gaps"],
        f"SELECT doc_id, collapsed, grp, phrase, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + (i - 1) * length(phrase) AS s FROM (SELECT *, unnest(range(1, len(gaps))) AS i FROM {name}_gaps) "
        f"WHERE NOT regexp_matches(gaps[i], '[\\p{{L}}\\p{{N}}_]$') AND NOT regexp_matches(gaps[i + 1], '^[\\p{{L}}\\p{{N}}_]')",
    )
    _add(
        f"{name}_hits", [f"{name}_all"],
        f"SELECT a.* FROM {name}_all a WHERE NOT EXISTS (SELECT 1 FROM {name}_all b WHERE b.doc_id = a.doc_id AND b.grp = a.grp AND length(b.phrase) > length(a.phrase) AND b.s <= a.s AND b.s + length(b.phrase) >= a.s + length(a.phrase))",
    )


_spans("vague", [("v", p) for ps in VAGUE_PHRASES.values() for p in ps])
_spans("term", [(k, a) for k, c, o in GLOSSARY if o for a in (c, *o)])
_description = "CASE phrase " + " ".join(f"WHEN {q(p)} THEN {q(d)}" for p, d in VAGUE_DESCRIPTIONS.items()) + " END"
_category = "CASE phrase " + " ".join(f"WHEN {q(p)} THEN {q(c)}" for c, ps in VAGUE_PHRASES.items() for p in ps) + " END"
_add(
    "vague", ["vague_hits"],
    f"SELECT doc_id, s::BIGINT AS start_pos, (s + length(phrase))::BIGINT AS end_pos, phrase, {_category} AS category, {_description} AS description, CASE WHEN s > 40 THEN '... ' ELSE '' END || "
    "trim(substring(collapsed, (greatest(s - 40, 0) + 1)::BIGINT, (least(s + length(phrase) + 120, length(collapsed)) - greatest(s - 40, 0))::BIGINT)) || CASE WHEN s + length(phrase) + 120 < length(collapsed) THEN ' ...' ELSE '' END AS excerpt FROM vague_hits",
)
_add("terms", ["term_hits"], "SELECT doc_id, grp AS term_key, phrase AS alias, count(*) AS n, min(s)::BIGINT AS first_pos FROM term_hits GROUP BY ALL")
_add("mixed", ["terms"], "SELECT doc_id, term_key, array_to_string(list_sort(list(alias)), ', ') AS used_variants, sum(n)::BIGINT AS total FROM terms GROUP BY ALL HAVING count(*) >= 2")


def _number(x: str) -> str:
    return f"CASE WHEN ltrim(translate({x}, {q(WIDE_DIGITS)}, {q(PLAIN_DIGITS)}), '0') = '' THEN '0' ELSE ltrim(translate({x}, {q(WIDE_DIGITS)}, {q(PLAIN_DIGITS)}), '0') END"


def _numbered_refs(name: str, words: tuple[list[str], list[str]]) -> None:
    mentions, captions = "|".join(words[0]), "|".join(words[1])
    _add(f"{name}_lines", ["lines"], f"SELECT doc_id, block_index, line_index, lower({strip('line')}) AS low FROM lines WHERE contains(lower(line), {q(words[1][0][:3])})")
    _add(f"{name}_roles", [f"{name}_lines"], f"SELECT *, regexp_extract(low, '^(?:{captions}){WS}*(\\p{{Nd}}+)', 1) AS declared FROM {name}_lines")
    _add(
        f"{name}_refs", [f"{name}_roles"],
        f"SELECT doc_id, 'declaration' AS role, {_number('declared')} AS label FROM {name}_roles WHERE declared <> '' UNION ALL "
        f"SELECT doc_id, 'mention', {_number('label')} FROM (SELECT doc_id, unnest(regexp_extract_all(low, '(?:^|[^а-яёa-z0-9])(?:{mentions}){WS}*(\\p{{Nd}}+)', 1)) AS label FROM {name}_roles WHERE declared = '')",
    )


_numbered_refs("figure", FIGURE)
_numbered_refs("table", TABLE)
_L = r"([а-яё]|\p{Nd}+)(?:[^а-яёa-z0-9]|$)"
_add("appendix_lines", ["lines"], f"SELECT doc_id, lower({collapse('line')}) AS low FROM lines WHERE contains(lower(line), 'приложени')")
_add(
    "appendix_roles", ["appendix_lines"],
    f"SELECT *, CASE WHEN regexp_matches(low, '^приложение к(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN '' ELSE regexp_extract(low, '^приложение {_L}', 1) END AS declared FROM appendix_lines",
)
_add(
    "appendix_found", ["appendix_roles"],
    "SELECT doc_id, declared, CASE WHEN declared <> '' THEN [declared] ELSE list_concat("
    f"list_filter(regexp_extract_all(low, '(?:^|[^а-яёa-z0-9])(?:приложение|приложении|приложению) {_L}', 1), lambda x: x <> 'к'), "
    f"regexp_extract_all(regexp_replace(low, 'приложения к ', 'приложения  ', 'g'), '(?:^|[^а-яёa-z0-9])приложения {_L}', 1)) END AS labels FROM appendix_roles",
)
_add(
    "appendix_refs", ["appendix_found"],
    "SELECT doc_id, CASE WHEN declared <> '' THEN 'declaration' ELSE 'mention' END AS role, CASE WHEN regexp_matches(label, '^\\p{Nd}+$') THEN CASE WHEN ltrim(label, '0') = '' THEN '0' ELSE ltrim(label, '0') END ELSE upper(label) END AS label "
    "FROM (SELECT doc_id, declared, unnest(labels) AS label FROM appendix_found)",
)
for _n in ("figure", "table", "appendix"):
    _add(
        f"{_n}_summary", [f"{_n}_refs"],
        f"SELECT *, CASE WHEN declarations = 0 THEN 'missing' WHEN mentions = 0 THEN 'unreferenced' ELSE 'ok' END AS state, declarations > 1 AS is_duplicate FROM (SELECT doc_id, label, count(*) FILTER (role = 'mention') AS mentions, count(*) FILTER (role = 'declaration') AS declarations FROM {_n}_refs GROUP BY ALL)",
    )
    _add(f"{_n}_numbers", [f"{_n}_refs"], f"SELECT DISTINCT doc_id, try_cast(label AS BIGINT) AS v FROM {_n}_refs WHERE role = 'declaration' AND try_cast(label AS BIGINT) IS NOT NULL")
    _add(f"{_n}_gaps", [f"{_n}_numbers"], f"SELECT doc_id, unnest(range(v + 1, nxt)) AS missing FROM (SELECT doc_id, v, lead(v) OVER (PARTITION BY doc_id ORDER BY v) AS nxt FROM {_n}_numbers) WHERE nxt > v + 1")
_add("letters", ["appendix_refs"], f"SELECT DISTINCT doc_id, strpos('{ALPHABET}', label) AS pos FROM appendix_refs WHERE role = 'declaration' AND length(label) = 1 AND strpos('{ALPHABET}', label) > 0")
_add("letter_gaps", ["letters"], f"SELECT doc_id, substring('{ALPHABET}', pos, 1) AS missing FROM (SELECT doc_id, unnest(range(pos + 1, nxt)) AS pos FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM letters) WHERE nxt > pos + 1)")

_PLAIN = "trim(regexp_replace(regexp_replace(collapsed, '[^\\p{L}\\p{N}_ ]+', ' ', 'g'), ' +', ' ', 'g'))"
_add("keyed", ["frags"], f"SELECT *, {_PLAIN} AS key FROM frags WHERE NOT is_heading AND {_PLAIN} <> ''")
_add(
    "exact", ["keyed"],
    "SELECT doc_id, key, count(*) AS occurrences, (list_sort(list({'i': frag_idx, 'f': frag}))[1]).f AS text, array_to_string(list_transform(list_sort(list_distinct(list(frag_idx))), lambda x: x::VARCHAR), '|') AS fragment_indexes, "
    "array_to_string(list_sort(list_distinct(list(section_title))), ', ') AS section_titles FROM keyed GROUP BY doc_id, key HAVING count(*) > 1",
)
_add(
    "wordsets", ["keyed"],
    "SELECT doc_id, key, list_distinct(regexp_extract_all(c, '[\\p{L}\\p{N}_]+')) AS ws FROM (SELECT doc_id, key, arg_min(collapsed, {'a': coalesce(section_ord, -1), 'b': frag_idx}) AS c FROM keyed GROUP BY doc_id, key)",
)
_add(
    "near", ["wordsets"],
    f"SELECT * FROM (SELECT a.doc_id, a.key AS key_a, b.key AS key_b, len(list_intersect(a.ws, b.ws)) AS shared, len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) AS jaccard "
    f"FROM wordsets a JOIN wordsets b ON a.doc_id = b.doc_id AND a.key < b.key WHERE len(a.ws) >= {MIN_TOKENS} AND len(b.ws) >= {MIN_TOKENS} AND least(len(a.ws), len(b.ws)) >= {NEAR_RELAXED} * greatest(len(a.ws), len(b.ws)) - 1e-9) WHERE shared >= {MIN_SHARED} AND jaccard >= {NEAR_RELAXED}",
)


def _issue(source: str, check: str, code: str, severity: str, message: str, fragment: str = "NULL", section: str = "NULL", index: str = "NULL", where: str = "true") -> str:
    return (
        f"SELECT doc_id, {check} AS check_key, {code} AS issue_code, {q(severity)} AS severity, {message} AS message, nullif(trim({fragment}), '') AS fragment_text, nullif(trim({section}), '') AS section_title, "
        f"{index} AS fragment_index FROM {source} WHERE {where}"
    )


def _ref_issues(kind: str, noun: str, declared: str, caption: str, twice: str, plural: str) -> list[str]:
    check = q(f"{kind}_references_check")
    s = f"{kind}_summary"
    return [
        _issue(s, check, q(f"{kind}.missing_declaration"), "warning", f"{q('Упоминается ' + noun + ' ')} || label || {q(f', но строка объявления {caption} с этим номером не найдена.')}", where="state = 'missing'"),
        _issue(s, check, q(f"{kind}.unreferenced"), "warning", f"{q(f'{declared} {noun} ')} || label || ', но в тексте не найдено упоминание этого номера.'", where="state = 'unreferenced'"),
        _issue(s, check, q(f"{kind}.duplicate_declaration"), "warning", f"{q(noun.capitalize() + ' ')} || label || {q(f' {twice} более одного раза.')}", where="is_duplicate"),
        _issue(f"{kind}_gaps", check, q(f"{kind}.caption_numbering_gap"), "recommendation", f"{q(f'В последовательности номеров подписей к {plural} пропущен номер ')} || missing::VARCHAR || '.'"),
    ]


_ISSUES = [
    _issue("vague", "'vague_wording_check'", "'vague_wording.dictionary_phrase'", "recommendation", "description", "excerpt"),
    _issue("sig", "'unverifiable_requirements_check'", "'unverifiable.obligation_without_metrics'", "warning", "'формулировка требования без измеримых критериев'", "frag", "section_title", "frag_idx", "NOT verifiable"),
    _issue("missing_sections", "'required_sections_check'", "'required_sections.missing.' || section_key", "warning", "'Отсутствует обязательный раздел: «' || rule_title || '».'"),
    _issue("violations", "'section_order_check'", "'section_order.violation'", "warning", "'Нарушен ожидаемый порядок разделов: после «' || expected_title || '» ожидался фрагмент структуры, фактически обнаружен раздел «' || found_title || '».'"),
    _issue("sig", "'numerical_characteristics_check'", "'numerical.missing_in_obligation_fragment'", "recommendation", "'В формулировке требования не обнаружены числовые характеристики (проценты, диапазоны, единицы и т.п.).'", "frag", "section_title", "frag_idx", "tags = ''"),
    _issue("reasons", "'measurement_units_check'", "'measurement.unit_linkage_review'", "recommendation", "reason", "frag", "section_title", "frag_idx", "is_finding"),
    _issue(
        "presence", "check_key", "CASE check_key " + " ".join(f"WHEN {q(k)} THEN {q(c)}" for k, (c, _) in PRESENCE_MESSAGES.items()) + " END", "warning",
        "CASE check_key " + " ".join(f"WHEN {q(k)} THEN {q(m)}" for k, (_, m) in PRESENCE_MESSAGES.items()) + " END", where="NOT is_present",
    ),
    *_ref_issues("figure", "рисунок", "Объявлен", "рисунка (подпись)", "объявлен (подписан)", "рисункам"),
    *_ref_issues("table", "таблица", "Объявлена", "таблицы (заголовок)", "объявлена (подписана)", "таблицам"),
    _issue("appendix_summary", "'appendix_references_check'", "'appendix.missing_declaration.' || label", "warning", "'Упоминается приложение ' || label || ', но строка объявления приложения с этим обозначением не найдена.'", where="state = 'missing'"),
    _issue("appendix_summary", "'appendix_references_check'", "'appendix.unreferenced.' || label", "warning", "'Объявлено приложение ' || label || ', но в тексте не найдено соответствующее упоминание.'", where="state = 'unreferenced'"),
    _issue("appendix_summary", "'appendix_references_check'", "'appendix.duplicate_declaration.' || label", "warning", "'Приложение ' || label || ' объявлено более одного раза.'", where="is_duplicate"),
    _issue("letter_gaps", "'appendix_references_check'", "'appendix.cyrillic_sequence_gap.' || missing", "recommendation", "'В последовательности обозначений приложений (кириллица) пропущена буква «' || missing || '».'"),
    _issue("appendix_gaps", "'appendix_references_check'", "'appendix.numeric_sequence_gap.' || missing::VARCHAR", "recommendation", "'В последовательности номеров приложений пропущен номер ' || missing::VARCHAR || '.'"),
    _issue("mixed", "'terminology_consistency_check'", "'terminology.mixed_variants.' || term_key", "recommendation", "'для одного термина использованы разные варианты наименования'"),
    _issue("exact", "'duplicate_formulations_check'", "'duplicate.exact'", "warning", "'в документе повторяется одинаковая формулировка'", "text", "section_titles"),
    _issue("near_texts", "'duplicate_formulations_check'", "'duplicate.near'", "warning", "'обнаружены очень похожие формулировки'", "text_a || ' — ' || text_b", where="jaccard >= 0.88"),
]
_add("firsts", ["keyed"], "SELECT doc_id, key, min({'a': coalesce(section_ord, -1), 'b': frag_idx, 'f': frag}) AS f FROM keyed GROUP BY doc_id, key")
# Near pairs that only their sequences of characters decide (words between 0.80 and 0.88) can't be told in SQL.
_add(
    "near_texts", ["near", "firsts"],
    "SELECT n.doc_id, n.jaccard, CASE WHEN (a.f.a, a.f.b) <= (b.f.a, b.f.b) THEN a.f.f ELSE b.f.f END AS text_a, CASE WHEN (a.f.a, a.f.b) <= (b.f.a, b.f.b) THEN b.f.f ELSE a.f.f END AS text_b "
    "FROM near n JOIN firsts a ON a.doc_id = n.doc_id AND a.key = n.key_a JOIN firsts b ON b.doc_id = n.doc_id AND b.key = n.key_b",
)
_add(
    "raw_issues",
    ["vague", "reasons", "missing_sections", "violations", "presence", "figure_summary", "figure_gaps", "table_summary", "table_gaps", "appendix_summary", "appendix_gaps", "letter_gaps", "mixed", "exact", "near_texts"],
    " UNION ALL ".join(_ISSUES),
)
_RECOMMENDATION = "CASE " + " ".join(f"WHEN issue_code = {q(c)} THEN {q(t)}" for c, t in RECOMMENDATIONS.items()) + " " + " ".join(f"WHEN starts_with(issue_code, {q(c)}) THEN {q(t)}" for c, t in RECOMMENDATION_PREFIXES.items()) + " END"
_add(
    "issues", ["raw_issues"],
    f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY check_key, issue_code, message, coalesce(fragment_text, ''), coalesce(fragment_index, -1)) AS issue_ord, {_RECOMMENDATION} AS recommendation FROM raw_issues",
)
_add("counted", ["issues"], "SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'recommendation') AS r, count(*) FILTER (recommendation IS NOT NULL) AS rec FROM issues GROUP BY 1")
_add(
    "report", ["corpus", "counted"],
    "SELECT *, CASE status " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in CONCLUSIONS.items()) + " END AS conclusion FROM (SELECT d.doc_id, coalesce(n, 0) AS total_issues, coalesce(c, 0) AS critical, coalesce(w, 0) AS warning, coalesce(r, 0) AS recommendation, 0::BIGINT AS unspecified, "
    "coalesce(rec, 0) AS with_recommendation, CASE WHEN coalesce(n, 0) = 0 THEN 'no_issues' WHEN c + w > 0 THEN 'needs_review' ELSE 'recommendations_only' END AS status FROM corpus d LEFT JOIN counted x ON x.doc_id = d.doc_id)",
)


def sql(final: str, *needs: str) -> str:
    """The statement with the common table expressions that it needs, in order."""
    out: dict[str, str] = {}

    def visit(name: str) -> None:
        if name not in out:
            for n in CTE[name][0]:
                visit(n)
            out[name] = CTE[name][1]

    for n in needs:
        visit(n)
    return ("WITH " + ", ".join(out.values()) + " " if out else "") + final


def _once(table: str, column: str) -> str:
    return f"(SELECT doc_id, any_value({column}) AS x FROM {table} WHERE {column} IS NOT NULL GROUP BY doc_id)"


_NAME = "CASE WHEN coalesce(filename, '') = '' OR string_split(filename, '/')[-1] = '' THEN 'upload' ELSE string_split(filename, '/')[-1] END"
_EXT = f"lower(regexp_extract({_NAME}, '(?s)^.+(\\.[^.]+)$', 1))"
_KIND = f"lower({strip('split_part(coalesce(content_type, ' + q('') + '), ' + q(';') + ', 1)')})"
_STEM0 = f"string_split(coalesce(nullif({strip('filename')}, ''), 'document'), '/')[-1]"
_STEM1 = f"CASE WHEN regexp_matches(b, '(?s)^.+\\.[^.]*$') THEN regexp_replace(b, '\\.[^.]*$', '') ELSE b END"
_CLEAN = f"regexp_replace({_STEM1}, '[\\x00-\\x1f<>:\"/\\\\|?*]+', '_', 'g')"
_RESERVED = f"regexp_replace({_CLEAN}, '^((?i)(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]))(\\.|$)', '_\\1\\2')"

# what XML can't hold is left out, as it is in the files
_PLAIN_XML = "regexp_replace(regexp_replace(replace(coalesce(p, ''), chr(13) || chr(10), chr(10)), '\\r', chr(10), 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffe}\\x{ffff}]', '', 'g')"
_add(
    "csv_lines", ["issues"],
    "SELECT doc_id, 0::BIGINT AS line_no, 'index,severity,check_key,issue_code,message,section_title,fragment_text,recommendation,category' AS line FROM (SELECT DISTINCT doc_id FROM issues) UNION ALL SELECT doc_id, issue_ord, array_to_string(list_transform("
    "[issue_ord::VARCHAR, severity, check_key, issue_code, message, coalesce(section_title, ''), coalesce(fragment_text, ''), coalesce(recommendation, ''), coalesce(CASE check_key " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in CHECK_LABELS.items()) + " END, '')], "
    "lambda c: CASE WHEN regexp_matches(c, '[\",\\r\\n]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END), ',') FROM issues",
)


_SEVERITY = "CASE severity " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in SEVERITY_LABELS.items()) + " END"
_CHECK = "CASE check_key " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in CHECK_LABELS.items()) + " ELSE check_key END"
_LABELLED = ", ".join(
    f"CASE WHEN nullif(trim({x}), '') IS NOT NULL THEN {q(REPORT_TEXTS[k] + ' ')} || {strip(x)} END"
    for k, x in (("severity", _SEVERITY), ("check_key", _CHECK), ("message", "message"), ("section_title", "section_title"), ("fragment_text", "fragment_text"), ("recommendation", "recommendation"))
)
_heading, _count = REPORT_TEXTS["issue"].replace("{}", ""), REPORT_TEXTS["count"].replace("{}", "")
_add(
    "report_lines", ["report", "issues"],
    "SELECT doc_id, unnest(range(len(ls))) AS idx, unnest(ls) AS text FROM (SELECT r.doc_id, list_concat("
    f"[{q(REPORT_TEXTS['title'])}, {q(REPORT_TEXTS['file'] + ' ')} || coalesce(nullif({strip('u.filename')}, ''), '—'), r.conclusion, {q(_count)} || r.total_issues::VARCHAR, {q(REPORT_TEXTS['list'])}], "
    f"coalesce(i.ls, [{q(REPORT_TEXTS['none'])}])) AS ls FROM report r LEFT JOIN (SELECT DISTINCT doc_id, filename FROM uploads) u ON u.doc_id = r.doc_id LEFT JOIN (SELECT doc_id, flatten(list(x ORDER BY issue_ord)) AS ls FROM ("
    f"SELECT doc_id, issue_ord, list_filter([{q(_heading)} || issue_ord::VARCHAR, {_LABELLED}], lambda x: x IS NOT NULL) AS x FROM issues) GROUP BY 1) i ON i.doc_id = r.doc_id)",
)

SQL: dict[str, str] = {
    "upload_kinds": f"SELECT DISTINCT doc_id, {_NAME} AS client_name, CASE WHEN {_EXT} IN ('.docx', '.pdf') THEN {_EXT} WHEN {_EXT} = '' THEN CASE {_KIND} WHEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN '.docx' WHEN 'application/pdf' THEN '.pdf' WHEN 'application/x-pdf' THEN '.pdf' END END AS suffix FROM uploads",
    "export_stems": f"SELECT doc_id, coalesce(nullif(left({strip(_RESERVED)}, 120), ''), 'document') AS stem FROM (SELECT DISTINCT doc_id, {_STEM0} AS b FROM uploads)",
    "normalized_paragraphs": f"SELECT doc_id, unnest(range(len(x))) AS idx, unnest(list_transform(x, lambda p: {normalize('p')})) AS text FROM {_once('docx_extraction', 'paragraphs')}",
    "cleaned_pages": f"SELECT doc_id, unnest(range(len(x))) AS idx, unnest(list_transform(x, lambda p: {normalize(cleanup('p'))})) AS text FROM {_once('pdf_extraction', 'pages')}",
    "unified_texts": f"SELECT doc_id, kind, len(bs) AS n_blocks, {join_blocks('bs')} AS full_text FROM (SELECT doc_id, 'docx' AS kind, list_transform(x, lambda p: {normalize('p')}) AS bs FROM {_once('docx_extraction', 'paragraphs')} UNION ALL SELECT doc_id, 'pdf', list_transform(x, lambda p: {normalize(cleanup('p'))}) FROM {_once('pdf_extraction', 'pages')})",
    "casefolded_texts": sql("SELECT doc_id, collapsed FROM texts", "texts"),
    "line_counts": sql("SELECT doc_id, block_index, count(*) AS n_lines, max(length(line)) AS longest FROM lines GROUP BY ALL", "lines"),
    "sections": sql("SELECT doc_id, section_ord, level, parent_ord, start_block, end_block, subtree_end, title, title_key FROM secs", "secs"),
    "section_contents": sql("SELECT doc_id, section_ord, length(content_text) AS n_chars, md5(content_text) AS digest FROM secs", "secs"),
    "required_present": sql("SELECT doc_id, section_key, first_ord FROM present", "present"),
    "required_missing": sql("SELECT doc_id, section_key FROM missing_sections", "missing_sections"),
    "section_order": sql("SELECT doc_id, position, expected_key, found_key FROM violations", "violations"),
    "structure_completeness": sql(
        f"SELECT c.doc_id, coalesce(s.n, 0) AS n_sections, coalesce(p.n, 0) AS n_present, round(coalesce(p.n, 0) / {len(REQUIRED_SECTIONS)}, 4) AS completeness_ratio, coalesce(p.n, 0) = {len(REQUIRED_SECTIONS)} AS is_complete, coalesce(s.n, 0) = 0 AS no_sections "
        "FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n FROM secs GROUP BY 1) s ON s.doc_id = c.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM present GROUP BY 1) p ON p.doc_id = c.doc_id", "corpus", "secs", "present",
    ),
    "presence": sql("SELECT * FROM presence", "presence"),
    "fragments": sql("SELECT doc_id, section_ord, frag_idx, frag, is_heading, is_obligation FROM frags", "frags"),
    "obligations": sql("SELECT doc_id, section_ord, frag_idx, collapsed, marker, marker_start, marker_end FROM oblig", "oblig"),
    "signals": sql("SELECT doc_id, collapsed, number, percent, time, unit, compact, letter, threshold, rate, span, comparison, acceptance, linked, verifiable, tags FROM sig", "sig"),
    "unverifiable": sql("SELECT doc_id, section_title, frag_idx, frag, marker FROM sig WHERE NOT verifiable", "sig"),
    "numerical": sql("SELECT doc_id, count(*) AS items, count(*) FILTER (tags <> '') AS numeric_items, count(*) FILTER (tags <> '') > 0 AS has_numeric_findings FROM sig GROUP BY 1", "sig"),
    "measurement": sql("SELECT doc_id, collapsed, number, has_unit, linked, reason, is_finding FROM reasons", "reasons"),
    "vague": sql("SELECT * FROM vague", "vague"),
    "vague_by_category": sql("SELECT category, phrase, count(*) AS n, count(DISTINCT doc_id) AS docs FROM vague GROUP BY ALL", "vague"),
    "term_counts": sql("SELECT * FROM terms", "terms"),
    "mixed_terms": sql("SELECT * FROM mixed", "mixed"),
    **{f"{k}_references": sql(f"SELECT doc_id, role, label, count(*) AS n FROM {k}_refs GROUP BY ALL", f"{k}_refs") for k in ("figure", "table", "appendix")},
    **{f"{k}_summary": sql(f"SELECT * FROM {k}_summary", f"{k}_summary") for k in ("figure", "table", "appendix")},
    **{f"{k}_gap_ranges": sql(f"SELECT doc_id, v + 1 AS first_missing, nxt - 1 AS last_missing FROM (SELECT doc_id, v, lead(v) OVER (PARTITION BY doc_id ORDER BY v) AS nxt FROM {k}_numbers) WHERE nxt > v + 1", f"{k}_numbers") for k in ("figure", "table", "appendix")},
    **{f"{k}_gaps": sql(f"SELECT * FROM {k}_gaps", f"{k}_gaps") for k in ("figure", "table", "appendix")},
    "appendix_letter_gaps": sql("SELECT * FROM letter_gaps", "letter_gaps"),
    "duplicates_exact": sql("SELECT doc_id, key, occurrences, text, fragment_indexes FROM exact", "exact"),
    "duplicates_near_words": sql("SELECT doc_id, key_a, key_b, round(jaccard, 6) AS jaccard FROM near", "near"),
    "issues": sql("SELECT doc_id, issue_ord, check_key, issue_code, severity, message, fragment_text, section_title, fragment_index, recommendation FROM issues", "issues"),
    "issues_by_check": sql("SELECT check_key, issue_code, severity, recommendation, count(*) AS n, count(DISTINCT doc_id) AS docs FROM issues GROUP BY ALL", "issues"),
    "issues_grouping_sets": sql("SELECT check_key, severity, count(*) AS n FROM issues GROUP BY GROUPING SETS ((check_key), (severity), ())", "issues"),
    "issue_facets": sql(
        "SELECT facet, value, n, coalesce(known, other || CASE WHEN sum(CASE WHEN known IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY facet) > 1 THEN ' №' || (sum(CASE WHEN known IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY facet ORDER BY value))::BIGINT::VARCHAR ELSE '' END) AS label FROM ("
        + " UNION ALL ".join(
            f"SELECT {q(f)} AS facet, {f} AS value, count(*) AS n, CASE {f} " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in FACET_LABELS[f].items()) + f" WHEN '' THEN {q(FACET_UNSET[f])} END AS known, {q(FACET_OTHER[f])} AS other FROM issues GROUP BY 2"
            for f in FACET_LABELS
        )
        + ")",
        "issues",
    ),
    "report_groups": sql(
        "SELECT doc_id, 'by_severity' AS grouping, severity AS value, string_agg(issue_ord::VARCHAR, '|' ORDER BY issue_ord) AS issue_ords FROM issues GROUP BY 1, 3 UNION ALL SELECT doc_id, 'by_check', check_key, string_agg(issue_ord::VARCHAR, '|' ORDER BY issue_ord) FROM issues GROUP BY 1, 3", "issues",
    ),
    "issues_filtered": sql("SELECT doc_id, count(*) AS n FROM issues WHERE check_key = 'figure_references_check' AND severity = 'warning' GROUP BY 1", "issues"),
    "report": sql("SELECT * FROM report", "report"),
    "report_by_check": sql("SELECT d.doc_id, coalesce(x.by_check, '') AS by_check FROM corpus d LEFT JOIN (SELECT doc_id, string_agg(check_key || '=' || n::VARCHAR, '|' ORDER BY check_key) AS by_check FROM (SELECT doc_id, check_key, count(*) AS n FROM issues GROUP BY ALL) GROUP BY 1) x ON x.doc_id = d.doc_id", "corpus", "issues"),
    "csv_rows": sql("SELECT * FROM csv_lines", "csv_lines"),
    "csv_files": sql("SELECT doc_id, chr(65279) || string_agg(line, chr(13) || chr(10) ORDER BY line_no) || chr(13) || chr(10) AS content FROM csv_lines GROUP BY 1", "csv_lines"),
    "payload_conclusions": sql("SELECT doc_id, conclusion, total_issues AS issues FROM report", "report"),
    "payload_fragments": sql("SELECT doc_id, issue_ord, check_key, severity, message, fragment_text FROM issues", "issues"),
    "docx_files": f"SELECT doc_id, unnest(range(len(x))) AS idx, unnest(list_transform(x, lambda p: {strip(_PLAIN_XML)})) AS text FROM {_once('docx_extraction', 'paragraphs')}",
    "dispositions": f"SELECT doc_id, 'attachment; filename=\"' || regexp_replace(regexp_replace(n, '[^\\x00-\\x7f]', '_', 'g'), '[\"\\\\?]', '_', 'g') || '\"; filename*=UTF-8' || chr(39) || chr(39) || url_encode(n) AS header FROM (SELECT doc_id, coalesce(nullif(left({strip(_RESERVED)}, 120), ''), 'document') || '-report.docx' AS n FROM (SELECT DISTINCT doc_id, {_STEM0} AS b FROM uploads))",
    "report_files": sql(
        f"SELECT r.doc_id, coalesce(nullif(left({strip(_RESERVED)}, 120), ''), 'document') || '-report.docx' AS filename, r.idx, r.text FROM report_lines r JOIN (SELECT c.doc_id, {_STEM0} AS b FROM corpus c LEFT JOIN (SELECT DISTINCT doc_id, filename FROM uploads) u ON u.doc_id = c.doc_id) n ON n.doc_id = r.doc_id", "report_lines", "corpus",
    ),
}
