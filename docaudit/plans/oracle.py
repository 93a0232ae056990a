"""SQL for DuckDB that states what the rule families report, from the same rule data."""

from __future__ import annotations

from docaudit.plans import model
from docaudit.plans.rules import Forms, Pattern, Phrases, Settings

_NORMAL = Settings()


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _number(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {_text(pattern)}))"


def _patterns(rules: tuple[Pattern, ...]) -> str:
    parts = []
    for r in rules:
        limit = _NORMAL.limit(r.rule, r.limits)
        lang = "TRUE" if r.lang is None else f"lang = {_text(r.lang)}"
        fires = f"n_words >= 200 AND round(n * 1000.0 / greatest(n_words, 1)) > {limit}" if r.kind == "density" else f"n >= {limit}"
        parts.append(f"SELECT doc_id, {_text(r.rule)} AS rule, {_text(r.severity)} AS severity, n FROM (SELECT doc_id, n_words, CASE WHEN {lang} THEN {_number(r.pattern)} ELSE 0 END AS n FROM counted) WHERE {fires}")
    return "\nUNION ALL ".join(parts)


def _forms(rules: tuple[Forms, ...]) -> str:
    parts = []
    for r in rules:
        limit = _NORMAL.limit(r.rule, r.limits)
        lang = "TRUE" if r.lang is None else f"lang = {_text(r.lang)}"
        fires = {"least": f"least(a, b) >= {limit}", "count": f"least(a, b) > 0 AND least(a, b) <= {limit} AND a <> b", "share": f"least(a, b) > 0 AND least(a, b) * 100 <= (a + b) * {limit} AND a <> b"}[r.bound]
        parts.append(f"SELECT doc_id, {_text(r.rule)} AS rule, {_text(r.severity)} AS severity, least(a, b) AS n FROM (SELECT doc_id, lang, {_number(r.first)} AS a, {_number(r.second)} AS b FROM counted) WHERE {lang} AND {fires}")
    return "\nUNION ALL ".join(parts)


#: Documents with their number of words.
_COUNTED = r"counted AS (SELECT doc_id, lang, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0)) AS n_words FROM documents WHERE text IS NOT NULL)"


def _phrases(rules: tuple[Phrases, ...]) -> str:
    rows = ", ".join(f"({_text(r.rule)}, {k}, {_text(p)}, {len(p.split())}, {_text(r.where)}, {_text(r.lang)}, {_NORMAL.limit(r.rule, r.limits)}, {_text(r.kind)}, {_text(r.severity)})" for r in rules for k, p in enumerate(r.phrases))
    return f"""lexicon AS (SELECT * FROM (VALUES {rows}) v(rule, ordinal, phrase, size, place, language, bound, kind, severity)),
listed AS (SELECT doc_id, lang, para, sent, list(word ORDER BY pos) AS w FROM words GROUP BY ALL),
ordered AS (SELECT s.doc_id, s.lang, s.para, s.sent, l.w, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.para, s.sent) AS nth, max(s.para) OVER (PARTITION BY s.doc_id) AS last FROM sentences s LEFT JOIN listed l USING (doc_id, para, sent)),
spots AS (SELECT doc_id, lang, para, sent, nth, last, w, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM ordered),
hits AS (SELECT doc_id, rule, bound, kind, severity, para, sent, min(ordinal) AS ordinal, arg_min(phrase, ordinal) AS phrase FROM spots JOIN lexicon ON word = string_split(phrase, ' ')[1] AND lang = language
  WHERE array_to_string(w[pos:pos + size - 1], ' ') = phrase AND (place = 'any' OR (place = 'start' AND pos = 1) OR (place = 'opening' AND nth <= 4) OR (place = 'closing' AND para = last)) GROUP BY ALL),
tallied AS (SELECT doc_id, rule, bound, kind, severity, count(*) AS n, arg_min(phrase, para * 100000 + sent) AS quote FROM hits GROUP BY ALL),
phrase_found AS (SELECT doc_id, rule, severity, n, quote FROM tallied JOIN counted USING (doc_id) WHERE CASE kind WHEN 'least' THEN n >= bound WHEN 'above' THEN n > bound ELSE n_words >= 200 AND round(n * 1000.0 / n_words) > bound END)"""


def patterns(rules: tuple[Pattern, ...]) -> str:
    return f"WITH {_COUNTED} {_patterns(rules)}"


def forms(rules: tuple[Forms, ...]) -> str:
    return f"WITH {_COUNTED} {_forms(rules)}"


def phrases(rules: tuple[Phrases, ...]) -> str:
    return f"WITH {model.SQL.strip()}, {_COUNTED}, {_phrases(rules)} SELECT * FROM phrase_found"


def all_findings(p: tuple[Pattern, ...], f: tuple[Forms, ...], l: tuple[Phrases, ...]) -> str:
    """Tables up to `found`, to follow WITH."""
    return f"{model.SQL.strip()}, {_COUNTED}, {_phrases(l)}, found AS ({_patterns(p)} UNION ALL {_forms(f)} UNION ALL SELECT doc_id, rule, severity, n FROM phrase_found)"


def not_run(*families) -> str:
    rows = ", ".join(f"({_text(r.rule)}, {_text(r.lang) if r.lang else 'NULL'})" for family in (families[0], families[2], families[1]) for r in family)
    return f"""WITH r(rule, language) AS (VALUES {rows}), p AS (SELECT rule, CASE WHEN text IS NULL THEN 'no text' WHEN language IS NOT NULL AND lang IS DISTINCT FROM language THEN 'other language' END AS reason FROM documents, r)
    SELECT rule, reason, count(*) AS documents FROM p WHERE reason IS NOT NULL GROUP BY ALL"""
