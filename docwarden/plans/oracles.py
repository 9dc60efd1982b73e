"""The named queries as plain SQL over the same tables.

They share common table expressions: the derived corpus, a line-by-line reading of its metadata
blocks, the rule tests, and the rewrites.  Nothing here uses the Spark side beyond the corpus text.
"""

from __future__ import annotations

from docwarden.operators.rules import ADVICE, BUILT_IN
from docwarden.plans.sample_corpus import SELECT

STAMP = "2024-01-01T00:00:00Z"
WORD = r"[\pL\pN_]"


def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_FENCE = r"'\A---\s*\n((?s:.*?))\n---\s*\n'"


def _reading(source: str, name: str) -> str:
    """Metadata fields and body of ``source(repo, path, abs_path, content)``."""
    return rf"""
{name}_cut AS (
  SELECT *, regexp_extract(content, {_FENCE}, 0) AS head, regexp_extract(content, {_FENCE}, 1) AS block FROM {source}),
{name}_line AS (
  SELECT *, substr(content, length(head) + 1) AS body, head <> '' AS has_fm,
    regexp_matches(block, '(?m)^id: ') AS has_id, trim(regexp_extract(block, '(?m)^id: (.*)$', 1), '"') AS id,
    regexp_matches(block, '(?m)^name: ') AS has_name, trim(regexp_extract(block, '(?m)^name: (.*)$', 1), '"') AS name,
    regexp_matches(block, '(?m)^description: ') AS has_desc, trim(regexp_extract(block, '(?m)^description: (.*)$', 1), '"') AS descr,
    regexp_matches(block, '(?m)^version: ') AS has_version, regexp_extract(block, '(?m)^version: (.*)$', 1) AS version_raw,
    regexp_matches(block, '(?m)^tags: ') AS has_tags, regexp_extract(block, '(?m)^tags: (.*)$', 1) AS tags_raw,
    regexp_matches(block, '(?m)^verification: ') AS has_ver, trim(regexp_extract(block, '(?m)^verification: (.*)$', 1), '"') AS verification
  FROM {name}_cut),
{name} AS (
  SELECT *, trim(version_raw, '"') AS version, regexp_matches(version_raw, '^\d+\.\d+$') AS version_float,
    CASE WHEN tags_raw = '[]' OR NOT has_tags THEN 0 ELSE 2 END AS n_tags,
    regexp_extract(tags_raw, '^\[(.*), (.*)\]$', 1) AS tag1, regexp_extract(tags_raw, '^\[(.*), (.*)\]$', 2) AS tag2
  FROM {name}_line)"""


def _errors(name: str) -> str:
    """Schema violations of a reading, numbered per document."""

    def part(n: int, field: str, keyword: str, message: str, when: str) -> str:
        return f"SELECT repo, path, {n} AS n, '{field}' AS field, '{keyword}' AS keyword, {message} AS message FROM {name} WHERE has_fm AND {when}"

    kebab = "^[a-z0-9]+(-[a-z0-9]+)*$"
    semver = r"^\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$"
    shown_semver = semver.replace("\\", "\\\\")
    parts = [
        part(i, "(root)", "required", f"'''{k}'' is a required property'", f"NOT {flag}")
        for i, (k, flag) in enumerate([("id", "has_id"), ("name", "has_name"), ("description", "has_desc"), ("version", "has_version"), ("tags", "has_tags")])
    ]
    parts += [
        part(10, "description", "minLength", "'''' || descr || ''' is too short'", "has_desc AND length(descr) < 10"),
        part(20, "id", "pattern", f"'''' || id || ''' does not match ''{kebab}'''", f"has_id AND NOT regexp_matches(id, '{kebab}')"),
        part(30, "name", "minLength", "''''' should be non-empty'", "has_name AND name = ''"),
        part(40, "tags", "minItems", "'[] should be non-empty'", "has_tags AND n_tags = 0"),
        part(41, "tags", "uniqueItems", "'[''' || tag1 || ''', ''' || tag2 || '''] has non-unique elements'", "n_tags > 0 AND tag1 = tag2"),
        part(50, "version", "type", "version || ' is not of type ''string'''", "has_version AND version_float"),
        part(51, "version", "pattern", f"'''' || version || ''' does not match ''{shown_semver}'''", f"has_version AND NOT version_float AND NOT regexp_matches(version, '{semver}')"),
    ]
    return f"{name}_err AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def _tests(name: str) -> str:
    """One row per document and fired rule."""
    tests = {
        "FM001": "NOT has_fm",
        "FM002": f"EXISTS (SELECT 1 FROM {name}_err e WHERE e.repo = d.repo AND e.path = d.path)",
        "FM003": "has_fm AND NOT (has_id AND has_name AND has_desc AND has_version AND has_tags)",
        "FM004": "has_fm AND has_id AND NOT regexp_matches(id, '^[a-z0-9]+(-[a-z0-9]+)*$')",
        "FM005": r"has_fm AND has_version AND NOT regexp_matches(version, '^\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$')",
        "CT001": r"length(regexp_replace(body, '^\s+|\s+$', '', 'g')) < 20",
        "CT002": r"NOT regexp_matches(body, 'example|usage|sample|e\.g\.|```', 'i')",
        "CT003": "has_fm AND (NOT has_ver OR verification = '')",
        "CT004": "has_fm AND n_tags = 0",
        "ST001": r"NOT regexp_matches(body, '(?m)^#{1,6}\s+\S')",
    }
    each = " UNION ALL ".join(f"SELECT repo, path, abs_path, '{k}' AS rule_id FROM {name} d WHERE {v}" for k, v in tests.items())
    return f"{name}_fired AS ({each})"


_RULE_ROWS = [(i, *r) for i, r in enumerate(BUILT_IN)]
_RULES = f"rules(rule_ord, rule_id, name, severity, description, effort, fixable) AS (VALUES {_values(_RULE_ROWS)})"
_ADVICE = f"advice(rule_id, action) AS (VALUES {_values(list(ADVICE.items()))})"
_SCORED = """
scored AS (
  SELECT r.*, a.action,
    CAST(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END * 10
      + CASE effort WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 2 END
      + CASE WHEN fixable THEN 0 ELSE 0.5 END AS DOUBLE) AS score,
    CASE WHEN fixable THEN effort WHEN effort = 'low' THEN 'medium' ELSE 'high' END AS risk
  FROM rules r LEFT JOIN advice a USING (rule_id))"""

_DOCS = rf"""
corpus AS ({SELECT}),
docs AS (
  SELECT doc_id, repo, path, abs_path, regexp_replace(c.content, '\r\n?', chr(10), 'g') AS content, strlen(c.content) AS size_bytes FROM corpus c)"""
_HASHED = "hashed AS (SELECT *, sha256(content) AS content_hash FROM docs)"
_CANDIDATE = rf"""
signals AS (
  SELECT *, CAST(regexp_matches(content, '(?m)^---\s*\n') AS INT)
    + CAST(regexp_matches(content, '(?i)(^|[^\pL\pN_])you are($|[^\pL\pN_])') AS INT)
    + CAST(regexp_matches(content, '(?i)(^|[^\pL\pN_])system prompt($|[^\pL\pN_])') AS INT)
    + CAST(regexp_matches(content, '(?i)(^|[^\pL\pN_])instruction($|[^\pL\pN_])') AS INT)
    + CAST(regexp_matches(content, '(?i)(^|[^\pL\pN_])act as($|[^\pL\pN_])') AS INT)
    + CAST(regexp_matches(content, '{WORD}\{{\{{[^\n]*?\}}\}}{WORD}') AS INT)
    + CAST(regexp_matches(content, '\{{[A-Z_]+\}}') AS INT) AS n_signals
  FROM docs),
tested AS (
  SELECT *, regexp_matches(path, '(?i)[^/]\.(md|markdown|txt|prompt|skill)$') AS ext_ok,
    regexp_matches(path, '(?i)(prompt|skill|instruction|system[-_]?message|template)[^/]*$') AS name_hit,
    list_bool_or([regexp_matches(x, '(?i)(prompts?|skills?|instructions?|templates?|agents?|ai|copilot|llm)$') FOR x IN string_split(path, '/')]) AS dir_hit,
    regexp_matches(path, '(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build)/') AS skipped
  FROM signals),
candidates AS (SELECT *, ext_ok AND (name_hit OR dir_hit OR n_signals >= 2) AS candidate FROM tested)"""
_KEPT = "kept AS (SELECT *, sha256(content) AS content_hash FROM d JOIN candidates c USING (repo, path, abs_path, content) WHERE c.candidate AND NOT c.skipped)"
_READ = _reading("docs", "d")
_JSON = """'{"id": "' || id || '", "name": "' || name || '", "description": "' || descr || '"'
  || CASE WHEN has_version THEN ', "version": ' || CASE WHEN version_float THEN version ELSE '"' || version || '"' END ELSE '' END
  || CASE WHEN NOT has_tags THEN '' WHEN n_tags = 0 THEN ', "tags": []' ELSE ', "tags": ["' || tag1 || '", "' || tag2 || '"]' END
  || CASE WHEN has_ver THEN ', "verification": "' || verification || '"' ELSE '' END || '}'"""

# One document after each rewrite, in the order FM001, FM004, FM005, ST001.
_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"
_HEADING = r"regexp_extract(content, '(?m)^#{1,6}\s+(.+)$', 1)"
_STUBBED = rf"""CASE WHEN head = '' THEN
    '---' || chr(10) || 'id: "' || coalesce(nullif({_SLUG.format(f"coalesce(nullif(trim({_HEADING}), ''), 'Untitled Skill')")}, ''), 'untitled-skill') || '"' || chr(10)
    || 'name: "' || coalesce(nullif(trim({_HEADING}), ''), 'Untitled Skill') || '"' || chr(10)
    || 'description: "TODO: describe this skill."' || chr(10) || 'version: "0.1.0"' || chr(10) || 'tags: []' || chr(10) || '---' || chr(10) || content
  ELSE content END"""


def _first(text: str, old: str, new: str) -> str:
    return f"CASE WHEN instr({text}, {old}) > 0 THEN substr({text}, 1, instr({text}, {old}) - 1) || {new} || substr({text}, instr({text}, {old}) + length({old})) ELSE {text} END"


_BARE = _first("content", "'id: ' || id", f"'id: ' || {_SLUG.format('id')}")
_QUOTED = _first("bare", "'id: \"' || id || '\"'", f"'id: \"' || {_SLUG.format('id')} || '\"'")


def _kebab_step(source: str, name: str) -> str:
    return f"{name} AS (SELECT repo, path, abs_path, CASE WHEN has_fm AND has_id THEN {_QUOTED} ELSE content END AS content FROM (SELECT *, {_BARE} AS bare FROM {source}) b)"


def _version_step(source: str, name: str) -> str:
    return rf"""{name} AS (SELECT repo, path, abs_path, CASE WHEN has_fm AND has_version AND NOT regexp_matches(version, '^\d+\.\d+(\.\d+)?(-[a-zA-Z0-9.]+)?$')
  THEN regexp_replace(content, '(?m)^version:\s*.+$', 'version: "0.1.0"') ELSE content END AS content FROM {source})"""


def _heading_step(source: str, name: str) -> str:
    return rf"""{name} AS (SELECT repo, path, abs_path, CASE WHEN NOT regexp_matches(body, '(?m)^#{{1,6}}\s+\S')
  THEN head || '# ' || CASE WHEN has_name THEN name ELSE 'Skill' END || chr(10) || chr(10) || body ELSE content END AS content FROM {source})"""


_FIXES = ",".join(
    [
        f"s1 AS (SELECT repo, path, abs_path, {_STUBBED} AS content FROM d)",
        _reading("s1", "r1"),
        _kebab_step("r1", "s2"),
        _reading("s2", "r2"),
        _version_step("r2", "s3"),
        _reading("s3", "r3"),
        _heading_step("r3", "s4"),
        """steps AS (
  SELECT d.repo, d.path, d.abs_path, d.content AS c0, s1.content AS c1, s2.content AS c2, s3.content AS c3, s4.content AS c4
  FROM d JOIN s1 USING (repo, path) JOIN s2 USING (repo, path) JOIN s3 USING (repo, path) JOIN s4 USING (repo, path)),
final AS (SELECT repo, path, abs_path, c4 AS content FROM steps WHERE c4 <> c0)""",
    ]
)

_PLAIN = "CASE WHEN {0} = '' THEN '''''' ELSE {0} END"
_ID = f"CASE WHEN has_fm AND has_id AND id <> '' THEN id ELSE trim(regexp_replace(lower(regexp_replace(replace(repo, '/', '-') || '-' || path, '\\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '-') END"
_DOMAIN = "CASE WHEN n_tags > 0 THEN coalesce(nullif(trim(regexp_replace(lower(tag1), '[^a-z0-9-]', '-', 'g'), '-'), ''), 'general') ELSE 'general' END"
_MOVED = f"""
moved AS (SELECT *, 'skills/' || domain || '/' || skill_id || '.md' AS dest_rel FROM (SELECT *, {_ID} AS skill_id, {_DOMAIN} AS domain FROM d) m)"""
_RENDERED = f"""
rendered AS (SELECT *, '---' || chr(10) || 'id: ' || skill_id || chr(10)
  || CASE WHEN has_fm THEN 'name: ' || name || chr(10) || 'description: ' || descr || chr(10)
    || CASE WHEN has_version THEN 'version: ' || version_raw || chr(10) ELSE '' END
    || CASE WHEN NOT has_tags THEN '' WHEN n_tags = 0 THEN 'tags: []' || chr(10) ELSE 'tags:' || chr(10) || '- ' || tag1 || chr(10) || '- ' || tag2 || chr(10) END
    || CASE WHEN has_ver THEN 'verification: ' || {_PLAIN.format("verification")} || chr(10) ELSE '' END ELSE '' END
  || 'source: https://github.com/' || repo || chr(10) || 'migrated_at: ''{STAMP}''' || chr(10) || '---' || chr(10) || body AS output FROM moved)"""

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = rf"""
words AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(text), '{_SPACE}') IF x <> ''] AS tokens FROM documents),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM words) u GROUP BY ALL),
len AS (SELECT id, len(tokens) AS dl FROM words),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
size AS (SELECT count(*) AS n, sum(dl) / count(*) AS avg_words FROM len),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS w FROM df, size),
mean AS (SELECT avg(w) AS mean_weight, count(*) AS n_terms FROM raw),
weight AS (SELECT token, CASE WHEN w < 0 THEN 0.25 * mean_weight ELSE w END AS idf FROM raw, mean)"""
_BM25 = rf"""WITH {_WORDS},
asked AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest([x FOR x IN string_split_regex(lower(text), '{_SPACE}') IF x <> '']) AS token FROM benchmark) u GROUP BY ALL),
matched AS (
  SELECT qid, id, sum(CAST(floor(idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_words))) * 1e10 + 0.5) AS BIGINT) * qtf) AS units
  FROM asked JOIN weight USING (token) JOIN tf USING (token) JOIN len USING (id), size GROUP BY qid, id),
every AS (SELECT item_id AS qid, doc_id AS id FROM benchmark, documents),
ranked AS (SELECT qid, id, coalesce(units, 0) AS units, row_number() OVER (PARTITION BY qid ORDER BY coalesce(units, 0) DESC, id) AS rank FROM every LEFT JOIN matched USING (qid, id))
SELECT qid, CAST(rank AS INT) AS rank, id, round(units / 1e10, 6) AS score FROM ranked WHERE rank <= 5"""


def _with(parts: list[str], body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body


_AUDIT = [_DOCS, _READ, _errors("d"), _tests("d"), _RULES]
_PLAN = [*_AUDIT, _ADVICE, _SCORED, "items AS (SELECT row_number() OVER (ORDER BY score, f.repo, f.path, f.abs_path, rule_ord) AS rank, f.*, s.* EXCLUDE (rule_id) FROM d_fired f JOIN scored s USING (rule_id))"]
_REAUDIT = [*_AUDIT, _FIXES, _reading("final", "x"), _errors("x"), _tests("x")]
_CANDIDATES = [_DOCS, _READ, _CANDIDATE, _KEPT]
_MIGRATE = [_DOCS, _READ, _MOVED]
_KEY = "sha256({0} || chr(0) || {1} || chr(0) || {2})"
_TEXT_FILES = r"regexp_matches(path, '(?i)[^/]\.(md|markdown|txt|prompt|skill)$')"

ORACLES: dict[str, str] = {
    "scan_tree": _with(_CANDIDATES, "SELECT repo, path, content_hash, size_bytes FROM kept"),
    "scan_files": _with(
        [_DOCS, _HASHED], f"SELECT regexp_extract(path, '[^/]+$') AS path, content_hash, size_bytes FROM hashed"
    ),
    "scan_object_store": _with(
        [_DOCS, _HASHED],
        """SELECT repo || '/' || path AS path, content_hash, size_bytes FROM hashed WHERE path NOT LIKE '%.png' AND path NOT LIKE 'node_modules/%'""",
    ),
    "corpus_from_table": f"""SELECT {_KEY.format("source", "doc_id || '.txt'", "'/corpus/' || source || '/' || doc_id || '.txt'")} AS doc_key, source AS repo, doc_id || '.txt' AS path,
  '/corpus/' || source || '/' || doc_id || '.txt' AS abs_path, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM documents""",
    "scan_sources": _with(
        _CANDIDATES,
        "SELECT s.label, 'https://github.com/' || s.label || '.git' AS url, (SELECT count(*) FROM kept k WHERE k.repo = s.label) AS n_candidates FROM (SELECT DISTINCT 'owner/' || source AS label FROM documents) s",
    ),
    "scan_manifest": _with(_CANDIDATES, "SELECT repo, path, content_hash, has_fm AS has_frontmatter, size_bytes FROM kept"),
    "scan_candidates": _with(
        _CANDIDATES,
        f"SELECT repo, path, abs_path, content_hash, has_fm AS has_frontmatter, CASE WHEN has_fm THEN {_JSON} ELSE '{{}}' END AS frontmatter, size_bytes FROM kept",
    ),
    "filter_extension": _with([_DOCS], rf"SELECT repo, path, lower(regexp_extract(path, '\.[^.]+$')) AS extension FROM docs WHERE {_TEXT_FILES}"),
    "filter_ignored_dirs": _with([_DOCS], "SELECT repo, path FROM docs WHERE NOT list_has_any(string_split(path, '/')[:-2], ['.git', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build'])"),
    "signal_name": _with([_DOCS, _CANDIDATE], "SELECT repo, path, name_hit AS signal FROM candidates"),
    "signal_dir": _with([_DOCS, _CANDIDATE], "SELECT repo, path, dir_hit AS signal FROM candidates"),
    "signal_content": _with(
        [
            _DOCS.replace("docs AS (", "base AS ("),
            """docs AS (SELECT repo || '/' || path AS path, content FROM base UNION ALL SELECT url || '#' || page_id, html FROM pages
  UNION ALL SELECT 'talk/' || conv_id || '/' || turn, text FROM conversations)""",
            _CANDIDATE,
        ],
        "SELECT path AS name, n_signals FROM signals",
    ),
    "is_candidate": _with([_DOCS, _CANDIDATE], "SELECT repo, path, candidate FROM candidates"),
    "source_labels": r"""WITH specs AS (
  SELECT 'owner/' || source AS spec FROM documents UNION SELECT 'git@github.com:owner/' || source || '.git' FROM documents
  UNION SELECT '/srv/' || source || '/' FROM documents UNION SELECT source FROM documents UNION SELECT url FROM pages),
kinds AS (SELECT spec, regexp_matches(spec, '^(https?://|git@)') AS remote, contains(spec, '/') AS slash FROM specs)
SELECT spec, CASE WHEN slash AND NOT remote AND NOT starts_with(spec, '/') THEN 'https://github.com/' || spec || '.git' ELSE spec END AS url,
  CASE WHEN slash AND NOT remote THEN trim(spec) ELSE replace(regexp_extract(rtrim(spec, '/'), '[^/]*$'), '.git', '') END AS label FROM kinds""",
    "normalise_text": _with([_DOCS], "SELECT repo, path, length(content) AS n_chars, sha256(content) AS content_hash FROM docs"),
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "split_frontmatter": _with([_DOCS, _READ], "SELECT repo, path, CASE WHEN has_fm THEN block END AS block, sha256(body) AS body_hash FROM d"),
    "frontmatter_fields": _with(
        [_DOCS, _READ],
        """SELECT repo, path, id, name, descr AS description, CASE WHEN has_version THEN version END AS version, CASE WHEN has_ver THEN verification END AS verification,
  CASE WHEN version_float THEN 'float' WHEN has_version THEN 'string' END AS version_kind,
  CASE WHEN n_tags > 0 THEN tag1 || '|' || tag2 ELSE '' END AS tags,
  'id|name|description' || CASE WHEN has_version THEN '|version' ELSE '' END || CASE WHEN has_tags THEN '|tags' ELSE '' END || CASE WHEN has_ver THEN '|verification' ELSE '' END AS keys
FROM d WHERE has_fm""",
    ),
    "frontmatter_long": _with(
        [_DOCS, _READ, f"k AS (SELECT *, {_KEY.format('repo', 'path', 'abs_path')} AS doc_key FROM d WHERE has_fm)"],
        """SELECT doc_key, 'id' AS key_path, 'string' AS kind, id AS value FROM k
UNION ALL SELECT doc_key, 'name', 'string', name FROM k UNION ALL SELECT doc_key, 'description', 'string', descr FROM k
UNION ALL SELECT doc_key, 'version', CASE WHEN version_float THEN 'float' ELSE 'string' END, version FROM k WHERE has_version
UNION ALL SELECT doc_key, 'verification', 'string', verification FROM k WHERE has_ver
UNION ALL SELECT doc_key, 'tags', 'list', CASE WHEN n_tags = 0 THEN '[]' ELSE '[''' || tag1 || ''', ''' || tag2 || ''']' END FROM k WHERE has_tags
UNION ALL SELECT doc_key, 'tags.0', 'string', tag1 FROM k WHERE n_tags > 0 UNION ALL SELECT doc_key, 'tags.1', 'string', tag2 FROM k WHERE n_tags > 0""",
    ),
    "stable_id": _with([_DOCS], r"SELECT repo, path, trim(regexp_replace(lower(regexp_replace(replace(repo, '/', '-') || '-' || path, '\.[^.]+$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS stable_id FROM docs"),
    "kebab_id": "SELECT doc_id, length(slug) AS n_chars, sha256(slug) AS slug_hash FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents) s",
    "domain_from_tags": _with(_MIGRATE, "SELECT repo, path, domain FROM moved"),
    "first_heading": _with([_DOCS], rf"SELECT repo, path, nullif(trim({_HEADING}), '') AS heading FROM docs"),
    "schema_errors": _with(
        [_DOCS, _READ, _errors("d")], "SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY n) - 1 AS pos, field, keyword, message FROM d_err"
    ),
    **{f"rule_{r[0].lower()}": _with(_AUDIT, f"SELECT repo, path FROM d_fired WHERE rule_id = '{r[0]}'") for r in BUILT_IN},
    "findings": _with(_AUDIT, "SELECT repo, path, rule_id, name, severity, description, effort, fixable FROM d_fired JOIN rules USING (rule_id)"),
    "finding_details": _with(
        _AUDIT,
        """SELECT repo, path, rule_id,
  coalesce(CASE WHEN rule_id = 'FM002' THEN (SELECT string_agg(field || ': ' || message, '|' ORDER BY n) FROM d_err e WHERE e.repo = f.repo AND e.path = f.path) END, '') AS schema_errors,
  coalesce(CASE WHEN rule_id = 'FM003' THEN (SELECT string_agg(regexp_extract(message, '[a-z]+'), '|' ORDER BY message) FROM d_err e WHERE e.repo = f.repo AND e.path = f.path AND keyword = 'required') END, '') AS missing_fields
FROM d_fired f WHERE rule_id IN ('FM002', 'FM003')""",
    ),
    "file_results": _with(
        _AUDIT,
        """SELECT d.repo, d.path, d.abs_path, sha256(any_value(content)) AS content_hash, count(rule_id) AS finding_count, coalesce(string_agg(rule_id, '|' ORDER BY rule_ord), '') AS rule_ids
FROM d LEFT JOIN (d_fired JOIN rules USING (rule_id)) f ON f.repo = d.repo AND f.path = d.path GROUP BY d.repo, d.path, d.abs_path""",
    ),
    "by_severity": _with(
        _AUDIT, "SELECT s.severity, count(rule_id) AS n FROM (VALUES ('error'), ('warning'), ('info')) s(severity) LEFT JOIN (d_fired JOIN rules USING (rule_id)) f USING (severity) GROUP BY 1"
    ),
    "audit_summary": _with(
        _AUDIT,
        """SELECT (SELECT count(*) FROM d) AS files_audited, count(*) AS total_findings, count(*) FILTER (WHERE severity = 'error') AS error,
  count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM d_fired JOIN rules USING (rule_id)""",
    ),
    "audit_report": _with(
        [
            *_AUDIT,
            r"""said AS (SELECT repo, path, string_agg('"' || replace(replace(field || ': ' || message, '\', '\\'), '"', '\"') || '"', ',' ORDER BY n) AS errors,
  string_agg('"' || regexp_extract(message, '[a-z]+') || '"', ',' ORDER BY message) FILTER (WHERE keyword = 'required') AS missing FROM d_err GROUP BY 1, 2),
shown AS (SELECT repo, path, rule_ord, '{"rule_id":"' || rule_id || '","name":"' || name || '","severity":"' || severity || '","description":"' || description || '","effort":"' || effort
  || '","fixable":' || fixable || CASE rule_id WHEN 'FM002' THEN ',"schema_errors":[' || errors || ']' WHEN 'FM003' THEN ',"missing_fields":[' || missing || ']' ELSE '' END || '}' AS js
  FROM d_fired JOIN rules USING (rule_id) LEFT JOIN said USING (repo, path))""",
        ],
        """SELECT d.repo, d.path, sha256(any_value(content)) AS content_hash, count(js) AS finding_count, '[' || coalesce(string_agg(js, ',' ORDER BY rule_ord), '') || ']' AS findings_json
FROM d LEFT JOIN shown s ON s.repo = d.repo AND s.path = d.path GROUP BY d.repo, d.path""",
    ),
    "audit_markdown": _with(
        [
            *_AUDIT,
            "f AS (SELECT * FROM d_fired JOIN rules USING (rule_id))",
            "sums AS (SELECT (SELECT count(*) FROM d) AS files, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w, count(*) FILTER (WHERE severity = 'info') AS i FROM f)",
            f"""top AS (SELECT unnest(['# Audit Report', '', '**Generated:** {STAMP}  ', '**Dry-run:** True  ', '', '## Rule Source', '', '- **URL:** (built-in)', '- **Commit SHA:** `N/A`',
  '- **Fetched at:** {STAMP}', '- **Using baseline:** True', '', '## Summary', '', '| Files audited | Total findings | Errors | Warnings | Info |', '|---|---|---|---|---|',
  '| ' || files || ' | ' || n || ' | ' || e || ' | ' || w || ' | ' || i || ' |', '', '## Findings', '']) AS text, unnest(range(20)) AS line_no FROM sums)""",
            """sections AS (SELECT repo, path, abs_path, ['### `' || repo || '/' || path || '`', '', '| Rule | Severity | Description |', '|---|---|---|']
  || list('| `' || rule_id || '` | ' || severity || ' | ' || description || ' |' ORDER BY rule_ord) || [''] AS lines FROM f GROUP BY 1, 2, 3)""",
        ],
        """SELECT 0 AS part, '' AS repo, '' AS path, '' AS abs_path, line_no, text FROM top
UNION ALL SELECT 1, repo, path, abs_path, unnest(range(len(lines))), unnest(lines) FROM sections""",
    ),
    "rules_load": """WITH d AS (SELECT *, 'place/' || doc_id AS location FROM documents)
SELECT location, 0 AS pos, 'X' || doc_id AS id, 'name|severity|fixable' AS given, 'rule ' || doc_id AS name, 'error' AS severity, NULL AS description, NULL AS effort, TRUE AS fixable FROM d WHERE doc_id % 3 <> 0
UNION ALL SELECT location, 1, 'FM00' || (doc_id % 9 + 1), 'effort', NULL, NULL, NULL, NULL, NULL FROM d WHERE doc_id % 3 <> 0
UNION ALL SELECT location, 0, 'Y' || doc_id, 'severity|description|fixable', NULL, 'warning', 'from ' || source, NULL, FALSE FROM d WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0
UNION ALL SELECT location, 0, 'Z' || doc_id, '', NULL, NULL, NULL, NULL, NULL FROM d WHERE doc_id % 6 = 0""",
    "rules_merged": f"""WITH {_RULES},
e AS (SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 0 THEN 'FM00' || (doc_id % 3 + 1) ELSE 'X-' || source END AS id, doc_id % 2 = 0 AS named,
  'rule ' || lang AS name, CASE WHEN doc_id % 4 = 0 THEN 'warning' END AS severity, 'from ' || doc_id AS description, doc_id % 3 = 0 AS fixable FROM documents),
p AS (SELECT *, min(pos) OVER (PARTITION BY id) AS first_pos, row_number() OVER (PARTITION BY id ORDER BY pos DESC) AS back FROM e),
x AS (SELECT * FROM p WHERE back = 1)
SELECT coalesce(r.rule_ord, 1099511627776 + x.first_pos) AS ord, coalesce(r.rule_id, x.id) AS id,
  CASE WHEN x.id IS NULL THEN r.name WHEN named THEN x.name ELSE x.id END AS name,
  CASE WHEN x.id IS NULL THEN r.severity WHEN named THEN x.severity ELSE 'info' END AS severity,
  CASE WHEN x.id IS NULL THEN r.description WHEN named THEN '' ELSE x.description END AS description,
  CASE WHEN x.id IS NULL THEN r.effort ELSE 'unknown' END AS effort,
  CASE WHEN x.id IS NULL THEN r.fixable WHEN named THEN FALSE ELSE x.fixable END AS fixable
FROM rules r FULL OUTER JOIN x ON x.id = r.rule_id""",
    "rule_scores": _with(_PLAN, "SELECT repo, path, rule_id, score, risk, action FROM items"),
    "plan_items": _with(_PLAN, "SELECT rank, repo, path, abs_path, rule_id, name, severity, effort, fixable, risk, description, action FROM items"),
    "plan_summary": _with(
        _PLAN,
        """SELECT 'total' AS dimension, NULL AS key, count(*) AS n FROM items UNION ALL SELECT 'fixable', NULL, count(*) FROM items WHERE fixable
UNION ALL SELECT 'severity', severity, count(*) FROM items GROUP BY severity UNION ALL SELECT 'risk', risk, count(*) FROM items GROUP BY risk""",
    ),
    "plan_markdown": _with(
        [
            *_PLAN,
            f"""top AS (SELECT unnest(['# Improvement Plan', '', '**Generated:** {STAMP}  ', '**Dry-run:** True  ', '', '## Summary', '', '- **Total items:** ' || count(*),
  '- **Auto-fixable:** ' || count(*) FILTER (WHERE fixable), '', '### By Severity', '', '| Severity | Count |', '|---|---|']) AS text, unnest(range(14)) AS line_no FROM items)""",
        ],
        """SELECT 0 AS part, '' AS repo, '' AS path, '' AS abs_path, line_no, text FROM top
UNION ALL SELECT 1, CASE severity WHEN 'error' THEN '000' WHEN 'warning' THEN '001' ELSE '002' END, severity, '', 0, '| ' || severity || ' | ' || count(*) || ' |' FROM items GROUP BY severity
UNION ALL SELECT 2, '', '', '', unnest(range(6)), unnest(['', '### By Risk', '', '| Risk | Count |', '|---|---|']) WHERE FALSE
UNION ALL SELECT 2, '', '', '', unnest(range(5)), unnest(['', '### By Risk', '', '| Risk | Count |', '|---|---|'])
UNION ALL SELECT 3, '000', risk, '', 0, '| ' || risk || ' | ' || count(*) || ' |' FROM items GROUP BY risk
UNION ALL SELECT 4, '', '', '', unnest(range(5)), unnest(['', '## Prioritised Action Items', '', '| # | File | Rule | Severity | Effort | Risk | Fixable | Action |', '|---|---|---|---|---|---|---|---|'])
UNION ALL SELECT 5, '', '', '', rank, '| ' || rank || ' | `' || repo || '/' || path || '` | `' || rule_id || '` | ' || severity || ' | ' || effort || ' | ' || risk || ' | ' || CASE WHEN fixable THEN '✅' ELSE '❌' END || ' | ' || action || ' |' FROM items
UNION ALL SELECT 6, '', '', '', 0, ''""",
    ),
    "fix_fm001": _with([_DOCS, _READ, f"s AS (SELECT repo, path, content AS old, {_STUBBED} AS content FROM d)"], "SELECT repo, path, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM s WHERE content <> old"),
    "fix_fm004": _with([_DOCS, _READ, _kebab_step("d", "s")], "SELECT s.repo, s.path, sha256(s.content) AS content_hash, strlen(s.content) AS size_bytes FROM s JOIN d USING (repo, path) WHERE s.content <> d.content"),
    "fix_fm005": _with([_DOCS, _READ, _version_step("d", "s")], "SELECT s.repo, s.path, sha256(s.content) AS content_hash, strlen(s.content) AS size_bytes FROM s JOIN d USING (repo, path) WHERE s.content <> d.content"),
    "fix_st001": _with([_DOCS, _READ, _heading_step("d", "s")], "SELECT s.repo, s.path, sha256(s.content) AS content_hash, strlen(s.content) AS size_bytes FROM s JOIN d USING (repo, path) WHERE s.content <> d.content"),
    "fix_actions": _with(
        [*_AUDIT, _FIXES, """acts AS (SELECT abs_path, path, repo, 1 AS o, 'FM001' AS rule_id FROM steps WHERE c1 <> c0 UNION ALL SELECT abs_path, path, repo, 2, 'FM004' FROM steps WHERE c2 <> c1
  UNION ALL SELECT abs_path, path, repo, 3, 'FM005' FROM steps WHERE c3 <> c2 UNION ALL SELECT abs_path, path, repo, 4, 'ST001' FROM steps WHERE c4 <> c3)"""],
        "SELECT abs_path, path, repo, row_number() OVER (PARTITION BY abs_path ORDER BY o) - 1 AS step, rule_id, FALSE AS applied, 'Rule ' || rule_id || ' fix applied.' AS diff_summary FROM acts",
    ),
    "fixed_docs": _with([_DOCS, _READ, _FIXES], "SELECT repo, path, abs_path, sha256(content) AS content_hash, strlen(content) AS size_bytes FROM final"),
    "fix_apply": _with([_DOCS, _READ, _FIXES], "SELECT repo, path, length(content) AS n_chars, sha256(content) AS content_hash FROM final"),
    "fix_reaudit": _with(_REAUDIT, "SELECT repo, path, rule_id, severity FROM x_fired JOIN rules USING (rule_id)"),
    "fix_delta": _with(
        _REAUDIT,
        """SELECT rule_id, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after FROM (
  SELECT f.rule_id, 1 AS b, 0 AS a FROM d_fired f JOIN final USING (repo, path) UNION ALL SELECT rule_id, 0, 1 FROM x_fired) u GROUP BY rule_id""",
    ),
    "migrate_plan": _with(_MIGRATE, "SELECT skill_id, repo, path, abs_path AS source_path, dest_rel AS dest_path, dest_rel, domain, 'ok' AS status FROM moved"),
    "migrate_rendered": _with([*_MIGRATE, _RENDERED], "SELECT repo, path, dest_rel, length(output) AS n_chars, sha256(output) AS content_hash FROM rendered"),
    "migrate_pointers": _with(
        _MIGRATE,
        """SELECT repo, path, '<!-- This file was migrated to [owner/library](https://github.com/owner/library/blob/main/' || dest_rel || '). -->' || chr(10) || chr(10) || '**Skill `' || skill_id
  || '` has been migrated.**  ' || chr(10) || 'See: https://github.com/owner/library/blob/main/' || dest_rel || chr(10) AS content FROM moved""",
    ),
    "migrate_actions": _with(
        _MIGRATE,
        "SELECT skill_id, repo, path, abs_path AS source_path, dest_rel AS dest_path, dest_rel, domain, 'ok' AS status, TRUE AS applied, TRUE AS deleted_source, FALSE AS wrote_pointer FROM moved",
    ),
    "migrate_outputs": _with([*_MIGRATE, _RENDERED], "SELECT domain, skill_id, dest_rel, sha256(output) AS content_hash FROM rendered"),
    "migrate_collisions": """WITH d AS (SELECT 'skills/general/owner-all-' || lang || '-' || source || '.md' AS dest_rel, lang || '/' || source || '.' || doc_id AS path FROM documents),
c AS (SELECT dest_rel, count(*) AS n_sources, '/corpus/owner/all/' || max(path) AS kept FROM d GROUP BY dest_rel HAVING count(*) > 1)
SELECT * FROM c UNION ALL SELECT '(overwritten)', CAST(sum(n_sources - 1) AS BIGINT), NULL FROM c""",
    "migrate_summary": "SELECT count(*) AS total, count(*) AS applied, count(*) AS pointers_written, CAST(0 AS BIGINT) AS deleted FROM documents",
    "token_stats": f"WITH {_WORDS} SELECT id, len(tokens) AS n_tokens, len(list_distinct(tokens)) AS n_distinct FROM words",
    "bm25_stats": f"WITH {_WORDS} SELECT n AS n_docs, n_terms, round(avg_words, 6) AS avg_words, round(mean_weight, 6) AS mean_weight FROM size, mean",
    "bm25_topk": _BM25,
    "search_index": _BM25,
    "cosine_topk": """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY label, i),
q AS (SELECT CAST(label AS BIGINT) AS qid, list(x ORDER BY i) AS qe FROM m GROUP BY label),
s AS (SELECT qid, id, list_dot_product(e, qe) / greatest(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)), 1e-9) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
SELECT qid, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "embedding_cache": """WITH t AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations)
SELECT sha256(text) AS content_key, count(*) AS copies, array_to_string([length(any_value(text)) - length(replace(any_value(text), c, '')) FOR c IN ['a', 'e', 'i', 'o', 'u']], '|') AS embedding FROM t GROUP BY 1""",
}
ORACLES["frontmatter_distinct"] = f"SELECT * FROM ({ORACLES['frontmatter_fields']}) f UNION ALL SELECT * REPLACE (repo || '-copy' AS repo) FROM ({ORACLES['frontmatter_fields']}) f"
ORACLES["cosine_groups"] = ORACLES["vector_index"] = ORACLES["cosine_topk"]
