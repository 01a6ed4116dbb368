"""The logical tables in SQL, as common table expressions over the same Parquet tables."""

from graphloom.operators.memory import ENTITY_PATTERNS, LEXICON
from graphloom.sources.adapters import CUES

#: What is no letter, digit, ``_`` or white space, in any script.
UNWORDED = r"[^\p{L}\p{M}\p{Nd}\p{Pc}\s]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cue(kind: str) -> str:
    """Whether the lower-cased sentence ``low`` has one of a class's cues."""
    return "(" + " OR ".join(f"contains(low, {quoted(c)})" for c in LEXICON[kind]) + ")"


#: The classes in the order in which they are tried: condition, class, confidence.
CASCADE = (
    (f"NOT asks AND {cue('decision')}", "decision", "0.9e0"), (f"NOT asks AND {cue('assistant_decision')} AND role = 'assistant'", "decision", "0.85e0"),
    (cue("error"), "error", "0.85e0"), (cue("conclusion"), "conclusion", "0.8e0"), (f"NOT asks AND {cue('change_verb')} AND {cue('change_noun')}", "code_change", "0.85e0"),
    (cue("question"), "open_question", "0.6e0"), (cue("weak_conclusion"), "conclusion", "0.8e0"),
)

TABLES = {
    "symbols": """
    SELECT 'c' || c_custkey AS id, c_name AS name, n_name || '::' || c_name AS qualified_name, 'f' AS kind, n_name AS scope, r_name || '/' || n_name AS file, r_name AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 's' || s_suppkey, s_name, n_name || '::' || s_name, 'f', n_name, r_name || '/' || n_name, r_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 'p' || p_partkey, p_name, p_brand || '::' || p_name, 't', p_brand, p_type || '/' || p_brand, 'PARTS' FROM part""",
    "edges": """
    SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    UNION ALL
    SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1""",
    "tests": "SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "commits": "SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS sha, o_orderdate AS ts FROM orders",
    "log": """
    SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'infer' WHEN 'error' THEN 'flag' WHEN 'purchase' THEN 'verify' ELSE event_type END AS kind,
           CAST(user_id AS VARCHAR) AS target, user_id % 3 AS agent, value / (value + 10) AS confidence, ts FROM events""",
    "placed": """
    SELECT src, dst, a.file AS src_file, b.file AS dst_file FROM edges JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst""",
    "salience": """
    SELECT id, qualified_name, file, local_fan_in, cross_fan_in, CASE WHEN most > 0 THEN floor(raw / most * 10000 + 0.5) / 10000 ELSE 0 END AS score
    FROM (SELECT *, max(raw) OVER () AS most FROM (
        SELECT id, qualified_name, file, coalesce(loc, 0) AS local_fan_in, coalesce(crs, 0) AS cross_fan_in,
               (coalesce(loc, 0) + 2.0 * coalesce(crs, 0) + 1.5 * coalesce(files, 0)) AS raw
        FROM symbols LEFT JOIN (
            SELECT dst, count(*) FILTER (src_file = dst_file) AS loc, count(*) FILTER (src_file <> dst_file) AS crs,
                   count(DISTINCT CASE WHEN src_file <> dst_file THEN src_file END) AS files FROM placed GROUP BY dst) f ON f.dst = id))""",
    "reached": """
    SELECT start, id, min(distance) AS distance FROM (
        SELECT t.id AS start, e.dst AS id, 1 AS distance FROM tests t JOIN edges e ON e.src = t.id
        UNION ALL SELECT t.id, f.dst, 2 FROM tests t JOIN edges e ON e.src = t.id JOIN edges f ON f.src = e.dst) GROUP BY start, id""",
    "coverage": """
    SELECT s.id, s.file, CASE WHEN r.id IS NULL THEN 'none' ELSE 'covered' END AS status, coalesce(n, 0) AS test_count
    FROM symbols s LEFT JOIN (SELECT id, count(*) FILTER (distance = 1) AS n FROM reached WHERE start <> id GROUP BY id) r ON r.id = s.id
    WHERE s.id NOT IN (SELECT id FROM tests)""",
    "history": """
    SELECT path, n AS commits, CASE WHEN n >= 3 THEN date_sub('day', first, now) ELSE 0 END AS age_days,
           CASE WHEN n >= 3 THEN date_sub('day', last, now) ELSE 0 END AS last_modified_days, CASE WHEN n >= 3 THEN days ELSE 0 END AS churn,
           CASE WHEN n >= 3 AND days >= 3 THEN 'volatile' WHEN n >= 3 AND days >= 1 THEN 'active' ELSE 'stable' END AS stability
    FROM (SELECT path, count(*) AS n, min(ts) AS first, max(ts) AS last, TIMESTAMP '2001-08-01' AS now,
                 count(DISTINCT CASE WHEN ts >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN CAST(ts AS DATE) END) AS days FROM commits GROUP BY path)""",
    "old_stamps": "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS content_hash FROM documents WHERE doc_id % 10 <> 0",
    "new_stamps": "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS content_hash FROM documents WHERE doc_id % 7 <> 0",
    "changes": """
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
           WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'fresh' END AS change FROM old_stamps a FULL JOIN new_stamps b ON a.path = b.path""",
    "messages": f"SELECT conv_id, turn, role, text || ' ' || [{', '.join(map(quoted, CUES))}][turn % {len(CUES)} + 1] AS text FROM conversations",
    "sentences": r"""
    SELECT conv_id, turn, role, CAST("at" - 1 AS INTEGER) AS "at", trim(raw) AS sentence FROM (
        SELECT conv_id, turn, role, unnest(parts) AS raw, generate_subscripts(parts, 1) AS "at"
        FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM messages)) WHERE trim(raw) <> ''""",
    "classified": f"""
    SELECT conv_id, turn, role, "at", sentence, category, confidence FROM (
        SELECT *, CASE {' '.join(f"WHEN {test} THEN '{kind}'" for test, kind, _ in CASCADE)} END AS category, CASE {' '.join(f"WHEN {test} THEN {sure}" for test, _, sure in CASCADE)} END AS confidence
        FROM (SELECT *, lower(sentence) AS low, sentence LIKE '%?' AS asks FROM sentences)) WHERE category IS NOT NULL""",
    "entities": "SELECT conv_id, entity, count(*) AS n FROM (" + " UNION ALL ".join(
        f"SELECT conv_id, unnest(regexp_extract_all(text, {quoted(pattern)}, 1)) AS entity, {once} AS once, '{kind}' AS kind FROM messages" for kind, pattern, once in ENTITY_PATTERNS)
        + ") WHERE kind <> 'snake' OR length(entity) > 5 GROUP BY 1, 2 HAVING count(*) >= 2 OR bool_or(once)",
    "tokens": r"""
    SELECT id, unnest(list_distinct(list_concat(n, p))) AS token FROM (SELECT id, TOK(qualified_name) AS n, TOK(file) AS p FROM symbols)""",
    "token_df": "SELECT token, count(*) AS df FROM tokens GROUP BY token",
}
USES = {
    "placed": ["symbols", "edges"], "salience": ["placed"], "reached": ["tests", "edges"], "coverage": ["symbols", "reached"], "history": ["commits"],
    "changes": ["old_stamps", "new_stamps"], "sentences": ["messages"], "classified": ["sentences"], "entities": ["messages"], "tokens": ["symbols"], "token_df": ["tokens"],
}


def tokenised(expression: str) -> str:
    """The identifier tokens of an expression: five cuts, then lower case."""
    text = f"regexp_replace({expression}, '[^0-9A-Za-z]+', ' ', 'g')"
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z])([A-Z0-9])", "([0-9])([A-Za-z])", "([A-Z])([0-9])"):
        text = f"regexp_replace({text}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower({text}), ' '), lambda t: t <> '')"


def using(names: str, query: str) -> str:
    """``query`` with the tables it names before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in USES.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    body = lambda n: TABLES[n].replace("TOK(qualified_name)", tokenised("qualified_name")).replace("TOK(file)", tokenised("file"))
    return "WITH " + ",\n".join(f"{n} AS ({body(n)})" for n in order) + "\n" + query
