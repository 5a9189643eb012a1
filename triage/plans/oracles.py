"""SQL that states the expected result of each registered query.

The statements follow from the rule that generates an input, or restate the
operation in plain SQL; none of them shares an expression with the library.
"""

from __future__ import annotations

from triage.plans.views import oracle

ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = oracle(sql, *views)


# --- references, files, repositories ----------------------------------------------

_add("ref_kinds", r"""
SELECT ref_id, kind, owner, name,
       CASE WHEN owner IS NOT NULL THEN 'https://github.com/' || owner || '/' || name || '.git' END AS clone_url,
       CASE WHEN kind = 'local_path' THEN raw END AS local_path
FROM (SELECT ref_id, raw,
        CASE WHEN raw LIKE './%' THEN 'local_path'
             WHEN regexp_full_match(raw, '(https://github\.com/|git@github\.com:)[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?') THEN 'remote_url'
             WHEN regexp_full_match(raw, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN 'shorthand' END AS kind,
        CASE WHEN raw LIKE './%' THEN NULL
             WHEN raw LIKE 'http%' OR raw LIKE 'git@%' OR raw LIKE '%/%' THEN
               string_split(replace(replace(raw, 'https://github.com/', ''), 'git@github.com:', ''), '/')[1] END AS owner,
        CASE WHEN raw LIKE './%' THEN NULL
             WHEN raw LIKE 'http%' OR raw LIKE 'git@%' OR raw LIKE '%/%' THEN
               regexp_replace(string_split(replace(replace(raw, 'https://github.com/', ''), 'git@github.com:', ''), '/')[2], '\.git$', '') END AS name
      FROM (SELECT ref_id, trim(raw_input) AS raw FROM v_refs) a) b
""", "v_refs")

_LANGUAGE = """CASE regexp_extract(path, '[.][a-z]+$') WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript'
 WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' END"""

_add("file_facts", f"""
SELECT repo, path, {_LANGUAGE} AS language, sha256(content) AS content_hash,
       CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count
FROM v_files""", "v_files")

_add("document_facts", """
SELECT doc_id, sha256(text) AS content_hash, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count
FROM documents""")

_add("source_files", """
SELECT repo, path, length FROM v_tree
WHERE length <= 2000000 AND path NOT LIKE 'node_modules/%' AND path NOT LIKE 'out/%'
  AND (path NOT LIKE '%.log' OR path LIKE 'logs/keep%')""", "v_tree")

_add("repo_validation", """
WITH held AS (
  SELECT repo, path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts' OR path LIKE '%.jsx'
    OR path LIKE '%.java' OR path LIKE '%.go' AS code FROM v_files
  UNION ALL SELECT source, false FROM documents),
repos AS (SELECT 'r' || CAST(s_suppkey AS VARCHAR) AS repo FROM supplier UNION SELECT source FROM documents)
SELECT r.repo, count(h.repo) AS n_files, coalesce(bool_or(h.code), false) AS has_code,
       coalesce(bool_or(h.code), false) AS valid,
       CASE WHEN count(h.repo) = 0 THEN 'empty' WHEN NOT bool_or(h.code) THEN 'no code' END AS reason
FROM repos r LEFT JOIN held h ON r.repo = h.repo GROUP BY r.repo""", "v_files")

_add("unprocessed_files", """
SELECT n.repo, n.path, sha256(n.content) AS content_hash FROM v_next n
WHERE NOT EXISTS (SELECT 1 FROM v_py o WHERE o.repo = n.repo AND o.path = n.path AND o.content = n.content)
""", "v_next")

_add("stored_index", """
SELECT repo, c AS commit_sha, path, sha256(content) AS content_hash
FROM v_files, (VALUES ('c2'), ('c3')) v(c)""", "v_files")

# --- symbols ----------------------------------------------------------------------

# (language files, name, qualified name, kind, parent, first line, last line, docstring)
_PY_SYMBOLS = [
    ("'C' || k", "'C' || k", "class", "NULL", "'class C' || k || ':'", "'        return inner'",
     "regexp_extract(content, '\"\"\"(Handles [^\"]*)\"\"\"', 1)"),
    ("'run'", "'C' || k || '.run'", "method", "'C' || k", "'    def run(self, x):'", "'        return y'", "NULL"),
    ("'load'", "'C' || k || '.load'", "method", "'C' || k", "'    async def load(self,'", "'        return inner'", "NULL"),
    ("'inner'", "'C' || k || '.inner'", "method", "'C' || k", "'        def inner():'", "'            return os.path'", "NULL"),
    ("'f' || k", "'f' || k", "function", "NULL", "'def f' || k || '(a, b):'", "'    return a + b'", "NULL"),
]
# the language files below have fixed line numbers
_JS_SYMBOLS = [
    ("'Widget' || k", "'Widget' || k", "class", "NULL", 8, 17),
    ("'constructor'", "'Widget' || k || '.constructor'", "method", "'Widget' || k", 9, 11),
    ("'render'", "'Widget' || k || '.render'", "method", "'Widget' || k", 12, 16),
    ("'helper' || k", "'helper' || k", "function", "NULL", 18, 20),
]
_JAVA_SYMBOLS = [
    ("'J' || k", "'J' || k", "class", "NULL", 5, 13),
    ("'get'", "'J' || k || '.get'", "method", "'J' || k", 7, 9),
    ("'Inner'", "'Inner'", "class", "NULL", 10, 12),
    ("'reset'", "'Inner.reset'", "method", "'Inner'", 11, 11),
]
_GO_SYMBOLS = [
    ("'G' || k", "'G' || k", "class", "NULL", 7, 9),
    ("'Get'", "'Get'", "function", "NULL", 10, 12),
    ("'Make' || k", "'Make' || k", "function", "NULL", 13, 15),
]


def _symbol_ctes() -> str:
    parts = [
        f"SELECT repo, path, {name} AS name, {qual} AS qualified_name, '{kind}' AS kind, CAST({parent} AS VARCHAR) AS parent, "
        f"CAST(list_position(l, {first}) AS INTEGER) AS start_line, CAST(list_position(l, {last}) AS INTEGER) AS end_line, "
        f"CAST({doc} AS VARCHAR) AS docstring FROM keyed WHERE kind_ = 'py'"
        for name, qual, kind, parent, first, last, doc in _PY_SYMBOLS
    ]
    for lang, rows in (("js", _JS_SYMBOLS), ("java", _JAVA_SYMBOLS), ("go", _GO_SYMBOLS)):
        parts += [
            f"SELECT repo, path, {name}, {qual}, '{kind}', CAST({parent} AS VARCHAR), {first}, {last}, NULL "
            f"FROM keyed WHERE kind_ = '{lang}'"
            for name, qual, kind, parent, first, last in rows
        ]
    union = " UNION ALL ".join(parts)
    return f"""keyed AS (
  SELECT repo, path, content, string_split(content, chr(10)) AS l,
    regexp_extract(path, '([0-9]+)[.][a-z]+$', 1) AS k,
    CASE WHEN path LIKE '%__init__.py' OR path LIKE '%util.js' THEN 'none' WHEN path LIKE '%.py' THEN 'py'
         WHEN path LIKE 'web/%' THEN 'js' WHEN path LIKE '%.java' THEN 'java' ELSE 'go' END AS kind_
  FROM v_files),
sym AS ({union})"""


_SYM = _symbol_ctes()

_add("symbol_ranges", f"WITH {_SYM} SELECT * FROM sym", "v_files")

_add("index_totals", f"""WITH {_SYM},
n AS (SELECT repo, count(*) AS n_symbols FROM sym GROUP BY repo)
SELECT f.repo, 'c1' AS commit_sha, count(*) AS n_files, coalesce(max(n.n_symbols), 0) AS n_symbols
FROM v_files f LEFT JOIN n ON f.repo = n.repo GROUP BY f.repo""", "v_files")

_add("index_stream", f"WITH {_SYM} SELECT repo, path, qualified_name, start_line, end_line FROM sym", "v_files")

# --- imports and the import graph -------------------------------------------------

_LINES = """ln AS (
  SELECT repo, path, unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1) AS no FROM v_files)"""

_add("import_specs", f"""WITH {_LINES},
py AS (
  SELECT repo, path,
    CASE WHEN line LIKE '%(' THEN line || chr(10) || '    List,' || chr(10) || ')' ELSE line END AS raw_import,
    CASE WHEN line LIKE '%(' THEN NULL WHEN line LIKE 'from %' THEN regexp_extract(line, '^from [.]*([A-Za-z0-9_.]*) import', 1)
         ELSE regexp_extract(line, '^import ([A-Za-z0-9_.]+)', 1) END AS module,
    CASE WHEN line LIKE '%(' THEN NULL WHEN line LIKE 'from %' THEN replace(regexp_extract(line, ' import (.+)$', 1), ', ', '|') ELSE '' END AS imported_names,
    CASE WHEN line LIKE '%(' THEN NULL ELSE line LIKE 'from .%' END AS is_relative,
    CASE WHEN line LIKE '%(' THEN NULL WHEN line LIKE 'from ..%' THEN 2 WHEN line LIKE 'from .%' THEN 1 ELSE 0 END AS relative_level
  FROM ln WHERE path LIKE '%.py' AND (line LIKE 'import %' OR line LIKE 'from %')),
js AS (
  SELECT repo, path,
    CASE WHEN line = 'import ' || chr(123) THEN line || chr(10) || '  b,' || chr(10) || chr(125) || ' from "../lib/util";' ELSE line END,
    nullif(regexp_extract(line, '[''"]([^''"]+)[''"]', 1), ''),
    CASE WHEN line LIKE '%;' THEN '' END,
    CASE WHEN line LIKE '%;' THEN line LIKE '%''.%' END,
    CASE WHEN line LIKE '%;' THEN 0 END
  FROM ln WHERE path LIKE 'web/%' AND line LIKE 'import %'),
java AS (
  SELECT repo, path, line, regexp_extract(line, '([a-zA-Z.]+)[*]?;', 1), '', false, 0
  FROM ln WHERE path LIKE '%.java' AND line LIKE 'import %'),
go AS (
  SELECT repo, path, s, m, CASE WHEN m IS NULL THEN NULL ELSE '' END, CASE WHEN m IS NULL THEN NULL ELSE false END,
    CASE WHEN m IS NULL THEN NULL ELSE 0 END
  FROM v_files, (VALUES ('"fmt"', 'fmt'), ('"net/http"', 'net/http'), ('str "strings"', NULL)) v(s, m)
  WHERE path LIKE '%.go')
SELECT * FROM py UNION ALL SELECT * FROM js UNION ALL SELECT * FROM java UNION ALL SELECT * FROM go
""", "v_files")

_EDGES = f"""{_LINES},
st AS (
  SELECT repo, path, line, string_split(path, '/')[1] AS pkg FROM ln
  WHERE path LIKE '%.py' AND (line LIKE 'import %' OR line LIKE 'from %') AND line NOT LIKE '%('),
py AS (
  -- from . import a, b
  SELECT repo, path, line, '' AS module, o, pkg || '/' || nm AS stem
  FROM (SELECT repo, path, line, pkg, unnest(string_split(regexp_extract(line, ' import (.+)$', 1), ', ')) AS nm,
               generate_subscripts(string_split(regexp_extract(line, ' import (.+)$', 1), ', '), 1) AS o
        FROM st WHERE line LIKE 'from . import %') a
  UNION ALL
  -- from .m import x, from ..p.m import x, import p.m, from p.m import x
  SELECT repo, path, line, module, 1, CASE WHEN line LIKE 'from .%' AND line NOT LIKE 'from ..%' THEN pkg || '/' ELSE '' END || replace(module, '.', '/')
  FROM (SELECT repo, path, line, pkg, CASE WHEN line LIKE 'from %' THEN regexp_extract(line, '^from [.]*([A-Za-z0-9_.]+) import', 1)
               ELSE regexp_extract(line, '^import ([A-Za-z0-9_.]+)', 1) END AS module
        FROM st WHERE line NOT LIKE 'from . import %') b),
js AS (
  SELECT repo, path, line, m AS module, 1 AS o,
    CASE WHEN m LIKE './%' THEN 'web/src/' || substr(m, 3) WHEN m LIKE '../%' THEN 'web/' || substr(m, 4) END AS stem
  FROM (SELECT repo, path, line, regexp_extract(line, '[''"]([^''"]+)[''"]', 1) AS m FROM ln
        WHERE path LIKE 'web/%' AND line LIKE 'import %;') c),
other AS (
  SELECT repo, path, line, regexp_extract(line, '([a-zA-Z.]+)[*]?;', 1) AS module, 1 AS o, NULL AS stem FROM ln
  WHERE path LIKE '%.java' AND line LIKE 'import %'
  UNION ALL SELECT repo, path, m, m, 1, NULL FROM v_files, (VALUES ('fmt'), ('net/http')) v(m) WHERE path LIKE '%.go'),
every AS (SELECT * FROM py UNION ALL SELECT * FROM js UNION ALL SELECT * FROM other),
hit AS (
  SELECT e.repo, e.path, e.line, e.module, arg_min(f.path, e.o * 10 + t.p) AS target
  FROM every e LEFT JOIN (VALUES (0, ''), (1, '.py'), (2, '/__init__.py'), (3, '.js'), (4, '.jsx'), (5, '.ts')) t(p, x)
    ON (e.path LIKE '%.py') = (t.p IN (1, 2))
  LEFT JOIN v_files f ON f.repo = e.repo AND f.path = e.stem || t.x
  GROUP BY ALL),
edges AS (
  SELECT DISTINCT repo, path AS src, coalesce(target, 'external:' || module) AS dst,
         CASE WHEN target IS NULL THEN 'external' ELSE 'repo_file' END AS dst_kind FROM hit)"""

_add("import_edges", f"WITH {_EDGES} SELECT * FROM edges", "v_files")

_add("graph_nodes", f"""WITH {_EDGES}
SELECT repo, path AS node, 'repo_file' AS kind FROM v_files
UNION SELECT repo, dst, 'external' FROM edges WHERE dst_kind = 'external'""", "v_files")

_CYCLES = """
  SELECT repo, 1 AS length, src AS cycle FROM e WHERE src = dst
  UNION ALL SELECT a.repo, 2, a.src || '>' || a.dst FROM e a JOIN e b ON a.repo = b.repo AND a.dst = b.src AND b.dst = a.src
  WHERE a.src < a.dst
  UNION ALL SELECT a.repo, 3, a.src || '>' || a.dst || '>' || b.dst FROM e a
  JOIN e b ON a.repo = b.repo AND a.dst = b.src JOIN e c ON b.repo = c.repo AND b.dst = c.src AND c.dst = a.src
  WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst"""

# --- graph ------------------------------------------------------------------------

_add("graph_imports", "SELECT repo, src AS start, dst AS path FROM v_edges", "v_edges")
_add("graph_imported_by", """
SELECT repo, dst AS start, src AS path FROM v_edges
WHERE (repo, dst) IN (SELECT repo, src FROM v_edges)""", "v_edges")


def _walk(depth: int, a: str, b: str) -> str:
    return f"""WITH RECURSIVE w AS (
  SELECT repo, {a} AS start, {b} AS path, 1 AS hop FROM v_edges WHERE (repo, {a}) IN (SELECT repo, src FROM v_edges)
  UNION SELECT w.repo, w.start, e.{b}, w.hop + 1 FROM w JOIN v_edges e ON e.repo = w.repo AND e.{a} = w.path WHERE w.hop < {depth})
SELECT repo, start, path, min(hop) AS hop FROM w GROUP BY repo, start, path"""


_add("graph_blast_radius", _walk(2, "dst", "src"), "v_edges")
_add("graph_dependencies", _walk(2, "src", "dst"), "v_edges")
_add("graph_dependencies_deep", _walk(4, "src", "dst"), "v_edges")

_NEAR = """
  SELECT a.repo, a.s AS start, a.t AS path, 1 AS hop, a.d FROM step a
  UNION ALL SELECT a.repo, a.s, b.t, 2, a.d FROM step a JOIN step b ON a.repo = b.repo AND a.d = b.d AND a.t = b.s"""
_add("graph_neighborhood", f"""WITH
step AS (SELECT repo, src AS s, dst AS t, 0 AS d FROM v_edges
         UNION ALL SELECT repo, dst, src, 1 FROM v_edges WHERE dst_kind = 'repo_file'),
w AS ({_NEAR})
SELECT repo, start, path, min(hop) AS hop FROM w
WHERE start <> path AND (repo, start) IN (SELECT repo, src FROM v_edges) GROUP BY repo, start, path""", "v_edges")

_add("graph_cycles3", f"""WITH e AS (SELECT repo, src, dst FROM v_edges WHERE dst_kind = 'repo_file')
{_CYCLES}""", "v_edges")

_SCC = """RECURSIVE_E AS (SELECT repo, src, dst FROM {t} WHERE dst_kind = 'repo_file'),
reached AS (SELECT repo, src AS a, dst AS b FROM scc_e UNION SELECT r.repo, r.a, e.dst FROM reached r JOIN scc_e e ON r.repo = e.repo AND r.b = e.src),
scc AS (SELECT x.repo, min(y.a) AS group_id, x.a AS node
        FROM reached x JOIN reached y ON x.repo = y.repo AND x.b = y.a AND y.b = x.a GROUP BY x.repo, x.a)""".replace("RECURSIVE_E", "scc_e")
_add("graph_cyclic_groups", f"WITH RECURSIVE {_SCC.format(t='v_edges')} SELECT repo, group_id, node FROM scc", "v_edges")
_add("graph_stats", f"""WITH RECURSIVE {_EDGES}, {_SCC.format(t="edges")}
SELECT f.repo, f.n AS total_files, coalesce(g.n, 0) AS total_edges, coalesce(g.x, 0) AS external_dependencies,
       coalesce(c.n, 0) AS cyclic_groups
FROM (SELECT repo, count(*) AS n FROM v_files GROUP BY repo) f
LEFT JOIN (SELECT repo, count(*) AS n, count(DISTINCT CASE WHEN dst_kind = 'external' THEN dst END) AS x FROM edges GROUP BY repo) g
  ON f.repo = g.repo
LEFT JOIN (SELECT repo, count(DISTINCT group_id) AS n FROM scc GROUP BY repo) c ON f.repo = c.repo""", "v_files")


_add("page_links", """
SELECT DISTINCT p.url AS src, CASE WHEN q.url IS NULL THEN 'external:' || p.m ELSE p.m END AS dst,
       CASE WHEN q.url IS NULL THEN 'external' ELSE 'repo_file' END AS dst_kind
FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS m FROM pages) p
LEFT JOIN (SELECT DISTINCT url FROM pages) q ON p.m = q.url""")

# --- chunks and vectors -----------------------------------------------------------

_CHUNKS = f"""{_SYM},
chunk AS (
  SELECT s.repo, s.path, s.path || '::' || s.qualified_name || '@' || CAST(s.start_line AS VARCHAR) AS chunk_id, s.qualified_name, s.kind, s.start_line, s.end_line,
    'File: ' || s.path || chr(10) || 'Symbol: ' || s.qualified_name || ' (' || s.kind || ')' || chr(10)
    || CASE WHEN s.docstring IS NULL THEN '' ELSE 'Docstring: ' || s.docstring || chr(10) END
    || 'Code:' || chr(10) || array_to_string(list_slice(k.l, s.start_line, s.end_line), chr(10)) AS embedding_text
  FROM sym s JOIN keyed k ON s.repo = k.repo AND s.path = k.path)"""

_add("chunk_text", f"""WITH {_CHUNKS}
SELECT repo, chunk_id, kind, start_line, end_line, embedding_text FROM chunk""", "v_files")


def _buckets(table: str, key: str, text: str) -> str:
    """(key, bucket, n) of the hashed terms of a text."""
    return f"""SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS b, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[^\\t\\n\\x0b\\f\\r ]+')) AS t FROM {table}) u GROUP BY ALL"""


_add("hashed_vectors", f"""WITH term AS ({_buckets("documents", "doc_id", "text")})
SELECT d.doc_id, string_agg(CAST(coalesce(t.n, 0) AS VARCHAR), ',' ORDER BY r.b) AS vector
FROM documents d CROSS JOIN (SELECT unnest(range(64)) AS b) r
LEFT JOIN term t ON d.doc_id = t.doc_id AND r.b = t.b GROUP BY d.doc_id""")

_add("stored_vectors", f"""WITH {_CHUNKS}
SELECT repo, chunk_id, 64 AS dim, CAST(len(regexp_extract_all(embedding_text, '[^\\s]+')) AS INTEGER) AS terms FROM chunk
""", "v_files")


def _knn(score: str) -> str:
    return f"""SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) + 0.0 AS score FROM embeddings a CROSS JOIN embeddings b) x) y
WHERE rank <= 10"""


_add("knn_cosine", _knn("list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
_add("knn_l2", _knn("1 - pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)"))

_add("upsert_vectors", """
SELECT chunk_id, max(version) AS version, arg_max(label, version) AS label FROM (
  SELECT vec_id // 3 AS chunk_id, vec_id AS version, label FROM embeddings
  UNION ALL SELECT vec_id, vec_id * 2, label FROM embeddings) u
GROUP BY chunk_id""")

# --- tracebacks -------------------------------------------------------------------

_TRACES = r"""tl AS (
  SELECT failure_id, repo, repo_root, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS no FROM v_traces),
head AS (SELECT failure_id, max(no) AS h FROM tl WHERE line = 'Traceback (most recent call last):' GROUP BY failure_id),
body AS (
  SELECT tl.*, lead(line) OVER (PARTITION BY tl.failure_id ORDER BY no) AS nxt
  FROM tl JOIN head USING (failure_id) WHERE no > h),
frame AS (
  SELECT failure_id, repo, repo_root, CAST(row_number() OVER (PARTITION BY failure_id ORDER BY no) - 1 AS INTEGER) AS pos,
    regexp_extract(line, 'File "([^"]+)"', 1) AS file_path, CAST(regexp_extract(line, ', line ([0-9]+)', 1) AS INTEGER) AS line_number,
    regexp_extract(line, ', in (.+)$', 1) AS function_name,
    CASE WHEN nxt LIKE '    %' THEN trim(nxt) END AS code_line
  FROM body WHERE line LIKE '  File "%'),
tail AS (
  SELECT failure_id, min(no) AS e FROM body WHERE line <> '' AND line NOT LIKE ' %' GROUP BY failure_id),
msg AS (
  SELECT b.failure_id, string_agg(trim(b.line), ' ' ORDER BY b.no) AS whole
  FROM body b JOIN tail t USING (failure_id)
  LEFT JOIN (SELECT failure_id, min(no) AS z FROM body WHERE line = '' GROUP BY failure_id) q USING (failure_id)
  WHERE b.no >= t.e AND (q.z IS NULL OR b.no < q.z) GROUP BY b.failure_id),
exc AS (
  SELECT failure_id,
    CASE WHEN whole LIKE '!!%' THEN 'UnknownError' WHEN whole LIKE '%: %' THEN string_split(whole, ': ')[1] ELSE whole END AS exception_type,
    CASE WHEN whole LIKE '!!%' THEN whole WHEN whole LIKE '%: %' THEN substr(whole, strpos(whole, ': ') + 2) ELSE '' END AS message
  FROM msg),
last_frame AS (SELECT * FROM frame QUALIFY row_number() OVER (PARTITION BY failure_id ORDER BY pos DESC) = 1),
anchor AS (
  SELECT failure_id, repo, substr(file_path, length(repo_root) + 2) AS path, line_number
  FROM last_frame WHERE file_path LIKE repo_root || '/%')"""

_add("trace_frames", f"""WITH {_TRACES}
SELECT failure_id, pos, file_path, line_number, function_name, code_line FROM frame""", "v_traces")

_add("trace_summary", f"""WITH {_TRACES}
SELECT x.failure_id, x.exception_type, x.message, CAST(l.pos + 1 AS INTEGER) AS n_frames, l.file_path AS inner_file,
       l.line_number AS inner_line, o.function_name AS outer_function
FROM exc x JOIN last_frame l USING (failure_id) JOIN (SELECT * FROM frame WHERE pos = 0) o USING (failure_id)""", "v_traces")

_ANCHORED = f"""{_SYM}, {_TRACES},
anchored AS (
  SELECT a.repo, a.path, a.line_number, a.failure_id,
    arg_min(s.qualified_name, (s.end_line - s.start_line) * 1000 + s.start_line) AS symbol
  FROM anchor a LEFT JOIN sym s
    ON a.repo = s.repo AND a.path = s.path AND a.line_number BETWEEN s.start_line AND s.end_line
  GROUP BY a.repo, a.path, a.line_number, a.failure_id)"""

_add("anchor_symbols", f"WITH {_ANCHORED} SELECT * FROM anchored", "v_files", "v_traces")

# --- localisation -----------------------------------------------------------------

_SIGNALS = f"""{_ANCHORED}, {_EDGES},
step AS (SELECT repo, src AS s, dst AS t, 0 AS d FROM edges
         UNION ALL SELECT repo, dst, src, 1 FROM edges WHERE dst_kind = 'repo_file'),
spots AS (SELECT DISTINCT repo, path AS start FROM anchor),
one AS (SELECT p.repo, p.start, s.t AS path, s.d FROM spots p JOIN step s ON p.repo = s.repo AND p.start = s.s),
two AS (SELECT o.repo, o.start, s.t AS path FROM (SELECT DISTINCT * FROM one) o
        JOIN step s ON o.repo = s.repo AND o.d = s.d AND o.path = s.s),
near AS (SELECT repo, start, path, min(hop) AS hop FROM (
  SELECT repo, start, path, 1 AS hop FROM one UNION ALL SELECT repo, start, path, 2 FROM two) u
  WHERE path <> start GROUP BY repo, start, path),
basic AS (
  SELECT failure_id, repo, path, 1.0 AS c, 1 AS src, 0 AS hop, symbol FROM anchored
  UNION ALL SELECT a.failure_id, a.repo, n.path, 0.6 / n.hop, 2, n.hop, NULL
  FROM anchored a JOIN near n ON a.repo = n.repo AND a.path = n.start)"""


def _ranked(signals: str) -> str:
    return f"""ranked AS (
  SELECT failure_id, repo, path, score, sources, relevant_symbols, hop_distance,
    CAST(row_number() OVER (PARTITION BY failure_id ORDER BY score DESC, path) AS INTEGER) AS rank
  FROM (SELECT failure_id, repo, path, round(CAST(sum(c) AS DOUBLE), 9) AS score,
      array_to_string(list_transform(list_sort(list(DISTINCT src)), lambda x: ['anchor', 'structural', 'semantic'][x]), '|') AS sources,
      coalesce(array_to_string(list_sort(list(DISTINCT symbol) FILTER (symbol IS NOT NULL)), '|'), '') AS relevant_symbols,
      CAST(min(hop) AS INTEGER) AS hop_distance
    FROM {signals} GROUP BY failure_id, repo, path) g)"""


_OUT = "failure_id, path, score, sources, relevant_symbols, hop_distance, rank"
_add("ranked_files", f"WITH {_SIGNALS}, {_ranked('basic')} SELECT {_OUT} FROM ranked", "v_files", "v_traces")

_HITS = f"""
chunk AS (
  SELECT s.repo, s.path, s.path || '::' || s.qualified_name || '@' || CAST(s.start_line AS VARCHAR) AS chunk_id, s.qualified_name,
    'File: ' || s.path || ' Symbol: ' || s.qualified_name || ' (' || s.kind || ') '
    || CASE WHEN s.docstring IS NULL THEN '' ELSE 'Docstring: ' || s.docstring || ' ' END
    || 'Code: ' || array_to_string(list_slice(k.l, s.start_line, s.end_line), chr(10)) AS text
  FROM sym s JOIN keyed k ON s.repo = k.repo AND s.path = k.path),
cterm AS ({_buckets("chunk", "repo, chunk_id, qualified_name, path", "text")}),
cnorm AS (SELECT repo, chunk_id, qualified_name, path, sqrt(sum(n * n)) AS len FROM cterm GROUP BY ALL),
ask AS (SELECT e.failure_id, t.repo, e.exception_type || ': ' || e.message AS q FROM exc e JOIN v_traces t USING (failure_id)),
text AS (SELECT DISTINCT repo, q FROM ask),
qterm AS ({_buckets("text", "repo, q", "q")}),
qnorm AS (SELECT repo, q, sqrt(sum(n * n)) AS len FROM qterm GROUP BY ALL),
dot AS (SELECT q.repo, q.q, c.chunk_id, sum(q.n * c.n) AS d FROM qterm q JOIN cterm c ON q.repo = c.repo AND q.b = c.b GROUP BY ALL),
scored AS (
  SELECT q.repo, q.q, c.chunk_id, c.qualified_name, c.path, round(coalesce(d.d, 0) / (q.len * c.len), 6) + 0.0 AS score
  FROM qnorm q JOIN cnorm c ON q.repo = c.repo LEFT JOIN dot d ON d.repo = q.repo AND d.q = q.q AND d.chunk_id = c.chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY repo, q ORDER BY score DESC, chunk_id) AS rank FROM scored
         QUALIFY rank <= 10),
hits AS (SELECT a.failure_id, b.* FROM ask a JOIN best b ON a.repo = b.repo AND a.q = b.q)"""

_add("semantic_hits", f"""WITH {_SYM}, {_TRACES}, {_HITS}
SELECT failure_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM hits""", "v_files", "v_traces")

_add("top_files", f"""WITH {_SIGNALS}, {_HITS},
every_signal AS (SELECT * FROM basic UNION ALL
  SELECT failure_id, repo, path, 0.5 * score, 3, NULL, qualified_name FROM hits),
{_ranked('every_signal')} SELECT {_OUT} FROM ranked WHERE rank <= 10""", "v_files", "v_traces")

# --- context ----------------------------------------------------------------------

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _compressed(text: str) -> str:
    lines = f"string_split_regex({text}, '{_BREAK}')"
    kept = f"list_transform(list_filter({lines}, lambda l: NOT regexp_matches(l, '^[\\s\\x0b]*#')), lambda l: regexp_replace(l, '[\\s\\x0b]+$', ''))"
    squeezed = f"regexp_replace(array_to_string({kept}, chr(10)), '\\n\\n\\n+', chr(10) || chr(10), 'g')"
    return f"trim({squeezed}, chr(10))"


_add("compressed_documents", f"SELECT doc_id, {_compressed('text')} AS compressed FROM documents")
_add("compressed_files", f"SELECT repo, path, {_compressed('content')} AS compressed FROM v_files", "v_files")

_TOKENS = "CAST(len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s\\x0b]')) AS INTEGER)"
_WORDS = "CAST(len(regexp_extract_all({t}, '[^ \\t\\r\\n]+')) AS INTEGER)"

_add("token_counts", f"""
SELECT doc_id, {_TOKENS.format(t='text')} AS tokens, {_WORDS.format(t='text')} AS words FROM documents""")

_PACK = f"""unit AS (
  SELECT source, doc_id, {_WORDS.format(t='text')} AS raw_tokens, {_WORDS.format(t='c')} AS compressed_tokens,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS no
  FROM (SELECT *, {_compressed('text')} AS c FROM documents) d),
walk AS (
  SELECT source, no, doc_id, raw_tokens, compressed_tokens, compressed_tokens <= 2000 AS inside,
    CASE WHEN compressed_tokens <= 2000 THEN compressed_tokens ELSE 0 END AS total
  FROM unit WHERE no = 1
  UNION ALL
  SELECT u.source, u.no, u.doc_id, u.raw_tokens, u.compressed_tokens, w.total + u.compressed_tokens <= 2000,
    CASE WHEN w.total + u.compressed_tokens <= 2000 THEN w.total + u.compressed_tokens ELSE w.total END
  FROM walk w JOIN unit u ON w.source = u.source AND u.no = w.no + 1)"""

_add("context_pack", f"""WITH RECURSIVE {_PACK}
SELECT source, doc_id, raw_tokens, compressed_tokens FROM walk WHERE inside""")

_add("context_usage", f"""WITH RECURSIVE {_PACK}
SELECT source, CAST(b AS BIGINT) AS baseline_tokens, CAST(c AS BIGINT) AS compressed_tokens, n AS units_available, i AS units_included,
  CAST(b - c AS BIGINT) AS tokens_saved,
  round(CASE WHEN b = 0 THEN 0.0 ELSE 1 - c / b END, 6) + 0.0 AS compression_ratio,
  round(CASE WHEN ib = 0 THEN 0.0 ELSE 1 - c / ib END, 6) + 0.0 AS included_ratio
FROM (SELECT source, sum(raw_tokens) AS b, coalesce(sum(compressed_tokens) FILTER (inside), 0) AS c, count(*) AS n,
        count(*) FILTER (inside) AS i, coalesce(sum(raw_tokens) FILTER (inside), 0) AS ib FROM walk GROUP BY source) s""")

_UNITS = f"""named AS (
  SELECT failure_id, repo, path, rank, relevant_symbols <> '' AS has, unnest(string_split(relevant_symbols, '|')) AS sn,
         generate_subscripts(string_split(relevant_symbols, '|'), 1) - 1 AS sr FROM ranked),
wanted AS (
  SELECT n.failure_id, n.repo, n.path, n.rank, CASE WHEN n.has THEN n.sn END AS symbol_name,
    CAST(n.sr AS INTEGER) AS unit_rank,
    CASE WHEN n.has THEN array_to_string(list_slice(k.l, s.start_line, s.end_line), chr(10)) ELSE k.content END AS raw
  FROM named n JOIN keyed k ON n.repo = k.repo AND n.path = k.path
  LEFT JOIN sym s ON n.has AND s.repo = n.repo AND s.path = n.path AND s.qualified_name = n.sn
  WHERE NOT n.has OR s.path IS NOT NULL),
small AS (SELECT *, {_compressed('raw')} AS compressed FROM (SELECT DISTINCT raw FROM wanted) r),
counted AS (
  SELECT w.failure_id, w.repo, w.path, w.symbol_name, w.rank, w.unit_rank, {_TOKENS.format(t='w.raw')} AS raw_tokens,
    {_TOKENS.format(t='s.compressed')} AS compressed_tokens, s.compressed
  FROM wanted w JOIN small s ON w.raw = s.raw)"""

_FETCHED = f"{_SIGNALS}, {_ranked('basic')}, {_UNITS}"

_add("context_units", f"""WITH {_FETCHED}
SELECT failure_id, path, symbol_name, rank, unit_rank, raw_tokens, compressed_tokens FROM counted""", "v_files", "v_traces")

_ASSEMBLED = f"""{_FETCHED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY rank, unit_rank) AS no FROM counted),
walk AS (
  SELECT failure_id, no, compressed_tokens <= 400 AS inside,
    CASE WHEN compressed_tokens <= 400 THEN compressed_tokens ELSE 0 END AS total FROM ordered WHERE no = 1
  UNION ALL
  SELECT u.failure_id, u.no, w.total + u.compressed_tokens <= 400,
    CASE WHEN w.total + u.compressed_tokens <= 400 THEN w.total + u.compressed_tokens ELSE w.total END
  FROM walk w JOIN ordered u ON w.failure_id = u.failure_id AND u.no = w.no + 1),
assembled AS (
  SELECT o.failure_id, string_agg('# File: ' || o.path || CASE WHEN o.symbol_name IS NULL THEN '' ELSE ' — Symbol: ' || o.symbol_name END
    || chr(10) || o.compressed, chr(10) || chr(10) ORDER BY o.no) AS assembled_text
  FROM ordered o JOIN walk w ON o.failure_id = w.failure_id AND o.no = w.no WHERE w.inside GROUP BY o.failure_id)"""

_add("assembled_contexts", f"WITH RECURSIVE {_ASSEMBLED} SELECT * FROM assembled", "v_files", "v_traces")

_add("fix_prompts", f"""WITH RECURSIVE {_ASSEMBLED}
SELECT x.failure_id, '## Failure' || chr(10) || x.exception_type || ': ' || x.message || chr(10)
  || 'Raised at ' || l.file_path || ':' || CAST(l.line_number AS VARCHAR) || ' in ' || l.function_name
  || chr(10) || chr(10) || '## Relevant code context' || chr(10) || coalesce(a.assembled_text, '')
  || chr(10) || chr(10) || '## Wanted' || chr(10) || 'The cause of this failure, and a change that removes it.' AS prompt
FROM exc x JOIN last_frame l USING (failure_id) LEFT JOIN assembled a USING (failure_id)""", "v_files", "v_traces")

# --- test reports and fix attempts ------------------------------------------------

_add("report_totals", """
SELECT run_id, iteration, count(*) AS total_tests, count(*) FILTER (outcome = 'passed') AS passed,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'error') AS errors,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome <> 'passed') > 0 AS has_failures
FROM v_results GROUP BY run_id, iteration""", "v_results")

_add("failure_rows", """
SELECT CAST(run_id AS VARCHAR) || '-' || CAST(iteration AS VARCHAR) AS run_id, node_id, 'tests/test_u.py' AS file_path, outcome,
  iteration / 4.0 AS duration_seconds, 'AssertionError' AS exception_type, 'run ' || CAST(run_id AS VARCHAR) AS message, 1 AS n_frames
FROM v_results WHERE outcome <> 'passed' AND NOT (run_id % 5 = 0 AND iteration = 1)""".replace("iteration / 4.0", "CAST(iteration / 4.0 AS DOUBLE)"), "v_results")

_LOOP = """failing AS (SELECT run_id, iteration, node_id FROM v_results WHERE outcome <> 'passed'),
target AS (SELECT run_id, node_id FROM failing WHERE iteration = 0),
tally AS (
  SELECT a.run_id, a.iteration, a.status, count(t.node_id) AS still, count(f.node_id) - count(t.node_id) AS fresh
  FROM v_attempts a LEFT JOIN failing f ON f.run_id = a.run_id AND f.iteration = a.iteration
  LEFT JOIN target t ON t.run_id = f.run_id AND t.node_id = f.node_id GROUP BY a.run_id, a.iteration, a.status),
judged AS (
  SELECT *, CASE WHEN status IN ('unparseable', 'not_applied') THEN 'no_change' WHEN status = 'no_report' THEN 'run_failed'
    WHEN still > 0 THEN 'no_change' WHEN fresh > 0 THEN 'regressed' ELSE 'fixed' END AS outcome FROM tally),
base AS (
  SELECT run_id, count(*) FILTER (outcome <> 'passed') AS n FROM v_results WHERE iteration = 0 GROUP BY run_id),
stop AS (SELECT run_id, min(iteration) AS at FROM judged WHERE outcome = 'fixed' AND iteration <= 5 GROUP BY run_id),
done AS (
  SELECT j.* FROM judged j JOIN base b ON j.run_id = b.run_id AND b.n > 0 LEFT JOIN stop s ON s.run_id = j.run_id
  WHERE j.iteration <= 5 AND (s.at IS NULL OR j.iteration <= s.at)),
solved AS (
  SELECT b.run_id, b.n = 0 OR coalesce(bool_or(d.outcome = 'fixed'), false) AS success,
    coalesce(max(d.iteration), 0) AS iterations, b.n AS baseline_failing,
    coalesce(arg_max(d.still + d.fresh, d.iteration) FILTER (d.status = 'applied'), b.n) AS final_failing
  FROM base b LEFT JOIN done d ON b.run_id = d.run_id GROUP BY b.run_id, b.n)"""

_add("run_outcomes", f"""WITH {_LOOP}
SELECT run_id, iteration, status, CASE WHEN status = 'applied' THEN still END AS still_failing,
  CASE WHEN status = 'applied' THEN fresh END AS newly_broken, outcome, outcome = 'fixed' AS kept,
  CASE WHEN status = 'unparseable' THEN 'no file change in the reply' WHEN status = 'not_applied' THEN 'the change does not fit the files'
    WHEN status = 'no_report' THEN 'no test report after the change'
    WHEN still > 0 THEN 'targets failing: ' || CAST(still AS VARCHAR) || ', undone'
    WHEN fresh > 0 THEN 'targets pass, newly failing: ' || CAST(fresh AS VARCHAR) || ', undone'
    ELSE '' END AS notes
FROM judged""", "v_results", "v_attempts")

_add("loop_results", f"WITH {_LOOP} SELECT * FROM solved", "v_results", "v_attempts")

_add("retry_descriptions", """WITH
target AS (SELECT run_id, node_id FROM v_results WHERE iteration = 0 AND outcome <> 'passed'),
bad AS (
  SELECT r.run_id, r.iteration, string_agg(r.node_id || ': ' || r.outcome || ' — AssertionError: run ' || CAST(r.run_id AS VARCHAR),
    chr(10) ORDER BY r.node_id) AS lines
  FROM v_results r JOIN target t ON r.run_id = t.run_id AND r.node_id = t.node_id WHERE r.outcome <> 'passed'
  GROUP BY r.run_id, r.iteration)
SELECT i.run_id, i.iteration, concat_ws(chr(10) || chr(10),
  CASE WHEN i.run_id % 2 = 0 THEN 'please fix ' || CAST(i.run_id AS VARCHAR) END,
  'Currently failing:' || chr(10) || b.lines) AS description
FROM (SELECT DISTINCT run_id, iteration FROM v_results) i
LEFT JOIN bad b ON b.run_id = i.run_id AND b.iteration = i.iteration""", "v_results")

# --- suggested fixes --------------------------------------------------------------

_REPLIES = """src AS (
  SELECT conv_id * 1000 + turn AS response_id, CASE WHEN role = 'assistant' THEN conv_id % 5 ELSE 5 END AS kind, (conv_id + turn) % 4 = 0 AS bad, replace(text, '```', '') AS reply,
    (conv_id * 3 + turn) % (SELECT count(*) FROM part) AS k FROM conversations),
ans AS (
  SELECT s.*, 'r' || CAST(k // 200 AS VARCHAR) AS repo, 'pkg' || CAST(k // 20 AS VARCHAR) || '/m' || CAST(k AS VARCHAR) || '.py' AS path,
    v.text FROM src s JOIN v_responses v USING (response_id)),
change AS (
  SELECT response_id, repo, kind, bad, 0 AS pos, CASE WHEN kind = 0 AND bad THEN '../' ELSE '' END || path AS path,
    CASE WHEN kind = 1 THEN 'unified_diff' ELSE 'full_file' END AS format,
    CASE WHEN kind <> 1 THEN reply END AS new_content,
    CASE WHEN kind = 1 THEN substr(text, strpos(text, '--- a/'), length(text) - strpos(text, '--- a/') - 2) END AS diff_text
  FROM ans WHERE kind <= 2
  UNION ALL SELECT response_id, repo, kind, bad, 1, 'new/n' || CAST(k AS VARCHAR) || '.py', 'full_file', 'x = 1' || chr(10), NULL
  FROM ans WHERE kind = 2)"""

_add("patch_changes", f"""WITH {_REPLIES}
SELECT response_id, pos, path, format, new_content, diff_text, 'parsed' AS status FROM change
UNION ALL SELECT response_id, NULL, NULL, NULL, NULL, NULL, 'unparseable' FROM ans WHERE kind > 2""", "v_responses")

_add("apply_patches", f"""WITH {_REPLIES},
tried AS (
  SELECT c.*, p.path IS NOT NULL AS existed_before, NOT (bad AND kind IN (0, 1)) AS ok,
    CASE WHEN kind = 1 THEN replace(replace(
        regexp_replace(p.content, chr(10), chr(10) || '# patched' || chr(10)), '        # step', '        # patched step'),
        'return a + b', 'return a - b') ELSE new_content END AS after_
  FROM change c LEFT JOIN v_py p ON c.repo = p.repo AND c.path = p.path)
SELECT response_id, path, existed_before, CASE WHEN ok THEN after_ END AS new_content, ok, ok AS applied,
  CASE WHEN NOT ok AND kind = 0 THEN 'unsafe path' WHEN NOT ok THEN 'patch does not apply' END AS error
FROM tried""", "v_responses", "v_py")

_add("patch_status", f"""WITH {_REPLIES}
SELECT response_id, CASE WHEN kind > 2 THEN 'unparseable' WHEN bad AND kind IN (0, 1) THEN 'not_applied' ELSE 'applied' END AS status
FROM ans""", "v_responses")

_add("apply_files", """
SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.path, o.path) AS path,
  CAST(CASE WHEN n.path IS NOT NULL AND o.path IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS version,
  coalesce(n.content, o.content) AS content
FROM v_py o FULL OUTER JOIN v_next n ON o.repo = n.repo AND o.path = n.path""", "v_py", "v_next")

_add("rollback", "SELECT repo, path, CAST(1 AS INTEGER) AS version, content FROM v_py", "v_py")

_add("snapshot_diff", """WITH
o AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line FROM (SELECT repo, path, rtrim(content, chr(10)) AS content FROM v_py) a),
n AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line FROM (SELECT repo, path, rtrim(content, chr(10)) AS content FROM v_next) a),
plus AS (SELECT repo, path, count(*) AS c FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) x GROUP BY repo, path),
minus AS (SELECT repo, path, count(*) AS c FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) x GROUP BY repo, path)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
  coalesce(p.c, 0) AS added_lines, coalesce(m.c, 0) AS removed_lines
FROM v_py a FULL OUTER JOIN v_next b ON a.repo = b.repo AND a.path = b.path
LEFT JOIN plus p ON p.repo = coalesce(a.repo, b.repo) AND p.path = coalesce(a.path, b.path)
LEFT JOIN minus m ON m.repo = coalesce(a.repo, b.repo) AND m.path = coalesce(a.path, b.path)
WHERE a.content IS DISTINCT FROM b.content""", "v_py", "v_next")

# --- usage ------------------------------------------------------------------------

_add("counter_deltas", """WITH
c AS (
  SELECT *, CAST(replace(estimated_cost_saved_usd, '$', '') AS DECIMAL(18,2)) AS usd FROM v_counters),
p AS (
  SELECT *, coalesce(lag(total_requests) OVER w, 0) AS pr, coalesce(lag(input_tokens_original) OVER w, 0) AS po,
    coalesce(lag(input_tokens_compressed) OVER w, 0) AS pc, coalesce(lag(usd) OVER w, 0) AS pu
  FROM c WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
d AS (
  SELECT session_id, event_id, CASE WHEN total_requests < pr THEN total_requests ELSE total_requests - pr END AS requests_delta,
    CASE WHEN input_tokens_original < po THEN input_tokens_original ELSE input_tokens_original - po END AS original_tokens,
    CASE WHEN input_tokens_compressed < pc THEN input_tokens_compressed ELSE input_tokens_compressed - pc END AS compressed_tokens,
    '$' || CAST(CASE WHEN usd > pu THEN usd - pu ELSE CAST(0 AS DECIMAL(18,2)) END AS VARCHAR) AS cost_saved_usd FROM p)
SELECT *, original_tokens - compressed_tokens AS tokens_saved,
  CASE WHEN original_tokens = 0 THEN 0.0 ELSE round(compressed_tokens / original_tokens, 3) END AS compression_ratio FROM d
""", "v_counters")

_BOARD = f"""{_LOOP},
used AS (SELECT u.*, d.outcome FROM v_usage u JOIN done d ON u.run_id = d.run_id AND u.iteration = d.iteration),
total AS (
  SELECT run_id, CAST(sum(baseline_tokens) AS BIGINT) AS b, CAST(sum(compressed_tokens) AS BIGINT) AS c,
    CAST(sum(requests) AS BIGINT) AS r, CAST(sum(tokens_saved) AS BIGINT) AS s,
    sum(CAST(replace(cost_saved_usd, '$', '') AS DECIMAL(18,2))) AS usd FROM used GROUP BY run_id),
kinds AS (
  SELECT run_id, string_agg(outcome || '=' || CAST(n AS VARCHAR), '|' ORDER BY outcome) AS o
  FROM (SELECT run_id, outcome, count(*) AS n FROM done GROUP BY run_id, outcome) x GROUP BY run_id),
board AS (
  SELECT s.run_id, s.success, s.iterations AS total_iterations, coalesce(k.o, '') AS outcome_counts,
    s.baseline_failing AS baseline_failing_tests, s.final_failing AS final_failing_tests,
    coalesce(t.b, 0) AS total_baseline_tokens, coalesce(t.c, 0) AS total_compressed_tokens,
    round(CASE WHEN coalesce(t.b, 0) = 0 THEN 0.0 ELSE 1 - t.c / t.b END, 3) AS overall_compression_ratio,
    coalesce(t.r, 0) AS total_requests, coalesce(t.s, 0) AS total_tokens_saved,
    '$' || CAST(CAST(coalesce(t.usd, 0) AS DECIMAL(18,2)) AS VARCHAR) AS total_cost_saved_usd
  FROM solved s LEFT JOIN total t ON s.run_id = t.run_id LEFT JOIN kinds k ON s.run_id = k.run_id)"""

_add("usage_totals", f"""WITH {_BOARD}
SELECT run_id, CAST(sum(requests) AS BIGINT) AS total_requests, CAST(sum(tokens_saved) AS BIGINT) AS total_tokens_saved
FROM used GROUP BY run_id""", "v_results", "v_attempts", "v_usage")
_add("usage_dashboard", f"WITH {_BOARD} SELECT * FROM board", "v_results", "v_attempts", "v_usage")
_add("usage_breakdown", f"""WITH {_BOARD}
SELECT run_id, iteration, outcome, baseline_tokens, compressed_tokens, tokens_saved,
  CASE WHEN baseline_tokens = 0 THEN 0.0 ELSE 1 - compressed_tokens / baseline_tokens END AS compression_ratio,
  CASE WHEN compressed_tokens + tokens_saved = 0 THEN 0.0 ELSE 1 - compressed_tokens / (compressed_tokens + tokens_saved) END AS proxy_ratio
FROM used""", "v_results", "v_attempts", "v_usage")

_REPORTED = ("total_iterations", "baseline_failing_tests", "final_failing_tests", "total_baseline_tokens",
             "total_compressed_tokens", "overall_compression_ratio", "total_requests", "total_tokens_saved", "total_cost_saved_usd")
_add("usage_reports", f"""WITH {_BOARD},
item AS (
  SELECT run_id, iteration, outcome || ', ' || CAST(baseline_tokens AS VARCHAR) || ' to ' || CAST(compressed_tokens AS VARCHAR)
    || ' tokens, proxy ' || CAST(tokens_saved AS VARCHAR) || ', ' || cost_saved_usd AS t FROM used),
list AS (
  SELECT run_id, string_agg('1. ' || t, chr(10) ORDER BY iteration) AS md, string_agg('<li>' || t || '</li>', '' ORDER BY iteration) AS li
  FROM item GROUP BY run_id),
titled AS (SELECT *, 'Run ' || CAST(run_id AS VARCHAR) || ': ' || CASE WHEN success THEN 'solved' ELSE 'open' END AS title FROM board)
SELECT b.run_id, concat_ws(chr(10), title, '', {", ".join(f"'- {c}: ' || CAST({c} AS VARCHAR)" for c in _REPORTED)}, '', md) AS markdown,
  '<section><h2>' || title || '</h2><dl>' || {" || ".join(f"'<dt>{c}</dt><dd>' || CAST({c} AS VARCHAR) || '</dd>'" for c in _REPORTED)}
    || '</dl><ol>' || coalesce(li, '') || '</ol></section>' AS html
FROM titled b LEFT JOIN list l ON b.run_id = l.run_id""", "v_results", "v_attempts", "v_usage")

# --- streams ----------------------------------------------------------------------

_add("failure_stream", """WITH e AS (SELECT ts, 'E' || CAST(event_id % 3 AS VARCHAR) AS kind FROM events WHERE event_type = 'error')
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, kind AS exception_type, count(*) AS failures
FROM e
GROUP BY date_trunc('hour', ts), kind""")

_add("failure_ledger", """WITH e AS (SELECT ts, 'E' || CAST(event_id % 3 AS VARCHAR) AS kind FROM events WHERE event_type = 'error'),
w AS (SELECT date_trunc('hour', ts) AS start, kind FROM e UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, kind FROM e)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, kind AS exception_type, count(*) AS failures
FROM w GROUP BY start, kind""")

_add("current_stream", """WITH held AS (
  SELECT repo, path, content FROM v_py WHERE path LIKE '%3.py'
  UNION ALL SELECT n.repo, n.path, n.content FROM v_next n WHERE n.path NOT LIKE '%3.py' OR n.path LIKE 'new/%')
SELECT repo, path, sha256(content) AS content_hash, CAST(len(string_split(content, chr(10))) AS INTEGER) AS line_count,
       CAST(content LIKE '%    def run(self, x):%' AS BIGINT) AS runs
FROM held""", "v_next")

_add("vector_index_update", f"""WITH {_CHUNKS},
old AS (
  SELECT repo, path, count(*) AS n, string_agg(DISTINCT qualified_name, '|' ORDER BY qualified_name) AS names,
         CAST(sum(len(regexp_extract_all(embedding_text, '[^\\s]+'))) AS BIGINT) AS terms
  FROM chunk WHERE path LIKE 'pkg%' GROUP BY repo, path),
held AS (
  SELECT o.*, n.repo IS NOT NULL AS there, n.content <> p.content AS edited
  FROM old o JOIN v_py p ON o.repo = p.repo AND o.path = p.path LEFT JOIN v_next n ON o.repo = n.repo AND o.path = n.path)
SELECT repo, path, CASE WHEN there THEN n ELSE 0 END AS live, CASE WHEN there THEN 0 ELSE n END AS removed,
       CASE WHEN there THEN CASE WHEN edited THEN 2 ELSE 1 END END AS written, CASE WHEN there THEN names ELSE '' END AS names,
       CASE WHEN there THEN terms + CASE WHEN edited THEN 4 ELSE 0 END ELSE 0 END AS terms
FROM held
UNION ALL
SELECT repo, 'shared/util.py', CASE WHEN repo LIKE '%1' THEN 1 ELSE 3 END, CASE WHEN repo LIKE '%1' THEN 3 ELSE 0 END,
       CASE WHEN repo LIKE '%1' THEN 2 ELSE 1 END, CASE WHEN repo LIKE '%1' THEN 'same' ELSE 'same|नमस्ते' END,
       CASE WHEN repo LIKE '%1' THEN 11 ELSE 29 END
FROM (SELECT DISTINCT repo FROM v_py) r""", "v_files", "v_next")

_add("graph_cycles", """WITH RECURSIVE way AS (
  SELECT repo, src AS root, dst AS node, [src] AS nodes FROM v_sparse WHERE dst >= src
  UNION ALL
  SELECT w.repo, w.root, e.dst, list_append(w.nodes, w.node) FROM way w JOIN v_sparse e ON e.repo = w.repo AND e.src = w.node
  WHERE w.node <> w.root AND e.dst >= w.root AND NOT list_contains(w.nodes[2:], e.dst) AND e.dst <> w.node)
SELECT repo, CAST(len(nodes) AS INTEGER) AS length, array_to_string(nodes, '>') AS cycle FROM way WHERE node = root
""", "v_sparse")

_add("report_summaries", """WITH r AS (
  SELECT run_id, iteration, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed,
         CAST(count(*) FILTER (outcome = 'failed') AS INTEGER) AS failed, CAST(count(*) FILTER (outcome = 'error') AS INTEGER) AS error
  FROM v_results GROUP BY run_id, iteration),
s AS (
  SELECT *, run_id % 5 = 0 AND iteration = 1 AS broken, run_id % 9 = 0 AS silent,
         CASE WHEN run_id % 9 = 0 THEN 0 ELSE failed + CASE WHEN run_id % 7 = 0 THEN 1 ELSE 0 END END AS f,
         CASE WHEN run_id % 9 = 0 THEN 0 ELSE error END AS e FROM r)
SELECT CAST(run_id AS VARCHAR) || '-' || CAST(iteration AS VARCHAR) AS run_id,
  CASE WHEN NOT broken THEN CASE WHEN silent THEN 0 ELSE total END END AS total_tests,
  CASE WHEN NOT broken THEN CASE WHEN silent THEN 0 ELSE passed END END AS passed,
  CASE WHEN NOT broken THEN f END AS failed, CASE WHEN NOT broken THEN e END AS errors, CASE WHEN NOT broken THEN 0 END AS skipped,
  CASE WHEN NOT broken THEN f + e > 0 END AS has_failures, CASE WHEN NOT broken THEN failed END AS listed_failed,
  CASE WHEN NOT broken THEN error END AS listed_errors, broken, CASE WHEN NOT broken THEN f = failed AND e = error END AS agrees
FROM s""", "v_results")

_add("capped_results", f"WITH {_LOOP.replace('iteration <= 5', 'iteration <= 2')} SELECT * FROM solved", "v_results", "v_attempts")

_add("search_texts", f"""WITH {_TRACES},
told AS (
  SELECT v.failure_id, x.exception_type || ': ' || x.message AS exception,
    CASE WHEN v.failure_id % 5 = 0 THEN '  ' WHEN v.failure_id % 5 <> 1 THEN 'it fails ' || CAST(v.failure_id AS VARCHAR) END AS description
  FROM v_traces v LEFT JOIN exc x USING (failure_id))
SELECT failure_id, concat_ws(' — ', exception, description) AS query FROM told
WHERE trim(concat_ws(' — ', exception, description)) <> ''""", "v_traces")

_add("compressor_choices", f"""SELECT d.doc_id, sha256(d.text) AS none, sha256(c.compressed) AS rule_based,
       sha256(regexp_replace(d.text, '[0-9]+', '#', 'g')) AS own
FROM documents d JOIN ({ORACLES["compressed_documents"]}) c ON d.doc_id = c.doc_id""")

_add("own_embedder_hits", """WITH v AS (
  SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS a, length(text) - length(replace(text, chr(10), '')) AS b,
         length(text) - length(replace(text, '.', '')) AS c FROM documents),
s AS (
  SELECT q.doc_id AS query_id, v.doc_id, CAST(1 - ((q.a - v.a) ** 2 + (q.b - v.b) ** 2 + (q.c - v.c) ** 2) AS DOUBLE) AS score
  FROM v q, v WHERE q.doc_id % 10 = 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) r WHERE rank <= 5""")

_add("flat_symbols", f"WITH {_SYM} SELECT repo, path, qualified_name, kind, start_line, end_line FROM sym", "v_files")

_add("scanned_files", """
SELECT 'site' || CAST(page_id % 7 AS VARCHAR) AS repo, 'c1' AS commit_sha,
       'html/d' || CAST(page_id % 13 AS VARCHAR) || '/p' || CAST(page_id AS VARCHAR) || '.py' AS path,
       strlen(html) AS length, 'python' AS language, sha256(html) AS content_hash
FROM pages WHERE strlen(html) <= 20000""")

# a, b: lines; p, s: equal lines at both ends; l: lengths of rising runs; run: the chosen one.
_add("snapshot_hunks", """WITH RECURSIVE f AS (
  SELECT o.repo || '/' || o.path AS f, o.repo, o.path, string_split(o.content, chr(10)) AS a, string_split(n.content, chr(10)) AS b
  FROM v_py o JOIN v_moved n ON o.repo = n.repo AND o.path = n.path WHERE o.content <> n.content),
p AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS p FROM f),
e AS (SELECT *, least(len(a), len(b)) - p AS rest FROM p),
s AS (SELECT *, coalesce(list_min(list_filter(range(1, rest + 1), lambda i: a[len(a) + 1 - i] <> b[len(b) + 1 - i])) - 1, rest) AS s FROM e),
la AS (SELECT f, i, a[i] AS t FROM (SELECT f, a, unnest(range(p + 1, len(a) - s + 1)) AS i FROM s) x),
lb AS (SELECT f, j, b[j] AS t FROM (SELECT f, b, unnest(range(p + 1, len(b) - s + 1)) AS j FROM s) x),
once AS (
  SELECT x.f, x.i, y.j FROM (SELECT f, t, min(i) AS i FROM la GROUP BY f, t HAVING count(*) = 1) x
  JOIN (SELECT f, t, min(j) AS j FROM lb GROUP BY f, t HAVING count(*) = 1) y ON x.f = y.f AND x.t = y.t),
grown AS (SELECT f, i, j, 1 AS n FROM once UNION SELECT o.f, o.i, o.j, g.n + 1 FROM grown g JOIN once o ON g.f = o.f AND o.i > g.i AND o.j > g.j),
l AS (SELECT f, i, j, max(n) AS n FROM grown GROUP BY f, i, j),
top AS (SELECT f, min(i) AS i, arg_min(j, i) AS j, n FROM l WHERE (f, n) IN (SELECT f, max(n) FROM l GROUP BY f) GROUP BY f, n),
run AS (
  SELECT f, i, j, n FROM top
  UNION ALL SELECT r.f, min(l.i), arg_min(l.j, l.i), r.n - 1 FROM run r JOIN l ON l.f = r.f AND l.n = r.n - 1 AND l.i < r.i AND l.j < r.j GROUP BY r.f, r.n),
cuts AS (
  SELECT f, i, j FROM run UNION ALL SELECT f, p, p FROM s UNION ALL SELECT f, len(a) - s + 1, len(b) - s + 1 FROM s),
gaps AS (
  SELECT f, lag(i) OVER w + 1 AS x, i - 1 AS xe, lag(j) OVER w + 1 AS y, j - 1 AS ye FROM cuts WINDOW w AS (PARTITION BY f ORDER BY i, j)),
g AS (
  SELECT g.*, s.repo, s.path, list_slice(a, x, xe) AS ga, list_slice(b, y, ye) AS gb FROM gaps g JOIN s ON g.f = s.f WHERE x <= xe OR y <= ye),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(ga), len(gb)) + 1), lambda i: ga[i] <> gb[i])) - 1, least(len(ga), len(gb))) AS hp FROM g),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(ga), len(gb)) - hp + 1), lambda i: ga[len(ga) + 1 - i] <> gb[len(gb) + 1 - i])) - 1,
                         least(len(ga), len(gb)) - hp) AS hs FROM h)
SELECT repo, path, CAST(row_number() OVER (PARTITION BY k.f ORDER BY x, y) AS INTEGER) AS hunk, CAST(x + hp AS INTEGER) AS old_start,
       CAST(len(ga) - hp - hs AS INTEGER) AS old_lines, CAST(y + hp AS INTEGER) AS new_start, CAST(len(gb) - hp - hs AS INTEGER) AS new_lines,
       CAST((SELECT count(*) FROM once o WHERE o.f = k.f AND o.i BETWEEN x + hp AND xe - hs
             AND NOT EXISTS (SELECT 1 FROM run r WHERE r.f = o.f AND r.i = o.i)) AS INTEGER) AS moved
FROM k WHERE len(ga) - hp - hs > 0 OR len(gb) - hp - hs > 0""", "v_moved")
