"""The registered queries as DuckDB SQL over the same tables, written independently of the
Spark code. Queries without an entry have no practical SQL; tests check them by brute force."""

from optrace import constants as K
from optrace.functions import names

B = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def _list(words) -> str:
    return "[" + ", ".join(_quote(w) for w in words) + "]"


DOC_FILES = """SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name,
  lang || '/' || source AS parent, lang, source, doc_id, text, strlen(text) AS size FROM documents"""
DOC_DIRS = """SELECT '' AS path, '/' AS name, NULL AS parent UNION SELECT lang, lang, '' FROM documents
  UNION SELECT lang || '/' || source, source, lang FROM documents"""
GEO = """geo_files AS (SELECT r_name || '/' || n_name || '/' || c_name AS path, c_name AS name, r_name || '/' || n_name AS parent,
    false AS is_dir, CASE WHEN c_custkey % 2 = 0 THEN 384 ELSE 420 END AS mode, lower(c_mktsegment) AS owner, 'staff' AS grp,
    1700000000.0::DOUBLE + c_custkey * 0.5::DOUBLE AS mtime, c_custkey * 37 AS size
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
geo_dirs AS (SELECT '' AS path, '/' AS name, NULL AS parent UNION SELECT r_name, r_name, '' FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION SELECT r_name || '/' || n_name, n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey),
geo AS (SELECT * FROM geo_files UNION ALL SELECT path, name, parent, true, 493, 'root', 'root', 1700000000.0, 0 FROM geo_dirs)"""
GEO_ASKED = f"""{GEO}, asked AS (SELECT path FROM geo UNION ALL SELECT path || '/none' FROM geo_dirs)"""
PLAIN_FLOAT = "CASE WHEN mtime = floor(mtime) THEN mtime::BIGINT || '.0' ELSE mtime::VARCHAR END"
GETATTR = f"""'{{"mode": ' || mode || ', "size": ' || size || ', "type": "' || CASE WHEN is_dir THEN 'directory' ELSE 'file' END
  || '", "mtime": ' || {PLAIN_FLOAT} || ', "owner": "' || owner || '", "group": "' || grp || '"}}'"""
def _listings(names: str) -> str:
    """Listings of names(parent, name) in parts of 1000 names."""
    return f"""SELECT parent, part, to_json(list_concat(CASE WHEN part = 0 THEN ['.', '..'] ELSE [] END, list_sort(list(name))))::VARCHAR AS listing
        FROM (SELECT parent, name, ((row_number() OVER (PARTITION BY parent ORDER BY name) - 1) // 1000)::INT AS part FROM {names} WHERE parent IS NOT NULL)
        GROUP BY parent, part"""


EVENTS = """ev AS (SELECT user_id::VARCHAR AS session, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'write' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'create' WHEN 'signup' THEN 'chmod' ELSE 'unlink' END AS operation,
    (props->>'$.k')::INT AS k, 'd' || ((props->>'$.k')::INT // 10) || '/f' || (props->>'$.k') AS path, ts, trunc(value)::BIGINT AS len FROM events),
evm AS (SELECT *, CASE WHEN k % 2 = 0 THEN 416 ELSE 384 END AS pmode FROM ev)"""
# State of every (session, path) seen by each operation: is it there, since when, how large.
FILE_STATE = f"""{EVENTS},
live AS (SELECT *, last_value(CASE WHEN operation IN ('create', 'unlink') THEN operation END IGNORE NULLS)
    OVER (PARTITION BY session, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM evm),
judged AS (SELECT *, coalesce(prior = 'create', k % 2 = 0) AS there FROM live),
good AS (SELECT *, operation = 'create' OR there AS ok FROM judged WHERE operation <> 'read')"""


REPLAYED = f"""{FILE_STATE},
users AS (SELECT DISTINCT user_id::VARCHAR AS session FROM events),
paths AS (SELECT session, k, 'd' || (k // 10) || '/f' || k AS path FROM users, (SELECT unnest(range(100)) AS k)),
lives AS (SELECT session, path, max(seq) FILTER (operation = 'unlink') AS gone, max(seq) FILTER (operation = 'create') AS made FROM good WHERE ok AND {{cut}} GROUP BY ALL),
alive AS (SELECT p.session, p.path, p.k, coalesce(l.gone, -1) AS gone, l.made,
    l.gone IS NULL AND p.k % 2 = 0 AS from_start FROM paths p LEFT JOIN lives l USING (session, path)
  WHERE CASE WHEN l.gone IS NULL AND l.made IS NULL THEN p.k % 2 = 0 WHEN l.gone IS NULL THEN true ELSE l.made > l.gone END),
facts AS (SELECT a.session, a.path, a.k, a.from_start, a.made,
    arg_min(g.pmode, g.seq) FILTER (g.operation = 'create' AND g.seq > a.gone) AS born_mode,
    arg_max(g.pmode, g.seq) FILTER (g.operation = 'chmod' AND g.seq > a.gone) AS new_mode,
    max(g.len) FILTER (g.operation = 'write' AND g.seq > coalesce(a.made, -1)) AS written,
    arg_max(epoch_us(g.ts), g.seq) FILTER (g.operation IN ('write', 'create') AND g.seq > a.gone) AS touched
  FROM alive a LEFT JOIN (SELECT * FROM good WHERE ok AND {{cut}}) g USING (session, path) GROUP BY ALL),
files AS (SELECT session AS snapshot_id, path, false AS is_dir, coalesce(new_mode, CASE WHEN from_start THEN 420 ELSE born_mode END)::INT AS mode,
    'root' AS owner, 'root' AS "group", round(coalesce(touched / 1e6, 1700000000.0), 3) AS mtime,
    greatest(CASE WHEN made IS NULL THEN k ELSE 0 END, coalesce(written, 0))::BIGINT AS size FROM facts),
dirs AS (SELECT session AS snapshot_id, unnest(['', 'd0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7', 'd8', 'd9']) AS path, true AS is_dir,
    493::INT AS mode, 'root' AS owner, 'root' AS "group", 1700000000.0::DOUBLE AS mtime, 0::BIGINT AS size FROM users)"""
STATE_SQL = f"WITH {REPLAYED.format(cut='true')} SELECT * FROM files UNION ALL SELECT * FROM dirs"

ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
# Fragments of the documents per language; chr(1) sorts before every name character.
XML = f"""files AS (SELECT lang AS snapshot_id, source || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name, * FROM documents),
frags AS (
  SELECT snapshot_id, 1 AS place, chr(1) || source || chr(1) || name AS order_key, path, 'file' AS kind,
    '<file path="' || path || '" name="' || name || '" mode="644" owner="' || lang || '" group="' || source
    || '" mtime="2025-01-01T00:00:01" size="' || strlen(text) || '"' || CASE WHEN strlen(text) <= 4000 OR {{focus}} THEN
      CASE WHEN text = '' THEN '><body /></file>' ELSE '><body>' || {ESC.format(x='text')} || '</body></file>' END ELSE ' />' END AS text FROM files
  UNION ALL SELECT DISTINCT lang, 1, chr(1) || source, source, 'open', '<directory path="' || source || '" name="' || source || '" mode="755" owner="root" group="root" mtime="2025-01-01T00:00:00">' FROM documents
  UNION ALL SELECT DISTINCT lang, 1, chr(1) || source || chr(2), source, 'close', '</directory>' FROM documents
  UNION ALL SELECT DISTINCT lang, 1, '', '', 'open', '<directory path="/" name="/" mode="755" owner="root" group="root" mtime="2025-01-01T00:00:00">' FROM documents
  UNION ALL SELECT DISTINCT lang, 1, chr(2), '', 'close', '</directory>' FROM documents
  UNION ALL SELECT DISTINCT lang, 0, NULL, NULL, 'start', '<filesystem>' FROM documents
  UNION ALL SELECT DISTINCT lang, 2, NULL, NULL, 'end', '</filesystem>' FROM documents)"""

CHAT = """cp AS (SELECT u.conv_id || '-' || u.turn AS example_id,
  CASE (u.conv_id + u.turn // 2) % 4 WHEN 0 THEN '<R>' || chr(10) || 'readdir(''/conv/' || u.conv_id || ''')' || chr(10) || '---' || chr(10) || u.text
    WHEN 1 THEN '<R>' || chr(10) || 'read(''/conv/' || u.conv_id || ''')' || chr(10) || '---' || chr(10) || u.text
    WHEN 2 THEN '<W>' || chr(10) || 'write(''/conv/' || u.conv_id || ''')' || chr(10) || '---' || chr(10) || u.text
    ELSE 'Current filesystem state:' || chr(10) || u.text || chr(10) || 'Operation: ' || CASE WHEN u.turn % 2 = 0 THEN 'flush(''/a'')' ELSE 'getattr(''/a'')' END || chr(10) || 'Result:' END AS prompt,
  (u.conv_id + u.turn // 2) % 4 AS layout, u.conv_id, u.turn, u.text AS asked, a.text AS completion
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
LINE = "CASE layout WHEN 0 THEN 'readdir(''/conv/' || conv_id || ''')' WHEN 1 THEN 'read(''/conv/' || conv_id || ''')' WHEN 2 THEN 'write(''/conv/' || conv_id || ''')' ELSE 'Current filesystem state:' END"


# Every version of every file that an operation touched, its state after that operation (NULL once
# it is gone), and what there was at the start (seq -1).
VERSIONS = f"""{FILE_STATE},
users AS (SELECT DISTINCT user_id::VARCHAR AS session FROM events),
begun AS (SELECT session, 'd' || (k // 10) || '/f' || k AS path, k, -1 AS seq, 'start' AS operation, true AS there, NULL::BIGINT AS len, NULL::INT AS pmode
    FROM users, (SELECT unnest(range(0, 100, 2))::INT AS k)),
steps AS (SELECT session, path, k, seq, operation, there, len, pmode FROM good WHERE ok UNION ALL SELECT * FROM begun),
segments AS (SELECT *, count(*) FILTER (operation = 'start' OR (operation = 'create' AND NOT there)) OVER w AS life,
    count(*) FILTER (operation IN ('start', 'create')) OVER w AS base FROM steps WINDOW w AS (PARTITION BY session, path ORDER BY seq)),
running AS (SELECT *,
    last_value(CASE WHEN operation = 'start' THEN 420 WHEN operation = 'chmod' OR (operation = 'create' AND NOT there) THEN pmode END IGNORE NULLS)
        OVER (PARTITION BY session, path, life ORDER BY seq) AS now_mode,
    greatest(first_value(CASE WHEN operation = 'start' THEN k ELSE 0 END) OVER b, coalesce(max(CASE WHEN operation = 'write' THEN len END) OVER b, 0)) AS now_size,
    first_value(operation) OVER b = 'create' AND count(*) FILTER (operation = 'write') OVER b = 0 AS blank
    FROM segments WINDOW b AS (PARTITION BY session, path, base ORDER BY seq)),
versions AS (SELECT session, path, k, seq, operation, operation <> 'unlink' AS alive, CASE WHEN operation <> 'unlink' THEN now_mode END AS mode,
    CASE WHEN operation <> 'unlink' THEN now_size END AS size, blank FROM running)"""
# The last operation of a session, and the files before and after it.
AROUND = f"""{VERSIONS},
chosen AS (SELECT session, max(seq) AS last_seq FROM ev GROUP BY 1),
placed AS (SELECT v.*, side FROM versions v JOIN chosen USING (session), (SELECT unnest(['before', 'after']) AS side)
    WHERE (side = 'before' AND seq < last_seq) OR (side = 'after' AND seq <= last_seq)),
sides AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY session, side, path ORDER BY seq DESC) = 1)"""
# Documents before and after the last operation, and the examples of the sessions whose last operation succeeded.
EXAMPLES = f"""{AROUND},
folders AS (SELECT u.session, s.side, d, count(v.path) AS n FROM users u, (SELECT unnest(['before', 'after']) AS side) s, (SELECT unnest(range(10))::INT AS d)
    LEFT JOIN sides v ON v.session = u.session AND v.side = s.side AND v.alive AND v.k // 10 = d GROUP BY ALL),
pieces AS (
  SELECT session, side, chr(1) || 'd' || (k // 10) || chr(1) || 'f' || k AS place, '<file path="' || path || '" name="f' || k || '" mode="' || printf('%o', mode)
    || '" owner="root" group="root" mtime="2025-01-01T00:00:01" size="' || size || '"' || CASE WHEN blank AND size <= 4000 THEN '><body /></file>' ELSE ' />' END AS t
  FROM sides WHERE alive
  UNION ALL SELECT session, side, chr(1) || 'd' || d, '<directory path="d' || d || '" name="d' || d || '" mode="755" owner="root" group="root" mtime="2025-01-01T00:00:00"'
    || CASE WHEN n > 0 THEN '>' ELSE ' />' END FROM folders
  UNION ALL SELECT session, side, chr(1) || 'd' || d || chr(2), '</directory>' FROM folders WHERE n > 0),
documents_of AS (SELECT session, side, '<filesystem><directory path="/" name="/" mode="755" owner="root" group="root" mtime="2025-01-01T00:00:00">'
    || string_agg(t, '' ORDER BY place) || '</directory></filesystem>' AS document FROM pieces GROUP BY 1, 2),
halves AS (SELECT session, max(document) FILTER (side = 'before') AS was, max(document) FILTER (side = 'after') AS became FROM documents_of GROUP BY 1),
done AS (SELECT j.*, s.alive AND s.blank AS blank FROM judged j JOIN chosen c ON j.session = c.session AND j.seq = c.last_seq
    LEFT JOIN sides s ON s.session = j.session AND s.path = j.path AND s.side = 'after' WHERE j.operation = 'create' OR j.there),
examples AS (SELECT session, CASE WHEN operation = 'read' THEN became ELSE was END AS initial_state,
    operation || '(''/' || path || '''' || CASE operation WHEN 'write' THEN ', data_length=' || len || ', offset=0'
      WHEN 'create' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END WHEN 'chmod' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END ELSE '' END || ')' AS operation,
    CASE WHEN operation <> 'read' THEN became WHEN blank THEN '' ELSE 'ERROR: Cannot read file ' || path END AS result,
    CASE WHEN operation = 'read' THEN 'query' ELSE 'state_change' END AS operation_type FROM done JOIN halves USING (session))"""


def _contract(state: str) -> str:
    return (f"{_quote(K.CONTRACT_HEADER)} || CASE layout WHEN 0 THEN {_quote(K.CONTRACT_LISTING)} WHEN 1 THEN {_quote(K.CONTRACT_READ)} "
            f"ELSE {_quote(state)} END || chr(10) || chr(10) || prompt")


def _hash60(expr: str) -> str:
    return f"('0x' || substr(sha256({expr}), 1, 15))::BIGINT"


def _u(expr: str) -> str:
    return f"({_hash60(expr)} / 1152921504606846976.0::DOUBLE)"


def _draw(digest: str, i: int) -> str:
    return f"('0x' || substr({digest}, {1 + 6 * i}, 6))::BIGINT"


def _word(words, digest: str, i: int) -> str:
    return f"{_list(words)}[({_draw(digest, i)} % {len(words)} + 1)::INT]"


class _Sql(str):
    """An expression among texts."""


def _joined(parts) -> str:
    return " || ".join(x if isinstance(x, _Sql) else _quote(x) for x in parts)


def _filename(digest: str) -> str:
    return (f"({_word(K.FILE_PREFIXES, digest, 2)} || CASE WHEN {_draw(digest, 0)} / 16777216.0::DOUBLE < 0.3 THEN '_' || {_word(K.FILE_MIDDLES, digest, 1)} ELSE '' END"
            f" || ({_draw(digest, 3)} % 999 + 1) || '.' || {_word(K.FILE_SUFFIXES, digest, 4)})")


def _dirname(digest: str) -> str:
    return (f"({_word(K.DIR_NAMES, digest, 4)} || CASE WHEN {_draw(digest, 0)} / 16777216.0::DOUBLE < 0.2 THEN '_' || {_word(K.DIR_SUFFIXES, digest, 1)} ELSE '' END"
            f" || CASE WHEN {_draw(digest, 2)} / 16777216.0::DOUBLE < 0.5 THEN ({_draw(digest, 3)} % 99 + 1)::VARCHAR ELSE '' END)")


def _cases(kind: str, texts: list[list]) -> str:
    return f"CASE {kind} % {len(texts)} " + " ".join(f"WHEN {i} THEN {_joined(parts)}" for i, parts in enumerate(texts)) + " END"


def _contents(source: str, out: str, path: str = "path") -> str:
    """Tables up to out: source with the content made for its paths. Templates are shared with the
    operator; draws, kinds and cuts are worked out here."""
    words = {"noun": K.NOUNS, "adjective": K.ADJECTIVES, "verb": K.VERBS, "fn": K.FUNCTION_NAMES, "var": K.VARIABLE_NAMES, "flag": ["true", "false"]}
    drawn = ", ".join(f"{_word(w, 'cd', i)} AS c_{n}" for i, (n, w) in enumerate(words.items()))
    line = "sha256(cd || '|' || i)"
    two = lambda low, high, i: f"lpad(({_draw(line, i)} % {high - low + 1} + {low})::VARCHAR, 2, '0')"
    log_line = " || ".join([
        "'2024-'", two(1, 12, 1), "'-'", two(1, 28, 2), "'T'", two(0, 23, 3), "':'", two(0, 59, 4), "'Z '", _word(K.LOG_LEVELS, line, 0), "' '", _word(K.NOUNS, line, 5),
        "'/'", f"({_draw(line, 7)} % 40 + 1)", "': could '", _word(K.VERBS, line, 6), "' after '", f"({_draw(line, 8)} % 899 + 2)", "' ms'",
    ])
    log = f"array_to_string(list_transform(range(1, ({_draw('cd', 8)} % 9 + 6)::BIGINT + 1), lambda i: {log_line}), chr(10))"
    noun, adjective, verb, fn, var, flag = (_Sql(f"c_{n}") for n in words)
    title, a, b, digits = _Sql("(upper(left(c_fn, 1)) || lower(substr(c_fn, 2)))"), _Sql("c_a"), _Sql("c_b"), [_Sql("substr(c_b, 1, 1)"), _Sql("substr(c_b, 2, 1)")]
    code = _cases("c_kind", names.code_texts(fn, title, var, verb, noun, a, b))
    structured = _cases("c_kind", names.structured_texts(var, noun, adjective, flag, a, b, digits))
    prose = _cases("c_kind", names.prose_texts(_Sql(log), noun, adjective, verb, fn, flag))
    return f"""{out}_d AS (SELECT *, sha256({path}) AS cd, lower(regexp_extract(string_split({path}, '/')[-1], '^\\.*[^.].*\\.([^.]*)$', 1)) AS c_ext FROM {source}),
    {out}_v AS (SELECT *, {drawn}, ({_draw('cd', 6)} % 100 + 1)::VARCHAR AS c_a, ({_draw('cd', 7)} % 9000 + 1000)::VARCHAR AS c_b, {_draw('cd', 9)} AS c_kind FROM {out}_d),
    {out}_w AS (SELECT *, CASE WHEN {path} IS NULL THEN NULL WHEN c_ext IN ({_list(K.CODE_EXTENSIONS)[1:-1]}) THEN {code}
        WHEN c_ext IN ({_list(K.STRUCTURED_EXTENSIONS)[1:-1]}) THEN {structured} ELSE {prose} END AS c_whole FROM {out}_v),
    {out}_h AS (SELECT *, left(c_whole, 500) AS c_head FROM {out}_w),
    {out}_n AS (SELECT *, CASE WHEN contains(c_head, chr(10)) THEN length(c_head) - strpos(reverse(c_head), chr(10)) ELSE -1 END AS c_line FROM {out}_h),
    {out} AS (SELECT * EXCLUDE (cd, c_ext, c_noun, c_adjective, c_verb, c_fn, c_var, c_flag, c_a, c_b, c_kind, c_whole, c_head, c_line),
        CASE WHEN length(c_whole) <= 500 THEN c_whole WHEN c_line > 350 THEN left(c_head, c_line) ELSE c_head END AS content FROM {out}_n)"""


def _op(name: str, path: str, parameters: str = "{}") -> str:
    return f"{{'operation': '{name}', 'path': {path}, 'parameters': '{parameters}'}}"


MODE, FILE_MODE = '{"mode":"0o755"}', '{"mode":"0o100644"}'


def _wrote(path: str, content: str = "content") -> str:
    """The two operations that write a new file."""
    data = f"""'{{"data":' || to_json({content}) || ',"data_length":"' || strlen({content}) || '","offset":"0"}}'"""
    return f"[{_op('create', path, FILE_MODE)}, {{'operation': 'write', 'path': {path}, 'parameters': {data}}}]"


#: Numbers the operations of the lists ops of a table.
LISTED = """SELECT session, first + pos - 1 AS seq, ops[pos].operation AS operation, '/' || ops[pos].path AS path, ops[pos].parameters AS parameters
        FROM (SELECT *, unnest(range(1, len(ops) + 1)) AS pos FROM {})"""

SPARSE = f"""sp AS (SELECT doc_id::VARCHAR AS session, {_hash60("'7|sparse|' || doc_id")} % 5 AS choice, {_hash60("'7|size|' || doc_id")} % 65 AS size,
        {_filename("sha256('7|file|' || doc_id)")} AS path, {_dirname("sha256('7|dir|' || doc_id)")} AS dir FROM documents),
    {_contents('sp', 'spc')},
    spo AS (SELECT session, 0 AS first, CASE choice WHEN 0 THEN [{_op('mkdir', 'dir', MODE)}] WHEN 1 THEN [{_op('create', 'path', FILE_MODE)}] WHEN 2 THEN {_wrote('path')}
        WHEN 3 THEN [{_op('create', 'path', FILE_MODE)}, {{'operation': 'truncate', 'path': path, 'parameters': '{{"length":"' || size || '"}}'}}] ELSE [{_op('readdir', "''")}] END AS ops FROM spc)"""

COVER = _dirname("sha256('7|empty|' || lang)")

def _weighted(weights: dict, u: str) -> str:
    total, running, cases = float(sum(weights.values())), 0.0, []
    for key, weight in weights.items():
        running += weight
        cases.append(f"WHEN {u} < {running / total!r}::DOUBLE THEN {key if isinstance(key, int) else _quote(key)}")
    return f"CASE {' '.join(cases[:-1])} ELSE {cases[-1].split(' THEN ')[1]} END"


MADE = "STRUCT(path VARCHAR, is_dir BOOLEAN)[]"


def _drawn(kind: str, key: str) -> str:
    return f"sha256('7|{kind}|' || {key})"


HAS, ON_FILE, ON_DIR = "a IS NOT NULL", "coalesce(NOT a.is_dir, false)", "coalesce(a.is_dir, false)"
CHAIN = "list_transform(range(1, CASE WHEN nested THEN depth ELSE 1 END + 1), lambda j: array_to_string(dirs[1:j], '/'))"
NEW = f"CASE WHEN {ON_FILE} THEN file ELSE dirs[1] END"
TOUCHED = f"CASE WHEN {ON_DIR} AND below THEN a.path || '/' || file ELSE file END"


def _operands(k: str) -> str:
    """What an operation may draw on besides the candidates a (any), f (a file) and p (a parent)."""
    dirs = ", ".join(_dirname(_drawn(f"dir{j}", k)) for j in range(5))
    return f"""{_weighted(K.OP_WEIGHTS, _u(f"'7|' || {k}"))} AS kind, {_filename(_drawn('file', k))} AS file, [{dirs}] AS dirs, {_u(f"'7|nested|' || {k}")} < 0.3 AS nested,
        ({_hash60(f"'7|depth|' || {k}")} % 4 + 2)::INT AS depth, {_u(f"'7|below|' || {k}")} < 0.3 AS below, {_hash60(f"'7|length|' || {k}")} % 101 AS size,
        {_list(K.CHMOD_MODES)}[({_hash60(f"'7|mode|' || {k}")} % {len(K.CHMOD_MODES)} + 1)::INT] AS mode"""


def _operations() -> str:
    """The operations of one kind, from the candidates and operands."""
    has, on_file, on_dir, chain, new, touched = HAS, ON_FILE, ON_DIR, CHAIN, NEW, TOUCHED
    create, owner = f"[{_op('create', 'file', FILE_MODE)}]", '{"uid":"1000","gid":"1000"}'
    op = lambda name, path, parameters: f"{{'operation': '{name}', 'path': {path}, 'parameters': {parameters}}}"
    mkdir = f"list_transform({chain}, lambda one: {_op('mkdir', 'one', MODE)})"
    mkdir0 = f"[{_op('mkdir', 'dirs[1]', MODE)}]"
    return f"""CASE WHEN kind = 'mkdir' THEN {mkdir} WHEN kind = 'touch' THEN [{_op('create', touched, FILE_MODE)}]
        WHEN kind = 'rm' THEN CASE WHEN {on_file} THEN [{_op('unlink', 'a.path')}] ELSE list_concat({create}, [{_op('unlink', 'file')}]) END
        WHEN kind = 'rmdir' THEN CASE WHEN {on_dir} AND bare THEN [{_op('rmdir', 'a.path')}] ELSE list_concat({mkdir0}, [{_op('rmdir', 'dirs[1]')}]) END
        WHEN kind = 'chmod' THEN CASE WHEN {has} THEN [{op('chmod', 'a.path', "'{" + '"mode":"0o100' + "' || mode || '" + '"}' + "'")}] ELSE list_concat({create}, [{_op('chmod', 'file', FILE_MODE)}]) END
        WHEN kind = 'chown' THEN CASE WHEN {has} THEN [{_op('chown', 'a.path', owner)}] ELSE list_concat({create}, [{_op('chown', 'file', owner)}]) END
        WHEN kind = 'truncate' THEN CASE WHEN {on_file} THEN [{op('truncate', 'a.path', "'{" + '"length":"' + "' || size || '" + '"}' + "'")}] ELSE {mkdir0} END
        WHEN kind = 'rename' THEN CASE WHEN {has} THEN [{op('rename', 'a.path', "'{" + '"new_path":"/' + "' || " + new + " || '" + '"}' + "'")}] ELSE {create} END
        WHEN kind = 'symlink' THEN CASE WHEN {has} THEN [{op('symlink', 'a.path', "'{" + '"target":"/link_to_' + "' || file || '" + '"}' + "'")}] ELSE {mkdir0} END
        WHEN kind = 'ls' THEN [{_op('readdir', "coalesce(p.path, '')")}] WHEN kind = 'stat' THEN [{_op('getattr', "coalesce(a.path, '')")}]
        WHEN kind = 'write' THEN {_wrote('written')} WHEN f IS NOT NULL THEN [{_op('read', 'f.path')}] ELSE [] END"""


def _round(i: int) -> str:
    """Tables of the i-th operation of a setup history: drawn from what the earlier ones made, and what
    there is after it, each kind of operation worked out on its own."""
    k = f"(session || '#{i}')"
    ops = _operations()
    place = lambda of, kind: f"{of}[({_hash60(f"'7|{kind}|' || {k}")} % greatest(len({of}), 1) + 1)::INT]"
    below = "len(list_filter(made, lambda y: starts_with(y.path, {} || '/'))) > 0"
    chain = CHAIN
    has, on_file, on_dir = HAS, ON_FILE, ON_DIR
    new, touched = NEW, TOUCHED
    known = "list_transform(made, lambda y: y.path)"
    file_too = lambda path: f"CASE WHEN list_contains({known}, {path}) THEN made ELSE list_append(made, {{'path': {path}, 'is_dir': false}}) END"
    dirs_too = lambda paths: f"list_concat(made, list_transform(list_filter({paths}, lambda q: NOT list_contains({known}, q)), lambda q: {{'path': q, 'is_dir': true}}))"
    without = lambda path: f"list_filter(made, lambda y: y.path <> {path})"
    moved = f"""list_transform({without(new)}, lambda y: {{'path': CASE WHEN y.path = a.path THEN {new} WHEN starts_with(y.path, a.path || '/') THEN {new} || substr(y.path, length(a.path) + 1)
        ELSE y.path END, 'is_dir': y.is_dir}})"""
    left = f"""CASE WHEN n < {i} THEN made WHEN kind = 'mkdir' THEN {dirs_too(chain)} WHEN kind = 'touch' THEN {file_too(touched)}
        WHEN kind = 'rm' THEN {without(f'CASE WHEN {on_file} THEN a.path ELSE file END')} WHEN kind = 'rmdir' THEN {without(f'CASE WHEN {on_dir} AND bare THEN a.path ELSE dirs[1] END')}
        WHEN kind IN ('chmod', 'chown') AND NOT {has} THEN {file_too('file')} WHEN kind = 'truncate' AND NOT {on_file} THEN {dirs_too('dirs[1:1]')}
        WHEN kind = 'rename' AND NOT {has} THEN {file_too('file')} WHEN kind = 'rename' AND a.path <> {new} THEN {moved}
        WHEN kind = 'symlink' AND NOT {has} THEN {dirs_too('dirs[1:1]')} WHEN kind = 'write' THEN {file_too('written')} ELSE made END"""
    return f"""x{i} AS (SELECT session, n, made, list_filter(made, lambda x: NOT x.is_dir) AS made_files,
        list_filter(made, lambda x: x.is_dir AND {below.format('x.path')}) AS made_parents FROM s{i - 1}),
    y{i} AS (SELECT session, n, made, {place('made', 'made')} AS a, {place('made_files', 'made file')} AS f, {place('made_parents', 'made parent')} AS p,
        {_operands(k)} FROM x{i}),
    z{i} AS (SELECT *, NOT ({below.format('a.path')}) AS bare, CASE WHEN {on_file} THEN a.path ELSE file END AS written FROM y{i}),
    {_contents(f'z{i}', f'w{i}', 'written')},
    s{i} AS (SELECT session, n, {10 * i} AS first, CASE WHEN n < {i} THEN [] ELSE {ops} END AS ops, CAST({left} AS {MADE}) AS made FROM w{i})"""


SETUP = f"""s0 AS (SELECT doc_id::VARCHAR AS session, {_weighted(K.SETUP_COUNT_WEIGHTS, _u("'7|setup count|' || doc_id"))} AS n, CAST([] AS {MADE}) AS made FROM documents),
    {', '.join(_round(i) for i in (1, 2, 3))},
    e0 AS (SELECT doc_id::VARCHAR AS session, 100 AS first, {_filename("sha256('7|extra|' || doc_id)")} AS path FROM documents WHERE {_u("'7|extra file|' || doc_id")} < {K.EXTRA_FILE_SHARE}),
    {_contents('e0', 'e1')}, e AS (SELECT session, first, {_wrote('path')} AS ops FROM e1)"""

def _target(kind: str) -> str:
    return f"sha256('7|{kind}|' || session || '|' || path)"


PICKED = f"""pe AS (SELECT session, 'd' || d AS path, true AS is_dir, 0 AS bytes FROM (SELECT DISTINCT user_id::VARCHAR AS session FROM events), (SELECT unnest(range(10)) AS d)
      UNION ALL SELECT DISTINCT user_id::VARCHAR, '', true, 0 FROM events
      UNION ALL SELECT session, 'd' || (n // 10) || '/f' || n, false, n FROM (SELECT DISTINCT user_id::VARCHAR AS session FROM events), (SELECT unnest(range(0, 100, 2)) AS n)),
    pk AS (SELECT session, arg_min({{'path': path, 'is_dir': is_dir}}, {_target('any')}) FILTER (path <> '') AS a, arg_min({{'path': path, 'is_dir': is_dir}}, {_target('file')}) FILTER (NOT is_dir) AS f,
      arg_min({{'path': path, 'is_dir': is_dir}}, {_target('parent_dir')}) FILTER (is_dir) AS p, arg_min({{'path': path, 'bytes': bytes}}, {_target('file16')}) FILTER (NOT is_dir AND bytes >= 16) AS f16,
      false AS bare FROM pe GROUP BY session),
    py AS (SELECT *, {_operands('session')}, {_list(K.TARGETED_SCENARIOS)}[({_hash60("'7|scenario|' || session")} % {len(K.TARGETED_SCENARIOS)} + 1)::INT] AS scenario,
      {_hash60("'7|new size|' || session")} % {2**40 + 1} AS new_size FROM pk)"""

RANDOM = f"""{PICKED}, pz AS (SELECT *, CASE WHEN {ON_FILE} THEN a.path ELSE file END AS written FROM py),
    {_contents('pz', 'pw', 'written')}, po AS (SELECT session, 0 AS first, {_operations()} AS ops FROM pw)"""

TARGETED = f"""{PICKED}, pz AS (SELECT *, CASE WHEN scenario IN ('write_then_read', 'write_text_log') THEN file WHEN {ON_FILE} THEN a.path ELSE file END AS written FROM py),
    ps AS (SELECT *, CASE WHEN scenario = 'overwrite_existing' AND f IS NOT NULL THEN f.path || ':overwrite' ELSE written END AS seeded FROM pz),
    {_contents('ps', 'pw', 'seeded')},
    po AS (SELECT session, 0 AS first, CASE WHEN scenario = 'nested_mkdir' THEN list_transform(range(1, 4), lambda j: {_op('mkdir', "array_to_string(dirs[1:j], '/')", MODE)})
        WHEN scenario = 'truncate_existing' AND f16 IS NOT NULL THEN [{{'operation': 'truncate', 'path': f16.path, 'parameters': '{{"length":"' || (new_size % greatest(f16.bytes, 2)) || '"}}'}}]
        WHEN scenario = 'overwrite_existing' AND f IS NOT NULL THEN {_wrote('f.path')} WHEN scenario = 'unlink_existing' AND f IS NOT NULL THEN [{_op('unlink', 'f.path')}]
        WHEN scenario = 'symlink_existing' AND f IS NOT NULL THEN [{{'operation': 'symlink', 'path': f.path, 'parameters': '{{"target":"/' || f.path || '_link"}}'}}]
        WHEN scenario = 'write_text_log' THEN {_wrote('file', _quote(K.LOG_TEXT))} WHEN scenario = 'write_then_read' THEN list_concat({_wrote('file')}, [{_op('read', 'file')}])
        ELSE {_operations()} END AS ops FROM pw)"""

SPLIT_KEY = _hash60("'42|' || example_id")

TOKENS = f"""words AS (SELECT doc_id, lang, text, CASE WHEN {_strip('text')} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({_strip('text')}, '{B}+') END AS w FROM documents),
tok AS (SELECT doc_id, lang, i, w[i] AS token, CASE WHEN i = 1 THEN '<START>' ELSE w[i - 1] END AS context FROM (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM words))"""


def _cost(group: str) -> str:
    by = f"{group}, " if group else ""
    using = f"({by}context, token)"
    return (f"m{group} AS (SELECT {by}context, token, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY {by}context) AS p FROM tok GROUP BY {by}context, token), "
            f"c{group} AS (SELECT doc_id, count(*) AS num_tokens, sum(CASE WHEN p = 1 THEN 0.0 ELSE -log2(p) END) AS bits FROM tok JOIN m{group} USING {using} GROUP BY doc_id)")


BYTES = "ceil(coalesce(round({c}.bits, 9), 0) / 8)::BIGINT"

PRED = """pred AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS example_id, 'q' || quality AS operation_type, text AS expected, doc_id,
  CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN left(text, length(text) // 2) WHEN 3 THEN text
    ELSE translate(left(text, length(text) // 2), 'aeinrst', 'AEINRST') || ' #' END AS bare FROM documents JOIN labels USING (doc_id))"""


def _clamped(bare: str, expected: str) -> str:
    p, e = _strip(bare), _strip(expected)
    return f"CASE WHEN {e} = '' THEN '' WHEN contains({p}, {e}) THEN {e} ELSE {p} END"


STATES = """st AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS example_id, lang AS operation_type, doc_id, translate(text, '<>&', '   ') AS body FROM documents),
st2 AS (SELECT *, '<filesystem><file path="d' || doc_id || '"><body>' || body || '</body></file></filesystem>' AS state FROM st),
states AS (SELECT example_id, operation_type, state || chr(10) || '<END_FS>' AS expected, state AS target,
  CASE doc_id % 4 WHEN 0 THEN state WHEN 1 THEN state WHEN 2 THEN left(state, length(state) - 20) ELSE 'no state, ' || translate(body, 'aeinrst', 'AEINRST') END AS bare FROM st2)"""
LISTINGS = """ls AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS example_id, lang AS operation_type, doc_id, '"a' || doc_id || '"' AS a, '"b ' || source || '"' AS b, '"c' || lang || '"' AS c FROM documents),
listings AS (SELECT example_id, operation_type, '[' || a || ',' || b || ',' || c || ']' AS expected,
  CASE doc_id % 4 WHEN 3 THEN 'nothing' WHEN 2 THEN '[' || a || ', ' || a || ', ' || b || ', ' || c || ']' ELSE '[' || a || ',' || b || ',' || c || ']' END AS predicted FROM ls)"""


def _fold(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{B}+', ' ', 'g')"


SIM = """CASE WHEN coalesce(predicted, '') = '' AND coalesce(target, '') = '' THEN 1.0 WHEN coalesce(predicted, '') = '' OR coalesce(target, '') = '' THEN 0.0
  WHEN fp = fe THEN 1.0 ELSE len(list_intersect(pc, ec))::DOUBLE / (len(pc) + len(ec) - len(list_intersect(pc, ec))) END"""
SCORED = f"""{PRED}, {STATES}, {LISTINGS},
raw AS (SELECT example_id, operation_type, expected, expected AS target, {_clamped('bare', 'expected')} AS predicted FROM pred
  UNION ALL SELECT example_id, operation_type, expected, regexp_replace(target, '{B}+$', ''), {_clamped('bare', 'target')} FROM states
  UNION ALL SELECT example_id, operation_type, expected, expected, predicted FROM listings),
folded AS (SELECT *, {_fold('predicted')} AS fp, {_fold('target')} AS fe FROM raw),
sets AS (SELECT *, list_distinct(string_split(lower(fp), '')) AS pc, list_distinct(string_split(lower(fe), '')) AS ec FROM folded),
scored AS (SELECT *, {SIM} AS similarity, {_strip('predicted')} = {_strip('target')} AS exact FROM sets)"""

ORACLES = {
    "list_directories": f"""WITH e AS (SELECT name, parent FROM ({DOC_FILES}) UNION ALL SELECT name, parent FROM ({DOC_DIRS}))
        SELECT parent AS path, part, listing FROM ({_listings('e')})""",
    "wide_listing_parts": f"""WITH {GEO}, n AS (SELECT parent AS path, name FROM geo WHERE parent IS NOT NULL UNION ALL
        SELECT DISTINCT parent, d FROM geo, (SELECT unnest(['.', '..']) AS d) WHERE parent IS NOT NULL)
        SELECT path, count(*) AS n, min(name) AS first, max(name) AS last FROM n GROUP BY path""",
    "listing_requests": f"""WITH e AS (SELECT name, parent FROM ({DOC_FILES}) UNION ALL SELECT name, parent FROM ({DOC_DIRS})),
        l AS ({_listings('e')}),
        q AS (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || source END || CASE WHEN doc_id % 7 = 0 THEN '/none' ELSE '' END AS p FROM documents)
        SELECT doc_id, '/' || p AS path, coalesce(part, 0) AS part, coalesce(listing, '[".",".."]') AS listing FROM q LEFT JOIN l ON p = parent""",
    "entry_attributes": f"""WITH {GEO_ASKED} SELECT path, CASE WHEN name IS NULL THEN 'ERROR: No such file or directory' ELSE {GETATTR} END AS attributes
        FROM asked LEFT JOIN geo USING (path)""",
    "point_lookups": f"WITH {GEO_ASKED} SELECT path, name, is_dir, mode, size FROM asked LEFT JOIN geo USING (path)",
    "file_contents": f"""SELECT path, text AS content FROM ({DOC_FILES}) UNION ALL SELECT path, 'ERROR: Is a directory' FROM ({DOC_DIRS})
        UNION ALL SELECT path || '/none', 'ERROR: No such file or directory' FROM ({DOC_DIRS})""",
    "file_ranges": f"""SELECT path, substr(hex(encode(text)), 7, 80) AS bytes FROM ({DOC_FILES}) UNION ALL SELECT path, NULL FROM ({DOC_DIRS})
        UNION ALL SELECT path || '/none', NULL FROM ({DOC_DIRS})""",
    "answered_queries": f"""WITH {GEO_ASKED}, l AS ({_listings('geo')}),
        r AS (SELECT path, ['getattr', 'readdir', 'read', 'statfs'][length(path) % 4 + 1] AS operation FROM asked)
        SELECT r.path, operation, CASE WHEN operation = 'readdir' THEN coalesce(part, 0) ELSE 0 END AS part, CASE operation WHEN 'readdir' THEN coalesce(listing::VARCHAR, '[".",".."]') WHEN 'statfs' THEN 'out ' || r.path
          WHEN 'getattr' THEN CASE WHEN name IS NULL THEN 'ERROR: No such file or directory' ELSE {GETATTR} END
          ELSE CASE WHEN name IS NULL THEN 'ERROR: No such file or directory' WHEN is_dir THEN 'ERROR: Is a directory' ELSE 'ERROR: Cannot read file ' || r.path END END AS answer
        FROM r LEFT JOIN geo ON r.path = geo.path LEFT JOIN l ON r.path = l.parent AND operation = 'readdir'""",
    "content_volume": "SELECT lang AS snapshot_id, sum(length(text))::BIGINT AS total_chars FROM documents GROUP BY 1",
    "coverage": """WITH d AS (SELECT lang, source, count_if(NOT (lang = 'fr' AND source = 'src1')) AS n FROM documents GROUP BY ALL)
        SELECT lang AS snapshot_id, bool_or(n = 0) AS has_empty_dir, bool_or(n > 0) AS has_populated_dir, sum(n)::BIGINT AS n_files,
          bool_or(n = 0) AND bool_or(n > 0) AND sum(n) >= 3 AS covered FROM d GROUP BY 1""",
    "visible_contents": """SELECT lang AS snapshot_id, count_if(strlen(text) <= 4000 OR doc_id % 10 = 7) AS shown, count(*) + count(DISTINCT source) + 1 AS entries FROM documents GROUP BY 1""",
    "edited_entries": f"""WITH {GEO}, e AS (SELECT path, name, is_dir, CASE WHEN NOT is_dir AND size % 5 = 0 THEN 1024 ELSE size END AS size, mode, size AS old FROM geo)
        SELECT path, name, is_dir, size::BIGINT AS size FROM e WHERE NOT (mode = 384 AND old % 3 = 0)
        UNION ALL SELECT CASE WHEN path = '' THEN 'new' ELSE path || '/new' END, 'new', true, 0 FROM geo_dirs""",
    "ordinary_entries": f"""SELECT path, false AS is_dir FROM ({DOC_FILES}) WHERE lang <> 'es' AND source <> 'src3'
        UNION ALL SELECT path, true FROM ({DOC_DIRS}) WHERE NOT (path = 'es' OR path LIKE 'es/%') AND path NOT LIKE '%/src3'""",
    "orphans": f"""WITH e AS (SELECT path, parent FROM ({DOC_FILES}) UNION ALL SELECT path, parent FROM ({DOC_DIRS}) WHERE name NOT IN ('src2', 'src5', 'fr'))
        SELECT path FROM e WHERE parent = 'fr' OR parent LIKE '%/src2' OR parent LIKE '%/src5'""",
    "candidate_picks": """WITH e AS (SELECT lang AS s, source || '/doc_' || doc_id || '.txt' AS path, false AS d, strlen(text) AS size FROM documents
          UNION ALL SELECT DISTINCT lang, source, true, 0 FROM documents UNION ALL SELECT DISTINCT lang, '', true, 0 FROM documents)
        SELECT s AS snapshot_id, arg_min(path, sha256('7|any|' || s || '|' || path)) FILTER (path <> '') AS "any",
          arg_min(path, sha256('7|file|' || s || '|' || path)) FILTER (NOT d) AS file, arg_min(path, sha256('7|file16|' || s || '|' || path)) FILTER (NOT d AND size >= 16) AS file16,
          arg_min(path, sha256('7|dir|' || s || '|' || path)) FILTER (d) AS dir, arg_min(path, sha256('7|parent_dir|' || s || '|' || path)) FILTER (d) AS parent_dir,
          NULL::VARCHAR AS empty_dir FROM e GROUP BY 1""",
    "render_xml": f"WITH {XML.format(focus='false')} SELECT * FROM frags",
    "render_focused": f"""WITH {XML.format(focus='doc_id % 10 = 7')}
        SELECT snapshot_id, place, order_key, path, kind, sha256(text) AS digest, length(text)::INT AS n_chars FROM frags""",
    "render_xml_parts": f"""WITH {XML.format(focus='false')},
        placed AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY order_key) - 1 AS pos, count(*) OVER (PARTITION BY snapshot_id) AS n FROM frags WHERE place = 1)
        SELECT snapshot_id, (pos // 500)::INT AS part, ((max(n) + 499) // 500)::INT AS n_parts, sha256(string_agg(text, '' ORDER BY pos)) AS digest FROM placed GROUP BY 1, 2""",
    "render_tree": f"""WITH f AS (SELECT lang AS s, source, 'doc_' || doc_id || '.txt' AS name, doc_id, text, strlen(text) AS size,
          source = max(source) OVER (PARTITION BY lang) AS dl, 'doc_' || doc_id || '.txt' = max('doc_' || doc_id || '.txt') OVER (PARTITION BY lang, source) AS fl FROM documents),
        g AS (SELECT *, CASE WHEN dl THEN '    ' ELSE '│   ' END AS pre, CASE WHEN fl THEN '    ' ELSE '│   ' END AS bar,
          CASE WHEN size < 1024 THEN size || ' B' ELSE printf('%.2f KB', size / 1024.0) END AS sz, string_split(text, chr(10)) AS parts FROM f),
        h AS (SELECT s, source, name, pre || CASE WHEN fl THEN '└── ' ELSE '├── ' END || name AS np, pre || bar || '    │ ' AS m, * EXCLUDE (s, source, name) FROM g),
        frag AS (SELECT s, chr(1) || source || chr(2) || name AS k, CASE WHEN length(np) >= 32 THEN np ELSE rpad(np, 32, ' ') END || ' file 644 ' || s || ':' || source || ' '
            || strftime(make_timestamp(((1700000000.0 + doc_id * 0.25) * 1000000)::BIGINT), '%b %d %H:%M') || ' ' || sz
            || CASE WHEN size <= 300 THEN chr(10) || m || '<file_body path="' || source || '/' || name || '">' || chr(10)
              || coalesce(array_to_string(list_transform(CASE WHEN len(parts) = 1 THEN parts ELSE list_filter(parts, lambda x: x <> '') END, lambda x: m || x), chr(10)) || chr(10), '') || m || '</file_body>' ELSE '' END AS t FROM h
          UNION ALL SELECT DISTINCT s, chr(1) || source, rpad(CASE WHEN dl THEN '└── ' ELSE '├── ' END || source, 32, ' ') || ' dir  755 root:root Nov 14 22:13' FROM g
          UNION ALL SELECT DISTINCT s, '', '/' || repeat(' ', 15) || ' dir  755 root:root Nov 14 22:13' FROM g)
        SELECT s AS snapshot_id, k AS order_key, t AS text FROM frag""",
    "xml_round_trip": """SELECT lang AS snapshot_id, source || '/doc_' || doc_id || '.txt' AS path, 'doc_' || doc_id || '.txt' AS name, false AS is_dir, 420 AS mode, lang AS owner, source AS "group",
          1735689601.0::DOUBLE AS mtime, strlen(text) AS size, CASE WHEN strlen(text) <= 4000 THEN text ELSE '' END AS content, NULL AS reason FROM documents
        UNION ALL SELECT DISTINCT lang, source, source, true, 493, 'root', 'root', 1735689600.0, 0, NULL, NULL FROM documents
        UNION ALL SELECT DISTINCT lang, '', '/', true, 493, 'root', 'root', 1735689600.0, 0, NULL, NULL FROM documents""",
    "principal_ops": f"""WITH {EVENTS}, o AS (SELECT *, operation <> 'unlink' AS main, CASE WHEN operation = 'unlink' THEN 'getattr' ELSE operation END AS op FROM ev)
        SELECT session, seq, op AS operation, '/' || path AS path FROM o QUALIFY row_number() OVER (PARTITION BY session ORDER BY main DESC, seq DESC) = 1""",
    "op_distribution": f"WITH {EVENTS} SELECT operation, count(*) AS n, 'useful' AS class FROM ev GROUP BY 1",
    "live_counts": f"WITH {EVENTS} SELECT operation, count(*) AS n FROM ev GROUP BY 1",
    "op_share_bounds": f"""WITH {EVENTS}, c AS (SELECT operation, count(*) AS n FROM ev GROUP BY 1 UNION ALL SELECT 'mkdir', 0)
        SELECT operation, n, round(n / (SELECT count(*) FROM ev), 6) AS share, n / (SELECT count(*) FROM ev) > 0.015 AND n / (SELECT count(*) FROM ev) < 0.6 AS within FROM c""",
    "missing_operations": f"WITH {EVENTS} SELECT x AS operation FROM (SELECT unnest(['mkdir', 'write', 'read', 'rename']) AS x) WHERE x NOT IN (SELECT operation FROM ev)",
    "op_signatures": f"""WITH {EVENTS} SELECT seq, operation || '(''/' || path || '''' || CASE operation WHEN 'write' THEN ', data_length=' || len || ', offset=0'
        WHEN 'create' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END WHEN 'chmod' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END ELSE '' END || ')' AS signature FROM ev""",
    "op_calls": f"""WITH {EVENTS} SELECT seq, operation || '(''/' || path || '''' || CASE operation WHEN 'write' THEN ', data_length=' || len || ', offset=0'
        WHEN 'create' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END WHEN 'chmod' THEN ', mode=0o100' || CASE WHEN k % 2 = 0 THEN '640' ELSE '600' END ELSE '' END
        || ', new_path="it''s /' || path || '", fh=None)' AS call FROM ev""",
    "cleaned_trace": f"""WITH {EVENTS} SELECT seq, CASE seq % 9 WHEN 1 THEN 'link' WHEN 2 THEN 'READ' ELSE operation END AS operation, '/' || path AS path,
        CASE WHEN seq % 9 = 1 THEN '/t' || seq ELSE '/mnt/x/t' || seq END AS target FROM ev WHERE seq % 9 <> 0""",
    "successful_sessions": f"WITH {EVENTS}, s AS (SELECT session, count_if(operation = 'unlink') < count(*) / 5 AS success FROM ev GROUP BY 1) SELECT * FROM s WHERE success",
    "replay_latest": STATE_SQL,
    "replay_fold": STATE_SQL,
    "replay_outcomes": f"""WITH {FILE_STATE} SELECT session, seq, operation, ok, CASE WHEN NOT ok THEN 'missing' END AS reason,
        CASE WHEN ok THEN NULL WHEN operation = 'write' THEN 'EIO' ELSE 'ENOENT' END AS errno FROM good""",
    "transition_log": f"""WITH {VERSIONS} SELECT * EXCLUDE (k, alive, blank, mode, size) FROM (SELECT *, lag(size) OVER w AS size_before, size AS size_after,
          lag(mode) OVER w AS mode_before, mode AS mode_after FROM versions WINDOW w AS (PARTITION BY session, path ORDER BY seq)) WHERE seq >= 0""",
    "training_examples": f"WITH {EXAMPLES} SELECT * FROM examples WHERE (length(initial_state) + length(operation) + length(result)) // 4 <= 15000",
    "pairs": f"""WITH {EXAMPLES} SELECT session AS example_id, CASE operation_type WHEN 'query' THEN '<R>' ELSE '<W>' END || chr(10) || operation || chr(10) || '---' || chr(10) || initial_state AS prompt,
          CASE operation_type WHEN 'query' THEN result ELSE result || chr(10) || '<END_FS>' END AS completion FROM examples
        WHERE (length(initial_state) + length(operation) + length(result)) // 4 <= 15000""",
    "state_before_and_after": f"""WITH {AROUND} SELECT session AS snapshot_id, side, count(*) + 11 AS entries, sum(size)::BIGINT AS bytes, (sum(mode) + 11 * 493)::BIGINT AS modes
        FROM sides WHERE alive GROUP BY 1, 2""",
    "session_histories": f"""WITH {EVENTS} SELECT session, part, string_agg(operation || ' /' || path, '; ' ORDER BY seq) AS history
        FROM (SELECT *, ((row_number() OVER (PARTITION BY session ORDER BY seq) - 1) // 20)::INT AS part FROM ev) GROUP BY 1, 2""",
    "token_budget": "SELECT doc_id, length(text) // 4 AS tokens FROM documents WHERE (length(text) + length(source)) // 4 <= 800",
    "chat_rows": f"""WITH {CHAT} SELECT example_id, 'user' AS first_role, completion AS last_content, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
        || completion || '<|im_end|>' AS text FROM cp""",
    "contract_prompts": f"WITH {CHAT} SELECT example_id, {LINE} AS line, {_contract(K.CONTRACT_STATE_EVAL)} AS prompt FROM cp",
    "training_texts": f"WITH {CHAT} SELECT example_id, {_contract(K.CONTRACT_STATE_TRAIN)} || chr(10) || completion AS text FROM cp",
    "prompt_operations": f"""WITH {CHAT}, n AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'flush' ELSE 'getattr' END AS old, ['readdir', 'read', 'write', ''][layout + 1] AS new FROM cp)
        SELECT example_id, CASE WHEN layout = 3 THEN old ELSE 'unknown' END AS legacy, CASE WHEN layout = 3 THEN old ELSE new END AS either, CASE WHEN layout = 3 THEN 'shell_command' ELSE new END AS name FROM n""",
    "legacy_examples": f"""WITH {CHAT} SELECT example_id, CASE WHEN layout = 3 THEN {_strip('asked')} ELSE '' END AS initial_state,
        CASE WHEN layout < 3 THEN '' WHEN turn % 2 = 0 THEN 'flush(''/a'')' ELSE 'getattr(''/a'')' END AS operation,
        CASE WHEN layout = 3 AND turn % 2 = 1 THEN 'query' ELSE 'state_change' END AS operation_type, completion AS result FROM cp""",
    "legacy_prompts": f"""SELECT doc_id, {_quote(K.LEGACY_INTRO)} || chr(10) || chr(10) || 'Initial virtual filesystem state:' || chr(10) || text || chr(10) || chr(10) || 'Operation: mkdir(''/d' || doc_id || ''')'
        || chr(10) || chr(10) || 'Expected result format: ' || CASE WHEN doc_id % 2 = 0 THEN 'virtual filesystem state tree' ELSE 'command output' END || chr(10) || chr(10) || 'Result:' AS prompt FROM documents""",
    "kept_pairs": f"WITH {CHAT} SELECT example_id FROM cp WHERE NOT (layout = 3 AND turn % 2 = 0)",
    "quarantined_pairs": f"WITH {CHAT} SELECT example_id FROM cp WHERE length(completion) % 5 = 0 OR contains(prompt || completion, '... (')",
    "split_rows": f"WITH {CHAT} SELECT example_id, CASE WHEN {SPLIT_KEY} < {int(0.9 * 16**15)} THEN 'train' ELSE 'test' END AS split FROM cp",
    "split_exact_rows": f"""WITH {CHAT} SELECT example_id, CASE WHEN row_number() OVER (ORDER BY {SPLIT_KEY}, example_id) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM cp""",
    "split_counts": f"WITH {CHAT} SELECT count(*) AS total, floor(0.9 * count(*))::BIGINT AS train, count(*) - floor(0.9 * count(*))::BIGINT AS test FROM cp",
    "quota": f"WITH {CHAT} SELECT example_id FROM cp ORDER BY {SPLIT_KEY}, example_id LIMIT 25",
    "sanitize_documents": f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' a' || text || chr(10) ELSE text END AS x FROM documents) SELECT doc_id, x AS read, {_strip('x')} AS tree FROM r""",
    "human_sizes": """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * [0, 1, 13, 1097, 777777][o_orderkey % 5 + 1] END AS n FROM orders)
        SELECT o_orderkey, CASE WHEN n IS NULL THEN '' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0::DOUBLE)
          WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size FROM s""",
    "permission_texts": """SELECT o_orderkey, CASE WHEN m = 0 THEN '0' ELSE ltrim(printf('%o', m), '0') END AS octal, m::INT AS back, '2025-01-01T00:00:0' || (m % 2) AS stamp FROM (SELECT o_orderkey, o_orderkey % 4096 AS m FROM orders)""",
    "parsed_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 2 THEN -1.0 ELSE epoch(date_trunc('second', o_orderdate)) END AS mtime FROM orders",
    "truncated_texts": """WITH h AS (SELECT doc_id, text, left(text, 500) AS h FROM documents), n AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN length(h) - strpos(reverse(h), chr(10)) ELSE -1 END AS nl FROM h)
        SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN nl > 350 THEN left(h, nl) ELSE h END AS head FROM n""",
    "write_previews": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...[truncated]' ELSE text END AS data, strlen(text) AS data_length FROM documents",
    "path_parts": f"""SELECT path, name, parent, 3 AS depth, 'txt' AS extension, path AS normal, false AS below_en FROM ({DOC_FILES})
        UNION ALL SELECT path, name, parent, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END, '', path, coalesce(parent = 'en', false) FROM ({DOC_DIRS})""",
    "operation_classes": f"WITH {EVENTS} SELECT CASE WHEN operation = 'read' THEN 'query' ELSE 'state_change' END AS kind, 'useful' AS class, count(*) AS n FROM ev GROUP BY 1",
    "normalized_listings": r"""SELECT doc_id, to_json(list_concat(['.', '..'], list_sort(list_filter(list_distinct(regexp_split_to_array(text, '[\s\x{0b}]+')), lambda x: x NOT IN ('.', '..'))))) AS listing FROM documents""",
    "unwrapped_results": f"""WITH h AS (SELECT doc_id, text AS h FROM documents),
        l AS (SELECT doc_id, h, list_filter(list_transform(string_split(h, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS parts, {_strip("string_split(h, chr(10))[1]")} AS one FROM h)
        SELECT doc_id, {_strip('h')} AS result, {_strip("'a:b' || chr(10) || 'The result is 5' || chr(10) || one || CASE WHEN len(string_split(h, chr(10))) > 1 THEN chr(10) || coalesce(array_to_string(list_filter(list_transform(string_split(h, chr(10))[2:], lambda x: " + _strip('x') + "), lambda x: x <> ''), chr(10)), '') ELSE '' END")} AS lines FROM l""",
    "clean_predictions": f"WITH {PRED} SELECT example_id, {_clamped('bare', 'expected')} AS predicted FROM pred",
    "clean_listings": f"WITH {LISTINGS} SELECT example_id, predicted FROM listings",
    "clean_states": f"WITH {STATES} SELECT example_id, {_clamped('bare', 'target')} AS predicted FROM states",
    "extracted_trees": f"""SELECT doc_id, {_strip("CASE WHEN doc_id % 2 = 0 THEN '  /' || text ELSE 'hm' || chr(10) || text END")} AS tree,
        {_strip("'<THINK>a' || chr(10) || 'b</think>hm' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  /' ELSE '' END || text")} AS read FROM documents""",
    "score_rows": f"WITH {SCORED} SELECT example_id, operation_type, predicted, round(similarity, 6) AS similarity, similarity > 0.7 AS correct, exact FROM scored",
    "score_joined": f"""WITH {SCORED}, s AS (SELECT *, example_id::BIGINT % 10 = 3 AS bad FROM scored WHERE operation_type IN ('q0', 'q1'))
        SELECT example_id, CASE WHEN bad THEN 'Error: timeout' ELSE predicted END AS predicted, CASE WHEN bad THEN 0.0 ELSE round(similarity, 6) END AS similarity,
          NOT bad AND similarity > 0.7 AS correct, NOT bad AND exact AS exact FROM s""",
    "score_summary": f"""WITH {SCORED} SELECT count(*) AS total_examples, count_if(similarity > 0.7) AS correct_predictions, round(avg((similarity > 0.7)::INT), 6) AS accuracy,
        round(avg(exact::INT), 6) AS exact_accuracy, round(avg(similarity), 6) AS average_similarity FROM scored""",
    "score_by_type": f"""WITH {SCORED} SELECT operation_type, count(*) AS total, count_if(similarity > 0.7) AS correct, round(avg((similarity > 0.7)::INT), 6) AS accuracy,
        round(avg(similarity), 6) AS avg_similarity FROM scored GROUP BY ROLLUP (operation_type)""",
    "first_failures": f"""WITH {SCORED} SELECT example_id, left(expected, 100) AS expected_preview, left(predicted, 100) AS predicted_preview, round(similarity, 6) AS similarity,
        count(*) OVER () AS failure_count FROM scored WHERE operation_type IN ('q0', 'q1') AND NOT similarity > 0.7 ORDER BY example_id LIMIT 3""",
    "first_examples": f"WITH {PRED} SELECT example_id, expected FROM pred ORDER BY example_id LIMIT 20",
    "ngram_model": f"WITH {TOKENS}, {_cost('')} SELECT context, token, n, round(p, 6) AS p FROM m",
    "floored_model": f"""WITH {TOKENS}, t AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY lang, token), u AS (SELECT lang, token, greatest(n / sum(n) OVER (PARTITION BY lang), 0.0005) AS p FROM t)
        SELECT lang, token, round(p / sum(p) OVER (PARTITION BY lang), 9) AS p FROM u""",
    "compress_ratio": f"""WITH {TOKENS}, {_cost('')} SELECT doc_id, num_tokens, round(bits, 4) AS bits, round(16 * num_tokens / bits, 6) AS ratio FROM c""",
    "compare_models": f"""WITH {TOKENS}, {_cost('')}, {_cost('lang')}, b AS (SELECT doc_id, text, {BYTES.format(c='c')} AS base_bytes, {BYTES.format(c='clang')} AS tuned_bytes FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN clang USING (doc_id))
        SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text_preview, length(text)::INT AS text_length, base_bytes, tuned_bytes,
          CASE WHEN base_bytes = 0 THEN 0.0 ELSE round((base_bytes - tuned_bytes) / base_bytes * 100, 6) END AS improvement_pct FROM b""",
    "length_guard": f"WITH {TOKENS} SELECT doc_id, len(w)::INT AS num_tokens, 'Input has ' || len(w) || ' tokens, exceeds max_tokens=1000' AS reason FROM words WHERE len(w) > 1000",
    "compression_summary": f"""WITH {TOKENS}, {_cost('')}, b AS (SELECT strlen(text) AS ob, {BYTES.format(c='c')} AS cb, coalesce(num_tokens, 0) AS nt FROM documents LEFT JOIN c USING (doc_id))
        SELECT count(*) AS total, count_if(cb > 0 AND ob > 0) AS successes, round(avg(ob / cb) FILTER (cb > 0 AND ob > 0), 6) AS avg_ratio, sum(ob)::BIGINT AS original_bytes, sum(cb)::BIGINT AS compressed_bytes, sum(nt)::BIGINT AS num_tokens FROM b""",
    "scenario_modes": f"""SELECT event_id, CASE WHEN {_u("'7|sparse|' || event_id")} < 0.35 THEN 'sparse' WHEN {_u("'7|targeted|' || event_id")} < 0.35 THEN 'targeted' ELSE 'random' END AS mode FROM events""",
    "synthetic_names": f"""WITH h AS (SELECT event_id, sha256('7|' || event_id) AS d FROM events) SELECT event_id,
        {_word(K.FILE_PREFIXES, 'd', 2)} || CASE WHEN {_draw('d', 0)} / 16777216.0::DOUBLE < 0.3 THEN '_' || {_word(K.FILE_MIDDLES, 'd', 1)} ELSE '' END || ({_draw('d', 3)} % 999 + 1) || '.' || {_word(K.FILE_SUFFIXES, 'd', 4)} AS file,
        {_word(K.DIR_NAMES, 'd', 4)} || CASE WHEN {_draw('d', 0)} / 16777216.0::DOUBLE < 0.2 THEN '_' || {_word(K.DIR_SUFFIXES, 'd', 1)} ELSE '' END || CASE WHEN {_draw('d', 2)} / 16777216.0::DOUBLE < 0.5 THEN ({_draw('d', 3)} % 99 + 1)::VARCHAR ELSE '' END AS dir FROM h""",
    "trace_scan": f"""WITH {EVENTS} SELECT operation, '/' || path AS path, count(*) AS n, max(epoch_ms(ts)) AS last FROM ev WHERE seq % 50 NOT IN (0, 1) GROUP BY 1, 2""",
    "trace_stream": f"WITH {EVENTS} SELECT operation, count(*) AS n FROM ev WHERE seq % 50 NOT IN (0, 1) GROUP BY 1",
    "pair_scan": f"WITH {CHAT} SELECT prompt, completion, count(*) AS n FROM cp GROUP BY 1, 2",
    "validated_lines": """SELECT text || '!' AS what, 'kept' AS outcome, count(*) AS n FROM conversations WHERE turn % 4 IN (0, 3) GROUP BY 1
        UNION ALL SELECT NULL, CASE turn % 4 WHEN 1 THEN 'Missing field' ELSE 'Invalid JSON' END, count(*) FROM conversations WHERE turn % 4 IN (1, 2) GROUP BY 2""",
    "synthetic_contents": f"""WITH p AS (SELECT lang || '/' || source || '/f' || doc_id || ['.py', '.json', '.txt', ''][(doc_id % 4 + 1)::INT] AS path FROM documents),
        {_contents('p', 'c')} SELECT path, content FROM c""",
    "sparse_ops": f"WITH {SPARSE} {LISTED.format('spo')}",
    "random_ops": f"WITH {RANDOM} {LISTED.format('po')}",
    "targeted_ops": f"WITH {TARGETED} {LISTED.format('po')}",
    "setup_ops": f"WITH {SETUP} " + " UNION ALL ".join(LISTED.format(x) for x in ("s1", "s2", "s3", "e")),
    "covered_entries": f"""SELECT lang AS snapshot_id, source || '/doc_' || doc_id || '.txt' AS path, false AS is_dir, strlen(text) AS size FROM documents
        UNION ALL SELECT DISTINCT lang, source, true, 0 FROM documents UNION ALL SELECT DISTINCT lang, '', true, 0 FROM documents
        UNION ALL SELECT lang, 'cover_empty_' || {COVER}, true, 0 FROM (SELECT DISTINCT lang FROM documents)""",
    "refused_lines": """WITH l AS (SELECT (conv_id % 8)::INT AS bucket, turn, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) AS line FROM conversations)
        SELECT bucket, line, CASE turn % 3 WHEN 1 THEN 'Missing field' ELSE 'Invalid JSON' END AS reason FROM l WHERE turn % 3 > 0""",
    "tree_scan": f"""WITH files AS (SELECT lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, text FROM documents),
        dirs AS (SELECT DISTINCT unnest(['', lang, lang || '/' || source]) AS path FROM documents)
        SELECT path, string_split(path, '/')[-1] AS name, false AS is_dir, strlen(text) AS size, sha256(text) AS digest FROM files
        UNION ALL SELECT path, CASE path WHEN '' THEN '/' ELSE string_split(path, '/')[-1] END, true, 0, sha256('') FROM dirs""",
    "xml_files": """WITH d AS (SELECT *, CASE WHEN doc_id % 7 = 3 AND text <> '' AND NOT regexp_matches(text, '[<>&]') THEN text || ' > 0' ELSE text END AS body FROM documents)
        SELECT lang AS snapshot_id, source || '/doc_' || doc_id || '.txt' AS path, false AS is_dir, 420 AS mode, lang AS owner, strlen(text) AS size, sha256(body) AS digest, NULL AS reason FROM d WHERE doc_id % 7 <> 5
        UNION ALL SELECT DISTINCT lang, source, true, 493, 'root', 0, sha256(''), NULL FROM documents
        UNION ALL SELECT DISTINCT lang, '', true, 493, 'root', 0, sha256(''), NULL FROM documents
        UNION ALL SELECT lang, NULL, NULL, NULL, NULL, NULL, NULL, 'Size is no number ' || source || '/doc_' || doc_id || '.txt' FROM documents WHERE doc_id % 7 = 5""",
    "split_sink": f"WITH {CHAT} SELECT example_id, CASE WHEN {SPLIT_KEY} < {int(0.9 * 16**15)} THEN 'train' ELSE 'test' END AS split FROM cp",
    "report_sink": f"""WITH {SCORED} SELECT count(*) AS total_examples, count_if(similarity > 0.7) AS correct_predictions FROM scored, (SELECT unnest([1, 2]) AS side)
        WHERE operation_type IN ('q0', 'q1') GROUP BY side""",
    "failing_predictions": f"""WITH {CHAT}, f AS (SELECT *, contains(prompt, '?') OR length(prompt) % 3 = 0 AS fails FROM cp)
        SELECT example_id, CASE WHEN NOT fails THEN right(prompt, 10) END AS predicted, CASE WHEN fails THEN 'no answer' END AS error FROM f""",
    "predict_echo": f"""WITH {CHAT}, t AS (SELECT example_id, string_split(prompt, chr(10))[-1] AS last FROM cp) SELECT example_id, {_strip("'echo ' || last")} AS predicted, NULL::VARCHAR AS error FROM t""",
}


def _weighted_sql() -> str:
    total, running, edges = float(sum(K.OP_WEIGHTS.values())), 0.0, []
    for weight in K.OP_WEIGHTS.values():
        running += weight
        edges.append(running / total)
    draw = _u("'7|' || event_id")
    cases = " ".join(f"WHEN u < {edge!r}::DOUBLE THEN {_quote(op)}" for op, edge in zip(list(K.OP_WEIGHTS)[:-1], edges))
    return f"SELECT event_id, CASE {cases} ELSE {_quote(list(K.OP_WEIGHTS)[-1])} END AS shell_op FROM (SELECT event_id, {draw} AS u FROM events)"


ORACLES["weighted_ops"] = _weighted_sql()
