"""Independent SQL for the queries, in DuckDB's dialect over the driver's views."""

from __future__ import annotations

AS_OF_MS = 1706745600000
TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fill(template: str, **parts: object) -> str:
    for name, part in parts.items():
        template = template.replace("{" + name + "}", str(part))
    return template


def trim(x: str) -> str:
    return fill(TRIM, x=x)


CF = r"""
k0 AS (SELECT d.*, (d.doc_id // 20) % 10 AS k, d.lang || '_' || d.source || '_' || CAST(d.doc_id % 7 AS VARCHAR) AS nm, coalesce(t.toxic, 0) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) t USING (doc_id)),
cf AS (SELECT doc_id, source || '/' || (['docs','src','tests','config','scripts','.github/workflows','systemd','assets','build','notes'])[k + 1] || '/doc_' || CAST(doc_id AS VARCHAR) || (['.md','.rs','_test.py','.toml','.sh','.yml','.service','.png','.js','.txt'])[k + 1] AS path,
  source AS domain_id, CASE WHEN toxic = 1 THEN 'untrusted' ELSE 'trusted' END AS trust_label,
  CASE WHEN k IN (0, 9) THEN replace(text, chr(10), chr(10) || chr(10))
       WHEN k = 1 THEN 'pub fn ' || nm || '(x: u32) {' || chr(10) || text
       WHEN k = 2 THEN 'def ' || nm || '(x):' || chr(10) || text
       WHEN k = 8 THEN 'export class_' || nm || ' = {' || chr(10) || 'function ' || nm || '() {' || chr(10) || text
       WHEN k = 3 THEN '# settings' || chr(10) || 'key_' || nm || ' = 1' || chr(10) || chr(10) || 'other: 2' || chr(10) || text
       ELSE text END AS content,
  sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, 1706742000000 - ((doc_id * 7919) % 1000) * 360000 AS modified_unix_ms, text
  FROM k0)"""

FT = r"""CASE WHEN regexp_matches(lower(path), '\.(rs|go|py|js|jsx|ts|tsx|java|c|cpp|h|hpp|cs|dart)$') THEN 'code' WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.txt' THEN 'text' WHEN lower(path) LIKE '%.json' THEN 'json'
 WHEN regexp_matches(lower(path), '\.ya?ml$') THEN 'yaml' WHEN lower(path) LIKE '%.toml' THEN 'toml' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|mp4)$') THEN 'binary' ELSE 'text' END"""
CLASS = {
    "docs": r"/docs/|\.md$|\.rst$|\.adoc$|readme$",
    "test": r"/tests?/|_test\.rs$|_test\.py$|\.spec\.ts$|\.test\.ts$",
    "code": r"\.(rs|py|ts|tsx|js|jsx|go|java|c|cpp|h|hpp|cs)$",
    "script": r"^scripts/|/scripts/|\.ps1$|\.sh$|\.bat$",
    "workflow": r"(^\.?github/workflows/|/workflows/)(.*)\.ya?ml$",
    "unit": r"^systemd/|/systemd/|\.(service|socket|timer|mount|target)$",
    "config": r"^config/|/config/|\.(toml|yaml|yml|json|ini|conf)$",
    "generated": r"/(\.next|\.nuxt|\.svelte-kit|\.turbo|\.dart_tool|__generated__|dist|build|out|coverage|target)/|\.min\.js$",
    "asset": r"/(assets|static|media)/|\.(dat|bin|png|jpg|jpeg|gif|svg|ico|mp3|wav|ogg|pdf|zip|onnx|pt|ckpt|pb|tflite)$",
}


def cls(name: str, path: str = "path") -> str:
    return f"regexp_matches(lower({path}), '{CLASS[name]}')"


DIR = "CASE WHEN instr({p}, '/') = 0 THEN '.' ELSE regexp_replace({p}, '/[^/]*$', '') END"
ABOVE = "list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))"
PRIOR = f"(CASE WHEN {cls('code')} THEN 1.15 ELSE 1.0 END * CASE WHEN {cls('docs')} THEN 0.85 ELSE 1.0 END * CASE WHEN {cls('test')} THEN 0.95 ELSE 1.0 END * CASE WHEN {cls('asset')} AND NOT {cls('code')} THEN 0.45 ELSE 1.0 END * CASE WHEN {cls('generated')} THEN 0.30 ELSE 1.0 END)".replace("1.15", "1.15::DOUBLE").replace("0.85", "0.85::DOUBLE").replace("0.95", "0.95::DOUBLE").replace("0.45", "0.45::DOUBLE").replace("0.30", "0.30::DOUBLE").replace("1.0 ", "1.0::DOUBLE ")
RECENCY = f"CASE WHEN modified_unix_ms <= 0 THEN 1.0 WHEN modified_unix_ms >= {AS_OF_MS} THEN 1.2 ELSE 0.85::DOUBLE + 0.35::DOUBLE * pow(0.5::DOUBLE, (({AS_OF_MS} - modified_unix_ms) / 3600000.0::DOUBLE) / 24.0::DOUBLE) END"

LINES = r"string_split(regexp_replace(regexp_replace(content, '\r?\n$', ''), '\r\n', chr(10), 'g'), chr(10))"
PAR = f"par AS (SELECT path, 'txt:' || CAST(i AS VARCHAR) AS chunk_id, 0 AS start_line, 0 AS end_line, {trim('c')} AS content, CAST(NULL AS VARCHAR) AS symbol FROM (SELECT path, unnest(string_split(content, chr(10) || chr(10))) AS c, unnest(range(len(string_split(content, chr(10) || chr(10))))) AS i FROM {{src}}) WHERE {trim('c')} <> '')"
LIN = f"lin AS (SELECT path, 'chunk:' || CAST(w * 20 + 1 AS VARCHAR) || ':' || CAST(least(len(ls), w * 20 + 20) AS VARCHAR) AS chunk_id, CAST(w * 20 + 1 AS INTEGER) AS start_line, CAST(least(len(ls), w * 20 + 20) AS INTEGER) AS end_line, array_to_string(ls[w * 20 + 1:w * 20 + 20], chr(10)) AS content, CAST(NULL AS VARCHAR) AS symbol FROM (SELECT path, ls, unnest(range((len(ls) - 1) // 20 + 1)) AS w FROM (SELECT path, {LINES} AS ls FROM {{src}})))"
CFG = f"cfg AS (SELECT path, 'cfg:' || CAST(i AS VARCHAR) AS chunk_id, CAST(i AS INTEGER) AS start_line, CAST(i AS INTEGER) AS end_line, c AS content, CASE WHEN instr(c, '=') > 0 THEN {trim("split_part(c, '=', 1)")} WHEN instr(c, ':') > 0 THEN {trim("split_part(c, ':', 1)")} END AS symbol FROM (SELECT path, {trim('l')} AS c, i FROM (SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, {LINES} AS ls FROM {{src}}))) WHERE c <> '' AND c NOT LIKE '#%')"
TYPED = f"ft AS (SELECT *, {FT} AS file_type FROM cf), f_par AS (SELECT * FROM ft WHERE file_type IN ('markdown', 'text')), f_cfg AS (SELECT * FROM ft WHERE file_type IN ('json', 'yaml', 'toml')), f_lin AS (SELECT * FROM ft WHERE file_type = 'code')"
CHUNKS = f"{TYPED}, {fill(PAR, src='f_par')}, {fill(CFG, src='f_cfg')}, {fill(LIN, src='f_lin')}, chunks AS (SELECT *, path || ':' || CAST(start_line AS VARCHAR) || ':' || CAST(end_line AS VARCHAR) AS place, path || ':' || CAST(start_line AS VARCHAR) || ':' || CAST(end_line AS VARCHAR) || ':' || chunk_id AS key FROM (SELECT * FROM par UNION ALL SELECT * FROM cfg UNION ALL SELECT * FROM lin))"
DECL = r"^(fn |async fn |pub fn |pub async fn |pub\((?:crate|super|self)\) (?:async )?fn |(?:public |private |protected |abstract )?class |(?:public |private |protected )?interface |(?:async )?def |(?:pub |pub\((?:crate|super|self)\) )?(?:struct|trait) |(?:pub |pub\((?:crate|super|self)\) |public |private |protected )?enum |(?:export )?(?:const|let) |function |export (?:default )?(?:async )?function )([^({: =]+)"
SYM = f"""sl AS (SELECT path, CAST(i AS INTEGER) AS line_start, {trim('l')} AS line FROM (SELECT path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, {LINES} AS ls FROM cf WHERE {FT} = 'code'))),
sn AS (SELECT *, regexp_extract(line, '{DECL}', 2) AS named, {trim("split_part(line, '(', 1)")} AS bef FROM sl),
st AS (SELECT *, CASE WHEN named <> '' THEN named WHEN instr(line, '(') > 0 AND line NOT LIKE '//%' AND instr(bef, '=') = 0 AND regexp_matches(line, '(\\{{|=>|=>;|;)$') AND regexp_matches(bef, '\\S\\s+\\S') AND regexp_extract(bef, '^(\\S+)', 1) NOT IN ('if','for','while','switch','catch','return','else','match') AND regexp_extract(bef, '(\\S+)$', 1) NOT IN ('if','for','while','switch','catch','return','else','match') AND regexp_matches(regexp_extract(bef, '(\\S+)$', 1), '^[A-Za-z_][A-Za-z0-9_]*$') THEN regexp_extract(bef, '(\\S+)$', 1) END AS symbol_name FROM sn),
syms AS (SELECT path, symbol_name, CASE WHEN instr(line, 'class ') > 0 THEN 'class' WHEN instr(line, 'interface ') > 0 THEN 'trait' WHEN instr(line, 'struct ') > 0 THEN 'struct' WHEN instr(line, 'enum ') > 0 THEN 'enum' WHEN instr(line, 'trait ') > 0 THEN 'trait' WHEN instr(line, 'const ') > 0 THEN 'const' ELSE 'function' END AS symbol_kind, line_start, (line LIKE 'pub %' OR line LIKE 'pub(%' OR line LIKE 'export %') AS exported FROM st WHERE symbol_name IS NOT NULL)"""

LIT = """lit AS (SELECT * FROM (VALUES (1, 'issue_token'), (2, 'EN_src4_3'), (3, 'def en_src1_2('), (4, 'en_src1_0'), (5, 'runs-on: ubuntu-latest'), (6, '[unit] description=x'), (7, 'trust_label = ' || chr(39) || 'x' || chr(39)),
 (8, 'how does the session pin a snapshot for readers'), (9, 'powershell -file run.ps1'), (10, 'docs for a_b_c_d schema fields in the table'), (11, '  fr_src3_1  '), (12, 'the of and'), (13, 'en_src4.md.md'), (14, 'a%20b_c.md'), (15, 'Die'), (16, 'en_src2_6')) t(query_id, query))"""
TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"
OVER = "list_filter(" + TERMS + ", lambda t: length(t) >= 3)"
SEARCH = r"list_filter(regexp_split_to_array(lower(strip_accents({x})), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _has(needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"instr(lower({trim('query')}), '{n}') > 0" for n in needles) + ")"


INTENTS = (
    "q1 AS (SELECT *, "
    + f"({_has(('.toml', '.yaml', '.yml', '.json', 'mount_point', 'allow_roots', 'deny_globs', 'trust_label', 'metrics_bind', 'health_bind'))} OR (instr({trim('query')}, '=') > 0 AND length({trim('query')}) - length(regexp_replace({trim('query')}, '[=\\[\\]{{}}\"'']', '', 'g')) >= 2)) AS is_config, "
    + f"(regexp_matches({trim('query')}, '^[A-Za-z0-9_:-]+$') AND regexp_matches({trim('query')}, '[_A-Z]')) AS is_symbol, "
    + f"{_has(('run-step', 'ap.add_argument(', 'invoke-expression', 'powershell', 'executionpolicy', ' -file ', '.ps1', '.sh', 'bash -lc', 'git ls-files', 'cargo run'))} AS is_command, "
    + f"{_has(('runs-on:', 'uses:', 'workflow_dispatch', 'pull_request:', 'actions/', 'ubuntu-latest'))} AS is_workflow, "
    + f"{_has(('[unit]', '[service]', '[install]', 'description=', 'after=', 'execstart=', 'wantedby=', 'restartsec=', 'type=simple', '.service'))} AS is_unit FROM {{src}}), "
    + f"q2 AS (SELECT *, (NOT is_config AND NOT is_command AND len({fill(TERMS, x='query')}) >= 5 AND length(query) - length(regexp_replace(query, '[A-Za-z]', '', 'g')) >= 20 AND length(query) - length(regexp_replace(query, '[=\\[\\]{{}}\"''`]', '', 'g')) <= 2) AS is_narrative FROM q1), "
    + "qi AS (SELECT *, (is_narrative AND length(query) - length(replace(query, '_', '')) >= 3) AS is_schema, (is_config OR is_command OR is_workflow OR is_unit) AS is_literal FROM q2)"
)
SPACED = r"regexp_replace(" + trim("query") + r", '\s+', ' ', 'g')"
SNAKE = f"array_to_string({fill(TERMS, x='query')}, '_')"
MADE = f"[{trim('query')}, {SPACED}, replace({SPACED}, ' ', '_'), {SNAKE}, '_' || {SNAKE}, array_to_string({fill(TERMS, x='query')}, ''), array_to_string(list_transform({fill(TERMS, x='query')}, lambda t: upper(t[1]) || t[2:]), ''), regexp_replace({trim('query')}, '^_+', '')]"
VAR = f"vr AS (SELECT query_id, v, min(o) AS o FROM (SELECT query_id, unnest(m) AS v, unnest(range(8)) AS o FROM (SELECT query_id, {MADE} AS m FROM {{src}})) WHERE v <> '' AND v <> '_' GROUP BY query_id, v)"
PASS = "pas AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:{n}], ' ') AS query FROM benchmark)"
LSEARCH = "{name} AS (SELECT * FROM (SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY path) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id, path FROM cf, {src} WHERE contains(content, query))) WHERE rank <= {n})"
EXPECTED = "expd AS (SELECT DISTINCT query_id, path FROM cf, (SELECT item_id AS query_id, unnest(string_split(text, '. ')) AS needle FROM benchmark) WHERE length(needle) >= 40 AND contains(replace(content, chr(10) || chr(10), chr(10)), needle))"
WAYS = f"[{trim('query')}, {fill(TRIM, x=fill('replace({x}, chr(95), chr(32))', x=trim('query')))}, array_to_string({fill(TERMS, x='query')}, ' ')]"


def bm25(q: str, n: str = "20", allowed: str = "TRUE", place: str = "key") -> str:
    """bm(query_id, key, score, rank) of q(query_id, query, ...), whose columns n and allowed may use as qq."""
    return f"""wy AS (SELECT query_id, unnest({WAYS}) AS v, unnest(range(3)) AS o FROM {q}), ws AS (SELECT query_id, list_sort(list_distinct({fill(SEARCH, x='v')})) AS ts, o FROM wy), tr AS (SELECT query_id, ts, min(o) AS tier FROM ws WHERE len(ts) > 0 GROUP BY query_id, ts),
w AS (SELECT query_id, tier, len(ts) AS need, unnest(ts) AS term FROM tr),
tk AS (SELECT key, place, path, {fill(SEARCH, x='content')} AS ts FROM chunks), ln AS (SELECT key, place, path, len(ts) AS len FROM tk), sst AS (SELECT count(*) AS nd, avg(len) AS al FROM ln),
po AS (SELECT term, key, count(*) AS tf FROM (SELECT key, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM w) GROUP BY term, key), dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query_id, tier, key, any_value({place}) AS spot, any_value({n}) AS lim, need, round(sum(greatest(ln((nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score, count(*) AS matched FROM po JOIN dfs USING (term) JOIN ln USING (key) CROSS JOIN sst JOIN w USING (term) JOIN {q} qq USING (query_id) WHERE {allowed} GROUP BY query_id, tier, key, need),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, key) AS nth FROM sc WHERE matched = need) WHERE nth <= lim), fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, spot ORDER BY tier, nth) AS first FROM nb) WHERE first = 1),
bm AS (SELECT query_id, key, score, rank FROM (SELECT query_id, key, score, lim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, nth) AS INTEGER) AS rank FROM fs) WHERE rank <= lim)"""


LIKES = {"is_workflow": ("github/workflows/%", ".github/workflows/%", "%/workflows/%.yml", "%/workflows/%.yaml"), "is_unit": ("systemd/%", "%/systemd/%", "%.service", "%.socket", "%.timer", "%.mount", "%.target"), "is_command": ("scripts/%", "%/scripts/%", "%.ps1", "%.sh", "%.bat")}
PUSHED = "CASE " + " ".join(f"WHEN qq.{k} THEN " + " OR ".join(f"ln.path ILIKE '{x}'" for x in v) for k, v in LIKES.items()) + " ELSE TRUE END"
EMB = "{name} AS (SELECT key, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS weight FROM (SELECT key, bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS bucket FROM (SELECT {key} AS key, unnest(list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '')) AS t FROM {src})) GROUP BY key, bucket))"
LISTS = f"{fill(PASS, n=3)}, {fill(LSEARCH, name='l2', src='pas', n=20)}, pas2 AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS query FROM benchmark), {fill(LSEARCH, name='l3a', src='pas2', n=100)}, l3 AS (SELECT * FROM (SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY modified_unix_ms DESC, path) AS INTEGER) AS rank FROM l3a JOIN cf USING (path)) WHERE rank <= 20), ls AS (SELECT query_id, path AS key, 2 AS list, rank FROM l2 UNION ALL SELECT query_id, path, 3, rank FROM l3), rf AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score_rrf, min(list) AS first_list FROM ls GROUP BY query_id, key)"
FACTORS = {"is_config": (("config", 1.30), ("docs", 0.95), ("code", 0.88)), "is_schema": (("docs", 2.80), ("config", 0.65), ("script", 0.80), ("code", 0.35)), "is_narrative": (("docs", 1.28), ("script", 0.86), ("code", 0.92)), "is_command": (("script", 2.10), ("docs", 0.68), ("config", 0.68), ("code", 0.72)), "is_workflow": (("workflow", 1.90), ("docs", 0.82), ("config", 0.86), ("code", 0.72)), "is_unit": (("unit", 1.40), ("docs", 0.92), ("config", 0.95), ("code", 0.88))}


def factor(name: str) -> str:
    on = "is_narrative AND NOT is_schema" if name == "is_narrative" else name
    return f"CASE WHEN {on} THEN CASE " + " ".join(f"WHEN {cls(c)} THEN {f}::DOUBLE" for c, f in FACTORS[name]) + " ELSE 1.0::DOUBLE END ELSE 1.0::DOUBLE END"


def overlap(path: str, weight: float) -> str:
    q, p = fill(OVER, x="query"), fill(OVER, x=path)
    return f"CASE WHEN len({q}) = 0 OR len({p}) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + {weight}::DOUBLE * len(list_filter({q}, lambda a: len(list_filter({p}, lambda b: starts_with(b, a) OR starts_with(a, b))) > 0)) / len({q}) END"


PAIRS = f"{CF}, {LIT}, {fill(INTENTS, src='lit')}, pr AS (SELECT query_id, query, path, string_split(path, '/')[-1] AS base, modified_unix_ms, is_config, is_symbol, is_command, is_workflow, is_unit, is_narrative, is_schema FROM cf, qi)"
EXACT = f"{SYM}, {fill(VAR, src='{q}')}, se0 AS (SELECT query_id, path, symbol_name, symbol_kind, line_start, exported, min(CASE WHEN symbol_name = v THEN 0 ELSE 1 END) AS tier FROM syms JOIN vr ON lower(symbol_name) = lower(v) GROUP BY ALL), se AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exported DESC, path, line_start, symbol_name) AS INTEGER) AS rank FROM (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM se0) WHERE tier = best) WHERE rank <= {{n}})"
RANKS = "fr AS (SELECT e.query_id, first_rank, e.query_id % 4 = 0 AS is_symbol FROM (SELECT DISTINCT query_id FROM expd) e LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM {hits} JOIN expd USING (query_id, path) GROUP BY query_id) USING (query_id))"
METRICS = "count(*) AS n_queries, round(avg(CAST(first_rank IS NOT NULL AS DOUBLE)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr, round(coalesce(avg(CASE WHEN is_symbol THEN CAST(coalesce(first_rank, 0) = 1 AS DOUBLE) END), 1.0), 6) AS symbol_hit_rate"
EVAL = f"{CF}, {fill(PASS, n=3)}, {fill(LSEARCH, name='lh', src='pas', n=10)}, {EXPECTED}, {fill(RANKS, hits='lh')}"
THREE = "p3 AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query FROM benchmark)"


def two(n: int) -> str:
    """fr: ranks of full text, ft2: those of the literal search with n hits."""
    return f"{CF}, {fill(PASS, n=5)}, {CHUNKS}, {bm25('pas')}, bh AS (SELECT query_id, path, rank FROM bm JOIN chunks USING (key)), {EXPECTED}, {fill(RANKS, hits='bh')}, {THREE}, {fill(LSEARCH, name='lh', src='p3', n=n)}, {fill(RANKS, hits='lh').replace('fr AS', 'ft2 AS', 1)}"


TWO = two(3)
PUSH_ROWS = "(20, 'the of .sh'), (21, 'and .sh'), (22, 'that powershell')"
BM25_N = "CASE WHEN is_workflow OR is_unit THEN 6 WHEN is_config OR is_command THEN 8 WHEN is_schema THEN 10 WHEN is_narrative THEN 8 ELSE 20 END"
VECTOR_N = f"CASE WHEN is_literal OR (is_symbol AND symbol_hits) THEN NULL WHEN is_narrative AND docs_hint THEN CASE WHEN is_schema THEN 8 WHEN len({fill(OVER, x='query')}) >= 7 THEN NULL ELSE 6 END WHEN is_narrative AND bm25_hits THEN CASE WHEN is_schema THEN 8 WHEN len({fill(OVER, x='query')}) <= 4 THEN 6 ELSE 8 END ELSE 20 END"
PREFIXED = "sp0 AS (SELECT DISTINCT query_id, path, symbol_name, symbol_kind, line_start, exported FROM syms JOIN vr ON starts_with(lower(symbol_name), lower(v))), sp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY exported DESC, path, line_start, symbol_name) AS INTEGER) AS rank FROM sp0) WHERE rank <= 10)"
ALL_PRIORS = f"{PRIOR} * {overlap('path', 0.35)} * {overlap('base', 0.55)} * ({RECENCY}) * " + " * ".join(f"({factor(n)})" for n in FACTORS)
TWO_DIGITS = "printf('%.2f', floor({x} * 100 + 0.5::DOUBLE) / 100)"
HYBRID = f"""{CF}, {fill(PASS, n=5)}, {LIT}, bq AS (SELECT query_id, query FROM pas UNION ALL SELECT query_id + 100000, query FROM lit WHERE query_id IN (4, 16, 11, 2, 9, 15) UNION ALL SELECT i + 100000, q FROM (VALUES {PUSH_ROWS}) t(i, q)), {fill(INTENTS, src='bq')}, qn AS (SELECT *, {BM25_N} AS n FROM qi),
{CHUNKS}, {bm25('qn', 'qq.n', PUSHED, 'place')}, {fill(EXACT, q='bq', n=10)}, {PREFIXED},
c0 AS (SELECT query_id, 0 AS list, rank, path, line_start AS start_line, line_start AS end_line, 2.0::DOUBLE AS score, symbol_kind FROM se UNION ALL SELECT query_id, 1, rank, path, line_start, line_start, 1.2::DOUBLE, symbol_kind FROM sp UNION ALL SELECT query_id, 2, rank, path, start_line, end_line, 1.0::DOUBLE, NULL FROM bm JOIN chunks USING (key)),
facts AS (SELECT query_id, bool_or(list < 2) AS sh, bool_or(list = 2) AS bh, bool_or(list = 2 AND rank <= 3 AND {cls('docs')}) AS dh FROM c0 GROUP BY query_id),
told AS (SELECT qi.*, coalesce(sh, FALSE) AS symbol_hits, coalesce(bh, FALSE) AS bm25_hits, coalesce(dh, FALSE) AS docs_hint FROM qi LEFT JOIN facts USING (query_id)), vq AS (SELECT query_id, query, {VECTOR_N} AS vector_n FROM told),
{fill(EMB, name='ce', key='key', text='content', src='chunks')}, {fill(EMB, name='qe', key='query_id', text='query', src='vq WHERE vector_n IS NOT NULL')},
vs AS (SELECT qe.key AS query_id, ce.key, round(sum(ce.weight * qe.weight), 6) AS score FROM ce JOIN qe USING (bucket) GROUP BY ALL), vk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM vs WHERE score > 0),
c1 AS (SELECT * FROM c0 UNION ALL SELECT query_id, 3, rank, path, start_line, end_line, score, NULL FROM vk JOIN vq USING (query_id) JOIN chunks USING (key) WHERE rank <= least(20, vector_n)),
l0 AS (SELECT c1.*, domain_id, trust_label, file_hash, modified_unix_ms, string_split(path, '/')[-1] AS base, qi.* EXCLUDE (query_id) FROM c1 JOIN cf USING (path) JOIN qi USING (query_id)),
l1 AS (SELECT *, {PRIOR} AS path_prior, {RECENCY} AS recency_prior, {ALL_PRIORS} AS prior, bool_or(list = 0) OVER (PARTITION BY query_id) AS has_exact FROM l0), l2 AS (SELECT *, is_symbol AND has_exact AS fast FROM l1),
dr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score * prior, 8) DESC, rank) AS position, path, start_line, end_line, round(score * prior, 8) AS score_rrf, list, score, symbol_kind, domain_id, trust_label, file_hash, '; exact-symbol-fast-path' AS why, path_prior, recency_prior FROM l2 WHERE fast AND list = 0),
f0 AS (SELECT query_id, path, start_line, end_line, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS base_, min(rank) FILTER (WHERE list = 0) AS exact, min(rank) FILTER (WHERE list = 1) AS prefix, arg_min(l2, list * 1000 + rank) AS f FROM l2 WHERE NOT fast GROUP BY ALL),
f1 AS (SELECT query_id, path, start_line, end_line, base_, round(base_ * f.prior, 8) AS score_rrf, coalesce(CASE WHEN f.has_exact THEN exact WHEN regexp_matches(f.query, '^[A-Za-z0-9_:]*$') THEN prefix END, 1073741824) AS pin, path || ':' || CAST(start_line AS VARCHAR) || ':' || CAST(end_line AS VARCHAR) AS spot, f FROM f0),
fu AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pin, score_rrf DESC, floor(base_ * 1000000) DESC, spot) AS position, path, start_line, end_line, score_rrf, f.list AS list, f.score AS score, f.symbol_kind AS symbol_kind, f.domain_id AS domain_id, f.trust_label AS trust_label, f.file_hash AS file_hash, '' AS why, f.path_prior AS path_prior, f.recency_prior AS recency_prior FROM f1),
hs AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY position) AS nth FROM (SELECT * FROM dr UNION ALL SELECT * FROM fu)), hr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY position, path) AS INTEGER) AS rank FROM hs WHERE nth = 1)"""
UP = f"up AS (SELECT path, unnest({ABOVE}) AS dir FROM cf)"
DOM = "dom AS (SELECT *, len(list_filter(string_split(root, '/'), lambda x: x <> '')) AS depth FROM (VALUES ('d0', 'src0', 'trusted', 10), ('d1', 'src1', 'untrusted', 5), ('d1docs', 'src1/docs', 'untrusted', 3), ('d2', 'src2', 'trusted', 7), ('deep', 'src0/docs', 'trusted', 2), ('all', 'src3/notes', 'untrusted', 0)) t(domain_id, root, trust_label, budget)), sch AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN trust_label = 'trusted' THEN 0 ELSE 1 END, depth DESC, root, domain_id) AS INTEGER) AS schedule_rank FROM dom)"
DENY = r"regexp_matches(path, '^.*/build/.*$|^(.*/)?.*_7.*\.txt$')"
ALLOW = r"regexp_matches(path, '^.*/docs/.*$|^.*/src/.*\.rs$|^.*/tests/.*$|^.*/notes/.*\.txt$|^src1/.*$')"
HIDDEN = r"regexp_matches(path, '(^|/)\s*\.')"
VERS = "v1 AS (SELECT path, file_hash, CAST(1 AS BIGINT) AS index_version FROM cf WHERE doc_id % 3 <> 0), v2 AS (SELECT path, sha256(file_hash || 'v2') AS file_hash, CAST(2 AS BIGINT) AS index_version FROM cf WHERE doc_id % 2 = 0)"
CNT = "cn AS (SELECT batch, path, count(*) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS batch, 'src' || CAST(user_id % 20 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) AS path FROM events) WHERE NOT starts_with(path, 'src7/') AND NOT regexp_matches(path, '^(.*/)?f.*13$') GROUP BY ALL), pl AS (SELECT batch, path, n, CAST(rank AS INTEGER) AS rank, total >= 80 AS bulk, CASE WHEN total < 80 OR rank <= 32 THEN 'hot' ELSE 'deferred' END AS lane FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, path) AS rank, count(*) OVER (PARTITION BY batch) AS total FROM cn))"
MS = "ms AS (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS ms FROM events)"
RUNS = "rn AS (SELECT event_type AS dataset, strftime(ts, '%Y%m%d') AS run, round(avg(value), 6) AS delta FROM events GROUP BY ALL)"
FTYPES = f"dft AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dir ORDER BY n DESC, file_type) AS INTEGER) AS rank FROM (SELECT dir, {FT} AS file_type, count(*) AS n FROM up GROUP BY ALL)) WHERE rank <= 5)"
TSYMS = f"{SYM}, dts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dir ORDER BY n DESC, symbol_name, symbol_kind) AS INTEGER) AS rank FROM (SELECT dir, symbol_name, symbol_kind, count(*) AS n FROM (SELECT unnest({ABOVE}) AS dir, symbol_name, symbol_kind FROM syms) GROUP BY ALL)) WHERE rank <= 8)"
KIDS = f"dr AS (SELECT dir, count(*) AS n_files FROM up GROUP BY dir), dk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY n_files DESC, child) AS INTEGER) AS rank FROM (SELECT {fill(DIR, p='dir')} AS parent, string_split(dir, '/')[-1] AS child, n_files FROM dr WHERE dir <> '.')) WHERE rank <= 6)"

COVER = f"cc AS (SELECT {fill(DIR, p='path')} AS key, max(doc_id % 4) AS priority FROM cf GROUP BY 1), sk AS (SELECT unnest(['src1/src', 'src3', 'src5/src', 'src2/.github']) AS spot), rp AS (SELECT key, arg_max(spot, length(spot)) AS representative FROM cc JOIN sk ON key = spot OR starts_with(key, spot || '/') GROUP BY key), cs AS (SELECT key, CASE WHEN representative = key THEN 'covered' WHEN representative IS NOT NULL THEN 'covered_by_parent' ELSE 'uncovered' END AS status, representative, CASE WHEN priority >= 3 THEN 'high' WHEN priority = 2 THEN 'medium' ELSE 'low' END AS bucket FROM cc LEFT JOIN rp USING (key))"
LEAF = "regexp_replace(CASE WHEN count(*) OVER (PARTITION BY leaf) > 1 THEN path ELSE leaf END, '[/_.-]+', ' ', 'g')"
PHRASE = r"regexp_replace(regexp_replace(regexp_replace(symbol_name, '^_+', ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-\s]+', ' ', 'g')"
PLAIN = r"replace(replace(regexp_replace(query, '(\.md)+$', ''), '_', ' '), '%20', ' ')"

SECRET = r"""regexp_matches(content, '(?i)api[_-]?key\s*[:=]\s*["'']?[a-z0-9_\-]{12,}') OR regexp_matches(content, '(?i)secret\s*[:=]\s*["'']?[a-z0-9_\-]{12,}') OR regexp_matches(content, '(?i)token\s*[:=]\s*["'']?[a-z0-9_\-]{12,}') OR regexp_matches(content, '-----BEGIN (RSA|EC|OPENSSH) PRIVATE KEY-----') OR regexp_matches(content, 'ghp_[A-Za-z0-9]{20,}')"""
ENTROPY = r"t AS (SELECT DISTINCT path, unnest(regexp_split_to_array(content, '\s+')) AS token FROM cf), l AS (SELECT * FROM t WHERE strlen(token) >= 20), c AS (SELECT token, ch, count(*) / CAST(strlen(token) AS DOUBLE) AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM (SELECT DISTINCT token FROM l)) WHERE ch <> '' GROUP BY token, ch), e AS (SELECT token, round(sum(-p * log2(p)), 6) AS entropy FROM c GROUP BY token), en AS (SELECT path, token, entropy FROM l JOIN e USING (token) WHERE entropy > {least})"
SESSIONS = "r AS (SELECT CAST(user_id AS VARCHAR) AS session, ts, max(CASE WHEN event_id % 50 = 0 THEN 1 END) AS explicit, bool_or(event_type = 'signup') AS refresh FROM events GROUP BY ALL), a AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 3 WHEN ts >= TIMESTAMP '2024-01-10' THEN 2 WHEN ts >= TIMESTAMP '2023-12-31' THEN 1 END AS active FROM r), p AS (SELECT *, CASE WHEN refresh OR row_number() OVER (PARTITION BY session ORDER BY ts) = 1 THEN active END AS pin FROM a), l AS (SELECT *, last_value(pin IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pinned FROM p), ses AS (SELECT session, epoch_us(ts) AS ts_us, CAST(coalesce(explicit, pinned) AS BIGINT) AS snapshot, CAST(active AS BIGINT) AS active, coalesce(explicit, pinned) <> active AS stale FROM l)"
RENDER = f"{CF}, {fill(PASS, n=3)}, {fill(LSEARCH, name='lh', src='pas', n=5)}, rh AS (SELECT query_id, '# Search: ' || query || chr(10) || string_agg(printf('## %d. `%s`', rank, path) || chr(10) || printf('- score: %.4f', 1.0::DOUBLE / rank), chr(10) ORDER BY rank) AS markdown FROM lh JOIN pas USING (query_id) GROUP BY query_id, query)"
HISTOGRAM = "b AS (SELECT event_type, CAST(CASE WHEN ms <= 1 THEN 1 WHEN ms <= 5 THEN 5 WHEN ms <= 10 THEN 10 WHEN ms <= 25 THEN 25 WHEN ms <= 50 THEN 50 WHEN ms <= 100 THEN 100 WHEN ms <= 250 THEN 250 WHEN ms <= 500 THEN 500 WHEN ms <= 1000 THEN 1000 ELSE 2000 END AS INTEGER) AS le, count(*) AS n FROM ms GROUP BY ALL), hg AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY le) AS BIGINT) AS cumulative FROM b)"
PERCENTILES = "o AS (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {src}) SELECT event_type, max(CASE WHEN i = CAST(floor((n - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) THEN ms END) AS p50, max(CASE WHEN i = CAST(floor((n - 1) * 0.95::DOUBLE + 0.5) AS BIGINT) THEN ms END) AS p95, max(ms) AS max_value, max(n) AS n FROM o GROUP BY event_type"
PAT = "pp AS (SELECT * FROM (VALUES ('d0', 'src0', 'trusted', ['docs/**'], ['*.bin']), ('d1', 'src1', 'untrusted', []::VARCHAR[], NULL), ('d2', 'src2', 'odd', ['/abs/*', ' ', 'a/../b'], ['**/*.tmp', 'C:' || chr(92) || 'x']), ('d3', 'src3', 'trusted', NULL, []::VARCHAR[])) t(domain_id, root, trust_label, allow, deny)), ef AS (SELECT domain_id, trust_label, CASE WHEN coalesce(len(allow), 0) = 0 THEN {general}::VARCHAR[] ELSE allow END AS allow, list_concat(['**/*.tmp'], list_filter(coalesce(deny, []), lambda x: x <> '**/*.tmp')) AS deny, coalesce(len(allow), 0) = 0 AS inherits_allow, CASE trust_label WHEN 'trusted' THEN 'trusted:tier_1' WHEN 'untrusted' THEN 'untrusted:tier_2' ELSE trust_label || ':invalid_trust' END AS priority_class FROM pp)"
FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(path) + 1), lambda i: ascii(substr(path, i, 1))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"

ORACLE_SQL: dict[str, str] = {
    "scan_corpus": f"WITH {CF} SELECT path, domain_id, trust_label, file_hash, size_bytes, modified_unix_ms, CAST(length(content) AS INTEGER) AS chars FROM cf",
    "first_seen": f"WITH {CF} SELECT path, doc_id, file_hash FROM cf",
    "raw_lookup": f"WITH {CF} SELECT path, content FROM cf WHERE path IN ('src0/docs/doc_0.md', 'src1/src/doc_1.rs', 'src1/src/doc_21.rs', 'src2/x')",
    "list_children": f"WITH {CF} SELECT split_part(substr(path, 6), '/', 1) AS name, CASE WHEN instr(substr(path, 6), '/') > 0 THEN 'dir' ELSE 'file' END AS kind, count(*) AS n_files FROM cf WHERE path LIKE 'src1/%' GROUP BY ALL",
    "file_types": f"WITH {CF} SELECT {FT} AS file_type, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM cf GROUP BY 1",
    "path_classes": f"WITH {CF} SELECT path, " + ", ".join(f"{cls(c)} AS {c}" for c in CLASS) + " FROM cf",
    "size_filter": f"WITH {CF} SELECT path, size_bytes FROM cf WHERE size_bytes * 500 // 1048576 > 1",
    "content_hash": f"WITH {CF} SELECT path, sha256(content) AS hash FROM cf",
    "policy_filter": f"WITH {CF} SELECT path FROM cf WHERE NOT {DENY} AND NOT {HIDDEN} AND {ALLOW}",
    "policy_decision": f"WITH {CF} SELECT path, NOT {DENY} AND NOT {HIDDEN} AND {ALLOW} AS allowed, CASE WHEN {DENY} THEN 'deny_glob' WHEN {HIDDEN} THEN 'hidden' WHEN {ALLOW} THEN 'allow_glob' ELSE 'deny_by_default' END AS reason FROM cf",
    "traverse_decision": f"WITH {CF}, {UP}, ds AS (SELECT DISTINCT dir AS path FROM up WHERE dir <> '.') SELECT path AS dir, NOT {DENY} AND NOT {HIDDEN} AS visit FROM ds",
    "resolve_owner": f"WITH {CF}, {DOM} SELECT path, o.owner, o.root, o.owner_trust, o.schedule_rank FROM (SELECT path, arg_min({{'owner': s.domain_id, 'root': root, 'owner_trust': s.trust_label, 'schedule_rank': schedule_rank}}, schedule_rank) AS o FROM cf JOIN sch s ON path = root OR starts_with(path, root || '/') GROUP BY path)",
    "domain_schedule": f"WITH {DOM} SELECT domain_id, CAST(depth AS INTEGER) AS depth, schedule_rank FROM sch",
    "domain_violations": "WITH b AS (SELECT * FROM (VALUES ('d0', 'src0', 'trusted', 10), ('d1', 'src1', 'untrusted', 5), ('d1docs', 'src1/docs', 'untrusted', 3), ('d2', 'src2', 'trusted', 7), ('deep', 'src0/docs', 'trusted', 2), ('all', 'src3/notes', 'untrusted', 0), ('d0', 'src9', 'trusted', 1), ('', 'src8', 'odd', 1), ('x', '', 'trusted', -1), ('y', 'a/../b', 'trusted', 1), ('z', 'src2', 'trusted', 1)) t(domain_id, root, trust_label, budget)) SELECT domain_id, root, 'empty_id' AS error FROM b WHERE domain_id = '' UNION ALL SELECT domain_id, root, 'empty_root' FROM b WHERE root = '' UNION ALL SELECT domain_id, root, 'unknown_trust' FROM b WHERE trust_label NOT IN ('trusted', 'untrusted') UNION ALL SELECT domain_id, root, 'traversal_root' FROM b WHERE list_contains(string_split(root, '/'), '..') UNION ALL SELECT domain_id, root, 'negative_budget' FROM b WHERE budget < 0 UNION ALL SELECT domain_id, root, 'duplicate_id' FROM b WHERE domain_id IN (SELECT domain_id FROM b GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT domain_id, root, 'duplicate_root' FROM b WHERE root IN (SELECT root FROM b GROUP BY 1 HAVING count(*) > 1)",
    "overlap_pairs": f"WITH {DOM} SELECT a.domain_id AS a_id, b.domain_id AS b_id FROM sch a, sch b WHERE a.schedule_rank < b.schedule_rank AND (a.root = b.root OR starts_with(a.root, b.root || '/') OR starts_with(b.root, a.root || '/'))",
    "prune_targets": f"WITH {CF}, t0 AS (SELECT {fill(DIR, p='path')} AS path FROM cf), t AS (SELECT path, length(path) % 2 = 0 AS recursive, 1 AS priority FROM t0 UNION ALL SELECT 'src1', TRUE, 2 UNION ALL SELECT 'src2', FALSE, 3), m AS (SELECT path, bool_or(recursive) AS recursive, max(priority) AS priority FROM t GROUP BY path) SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m c WHERE c.recursive AND starts_with(m.path, c.path || '/'))",
    "domain_budget": f"WITH {CF}, s AS (SELECT domain_id, path, size_bytes * 500 // 1048576 <= 1 AS fits FROM cf), b AS (SELECT *, coalesce(sum(CAST(fits AS INTEGER)) OVER (PARTITION BY domain_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM s) SELECT domain_id, path, CASE WHEN bef >= 20 THEN 'domain_budget_capped' WHEN NOT fits THEN 'too_large' ELSE 'indexed' END AS parse_status FROM b",
    "schedule_order": f"WITH {CF}, {DOM}, r AS (SELECT split_part(root, '/', 1) AS domain_id, min(schedule_rank) AS r FROM sch GROUP BY 1) SELECT hot, domain_id, r, path, CAST(row_number() OVER (PARTITION BY hot, domain_id ORDER BY path) AS INTEGER) AS place FROM (SELECT *, modified_unix_ms >= {AS_OF_MS - 24 * 3600000} AS hot FROM cf) JOIN r USING (domain_id)",
    "trust_counts": f"WITH {CF} SELECT dir, trust_label, count(*) AS n FROM (SELECT unnest({ABOVE}) AS dir, trust_label FROM cf) GROUP BY ALL",
    "trust_levels": "SELECT label, CASE WHEN lower(label) = 'untrusted' THEN 'untrusted' ELSE 'trusted' END AS ranking, CASE WHEN lower(label) = 'trusted' THEN 'trusted' ELSE 'untrusted' END AS guard FROM (VALUES ('trusted'), ('Untrusted'), ('workspace_default'), ('TRUSTED')) t(label)",
    "secret_scan": f"WITH {CF} SELECT path FROM cf WHERE {SECRET}",
    "contains_secret": f"WITH {CF}, {fill(ENTROPY, least=4.2)} SELECT path FROM cf WHERE {SECRET} UNION SELECT path FROM en",
    "entropy_tokens": f"WITH {CF}, {fill(ENTROPY, least=3.0)} SELECT * FROM en",
    "default_query": f"WITH {CF} SELECT path, coalesce(list_filter(list_transform(string_split(content, chr(10))[1:25], lambda x: {trim('x')}), lambda x: length(x) >= 5 AND regexp_matches(x, '[A-Za-z0-9]'))[1], string_split(path, '/')[-1]) AS query FROM cf",
    "leaf_query_text": f"WITH {CF}, l AS (SELECT path, 'doc_' || CAST(doc_id % 300 AS VARCHAR) AS leaf FROM cf) SELECT path, {trim(LEAF)} AS query FROM l",
    "path_facts": f"WITH {CF} SELECT path, {HIDDEN} AS hidden, TRUE AS climbs, path AS normal, {fill(DIR, p='path')} AS dir, string_split(path, '/')[-1] AS base, array_to_string({ABOVE}, '|') AS above FROM cf",
    "chunks_all": f"WITH {CF}, {CHUNKS} SELECT path, chunk_id, start_line, end_line, md5(content) AS hash, symbol FROM chunks",
    "chunk_lines": f"WITH {CF}, {fill(LIN, src='cf')} SELECT path, chunk_id, start_line, end_line, md5(content) AS hash FROM lin",
    "chunk_paragraphs": f"WITH {CF}, {fill(PAR, src='cf')} SELECT path, chunk_id, md5(content) AS hash FROM par",
    "chunk_config": f"WITH {CF}, {fill(CFG, src='cf')} SELECT path, chunk_id, symbol, md5(content) AS hash FROM cfg",
    "extract_symbols": f"WITH {CF}, {SYM} SELECT * FROM syms",
    "mine_symbols": f"WITH {CF}, m AS (SELECT path, regexp_extract(l, '^\\s*(?:pub\\s+)?(?:export\\s+)?(?:async\\s+)?(?:def|fn|function|class|struct|enum|trait|interface)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM (SELECT path, unnest({LINES}) AS l FROM cf WHERE {cls('code')})) SELECT DISTINCT path, name FROM m WHERE length(name) >= 4 AND NOT starts_with(name, '__') AND lower(name) NOT IN ('main', 'test', 'self', 'init')",
    "hash_embed": f"WITH {CF}, {fill(EMB, name='em', key='path', text='content', src='cf')} SELECT key AS path, CAST(bucket AS INTEGER) AS bucket, round(weight, 6) AS weight FROM em",
    "symbol_to_phrase": f"WITH {CF}, {SYM} SELECT DISTINCT symbol_name, lower({trim(chr(114) + 'egexp_replace(regexp_replace(regexp_replace(symbol_name, ' + chr(39) + '^_+' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '([a-z0-9])([A-Z])' + chr(39) + ', ' + chr(39) + '\\1 \\2' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[_\\-\\s]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) AS phrase FROM syms",
    "query_terms": f"WITH {LIT} SELECT CAST(query_id AS BIGINT) AS query_id, array_to_string({fill(TERMS, x='query')}, '|') AS terms, array_to_string({fill(OVER, x='query')}, '|') AS overlap, array_to_string({fill(SEARCH, x='query')}, '|') AS search FROM lit",
    "symbol_variants": f"WITH {LIT}, {fill(VAR, src='lit')} SELECT CAST(query_id AS BIGINT) AS query_id, string_agg(v, '|' ORDER BY o) AS variants FROM vr GROUP BY query_id",
    "normalize_query": f"WITH {LIT} SELECT CAST(query_id AS BIGINT) AS query_id, {trim(chr(114) + 'eplace(replace(regexp_replace(query, ' + chr(39) + '(\\.md)+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) + '%20' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} AS normal FROM lit",
    "classify_queries": f"WITH {LIT}, {fill(INTENTS, src='lit')} SELECT * REPLACE (CAST(query_id AS BIGINT) AS query_id) FROM qi",
    "adaptive_limits": f"WITH {LIT}, {fill(INTENTS, src='lit')}, b AS (SELECT unnest([FALSE, TRUE]) AS x), f AS (SELECT a.x AS symbol_hits, b2.x AS bm25_hits, c.x AS docs_hint FROM b a, b b2, b c) SELECT CAST(query_id AS BIGINT) AS query_id, symbol_hits, bm25_hits, docs_hint, CAST(CASE WHEN is_workflow OR is_unit THEN 6 WHEN is_config OR is_command THEN 8 WHEN is_schema THEN 10 WHEN is_narrative THEN 8 ELSE 20 END AS INTEGER) AS bm25_n, CAST(CASE WHEN is_literal OR (is_symbol AND symbol_hits) THEN NULL WHEN is_narrative AND docs_hint THEN CASE WHEN is_schema THEN 8 WHEN len({fill(OVER, x='query')}) >= 7 THEN NULL ELSE 6 END WHEN is_narrative AND bm25_hits THEN CASE WHEN is_schema THEN 8 WHEN len({fill(OVER, x='query')}) <= 4 THEN 6 ELSE 8 END ELSE 20 END AS INTEGER) AS vector_n FROM qi, f",
    "symbol_exact": f"WITH {CF}, {LIT}, {fill(EXACT, q='lit', n=10)} SELECT CAST(query_id AS BIGINT) AS query_id, path, symbol_name, symbol_kind, line_start, exported, tier, rank FROM se",
    "symbol_prefix": f"WITH {CF}, {LIT}, {SYM}, {fill(VAR, src='lit')}, {PREFIXED} SELECT * REPLACE (CAST(query_id AS BIGINT) AS query_id) FROM sp",
    "bm25_topk": f"WITH {CF}, {LIT}, {CHUNKS}, {bm25('lit')} SELECT * REPLACE (CAST(query_id AS BIGINT) AS query_id) FROM bm",
    "bm25_passages": f"WITH {CF}, {fill(PASS, n=5)}, {CHUNKS}, {bm25('pas')} SELECT * FROM bm",
    "bm25_path_filtered": f"WITH {CF}, {LIT}, lp AS (SELECT * FROM lit UNION ALL SELECT * FROM (VALUES {PUSH_ROWS}) t(query_id, query)), {fill(INTENTS, src='lp')}, {CHUNKS}, {bm25('qi', '20', PUSHED)} SELECT * REPLACE (CAST(query_id AS BIGINT) AS query_id) FROM bm",
    "bm25_variants": f"WITH {fill(PASS, n=5)}, {LIT}, b AS (SELECT * FROM pas UNION ALL SELECT query_id + 100000, query FROM lit), v AS (SELECT query_id, unnest({WAYS}) AS v, unnest(range(3)) AS o FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, {fill(LOW, x='v')} ORDER BY o) AS nth FROM v WHERE v <> '') SELECT b.query_id, coalesce(s, '') AS variants FROM b LEFT JOIN (SELECT query_id, string_agg(v, '|' ORDER BY o) AS s FROM k WHERE nth = 1 GROUP BY query_id) USING (query_id)",
    "hybrid_search": f"WITH {HYBRID} SELECT query_id, rank, path, domain_id, start_line, end_line, file_hash, CAST(1 AS BIGINT) AS snapshot_version, CAST(1 AS BIGINT) AS active_version, score_rrf, CASE WHEN list < 2 THEN score END AS score_symbol, CASE WHEN list = 2 THEN score END AS score_bm25, CASE WHEN list = 3 THEN score END AS score_vector, (['symbol', 'symbol', 'bm25', 'vector'])[list + 1] AS source, symbol_kind, FALSE AS stale, trust_label, CASE WHEN lower(trust_label) = 'untrusted' THEN 'untrusted' ELSE 'trusted' END AS trust_level, (['exact symbol match', 'prefix symbol match', 'bm25 keyword match', 'vector semantic similarity'])[list + 1] || why || '; prior(path=' || {fill(TWO_DIGITS, x='path_prior')} || ', recency=' || {fill(TWO_DIGITS, x='recency_prior')} || ')' AS why_selected FROM hr WHERE rank <= 5 AND NOT {DENY} AND NOT {HIDDEN}",
    "literal_search_any_case": f"WITH {CF}, {fill(PASS, n=4)}, {fill(LSEARCH, name='lh', src='pas', n=20).replace('contains(content, query)', 'contains(lower(content), lower(query))')} SELECT * FROM lh",
    "literal_search": f"WITH {CF}, {fill(PASS, n=8)}, {fill(LSEARCH, name='lh', src='pas', n=20)} SELECT * FROM lh",
    "cosine_topk": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.v, q.v), 6) AS score FROM e, e q WHERE q.vec_id % 100 = 0) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 20",
    "vec_pad_truncate": "SELECT vec_id, CAST(100 AS INTEGER) AS n_long, round(list_sum(embedding::DOUBLE[]), 4) AS sum_long, CAST(16 AS INTEGER) AS n_short, round(list_sum((embedding::DOUBLE[])[1:16]), 4) AS sum_short FROM embeddings WHERE embedding IS NOT NULL",
    "vector_search": f"WITH {CF}, {fill(PASS, n=12)}, {CHUNKS}, {fill(EMB, name='ce', key='key', text='content', src='chunks')}, {fill(EMB, name='qe', key='query_id', text='query', src='pas')}, s AS (SELECT qe.key AS query_id, ce.key, round(sum(ce.weight * qe.weight), 6) AS score FROM ce JOIN qe USING (bucket) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10",
    "vector_pool": f"WITH {CF}, {fill(PASS, n=12)}, {CHUNKS}, {fill(EMB, name='ce', key='key', text='content', src='chunks')}, {fill(EMB, name='qe', key='query_id', text='query', src='pas')}, s AS (SELECT qe.key AS query_id, ce.key, round(sum(ce.weight * qe.weight), 6) AS score FROM (SELECT * FROM ce WHERE key IN (SELECT DISTINCT key FROM ce ORDER BY key LIMIT 500)) ce JOIN qe USING (bucket) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10",
    "rrf_fuse": f"WITH {CF}, {LISTS} SELECT * FROM rf",
    "dedupe_by_path": f"WITH {CF}, {LISTS}, o AS (SELECT *, {fill(DIR, p='key')} AS path, row_number() OVER (PARTITION BY query_id ORDER BY score_rrf DESC, key) AS pos FROM rf), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) AS nth FROM o) WHERE nth = 1) SELECT * FROM (SELECT query_id, path, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, score_rrf FROM f) WHERE rank <= 5",
    "path_prior": f"WITH {CF} SELECT path, round({PRIOR}, 6) AS prior FROM cf",
    "overlap_prior": f"WITH {PAIRS} SELECT CAST(query_id AS BIGINT) AS query_id, path, round({overlap('path', 0.35)}, 6) AS path_overlap, round({overlap('base', 0.55)}, 6) AS name_overlap FROM pr",
    "recency_prior": f"WITH {CF} SELECT path, round({RECENCY}, 6) AS prior FROM cf",
    "intent_priors": f"WITH {PAIRS} SELECT CAST(query_id AS BIGINT) AS query_id, path, " + ", ".join(f"round({factor(n)}, 6) AS {n}" for n in FACTORS) + " FROM pr",
    "priors": f"WITH {PAIRS} SELECT CAST(query_id AS BIGINT) AS query_id, path, round({PRIOR} * {overlap('path', 0.35)} * {overlap('base', 0.55)} * ({RECENCY}) * " + " * ".join(f"({factor(n)})" for n in FACTORS) + ", 10) AS prior FROM pr",
    "symbol_fast_path": f"WITH {CF}, {LIT}, {fill(INTENTS, src='lit')}, qs AS (SELECT * FROM qi WHERE is_symbol), {fill(EXACT, q='qs', n=50)}, h AS (SELECT query_id, path, rank, round(2.0::DOUBLE * {PRIOR}, 6) AS score FROM se), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS pos FROM h), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) AS nth FROM o) WHERE nth = 1) SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, score FROM f) WHERE rank <= 5",
    "first_relevant_rank": f"WITH {EVAL} SELECT query_id, first_rank FROM fr",
    "eval_metrics": f"WITH {EVAL} SELECT 'set' || CAST(query_id % 3 AS VARCHAR) AS dataset, {METRICS} FROM fr GROUP BY 1",
    "eval_metrics_micro": f"WITH {EVAL} SELECT {METRICS} FROM fr",
    "head_to_head": f"WITH {TWO}, a AS (SELECT {METRICS} FROM fr), b AS (SELECT {METRICS} FROM ft2) SELECT a.n_queries, a.recall, a.mrr, b.recall AS their_recall, b.mrr AS their_mrr, round(a.recall - b.recall, 6) AS delta_recall, round(a.mrr - b.mrr, 6) AS delta_mrr FROM a, b",
    "query_gap": f"WITH {TWO}, g AS (SELECT fr.first_rank AS o, ft2.first_rank AS t FROM fr JOIN ft2 USING (query_id)), c AS (SELECT 'semantic_miss' AS gap FROM g WHERE o IS NULL UNION ALL SELECT 'baseline_miss' FROM g WHERE t IS NULL UNION ALL SELECT 'rank_lag' FROM g WHERE o > t UNION ALL SELECT 'gain' FROM g WHERE o < t UNION ALL SELECT 'equal' FROM g WHERE o = t) SELECT gap, count(*) AS n FROM c GROUP BY gap",
    "release_gate": f"WITH {EVAL}, m AS (SELECT {METRICS} FROM fr), c AS (SELECT 'recall' AS \"check\", recall AS value, 0.9::DOUBLE AS threshold FROM m UNION ALL SELECT 'mrr', mrr, 0.8 FROM m UNION ALL SELECT 'symbol_hit_rate', symbol_hit_rate, 0.99 FROM m UNION ALL SELECT 'n_queries', n_queries::DOUBLE, 20 FROM m), p AS (SELECT *, value >= threshold AS passed FROM c) SELECT * FROM p UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM p",
    "dir_rollup": f"WITH {CF}, {UP} SELECT dir, count(*) AS n_files FROM up GROUP BY dir",
    "dir_file_types": f"WITH {CF}, {UP}, {FTYPES} SELECT * FROM dft",
    "dir_top_symbols": f"WITH {CF}, {TSYMS} SELECT * FROM dts",
    "dir_children": f"WITH {CF}, {UP}, {KIDS} SELECT * FROM dk",
    "dir_enrichment": f"WITH {CF}, {UP}, {FTYPES}, {TSYMS}, {KIDS} SELECT dir, CASE WHEN contains(lower(dir), 'test') THEN 'tests' WHEN contains(lower(dir), 'doc') THEN 'documentation' WHEN contains(lower(dir), 'service') OR contains(lower(dir), 'api') THEN 'services' ELSE 'general' END AS focus, coalesce((SELECT string_agg(file_type || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY rank) FROM dft WHERE dft.dir = dr.dir), 'none') AS types, coalesce((SELECT string_agg(symbol_kind || ' ' || symbol_name, ', ' ORDER BY rank) FROM dts WHERE dts.dir = dr.dir), 'none') AS symbols, coalesce((SELECT string_agg(child || ' ' || CAST(n_files AS VARCHAR), ', ' ORDER BY rank) FROM dk WHERE dk.parent = dr.dir), 'none') AS children FROM dr",
    "dir_overview": f"WITH {CF}, {UP}, {KIDS} SELECT dir, '# ' || dir || ': ' || CAST(n_files AS VARCHAR) || ' files' || CASE WHEN n_files % 2 = 0 THEN chr(10) || chr(10) || 'about ' || dir ELSE '' END AS overview FROM dr",
    "render_hits": f"WITH {RENDER} SELECT * FROM rh",
    "hit_paths": f"WITH {CF}, {fill(PASS, n=3)}, {fill(LSEARCH, name='lh', src='pas', n=5)} SELECT query_id, CAST(rank - 1 AS INTEGER) AS place, path FROM lh",
    "active_version": "SELECT CAST(5 AS BIGINT) AS next_version, CAST(2 AS BIGINT) AS active_version",
    "publish_snapshot": "SELECT CAST(version AS BIGINT) AS version, CASE WHEN version = 3 THEN 'active' WHEN state = 'active' THEN 'obsolete' ELSE state END AS state FROM (VALUES (1, 'obsolete'), (2, 'active'), (3, 'staging'), (4, 'staging')) t(version, state)",
    "snapshot_read": f"WITH {CF}, {VERS} SELECT path, file_hash, index_version FROM v2",
    "upsert_latest": f"WITH {CF}, {VERS} SELECT * FROM v2 UNION ALL SELECT * FROM v1 WHERE path NOT IN (SELECT path FROM v2)",
    "delete_paths": f"WITH {CF}, {VERS} SELECT path, file_hash FROM v1 WHERE path NOT IN (SELECT path FROM v2)",
    "session_snapshots": f"WITH {SESSIONS} SELECT * FROM ses",
    "session_status": f"WITH {SESSIONS}, la AS (SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts_us DESC) = 1) SELECT session, '{{\"mode\":\"pinned\",\"session\":\"' || session || '\",\"snapshot_version\":' || CAST(snapshot AS VARCHAR) || ',\"active_version\":' || CAST(active AS VARCHAR) || ',\"stale\":' || CAST(stale AS VARCHAR) || ',\"last_access_unix_ms\":' || CAST(ts_us // 1000 AS VARCHAR) || '}}' AS status FROM la",
    "debounce_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, b",
    "change_counts": f"WITH {CNT} SELECT * FROM cn",
    "reindex_plan": f"WITH {CNT} SELECT * FROM pl",
    "phase_progress": f"WITH {CNT}, h AS (SELECT *, CAST(coalesce(sum(CAST(lane = 'hot' AS INTEGER)) OVER (PARTITION BY batch ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS hot_left FROM pl) SELECT batch, path, rank, hot_left, CASE WHEN hot_left > 0 THEN 'p1_hotset' ELSE 'p3_backfill' END AS phase FROM h",
    "pending_status": f"WITH {CNT}, o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY path) AS i FROM pl WHERE lane = 'deferred') SELECT batch, count(*) AS n_deferred, string_agg(path, ',' ORDER BY path) FILTER (WHERE i <= 20) AS pending FROM o GROUP BY batch",
    "latency_percentiles": f"WITH {MS}, {fill(PERCENTILES, src='ms')}",
    "latency_sample": f"WITH s0 AS (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events), s1 AS (SELECT event_type, arg_max(ms, nth) AS ms FROM s0 GROUP BY event_type, (nth - 1) % 50), {fill(PERCENTILES, src='s1')}",
    "median_latency": f"WITH {MS}, l AS (SELECT event_type, list_sort(list(ms)) AS l FROM ms GROUP BY event_type) SELECT event_type, CAST((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) // 2 AS BIGINT) AS median FROM l",
    "latency_histogram": f"WITH {MS}, {HISTOGRAM} SELECT * FROM hg",
    "metrics_text": f"WITH {MS}, {HISTOGRAM} SELECT event_type, '# TYPE skerry_latency_ms histogram' || chr(10) || string_agg('skerry_latency_ms_bucket{{event_type=\"' || event_type || '\",le=\"' || CAST(le AS VARCHAR) || '\"}} ' || CAST(cumulative AS VARCHAR), chr(10) ORDER BY le) || chr(10) || 'skerry_latency_ms_bucket{{event_type=\"' || event_type || '\",le=\"+Inf\"}} ' || CAST(max(cumulative) AS VARCHAR) || chr(10) || 'skerry_latency_ms_count{{event_type=\"' || event_type || '\"}} ' || CAST(max(cumulative) AS VARCHAR) AS text FROM hg GROUP BY event_type",
    "slowest_topk": "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 5",
    "drift_summary": f"WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY run DESC) AS i FROM rn) SELECT dataset, count(*) AS n_runs, round(min(delta), 6) AS min_delta, round(avg(delta), 6) AS avg_delta, round(max(delta), 6) AS max_delta, max(run) AS latest FROM o WHERE i <= 7 GROUP BY dataset",
    "complete_nights": "SELECT strftime(ts, '%Y-%m-%d') AS night FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_type IN ('click', 'view', 'signup', 'error', 'purchase') THEN event_type END) = 5",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1",
    "coverage_status": f"WITH {CF}, {COVER} SELECT * FROM cs",
    "coverage_counts": f"WITH {CF}, {COVER} SELECT status, bucket, count(*) AS n FROM cs GROUP BY ALL",
    "identity_dedupe": "WITH c AS (SELECT sha256(text) AS identity, source || '/' || CAST(doc_id AS VARCHAR) AS path, doc_id % 2 = 1 AS is_mirror, doc_id % 3 AS n_files, doc_id % 5 AS n_code FROM documents) SELECT identity, path, is_mirror, n_files, n_code FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY is_mirror, n_files DESC, n_code DESC, length(path), path) AS i FROM c) WHERE i = 1",
    "candidate_select": f"WITH {RUNS}, c AS (SELECT dataset AS name, round(avg(delta) / 1000, 4) AS mrr, round(max(delta) / 1000, 4) AS recall, 1.0::DOUBLE AS symbol, round(max(delta), 3) AS p95 FROM rn GROUP BY 1) SELECT *, round(1000 * mrr + 100 * recall + 100 * symbol - 0.01::DOUBLE * p95, 6) AS score FROM c ORDER BY score DESC, mrr DESC, recall DESC, p95, name LIMIT 1",
    "split_suite": "WITH s AS (SELECT lang AS dataset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents) SELECT dataset, doc_id, CASE WHEN row_number() OVER (PARTITION BY dataset ORDER BY position % 2, position) <= 8 THEN 'tune' ELSE 'holdout' END AS split FROM s",
    "curated_split": f"WITH {CF}, {SYM}, g AS (SELECT lower(symbol_name) AS name, count(DISTINCT path) AS n, min(path) AS path FROM syms GROUP BY 1), o AS (SELECT name, path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY name) AS i FROM g WHERE n <= 3 AND length(name) >= 4) SELECT name, path, 'b' || lpad(CAST(i AS VARCHAR), CAST(greatest(2, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS id, CASE WHEN i % 2 = 1 THEN 'tune' ELSE 'holdout' END AS split, regexp_replace(name, '_+', ' ', 'g') AS phrase FROM o",
    "redact_hits": f"WITH {CF}, {fill(PASS, n=3)}, {fill(LSEARCH, name='lh', src='pas', n=10)} SELECT * FROM lh WHERE NOT {DENY} AND NOT {HIDDEN}",
    "virtual_paths": f"WITH {CF} SELECT path, domain_id || '/' || path AS virtual, domain_id AS top, path AS single FROM cf",
    "resolve_virtual": f"WITH {CF}, {DOM}, n AS (SELECT CASE domain_id WHEN 'src0' THEN 'd0/' WHEN 'src1' THEN 'd1docs/' ELSE 'none/' END || substr(path, instr(path, '/') + 1) AS path FROM cf UNION ALL SELECT unnest(['d0/../x', 'd2', '/d2/a' || chr(92) || 'b/'])), m AS (SELECT path, trim(replace(path, chr(92), '/'), '/') AS p FROM n), s AS (SELECT path, split_part(p, '/', 1) AS domain_id, array_to_string(string_split(p, '/')[2:], '/') AS relative FROM m), j AS (SELECT s.path, s.domain_id, relative, CASE WHEN relative = '' THEN root ELSE root || '/' || relative END AS disk_path, dom.trust_label FROM s JOIN dom USING (domain_id) WHERE NOT list_contains(string_split(relative, '/'), '..')), o AS (SELECT disk_path, arg_min(sch.domain_id, schedule_rank) AS owner FROM (SELECT DISTINCT disk_path FROM j) JOIN sch ON disk_path = root OR starts_with(disk_path, root || '/') GROUP BY disk_path) SELECT path, domain_id, relative, disk_path, trust_label FROM j JOIN o USING (disk_path) WHERE owner = domain_id",
    "domain_patterns": f"WITH {fill(PAT, general="['src/**']")} SELECT domain_id, array_to_string(allow, '|') AS allow, array_to_string(deny, '|') AS deny, inherits_allow, priority_class FROM ef",
    "pattern_violations": f"WITH {fill(PAT, general='[]')}, e AS (SELECT domain_id, 'allow' AS field, allow AS ps FROM ef UNION ALL SELECT domain_id, 'deny', deny FROM ef), p AS (SELECT domain_id, field, unnest(ps) AS pattern FROM e) SELECT domain_id, field, NULL AS pattern, 'no_patterns' AS error FROM e WHERE len(ps) = 0 UNION ALL SELECT domain_id, field, pattern, 'empty' FROM p WHERE trim(pattern) = '' UNION ALL SELECT domain_id, field, pattern, 'absolute' FROM p WHERE trim(pattern) <> '' AND (trim(pattern)[1] IN ('/', chr(92)) OR regexp_matches(trim(pattern), '^[A-Za-z]:')) UNION ALL SELECT domain_id, field, pattern, 'traversal' FROM p WHERE list_contains(string_split(replace(pattern, chr(92), '/'), '/'), '..')",
    "domain_counts": f"WITH {DOM} SELECT count(*) FILTER (WHERE budget > 0) AS budgeted, count(*) FILTER (WHERE trust_label = 'trusted') AS trusted, count(*) AS domains FROM dom",
    "scan_targets": "SELECT * FROM (VALUES ('d0', 'd0/src', FALSE, 1), ('d0', 'd0/docs/a.md', FALSE, 1), ('d0', 'd0/docs', TRUE, 1), ('d1', 'd1', TRUE, 1), ('d2', 'd2/x/y/z', FALSE, 1), ('d2', 'd2/a', TRUE, 1), ('d3', 'd3', TRUE, 1), ('d4', 'd4', FALSE, 1), ('d4', 'd4/lib', TRUE, 1)) t(domain_id, path, recursive, priority)",
    "fnv_hash": f"WITH {CF}, h AS (SELECT path, {FNV} AS h FROM cf) SELECT path, CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT) AS inode FROM h",
    "slugs": f"WITH {LIT}, a AS (SELECT * FROM lit UNION ALL SELECT * FROM (VALUES (90, ' -- '), (91, 'Ä b__C')) t(query_id, query)) SELECT CAST(query_id AS BIGINT) AS query_id, coalesce(nullif(trim(regexp_replace(lower(query), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'dataset') AS slug, lower(regexp_replace({trim('query')}, '\\s+', ' ', 'g')) AS normal, query || '|2|3' AS key FROM a",
    "lower_distinct": f"WITH {LIT}, m AS (SELECT query_id, {MADE} AS m FROM lit), v AS (SELECT query_id, {fill(LOW, x='v')} AS v, min(o) AS o FROM (SELECT query_id, unnest(m) AS v, unnest(range(8)) AS o FROM m) WHERE v <> '' AND v <> '_' GROUP BY ALL) SELECT CAST(query_id AS BIGINT) AS query_id, string_agg(v, '|' ORDER BY o) AS variants FROM v GROUP BY 1",
    "text_samples": f"WITH {CF}, s0 AS (SELECT path, unnest(string_split(content, chr(10) || chr(10))) AS raw, unnest(range(len(string_split(content, chr(10) || chr(10))))) AS place FROM cf WHERE regexp_matches(lower(path), '\\.(rs|py|ts|tsx|js|jsx|java|go|md|txt|toml|yaml|yml|json)$')), s1 AS (SELECT path, CAST(place AS INTEGER) AS place, {trim('raw')} AS sample FROM s0) SELECT path, place, md5(substr(sample, 1, 1200)) AS hash FROM s1 WHERE strlen(sample) >= 20 ORDER BY path, place LIMIT 200",
    "soak_gate": f"WITH {MS}, al AS (SELECT 'all' AS event_type, ms FROM ms), {fill(PERCENTILES, src='al').replace('SELECT event_type, max(CASE WHEN i', ', pc AS (SELECT event_type, max(CASE WHEN i', 1)}), c AS (SELECT 'p95' AS \"check\", CAST(p95 AS DOUBLE) AS value, 1500.0::DOUBLE AS threshold FROM pc UNION ALL SELECT 'errors', CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE), 100.0 FROM events UNION ALL SELECT 'rss_mb', NULL, 512.0), k AS (SELECT *, coalesce(value <= threshold, FALSE) AS passed FROM c) SELECT * FROM k UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM k",
    "hit_ratio": "SELECT user_id, CASE WHEN h + m = 0 THEN 0.0 ELSE round(h / CAST(h + m AS DOUBLE), 6) END AS ratio FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS h, count(*) FILTER (WHERE event_type = 'click') AS m FROM events GROUP BY 1)",
    "sweep_grid": f"WITH {two(20)}, g AS (SELECT b AS backend, t AS top FROM (SELECT unnest(['bm25', 'literal']) AS b), (SELECT unnest([5, 10, 20]) AS t)), x AS (SELECT 'bm25' AS backend, query_id, first_rank FROM fr UNION ALL SELECT 'literal', query_id, first_rank FROM ft2), y AS (SELECT backend, top, CASE WHEN first_rank <= top THEN first_rank END AS first_rank FROM g JOIN x USING (backend)) SELECT backend, top, count(*) AS n_queries, round(avg(CAST(first_rank IS NOT NULL AS DOUBLE)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr FROM y GROUP BY ALL",
    "sweep_best": "WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id % 4 AS part, round(count(*) / CAST(count(DISTINCT user_id) AS DOUBLE), 6) AS throughput FROM events GROUP BY ALL) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY throughput DESC, day, part) = 1",
    "promotion_states": "WITH k AS (SELECT (['promote_candidate', 'harden_existing', 'expand_parent_root', 'add_strict_holdout', 'monitor', 'review', 'harden_existing'])[doc_id % 7 + 1] AS state FROM documents), n AS (SELECT unnest(['promote_candidate', 'harden_existing', 'expand_parent_root', 'add_strict_holdout', 'monitor', 'review']) AS state) SELECT n.state, count(k.state) AS n FROM n LEFT JOIN k USING (state) GROUP BY 1",
    "presets": "SELECT * FROM (VALUES ('symbol_focus', 'symbol_exact_boost', 3.0::DOUBLE), ('symbol_focus', 'symbol_prefix_boost', 1.5), ('symbol_focus', 'code_path_boost', 1.3), ('symbol_focus', 'docs_path_penalty', 0.8), ('symbol_focus', 'test_path_penalty', 0.9), ('code_focus', 'symbol_exact_boost', 2.8), ('code_focus', 'symbol_prefix_boost', 1.4), ('code_focus', 'code_path_boost', 1.4), ('code_focus', 'docs_path_penalty', 0.7), ('code_focus', 'test_path_penalty', 0.85), ('code_focus', 'topn_bm25', 30), ('code_focus', 'topn_vector', 30)) t(preset, setting, value)",
    "profile_matrix": f"WITH {TWO} SELECT 'full_text' AS profile, {METRICS} FROM fr UNION ALL SELECT 'literal', {METRICS} FROM ft2",
    "change_kinds": "WITH e AS (SELECT 'src' || CAST(user_id % 20 AS VARCHAR) || '/f' || CAST(user_id AS VARCHAR) AS path, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'removed' ELSE 'modified' END AS what FROM events), g AS (SELECT path, count(*) AS n, arg_min(what, event_id) AS a, arg_max(what, event_id) AS b FROM e GROUP BY path) SELECT path, CASE WHEN a = 'created' AND b = 'removed' THEN 'none' WHEN b = 'removed' THEN 'removed' WHEN a = 'created' THEN 'created' ELSE 'modified' END AS kind, n FROM g",
}
