"""DuckDB SQL with the same rows as the queries. RE2 has no look-around, so patterns consume their context."""

from __future__ import annotations

from ..functions import fixed
from . import corpora


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DOCS = "docs AS (SELECT doc_id, 'docs/doc_' || printf('%08d', doc_id) || '.txt' AS path, coalesce(text, '') AS text FROM documents)"
N = len(corpora.PAYLOADS)
PAYLOADS = "payloads AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_lit(p)})" for i, (p, _) in enumerate(corpora.PAYLOADS)) + ") AS v(k, payload))"
SEEDED = f"{PAYLOADS}, seeded AS (SELECT doc_id, 'seed/doc_' || printf('%08d', doc_id) || '.txt' AS path, coalesce(text, '') || chr(10) || payload AS text FROM documents JOIN payloads ON doc_id % {N} = k)"
EMAIL_CHARS = "A-Za-z0-9.!#$%&''*+/=?^_`{|}~-"
EMAIL = f"[{EMAIL_CHARS}]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)+[A-Za-z]{{2,63}}"
PHONE = r"(?:\+?1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s][0-9]{3}[-.\s][0-9]{4}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
EMAIL_AT = f"(^|[^{EMAIL_CHARS}])({EMAIL})([^A-Za-z0-9-]|$)"
PHONE_AT = rf"(^|[^0-9])({PHONE})([^0-9]|$)"
IP_AT = rf"(^|[^0-9.])({IP})([^0-9.]|$)"
OCTETS = "len(list_filter(string_split({}, '.'), lambda o: NOT regexp_full_match(o, '0|[1-9][0-9]{{0,2}}') OR CAST(o AS INTEGER) > 255)) = 0"
HITS = f"""hits AS (
  SELECT doc_id, path, text, regexp_extract_all(text, '{EMAIL_AT}', 2) AS emails, regexp_extract_all(text, '{PHONE_AT}', 2) AS phones,
    list_filter(regexp_extract_all(text, '{IP_AT}', 2), lambda x: {OCTETS.format('x')}) AS ips FROM docs)"""


def _kind(col: str) -> str:
    return f"WITH {DOCS}, {HITS} SELECT doc_id, CAST(len({col}) AS BIGINT) AS n, sha256(array_to_string({col}, '|')) AS values_sha256 FROM hits WHERE len({col}) > 0"


_EMAIL_SPANS = f"""WITH {DOCS}, m AS (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS v, regexp_split_to_array(text, '{EMAIL}') AS p FROM docs WHERE contains(text, '@')),
s AS (SELECT doc_id, text, v, p, unnest(range(1, len(v) + 1)) AS i FROM m),
o AS (SELECT doc_id, text, v[i] AS x, list_sum(list_transform(p[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda y: length(y))), 0) AS a FROM s)
SELECT doc_id, CAST(a AS BIGINT) AS start_at, CAST(a + length(x) AS BIGINT) AS end_at,
  CAST(1 + length(left(text, CAST(a AS BIGINT))) - length(replace(left(text, CAST(a AS BIGINT)), chr(10), '')) AS BIGINT) AS line FROM o"""

_ASSIGNED = f"""WITH {DOCS}, m AS (SELECT doc_id, regexp_extract_all(text, '(?:^|[^A-Za-z0-9])token = "([^"]+)"', 1) AS v FROM docs)
SELECT doc_id, CAST(len(v) AS BIGINT) AS n, sha256(array_to_string(list_transform(v, lambda x: 'API_KEY=' || x), '|')) AS values_sha256 FROM m WHERE len(v) > 0"""

_SEV = "CASE WHEN t IN ('EMAIL', 'PHONE', 'IPV4') THEN 'medium' WHEN t IN ('CHINESE_ID', 'PROMPT_INJECTION') THEN 'high' ELSE 'critical' END"


def _positions(src: str, kinds: list[tuple[str, str, str]]) -> str:
    """CTEs up to f(doc_id, t, sens, v, a, b): what patterns (before)(value)(behind) find in the texts of src, and where.

    Personal data inside secrets doesn't count, nor does what a longer find of the same kind holds.
    """
    every = " UNION ALL ".join(
        f"SELECT doc_id, '{t}' AS t, '{s}' AS sens, regexp_extract_all(text, {_lit(p)}, 0) AS w, regexp_extract_all(text, {_lit(p)}, 1) AS l, regexp_extract_all(text, {_lit(p)}, 2) AS v, "
        f"regexp_split_to_array(text, {_lit(p)}) AS p FROM {src}"
        for t, s, p in kinds
    )
    return f"""found AS ({every}), each_ AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM found WHERE len(v) > 0),
placed AS (SELECT DISTINCT doc_id, t, sens, v[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) + length(l[i]) AS BIGINT) AS a FROM each_),
spans AS (SELECT doc_id, t, sens, v, a, a + length(v) AS b FROM placed WHERE t <> 'IPV4' OR {OCTETS.format('v')}),
f AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.a < s.b AND s.a < o.b AND (s.sens = 'pii' AND o.sens = 'secret' OR s.sens = o.sens AND o.b - o.a > s.b - s.a)))"""


_PII_KINDS = [("EMAIL", "pii", EMAIL_AT.replace("''", "'")), ("PHONE", "pii", PHONE_AT), ("IPV4", "pii", IP_AT)]
_LINE_OF = r"(^|[\r\n])([^\r\n]*(?:{})[^\r\n]*)($|[\r\n])"
_KINDS = [
    *_PII_KINDS,
    ("PHONE", "pii", r"(^|[^0-9])((?:\+?86[-.\s]?)?1[3-9][0-9][-.\s]?[0-9]{4}[-.\s]?[0-9]{4})([^0-9]|$)"),
    ("PHONE", "pii", r"(^|[^\w])(\+[0-9]{1,3}(?:[-.\s]?[0-9]){7,13})([^0-9]|$)"),
    ("CHINESE_ID", "pii", r"(^|[^0-9])([1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx])([^0-9Xx]|$)"),
    ("API_KEY", "secret", r"((?:^|[^A-Za-z0-9])[\"]?(?:api_key|token|clientSecret)[\"]?\s*[:=]\s*[\"]?)([A-Za-z0-9_-]{8,})()"),
    ("API_KEY", "secret", r"(^|[^A-Z0-9_-])([A-Z][A-Z0-9]*_SECRET_[A-Z0-9]*[0-9][A-Z][A-Z0-9]*)([^A-Z0-9_-]|$)"),
    ("PASSWORD", "secret", r"(^|[^A-Z0-9_-])([A-Z][A-Z0-9]*_PASSWORD_[A-Z0-9]*[0-9][A-Z][A-Z0-9]*)([^A-Z0-9_-]|$)"),
    ("PASSWORD", "secret", r"((?:^|[^A-Za-z0-9])password\s*[:=]\s*')([^'\r\n]+)(')"),
    ("BEARER_TOKEN", "secret", r"((?i:\bbearer)[ \t]+)([A-Za-z0-9._~+/=-]{12,})()"),
    ("JWT", "secret", r"(^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})([^A-Za-z0-9_-]|$)"),
    ("AWS_ACCESS_KEY", "secret", r"(^|[^A-Z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})([^A-Z0-9]|$)"),
    ("PRIVATE_KEY", "secret", r"()(-----BEGIN RSA PRIVATE KEY-----(?s:.*?)-----END RSA PRIVATE KEY-----)()"),
    ("DATABASE_URL", "secret", r"(\b)((?i:postgres|postgresql|mysql|mariadb|mongodb|redis|rediss|amqp|mssql)://[^\s\"'<>]+)()"),
    ("CONNECTION_STRING", "secret", r"(\b)((?i:server|data source|host)\s*=\s*[^;\s\"']+(?:;\s*[A-Za-z][A-Za-z ]*=[^;\r\n\"']*)*?;\s*(?i:password|pwd)\s*=\s*[^;\s\"']+)()"),
    ("PROMPT_INJECTION", "instruction", _LINE_OF.format(r"(?i:Please ignore\b.{0,60}\bprevious\s+instructions)|(?:绕过|跳过).{0,40}(?:净化|过滤)|(?i:do\s+not\s+use\b.{0,70}\bsafe\s+context\b.{0,180}\bopen\b.{0,100}\braw\b)")),
    ("PROMPT_INJECTION", "instruction", r"(^|[\r\n])(Ignore[^\r\n]{0,60}[\r\n][^\r\n]{0,60}earlier instructions[^\r\n]*)($|[\r\n])"),
    ("PROMPT_INJECTION", "instruction", r"()(<!--[^>]*hidden instructions[^>]*-->)()"),
    ("DATA_EXFILTRATION", "instruction", _LINE_OF.format(r"(?i:upload\b.{0,160}\bprivate\s+keys)|收集.{0,80}凭证.{0,100}发送")),
]
_FOUND = f"{SEEDED}, {_positions('seeded', _KINDS)}"
_PUBLIC = f"""WITH {_FOUND} SELECT t AS type, {_SEV} AS severity, path AS source, CAST(1 + length(left(text, a)) - length(replace(left(text, a), chr(10), '')) AS INTEGER) AS line,
  if(sens = 'instruction', 'heuristic', 'regex') AS detector, CASE sens WHEN 'secret' THEN 'REDACT' WHEN 'pii' THEN 'PSEUDONYMIZE' ELSE 'ISOLATE' END AS action FROM f JOIN seeded USING (doc_id)"""


def _count(*types: str) -> str:
    return f"CAST(count(*) FILTER (WHERE t IN ({', '.join(map(_lit, types))})) AS BIGINT)"


_SUMMARY = f"""WITH {_FOUND} SELECT {_count('API_KEY')} AS api_keys, {_count('BEARER_TOKEN')} AS bearer_tokens, {_count('JWT')} AS jwt_tokens, {_count('AWS_ACCESS_KEY')} AS aws_keys,
  {_count('PRIVATE_KEY')} AS private_keys, {_count('DATABASE_URL', 'CONNECTION_STRING')} AS database_credentials, {_count('PASSWORD')} AS password_assignments, {_count('EMAIL')} AS emails,
  {_count('PHONE')} AS phones, {_count('CHINESE_ID')} AS chinese_ids, {_count('IPV4')} AS ip_addresses, {_count('EMAIL', 'PHONE', 'CHINESE_ID', 'IPV4')} AS pii_items,
  {_count('PROMPT_INJECTION')} AS prompt_injections, {_count('DATA_EXFILTRATION')} AS data_exfiltration_attempts, {_count('PROMPT_INJECTION', 'DATA_EXFILTRATION')} AS blocked_instructions FROM f"""
_BY_DOC = f"""{_FOUND}, by_doc AS (SELECT s.doc_id, count(f.t) AS n, count(*) FILTER (WHERE sens = 'secret') AS secrets, count(*) FILTER (WHERE sens = 'instruction') AS orders,
  count(*) FILTER (WHERE t = 'PRIVATE_KEY') AS keys, coalesce(string_agg(t, ',' ORDER BY t), '') AS types,
  string_agg(DISTINCT if(t = 'PROMPT_INJECTION', 'injection', 'data_exfiltration'), ',') FILTER (WHERE sens = 'instruction') AS categories FROM seeded s LEFT JOIN f USING (doc_id) GROUP BY s.doc_id)"""
_LEVEL = "CASE WHEN {0}(keys) > 0 THEN 'CRITICAL' WHEN {0}(secrets) + {0}(orders) > 0 THEN 'HIGH' WHEN {0}(n) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, if({0}(n) > 0, 'ALLOW_WITH_TRANSFORM', 'ALLOW') AS decision"
_RISK = f"WITH {_BY_DOC} SELECT doc_id, {_LEVEL.format('')} FROM by_doc"
_CORPUS_RISK = f"WITH {_BY_DOC} SELECT {_LEVEL.format('max')} FROM by_doc"
_INJECTED = f"WITH {_BY_DOC} SELECT doc_id, categories FROM by_doc WHERE orders > 0"


def _replaced(src: str, key: str, label: str, only: str = "true") -> str:
    """CTE done(key, text, n): texts with every span of f replaced. label: of a row of f."""
    return f"""cut AS (SELECT {key}, a, b, {label} AS label, coalesce(lag(b) OVER (PARTITION BY {key} ORDER BY a), 0) AS p FROM f WHERE {only}),
parts AS (SELECT {key}, string_agg(substring(text, CAST(p + 1 AS BIGINT), CAST(a - p AS BIGINT)) || label, '' ORDER BY a) AS head, max(b) AS last, count(*) AS n FROM cut JOIN {src} USING ({key}) GROUP BY {key}),
done AS (SELECT s.{key}, if(head IS NULL, s.text, head || substring(s.text, CAST(last + 1 AS BIGINT))) AS text, coalesce(n, 0) AS n FROM {src} s LEFT JOIN parts USING ({key}))"""


_TRANSFORMED = f"""WITH {_FOUND}, {_replaced('seeded', 'doc_id', "if(sens = 'instruction', '[UNTRUSTED_INSTRUCTION_ISOLATED]', '[' || t || '_REDACTED]')")}
SELECT doc_id, sha256(text) AS text_sha256, n AS replaced FROM done"""
_SAFE = f"WITH {_FOUND}, {_replaced('seeded', 'doc_id', _lit(''), _lit('instruction') + ' = sens')} SELECT doc_id, regexp_matches(text, '\\S') AS safe FROM done"
_COMMENTS = r"""WITH c AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<!--(?s:.*?)-->')) AS v FROM pages), p AS (SELECT page_id, trim(regexp_replace(v, '[\t\r\n ]+', ' ', 'g')) AS v FROM c)
SELECT page_id, sha256(v) AS projected_sha256, regexp_matches(v, '(?i)system\s+(prompt|override)|hidden\s+instructions?|instructions') AS risky FROM p"""
_TASKS = "SELECT conv_id, turn, conv_id % 4 <> 0 AS blocked FROM conversations WHERE role = 'user'"
_REDACTED = f"""WITH {DOCS}, {HITS} SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL_AT}', '\\1[EMAIL_REDACTED]\\3', 'g'), '{PHONE_AT}', '\\1[PHONE_REDACTED]\\3', 'g'),
  '(^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))([^0-9.]|$)', '\\1[IPV4_REDACTED]\\3', 'g')) AS text_sha256,
  CAST(len(emails) + len(phones) + len(ips) AS BIGINT) AS replaced FROM hits"""
_SEEN = f"""{DOCS}, {HITS}, seen AS (
  SELECT 'EMAIL' AS kind, path, unnest(range(1, len(emails) + 1)) AS i, lower(unnest(emails)) AS identity FROM hits
  UNION ALL SELECT 'PHONE', path, unnest(range(1, len(phones) + 1)), unnest(list_transform(phones, lambda p: if(starts_with(p, '+'), '+', '') || regexp_replace(p, '[^0-9]', '', 'g'))) FROM hits
  UNION ALL SELECT 'IPV4', path, unnest(range(1, len(ips) + 1)), unnest(ips) FROM hits),
firsts AS (SELECT kind, identity, min(path || printf('%09d', i)) AS f FROM seen GROUP BY ALL),
reg AS (SELECT kind, identity, '[' || kind || '_' || printf('%03d', row_number() OVER (PARTITION BY kind ORDER BY f)) || ']' AS label FROM firsts)"""
_REGISTRY = f"WITH {_SEEN} SELECT kind, sha256(identity) AS identity_sha256, label FROM reg"
_PSEUDO = f"""WITH {_SEEN}, {_positions('docs', _PII_KINDS)}, named AS (SELECT f.*, label FROM f JOIN reg ON reg.kind = t AND reg.identity = CASE t WHEN 'EMAIL' THEN lower(v)
  WHEN 'PHONE' THEN if(starts_with(v, '+'), '+', '') || regexp_replace(v, '[^0-9]', '', 'g') ELSE v END), {_replaced('docs', 'doc_id', 'label').replace('FROM f WHERE', 'FROM named WHERE')}
SELECT path, sha256(done.text) AS text_sha256 FROM done JOIN docs USING (doc_id)"""

_FINDINGS = """f AS (SELECT l_orderkey, (['API_KEY', 'EMAIL', 'PHONE', 'PASSWORD', 'IPV4', 'PROMPT_INJECTION'])[CAST(l_partkey % 6 + 1 AS INTEGER)] AS t, CAST(l_suppkey % 40 AS INTEGER) AS s,
  CAST(l_suppkey % 40 + 1 + l_partkey % 11 AS INTEGER) AS e FROM lineitem)"""
_RESOLVED = f"""{_FINDINGS}, c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY if(t IN ('API_KEY', 'PASSWORD'), 0, 1), s - e,
  CASE t WHEN 'PASSWORD' THEN 6 WHEN 'API_KEY' THEN 7 WHEN 'EMAIL' THEN 21 WHEN 'PHONE' THEN 22 ELSE 23 END, s, t) AS rn FROM f WHERE t <> 'PROMPT_INJECTION'),
r AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s INTEGER, e INTEGER, t VARCHAR)[]) AS acc FROM f
  UNION ALL SELECT r.l_orderkey, c.rn, CASE WHEN len(list_filter(r.acc, lambda a: a.s < c.e AND c.s < a.e)) = 0 THEN list_append(r.acc, {{'s': c.s, 'e': c.e, 't': c.t}}) ELSE r.acc END
  FROM r JOIN c ON r.l_orderkey = c.l_orderkey AND c.rn = r.rn + 1),
done AS (SELECT l_orderkey, list_sort(arg_max(acc, rn)) AS acc FROM r GROUP BY l_orderkey)"""
_OVERLAP = f"WITH RECURSIVE {_RESOLVED} SELECT l_orderkey, array_to_string(list_transform(acc, lambda a: a.t || ':' || a.s || '-' || a.e), ',') AS resolved FROM done"


def _islands(src: str, name: str, op: str) -> str:
    return f"""{name}_w AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {src}),
{name}_i AS (SELECT *, sum(CASE WHEN m IS NULL OR s {op} m THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM {name}_w),
{name} AS (SELECT l_orderkey, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY l_orderkey, g)"""


_QUARANTINE = f"""WITH RECURSIVE {_RESOLVED}, ins AS (SELECT l_orderkey, s, e FROM f WHERE t = 'PROMPT_INJECTION'), {_islands('ins', 'base', '>')},
sens AS (SELECT l_orderkey, unnest(acc, recursive := true) FROM done),
grown AS (SELECT * FROM base UNION SELECT x.l_orderkey, x.s, x.e FROM sens x JOIN base b ON x.l_orderkey = b.l_orderkey AND b.s < x.e AND x.s < b.e), {_islands('grown', 'q', '>')}
SELECT o.l_orderkey, coalesce(string_agg(q.s || '-' || q.e, ',' ORDER BY q.s), '') AS quarantined FROM (SELECT DISTINCT l_orderkey FROM f) o LEFT JOIN q ON o.l_orderkey = q.l_orderkey GROUP BY o.l_orderkey"""
_MERGED = f"WITH {_FINDINGS}, {_islands('f', 'q', '>=')} SELECT l_orderkey, count(*) AS n FROM q GROUP BY l_orderkey"

_TOKENS = f"WITH {DOCS} SELECT doc_id, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens FROM docs"
_JSON = f"WITH {DOCS} SELECT doc_id, CAST(octet_length(encode(CAST(to_json(text) AS VARCHAR))) AS BIGINT) AS bytes FROM docs"
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"WITH {DOCS}, p AS (SELECT doc_id, text, regexp_split_to_array(text, '{_ENDS}') AS p FROM docs) SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS BIGINT) AS lines FROM p"
_EXT = ", ".join(map(_lit, fixed.EXTENSIONS))
_SOURCES = f"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?:/', CASE page_id % 3 WHEN 0 THEN '..' WHEN 1 THEN '' ELSE '.' END) AS path FROM pages),
p AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM u)
SELECT page_id, CASE WHEN page_id % 3 IN (0, 1) THEN parts[-1] ELSE array_to_string(parts, '/') END AS source,
  list_contains([{_EXT}], regexp_extract(lower(parts[-1]), '[^.].*\\.([^.]+)$', 1)) AND NOT ends_with(path, '/') AS supported FROM p"""
_UNIQUE = """WITH RECURSIVE p AS (SELECT source || '/' || (doc_id % 50) || '.txt' AS root, doc_id % 11 = 0 AS odd, doc_id % 3 + 2 AS k, 'doc_' || printf('%08d', doc_id) AS path FROM documents),
n AS (SELECT root, root || if(odd, '#' || k, '') AS safe, path, row_number() OVER (PARTITION BY root ORDER BY path) AS n FROM p),
u AS (SELECT root, path, safe AS source, n, [safe] AS used FROM n WHERE n = 1
  UNION ALL SELECT root, path, source, n, list_append(used, source) FROM (SELECT u.root, n.path, n.n, u.used,
    if(list_contains(u.used, n.safe), n.safe || '#' || list_filter(range(2, len(u.used) + 3), lambda i: NOT list_contains(u.used, n.safe || '#' || i))[1], n.safe) AS source
    FROM u JOIN n ON n.root = u.root AND n.n = u.n + 1) AS s)
SELECT path, source FROM u"""
_STOP = ", ".join(map(_lit, fixed.STOPWORDS))
_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all({}, '(?i)[a-z0-9]+(?:[_-][a-z0-9]+)*'), lambda w: lower(w)), lambda w: w NOT IN (" + _STOP + ")))"
_TASK_TOKENS = f"SELECT conv_id, turn, array_to_string(list_sort({_WORDS.format("coalesce(text, '')")}), ' ') AS tokens FROM conversations"

_LOGS = f"""ev AS (SELECT user_id, event_id, event_id // 2000 AS part, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' svc-' || (user_id % 7) || ' ' || if(event_type = 'error', 'ERROR', 'INFO') || ' ' || event_type
  || ' status=' || (200 + event_id % 31 * 10) || ' id=' || event_id AS line FROM events),
ln AS (SELECT 'logs/user_' || printf('%06d', user_id) || '_' || printf('%06d', part) || '.log' AS source, line, row_number() OVER (PARTITION BY user_id, part ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, part) AS n FROM ev),
sc AS (SELECT source, line, i, n, 4 * len(list_filter(t, lambda w: w IN ('did', 'error', 'fail', '500'))) + 3 * len(list_filter(t, lambda w: w IN ('error'))) + 5 * len(regexp_extract_all(line, '\\b(?:ERROR|FATAL)\\b'))
  + 4 * len(regexp_extract_all(line, '(?:^|[^0-9])5[0-9][0-9](?:[^0-9]|$)')) AS score FROM (SELECT *, {_WORDS.format('line')} AS t FROM ln))"""
_SCORES = f"WITH {_LOGS} SELECT source, i AS line, CAST(score AS BIGINT) AS score FROM sc"
_WINDOWS = f"""{_LOGS}, sd AS (SELECT *, i - lag(i) OVER (PARTITION BY source ORDER BY i) AS gap FROM sc WHERE score > 0),
gr AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM sd),
wn AS (SELECT source, g, greatest(1, min(i) - 2) AS a, least(max(n), max(i) + 2) AS b, sum(score) AS score FROM gr GROUP BY source, g),
win AS (SELECT w.source, w.a AS start_line, w.b AS end_line, CAST(w.score AS BIGINT) AS score, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM wn w JOIN ln l ON l.source = w.source AND l.i BETWEEN w.a AND w.b GROUP BY ALL)"""
_EVIDENCE = f"WITH {_WINDOWS} SELECT source, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, score, sha256(text) AS text_sha256 FROM win"


def first_fit(win: str, budget: int, facts: int) -> str:
    return f"""{win}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, start_line) AS rn,
  octet_length(encode(CAST(to_json({{'end_line': end_line, 'score': score, 'source': source, 'start_line': start_line, 'text': text}}) AS VARCHAR))) AS b FROM win),
ff AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(2 AS BIGINT) AS used, false AS took
  UNION ALL SELECT k.rn, if(k.fits, k.n + 1, k.n), if(k.fits, k.u, k.used), k.fits FROM (
    SELECT rk.rn, ff.n, ff.used, ff.used + rk.b + if(ff.n > 0, 1, 0) AS u, ff.n < {facts} AND ff.used + rk.b + if(ff.n > 0, 1, 0) <= {4 * budget} AS fits FROM ff JOIN rk ON rk.rn = ff.rn + 1) k)"""


_SELECTED = f"""WITH RECURSIVE {first_fit(_WINDOWS, 3000, 8)}
SELECT ff.n AS position, source, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, score, (SELECT count(*) FROM rk) AS candidates,
  CAST((SELECT (max(used) + 3) // 4 FROM ff) AS BIGINT) AS tokens FROM ff JOIN rk USING (rn) WHERE took"""

# Packing: at most five lines and 256 bytes; every log line is one fragment.
_PACKED = f"""{_LOGS}, lb AS (SELECT source, line, i, octet_length(encode(line)) AS b, 'svc-' || regexp_extract(line, ' svc-([0-9]+) ', 1) AS anchor FROM ln),
pk AS (SELECT source, i, CAST(1 AS BIGINT) AS c, CAST(1 AS BIGINT) AS k, CAST(b AS BIGINT) AS size FROM lb WHERE i = 1
  UNION ALL SELECT lb.source, lb.i, if(pk.k >= 5 OR pk.size + 1 + lb.b > 256, pk.c + 1, pk.c), if(pk.k >= 5 OR pk.size + 1 + lb.b > 256, 1, pk.k + 1),
    if(pk.k >= 5 OR pk.size + 1 + lb.b > 256, lb.b, pk.size + 1 + lb.b) FROM pk JOIN lb ON lb.source = pk.source AND lb.i = pk.i + 1),
cand AS (SELECT source, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line, min(anchor) AS anchor, string_agg(line, chr(10) ORDER BY i) AS text FROM pk JOIN lb USING (source, i) GROUP BY source, c)"""
_PACKING = f"WITH RECURSIVE {_PACKED} SELECT source, start_line, end_line, anchor, sha256(text) AS text_sha256 FROM cand"
_ANCHORS = f"WITH {_LOGS} SELECT DISTINCT 'svc-' || regexp_extract(line, ' svc-([0-9]+) ', 1) AS anchor FROM ln"
_VEC = """vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS q FROM vec WHERE vec_id = 0), nv AS (SELECT count(*) AS n FROM embeddings),
mix AS (SELECT vec_id, q, list_transform(list_zip(q, v), lambda p: p[1] + 0.8::DOUBLE * p[2]) AS m FROM vec, q)"""
_COSINE = f"WITH {_VEC} SELECT vec_id, CAST(greatest(0, least(1000000, round_even((greatest(-1, least(1, list_cosine_similarity(v, q))) + 1) * 500000, 0))) AS BIGINT) AS score FROM vec, q"
# Seven producers; families share no word, since 'svc' and digits are below three letters or no letters... but svc.
_CALIBRATED = """an AS (SELECT DISTINCT anchor FROM cand), si AS (SELECT anchor, greatest(-1, least(1, list_cosine_similarity(m, q))) AS s FROM an, nv, mix WHERE vec_id = CAST(regexp_extract(anchor, '[0-9]+') AS BIGINT) % n),
tp AS (SELECT count(*) AS n, max(s) AS top, median(s) AS mid FROM si), cal AS (SELECT anchor, greatest(0, if(family, greatest(s, top), s) - mid) AS affinity FROM (
  SELECT si.*, tp.*, true AS family FROM si, tp WHERE tp.n >= 4 AND top >= 0.78 AND top - mid >= 0.035))"""
_SCOPE = f"WITH RECURSIVE {_PACKED}, {_VEC}, {_CALIBRATED} SELECT anchor, CAST(round_even(affinity * 1000000, 0) AS BIGINT) AS affinity FROM cal"
_SIG = {
    "change": r"\bincreased\b", "boundary": r"\b(limit|quota)\b.{0,64}\b(reached|hit|zero)\b", "causal": r"\b(after|because)\b", "abnormal": r"\bno\s+space\b", "multiplier": r"\b12x\b",
    "benign": r"\bcompleted\s+successfully\b",
}
_SIGNALS = f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') || (['', ' errors increased after the limit was reached', ' job completed successfully', ' 12x retries, no space', ' because quota hit zero'])[CAST(conv_id % 5 + 1 AS INTEGER)] AS text FROM conversations),
w AS (SELECT *, {_WORDS.format('text')} AS k FROM t)
SELECT conv_id, turn, CAST(len(list_filter(k, lambda x: x IN ('did', 'pay', 'retries', 'reach', 'limit'))) AS BIGINT) AS task_overlap, CAST(1 AS BIGINT) AS source_overlap, list_contains(k, 'retries') AS hard,
  {', '.join(f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in _SIG.items())} FROM w"""
_HYBRID = f"""{_PACKED}, {_VEC}, {_CALIBRATED}, sm AS (SELECT c.*, greatest(-1, least(1, list_cosine_similarity(m, q))) AS s, cal.affinity, (SELECT count(*) FROM cal) > 0 AS calibrated FROM cand c CROSS JOIN nv JOIN mix ON mix.vec_id = (length(text) * 31 + start_line) % n LEFT JOIN cal USING (anchor)),
tk AS (SELECT *, {_WORDS.format('text')} AS k FROM sm),
hs AS (SELECT *, list_contains(k, 'error') OR regexp_matches(text, '\\b(ERROR|FATAL)\\b') OR regexp_matches(text, '(?:^|[^0-9])5[0-9][0-9](?:[^0-9]|$)') AS hard, len(list_filter(k, lambda x: x IN ('did', 'error', 'fail', '500'))) AS ov FROM tk),
sc AS (SELECT *, round_even((s + 1) * 500000, 0) AS sem FROM hs),
hy AS (SELECT source, start_line, end_line, text, anchor, k, if(hard, 'supported', 'neutral') AS lane, CAST(sem AS BIGINT) AS semantic,
  CAST(sem + 1500 * least(ov, 6) + coalesce(round_even(1000000 * affinity, 0), 0) + if(hard, 20000, 0) AS BIGINT) AS score, m_id FROM (SELECT *, (length(text) * 31 + start_line) % (SELECT n FROM nv) AS m_id FROM sc) WHERE s >= if(hard, 0.70, 0.74))""".replace("sc AS (SELECT *, round_even", "sq AS (SELECT *, round_even").replace("FROM sc) WHERE s >=", "FROM sq) WHERE s >=")
_HYBRID_SCORES = f"WITH RECURSIVE {_HYBRID} SELECT source, start_line, lane, semantic, score FROM hy"
# Greedy with state: neutral taken, and a list of taken (words, vector) for near duplicates.
_HYBRID_SELECTED = f"""WITH RECURSIVE {_HYBRID}, rk AS (SELECT hy.*, mix.m AS vec, row_number() OVER (ORDER BY score DESC, semantic DESC, source, start_line) AS rn,
  octet_length(encode(CAST(to_json({{'end_line': end_line, 'score': score, 'source': source, 'start_line': start_line, 'text': text}}) AS VARCHAR))) AS b FROM hy JOIN mix ON mix.vec_id = m_id),
ff AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(2 AS BIGINT) AS used, false AS took, 0 AS neutral, CAST([] AS STRUCT(k VARCHAR[], v DOUBLE[])[]) AS taken
  UNION ALL SELECT x.rn, if(fits, n + 1, n), if(fits, u, used), fits, if(fits AND lane = 'neutral', neutral + 1, neutral), if(fits, list_append(taken, {{'k': k, 'v': vec}}), taken) FROM (
    SELECT rk.rn, ff.n, ff.used, ff.neutral, ff.taken, rk.k, rk.vec, rk.lane, ff.used + rk.b + if(ff.n > 0, 1, 0) AS u,
      ff.n < 8 AND ff.used + rk.b + if(ff.n > 0, 1, 0) <= 12000 AND NOT (rk.lane = 'neutral' AND ff.neutral >= 1)
      AND len(list_filter(ff.taken, lambda t: list_cosine_similarity(t.v, rk.vec) >= 0.98 AND len(list_intersect(t.k, rk.k)) >= 0.8 * len(list_distinct(list_concat(t.k, rk.k))) AND len(t.k) >= 3 AND len(rk.k) >= 3)) = 0 AS fits
    FROM ff JOIN rk ON rk.rn = ff.rn + 1 WHERE ff.n < 8) x)
SELECT ff.n AS position, source, start_line, score, lane, (SELECT count(*) FROM rk) AS scored, CAST((SELECT (max(used) + 3) // 4 FROM ff) AS BIGINT) AS tokens FROM ff JOIN rk USING (rn) WHERE took"""

_GATE = f"""WITH {_BY_DOC} SELECT doc_id, n - orders AS sensitive_spans, least(orders, 1) AS instruction_spans, CAST(0 AS BIGINT) AS left_over FROM by_doc"""
_LEAKS = f"WITH {DOCS}, {HITS} SELECT doc_id, CAST(len(list_distinct(list_concat(list_concat(emails, phones), ips))) AS BIGINT) AS leaked_raw, CAST(0 AS BIGINT) AS leaked FROM hits WHERE len(emails) + len(phones) + len(ips) > 0"
_DIGITS = f"""WITH {DOCS}, {HITS}, v AS (SELECT DISTINCT unnest(list_concat(phones, list_concat(emails, ips))) AS v FROM hits), d AS (SELECT DISTINCT regexp_replace(v, '[^0-9]', '', 'g') AS d FROM v WHERE v LIKE '+1%')
SELECT (SELECT count(*) FROM d) AS payloads, (SELECT count(*) FROM v WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 AND regexp_replace(v, '[^0-9]', '', 'g') IN (SELECT d FROM d)) AS leaks"""
# What the contract says of each case.
_GOOD = ("health_good", "scan_good", "scan_no_findings", "analyze_good", "analyze_blocked", "analyze_confirm")
_BAD = (
    *(f"{c}_{n}" for c in ("health", "scan", "analyze") for n in ("missing_key", "not_json", "duplicate_key", "nan")), "health_extra_key", "health_wrong_type", "scan_bad_line", "scan_bad_source",
    "scan_secret", "scan_bad_counter", "analyze_blocked_with_facts", "analyze_leaked", "analyze_ratio", "analyze_order", "analyze_bad_ref", "analyze_warned_with_facts",
)
_GATED = "SELECT * FROM (VALUES " + ", ".join([f"('{n}', true)" for n in _GOOD] + [f"('{n}', false)" for n in _BAD]) + ") AS v(name, accepted)"
_CODES = "c AS (SELECT unnest([" + ", ".join(map(_lit, fixed.ERRORS)) + "]) AS code, unnest([" + ", ".join(map(_lit, fixed.ERRORS.values())) + "]) AS message)"
_ERROR_GATE = f"WITH {_CODES} SELECT a.code || '/' || b.code AS name, a.message = b.message AS accepted FROM c a CROSS JOIN c b"
_CHECKED = r"""WITH s AS (SELECT if(page_id % 4 = 0, (['', '/', 'a/../', './', 'x\', 'a//'])[CAST(page_id % 6 + 1 AS INTEGER)], 'ok/') || (page_id // if(page_id % 7 = 0, 14, 1)) AS source FROM pages)
SELECT source FROM s WHERE source = '' OR starts_with(source, '/') OR contains(source, chr(92)) OR regexp_matches(source, '(^|/)(|\.|\.\.)(/|$)')
UNION ALL SELECT source FROM s GROUP BY source HAVING count(*) > 1"""
_INGESTED = """WITH n AS (SELECT n_nationkey AS k, n_name || chr(10) || n_nationkey AS text FROM nation WHERE n_nationkey % 5 IN (0, 1, 3)),
f AS (SELECT 'r' || (k % 5) || if(k % 5 = 3, '/.h', '') || '/n' || k || CASE k % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.py' END AS path, text, octet_length(encode(text)) + 3 * (k % 2) AS b FROM n)
SELECT path, text, CAST(b AS BIGINT) AS byte_size, (SELECT count(*) FROM f) AS inspected, (SELECT count(*) + 1 FROM nation WHERE n_nationkey % 5 NOT IN (0, 1, 3)) AS skipped, CAST((SELECT sum(b) FROM f) AS BIGINT) AS total_bytes FROM f"""
_RATIO = f"""WITH {DOCS}, {_positions('docs', _PII_KINDS)}, {_replaced('docs', 'doc_id', "'[' || t || '_REDACTED]'")},
t AS (SELECT doc_id, (octet_length(encode(docs.text)) + 3) // 4 AS o, (octet_length(encode(done.text)) + 3) // 4 AS k FROM docs JOIN done USING (doc_id))
SELECT doc_id, CAST(round_even(if(o = 0, 0, round_even(1 - k / o, 6)) * 1000000, 0) AS BIGINT) AS millionths FROM t"""
_CAPSULE = f"""WITH RECURSIVE {first_fit(_WINDOWS, 3000, 8)} SELECT 'fact_' || printf('%03d', ff.n) AS id, source, if(start_line = end_line, 'L' || start_line, 'L' || start_line || '-L' || end_line) AS local_ref, score,
  'ALLOW' AS decision, 'LOW' AS risk_level FROM ff JOIN rk USING (rn) WHERE took"""
_PR = r"""WITH r AS (SELECT toxic = 1 AS y, regexp_matches(lower(text), '\b(idiot|moron|clown|scum)\b') AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) FILTER (WHERE y AND NOT p) AS fn FROM r)
SELECT *, CAST(if(tp + fp = 0, NULL, round_even(tp / (tp + fp), 6)) * 1000000 AS BIGINT) AS precision, CAST(if(tp + fn = 0, NULL, round_even(tp / (tp + fn), 6)) * 1000000 AS BIGINT) AS recall FROM c"""
_RETRIEVAL = """WITH b AS (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS p, bool_or(l_quantity > 30) AS r FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_suppkey) AS n FROM b),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE r) AS a, count(*) FILTER (WHERE r AND n <= 3) AS h, count(*) FILTER (WHERE n <= 3) AS t, min(n) FILTER (WHERE r) AS f FROM k GROUP BY l_orderkey)
SELECT l_orderkey, CAST(round_even(if(a = 0, NULL, h / a) * 1000000, 0) AS BIGINT) AS recall_at_k, CAST(round_even(h / t * 1000000, 0) AS BIGINT) AS precision_at_k, CAST(round_even(coalesce(1 / f, 0) * 1000000, 0) AS BIGINT) AS reciprocal_rank FROM g"""
_PERCENTILE = "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS percentile FROM lineitem GROUP BY l_returnflag"
_AB = """WITH m AS (SELECT l_suppkey, l_returnflag, max(l_quantity) AS m, max(l_discount) < 0.1 AS ok FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT l_suppkey, if(bool_and(ok), round_even(max(m) FILTER (WHERE l_returnflag = 'R') - max(m) FILTER (WHERE l_returnflag = 'A'), 6), NULL) AS delta FROM m GROUP BY l_suppkey"""
_FORBIDDEN = f"""WITH {SEEDED} SELECT DISTINCT v AS value FROM (SELECT unnest(regexp_extract_all(text, '{EMAIL_AT}', 2)) AS v FROM seeded
  UNION ALL SELECT unnest(regexp_extract_all(text, '(^|[^0-9])((?:\\+?86[-.\\s]?)?1[3-9][0-9][-.\\s]?[0-9]{{4}}[-.\\s]?[0-9]{{4}})([^0-9]|$)', 2)) FROM seeded
  UNION ALL SELECT trim(unnest(regexp_extract_all(text, '(?m)^[A-Z][A-Z0-9_]*=(.+)$', 1))) FROM seeded UNION ALL SELECT 'listed-value')"""

ORACLE = {
    "pii_email_findings": _kind("emails"), "pii_phone_findings": _kind("phones"), "pii_ipv4_findings": _kind("ips"), "email_spans": _EMAIL_SPANS, "secret_assignment_findings": _ASSIGNED,
    "seeded_findings": f"WITH {_BY_DOC} SELECT doc_id, types FROM by_doc", "findings_public": _PUBLIC, "security_summary": _SUMMARY, "risk_and_decision": _RISK, "corpus_decision": _CORPUS_RISK,
    "corpus_stats": f"WITH {DOCS} SELECT count(*) AS inspected, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_bytes FROM docs", "injection_documents": _INJECTED, "html_comments": _COMMENTS,
    "task_blocked": _TASKS, "redacted_documents": _REDACTED, "pseudonym_registry": _REGISTRY, "pseudonymized_documents": _PSEUDO, "seeded_transformed": _TRANSFORMED, "safe_content": _SAFE,
    "overlap_resolved": _OVERLAP, "quarantine_merged": _QUARANTINE, "merged_interval_count": _MERGED, "token_estimates": _TOKENS, "stable_json_bytes": _JSON, "split_lines": _LINES,
    "safe_sources": _SOURCES, "unique_sources": _UNIQUE, "task_tokens": _TASK_TOKENS, "line_scores": _SCORES, "evidence_windows": _EVIDENCE, "selected_facts": _SELECTED,
    "candidate_packing": _PACKING, "scope_anchors": _ANCHORS, "cosine_quantized": _COSINE, "scope_calibration": _SCOPE, "hybrid_signals": _SIGNALS, "hybrid_scores": _HYBRID_SCORES,
    "hybrid_selected": _HYBRID_SELECTED, "gate_inspection": _GATE, "registry_leaks": _LEAKS, "digit_leaks": _DIGITS, "response_gate": _GATED, "error_gate": _ERROR_GATE, "source_checks": _CHECKED, "ingested_files": _INGESTED, "reduction_ratio": _RATIO, "analyze_capsule": _CAPSULE,
    "precision_recall": _PR, "retrieval_metrics": _RETRIEVAL, "nearest_rank_percentile": _PERCENTILE, "ab_delta": _AB, "forbidden_values": _FORBIDDEN,
}
