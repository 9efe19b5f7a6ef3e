"""SQL counterparts of the corpus queries, for DuckDB. All of them compare by brute force."""

from __future__ import annotations

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT doc_id, i, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line, doc_id * 10000000 + i AS pos FROM l),
f AS (SELECT line, min(pos) AS pos, length(line) AS n FROM n WHERE line <> '' GROUP BY line),
c AS (SELECT *, unnest([n, n + 1]) AS cls FROM f), r AS (SELECT *, CASE WHEN cls < 64 THEN 4 * (cls // 8) ELSE 16 * (cls // 32) END AS reach FROM c),
e AS (SELECT line, pos, n, cls, unnest(['h' || left(line, reach), 't' || right(line, reach)]) AS part FROM r),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS na, b.n AS nb, a.pos FROM e a JOIN e b ON a.cls = b.cls AND a.part = b.part AND a.pos < b.pos),
near AS (SELECT b AS line, min(pos) AS pos FROM pairs WHERE len(list_filter(range(0, greatest(na, nb)), lambda k: left(a, k) = left(b, k) AND CASE WHEN na = nb THEN substr(a, k + 2) = substr(b, k + 2) WHEN na > nb THEN substr(a, k + 2) = substr(b, k + 1) ELSE substr(a, k + 1) = substr(b, k + 2) END)) > 0 GROUP BY b),
m AS (SELECT n.doc_id, n.i, n.raw, n.line <> '' AND n.pos > least(f.pos, coalesce(near.pos, f.pos)) AS gone FROM n LEFT JOIN f USING (line) LEFT JOIN near USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS text_sha256 FROM documents d LEFT JOIN g USING (doc_id)"""

OP2 = f"""WITH b AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
s AS (SELECT DISTINCT size FROM w), p AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, s WHERE len(ws) >= size),
h AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM p) p JOIN w USING (size, g)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""

OP5 = """WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
v AS (SELECT conv_id, turn, i, raw, regexp_extract(raw, '^((?:[ \\t]*>)*)', 1) AS marks FROM l),
x AS (SELECT conv_id, turn, i, raw, length(marks) AS marked, length(replace(replace(marks, ' ', ''), chr(9), '')) AS level, trim(regexp_replace(lower(substr(raw, length(marks) + 1)), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM v),
y AS (SELECT *, CASE WHEN body <> '' AND (lag(body, 1, '') OVER t = '' OR lag(level) OVER t <> level) THEN 1 ELSE 0 END AS starts FROM x WINDOW t AS (PARTITION BY conv_id, turn ORDER BY i)),
z AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY i) AS part FROM y),
passages AS (SELECT conv_id, turn, part, min(level) AS level, string_agg(body, ' ' ORDER BY i) AS said FROM z WHERE body <> '' GROUP BY conv_id, turn, part),
told AS (SELECT conv_id, turn, level, said, 0 AS kind FROM passages UNION ALL SELECT conv_id, turn, level, body, 1 FROM x WHERE body <> ''),
met AS (SELECT q.conv_id, q.turn, q.level, q.kind, max(o.turn) AS said_in FROM told q JOIN told o ON q.conv_id = o.conv_id AND q.said = o.said AND q.kind = o.kind AND q.level > 0 AND o.level = 0 AND o.turn < q.turn GROUP BY ALL),
links AS (SELECT conv_id, turn, arg_min(said_in, 2 * level + kind) AS parent FROM met GROUP BY conv_id, turn),
up(conv_id, turn, far, depth) AS (SELECT conv_id, turn, parent, 1 FROM links UNION ALL SELECT up.conv_id, up.turn, links.parent, up.depth + 1 FROM up JOIN links ON links.conv_id = up.conv_id AND links.turn = up.far),
roots AS (SELECT conv_id, turn, arg_max(far, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
own AS (SELECT conv_id, turn, count(*) FILTER (marked > 0) AS n_quoted, string_agg(raw, chr(10) ORDER BY i) FILTER (marked = 0) AS text FROM x GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, links.parent AS parent_turn, coalesce(roots.root, m.turn) AS root_turn, CAST(coalesce(roots.depth, 0) AS BIGINT) AS depth, own.n_quoted, regexp_replace(coalesce(own.text, ''), '\\A\\s+|\\s+\\z', '', 'g') AS text
FROM m LEFT JOIN links USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)"""

# ---- spans


def _found(kinds: dict[str, str]) -> str:
    """y: all matches m of each kind's expression in each text, with their ends e (code points)."""
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(t, '{r}') AS ms, regexp_split_to_array(t, '{r}') AS ps FROM d" for k, r in ((k, v.replace("'", "''")) for k, v in kinds.items()))
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({each}),
u AS (SELECT doc_id, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS k FROM x WHERE len(ms) > 0),
y AS (SELECT doc_id, kind, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS BIGINT) AS e FROM u)"""


def _reported(base: list[str], order: str) -> str:
    """From spans (doc_id, kind, rank, b, e) to the columns of the query."""
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    own = ", ".join(f"'{k}'" for k in base)
    return f"""g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY {order}) FILTER (kind IN ({own})) AS own, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY {order}) AS every FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 - 9 * CAST(CAST(c AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0"
_IBAN = "regexp_replace(inner_m, ' ', '', 'g')"
_IBAN_OK = f"length({_IBAN}) <= 34 AND list_reduce([0] || list_transform(string_split(substr({_IBAN}, 5) || left({_IBAN}, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END), lambda acc, v: (acc * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
_CUED = "[Ii][Bb][Aa][Nn][ :#=.]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)"
_ACCOUNT = "(?i)(?:account|acct|passport|ssn|customer|konto|cuenta|compte)[ :#=.]*(?:(?:number|no|nr|id)\\b[ :#=.]*)?([0-9](?:[ -]?[0-9]){5,19})(?:[^0-9]|$)"

OP3 = f"""WITH {_found({"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "ip": "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "card": "[0-9](?:[ -]?[0-9])+", "phone": "[+][0-9][ ().0-9-]+[0-9]", "url": "(?i)(?:https?|ftp)://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?:[/?#][^ \t\r\n\f\v<>\"']*)?", "iban": _CUED, "account": _ACCOUNT})},
z AS (SELECT *, CASE kind WHEN 'iban' THEN regexp_extract(m, '{_CUED}', 1) WHEN 'account' THEN regexp_extract(m, '{_ACCOUNT}', 1) WHEN 'url' THEN rtrim(m, '.,;:!?)]}}') ELSE m END AS inner_m FROM y),
w AS (SELECT *, CASE WHEN kind = 'url' THEN e - length(m) WHEN kind IN ('iban', 'account') THEN e - CASE WHEN ends_with(m, inner_m) THEN 0 ELSE 1 END - length(inner_m) ELSE e - length(m) END AS b FROM z),
spans AS (SELECT doc_id, kind, list_position(['email', 'ip', 'card', 'phone', 'url', 'iban', 'account'], kind) AS rank, b, b + length(inner_m) AS e FROM w WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255))
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN} WHEN 'phone' THEN length({_DIGITS}) BETWEEN 8 AND 15 WHEN 'iban' THEN {_IBAN_OK} ELSE true END),
{_reported(["email", "ip", "card", "phone"], "rank, b")}"""

_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"""(?:{_KEYWORDS})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
_TOKEN = "(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?:[^A-Za-z0-9]|$)"
_BIT = "CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END"
_CRC = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(body, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda s, v: list_reduce([xor(s, v)] || CAST(range(8) AS BIGINT[]), lambda acc, k: {_BIT})), 4294967295)"
_BASE62 = "array_to_string(list_transform(range(5, -1, -1), lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(crc // CAST(pow(62, k) AS BIGINT) % 62 AS INTEGER) + 1, 1)), '')"

OP6 = f"""WITH {_found({"assign": _ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "token": _TOKEN})},
z AS (SELECT *, regexp_extract(m, '{_TOKEN}', 1) AS body, regexp_extract(m, '{_TOKEN}', 2) AS mark FROM y), c AS (SELECT *, CASE WHEN kind = 'token' THEN {_CRC} END AS crc FROM z),
spans AS (SELECT doc_id, kind, list_position(['assign', 'access', 'hex', 'token'], kind) AS rank, e - length(m) AS b, CASE WHEN kind = 'token' THEN e - length(m) + 37 + position('_' IN m) - 1 ELSE e END AS e FROM c WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(m, '{_ASSIGN.replace("'", "''")}', 1)) >= 12 WHEN 'access' THEN length(m) >= 18 WHEN 'hex' THEN length(m) >= 16 ELSE {_BASE62} = mark END),
{_reported(["assign", "access", "hex"], "b, rank")}"""

# ---- fingerprints: XXH64 in arithmetic modulo 2 ** 64

_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_M = f"{1 << 64}::UHUGEINT"


def _times(x: str, p: str) -> str:
    return f"(({x}) * {p} % {_M})"


def _rotated(x: str, r: int) -> str:
    return f"(({x}) * {1 << r}::UHUGEINT % {_M} + ({x}) // {1 << (64 - r)}::UHUGEINT)"


def _round(acc: str, x: str) -> str:
    return _times(_rotated(f"(({acc}) + {_times(x, _P2)}) % {_M}", 31), _P1)


def _bytes(at: str, n: int) -> str:
    """The little-endian number in ``n`` bytes of hx from byte ``at``."""
    return "CAST(CAST('0x' || " + " || ".join(f"substr(hx, CAST(2 * ({at}) + {2 * k + 1} AS INTEGER), 2)" for k in reversed(range(n))) + " AS UBIGINT) AS UHUGEINT)"


_LANES = [(j, (42 + c) % (1 << 64)) for j, c in enumerate((11400714785074694791 + 14029467366897019727, 14029467366897019727, 0, -11400714785074694791))]
_ACCS = ", ".join(f"CASE WHEN n >= 32 THEN list_reduce([{seed}::UHUGEINT] || list_transform(range(0, n // 32), lambda i: {_bytes(f'32 * i + {8 * j}', 8)}), lambda acc, x: {_round('acc', 'x')}) END AS v{j}" for j, seed in _LANES)
_TAIL = "n - n % 32"

OP9 = f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format("coalesce(text, '')")}, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i + 1:i + 4], ' '))) AS s FROM t WHERE len(ws) > 0),
q AS (SELECT s, upper(hex(encode(s))) AS hx, length(hex(encode(s))) // 2 AS n FROM (SELECT DISTINCT s FROM s)),
a AS (SELECT *, {_ACCS} FROM q),
m0 AS (SELECT *, CASE WHEN n >= 32 THEN ({_rotated('v0', 1)} + {_rotated('v1', 7)} + {_rotated('v2', 12)} + {_rotated('v3', 18)}) % {_M} END AS h0 FROM a),
{", ".join(f"m{j + 1} AS (SELECT *, ({_times(f'xor(h{j}, {_round("0::UHUGEINT", f"v{j}")})', _P1)} + {_P4}) % {_M} AS h{j + 1} FROM m{j})" for j in range(4))},
b AS (SELECT s, hx, n, (CASE WHEN n >= 32 THEN h4 ELSE 42 + {_P5} END + n::UHUGEINT) % {_M} AS h FROM m4),
e AS (SELECT s, hx, n, list_reduce([h] || list_transform(range(0, n % 32 // 8), lambda i: {_bytes(f'{_TAIL} + 8 * i', 8)}), lambda acc, x: ({_times(_rotated(f"xor(acc, {_round('0::UHUGEINT', 'x')})", 27), _P1)} + {_P4}) % {_M}) AS h FROM b),
f AS (SELECT s, hx, n, CASE WHEN n % 8 >= 4 THEN ({_times(_rotated(f"xor(h, {_times(_bytes('n - n % 8', 4), _P1)})", 23), _P2)} + {_P3}) % {_M} ELSE h END AS h FROM e),
w AS (SELECT s, list_reduce([h] || list_transform(range(0, n % 4), lambda i: {_bytes('n - n % 4 + i', 1)}), lambda acc, x: {_times(_rotated(f"xor(acc, {_times('x', _P5)})", 11), _P1)}) AS h FROM f),
w1 AS (SELECT s, {_times(f'xor(h, h // {1 << 33}::UHUGEINT)', _P2)} AS h FROM w), w2 AS (SELECT s, {_times(f'xor(h, h // {1 << 29}::UHUGEINT)', _P3)} AS h FROM w1), hashed AS (SELECT s, CAST(xor(h, h // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM w2),
ones AS (SELECT doc_id, k, sum(CAST((h // CAST(pow(2::UHUGEINT, k) AS UBIGINT)) % 2 AS BIGINT)) * 2 > count(*) AS one FROM s JOIN hashed USING (s), (SELECT range AS k FROM range(64)) GROUP BY doc_id, k),
fp AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN one THEN CAST(pow(2::UHUGEINT, k) AS UBIGINT)::HUGEINT END), 0) AS UBIGINT) AS fp FROM documents LEFT JOIN ones USING (doc_id) GROUP BY doc_id),
few AS (SELECT fp, min(doc_id) AS least FROM fp GROUP BY fp), near AS (SELECT x.fp AS u, y.fp AS v FROM few x JOIN few y ON bit_count(xor(x.fp, y.fp)::UHUGEINT::HUGEINT) <= 4),
reach(u, v) AS (SELECT u, v FROM near UNION SELECT reach.u, near.v FROM reach JOIN near ON reach.v = near.u),
named AS (SELECT u AS fp, min(least) AS component_id FROM reach JOIN few ON few.fp = reach.v GROUP BY u)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM fp JOIN named USING (fp)"""

OP10 = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE coalesce(len(v), 0) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (SELECT x.vec_id AS u, y.vec_id AS w FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95),
reach(u, w) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.u, near.w FROM reach JOIN near ON reach.w = near.u),
named AS (SELECT u AS vec_id, min(w) AS component_id FROM reach GROUP BY u), many AS (SELECT u AS vec_id, count(*) AS n FROM near GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN named USING (vec_id) LEFT JOIN many USING (vec_id)"""

ORACLE = {"op1_line_dedup": OP1, "op2_decontamination": OP2, "op3_pii": OP3, "op5_chat_formatting": OP5, "op6_secrets": OP6, "op9_simhash_near_dedup": OP9, "op10_embedding_near_dedup": OP10}
