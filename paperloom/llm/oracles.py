"""DuckDB twins of the training-text queries that SQL can state, over whole tables and whole texts."""

from __future__ import annotations

from .quality_rules import BOILERPLATE

_WORD = "[^\\x20\\x09-\\x0D]+"
_SEP = "[\\x20\\x09-\\x0D]"


def op3(n: int = 50) -> str:
    """Texts as hex strings; a window is 2n digits at an even place, compared by a 64-bit hash."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 1000 * c AS base, substr(h, 2000 * c + 1, {2000 + 2 * (n - 1)}) AS p FROM (SELECT doc_id, h, unnest(range(CAST(ceil(length(h) / 2000) AS BIGINT))) AS c FROM d)),
w AS (SELECT doc_id, base + i AS i, hash(substr(p, 2 * i + 1, {2 * n})) AS g FROM (SELECT doc_id, base, p, unnest(range(greatest(0, least(1000, CAST(length(p) / 2 AS BIGINT) - {n - 1})))) AS i FROM c)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
hit AS (SELECT w.doc_id, w.i FROM w JOIN f USING (g) WHERE f.first < w.doc_id),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {n} THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + {n} AS b FROM isl GROUP BY 1, 2),
keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM span UNION ALL SELECT d.doc_id, coalesce(m.b, 0), CAST(length(d.h) / 2 AS BIGINT) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY 1) m USING (doc_id)),
text AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * k.s + 1, 2 * (k.e - k.s)), '' ORDER BY k.s, k.e) AS h FROM keep k JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM d JOIN text t USING (doc_id) LEFT JOIN sums s USING (doc_id)"""


def op4() -> str:
    boiler = " OR ".join(f"contains(lower(line), '{b}')" for b in BOILERPLATE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) m ON m.doc_id = g.doc_id AND m.g = g.g) GROUP BY 1),
l AS (SELECT doc_id, line, length(regexp_replace(line, '{_SEP}', '', 'g')) AS chars, len(regexp_extract_all(line, '{_WORD}')) AS words FROM (SELECT doc_id, unnest(ls) AS line FROM d)),
v AS (SELECT *, (len(regexp_extract_all(line, '[|»›•·→]')) >= 4 AND len(regexp_extract_all(line, '[|»›•·→]')) * 3 >= words) OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 5 >= chars OR (words >= 4 AND len(regexp_extract_all(line, '[!?]+')) * 2 >= words) OR {boiler} AS fails FROM l WHERE chars > 0),
q AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups, sum(CASE WHEN fails THEN 0 ELSE chars END) AS good FROM v GROUP BY 1),
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(q.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(q.good, 0) AS good
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 1 - good / word_chars <= 0.5 AS kept FROM x"""


def op7(window: int = 3, long_words: int = 20) -> str:
    return f"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INT) AS line, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM l WHERE t <> ''),
runs AS (SELECT doc_id, k, {window} AS n, list(t) OVER w AS key, count(*) OVER w AS c FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)),
every AS (SELECT doc_id, k, n, key FROM runs WHERE c = {window} UNION ALL SELECT doc_id, k, 1, [t] FROM f WHERE len(regexp_extract_all(t, '{_WORD}')) >= {long_words}),
later AS (SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n, key ORDER BY doc_id, k) AS r FROM every) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM later),
cut AS (SELECT f.doc_id, f.line FROM f JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k),
kept AS (SELECT o.doc_id, string_agg(o.x, chr(10) ORDER BY o.line) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents) o ANTI JOIN cut c ON c.doc_id = o.doc_id AND c.line = o.line GROUP BY 1),
sums AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS r FROM cut GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_removed, coalesce(s.r, '') AS removed_lines, CAST(length(coalesce(k.t, '')) AS BIGINT) AS n_kept_chars, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN sums s USING (doc_id)"""


def op8(percent: int = 80) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sn AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sn a JOIN sn b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
two AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN two l ON l.x = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.b AS component_id, c.b = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY 1) c USING (doc_id)"""


#: DuckDB has no crc32: `t` is the table of 256 entries that the sum over a list of bytes needs.
_CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc(data: str) -> str:
    return f"xor(4294967295, list_reduce([4294967295] || {data}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _bytes(text: str) -> str:
    """UTF-8 bytes of a string as numbers."""
    return f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT))"


def _nodes(tree: str, leaves: str) -> str:
    """All nodes of the trees of `leaves(g, i, h, n)`, level by level."""
    return f"""{tree}_nodes AS (SELECT g, 0 AS level, i, h, n FROM {leaves} UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {tree}_nodes WHERE n > 1 GROUP BY g, level, i // 3),
{tree}_all AS MATERIALIZED (SELECT * FROM {tree}_nodes)"""


def _ways(tree: str, leaves: str) -> str:
    """From `leaves(id, g, i, now, proof)` up to the top: the folded digest and all siblings."""
    return f"""{tree}_way AS (SELECT id, g, 0 AS level, i, now, proof FROM {leaves} UNION ALL
  SELECT w.id, any_value(w.g), any_value(w.level) + 1, any_value(w.i) // 3, sha256(string_agg(CASE WHEN x.i = w.i THEN w.now ELSE x.h END, '' ORDER BY x.i)), any_value(w.proof) || coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i <> w.i), '')
  FROM {tree}_way w JOIN {tree}_all x ON x.g = w.g AND x.level = w.level AND x.i // 3 = w.i // 3 AND x.n > 1 GROUP BY w.id),
{tree}_end AS (SELECT id, g, arg_max(now, level) AS now, arg_max(proof, level) AS proof FROM {tree}_way GROUP BY id, g)"""


def op11() -> str:
    """Levels of all trees, and the way of every leaf, by recursion."""

    def leaf(text: str) -> str:
        fields = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({' || '.join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields)})"

    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
h AS (SELECT row_number() OVER () AS id, doc_id, source, {leaf("text")} AS h, {leaf("replace(text, chr(10), '')")} AS other, coalesce({_crc(_bytes("CAST(doc_id AS VARCHAR)"))} % 2 = 0, false) AS even FROM documents, crc),
leaves AS MATERIALIZED (SELECT id, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, h, CASE WHEN even THEN other ELSE h END AS now FROM h),
{_nodes("doc", "leaves")},
subroots AS MATERIALIZED (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM doc_all WHERE n = 1),
{_nodes("top", "subroots")},
{_ways("doc", "(SELECT id, g, i, now, '' AS proof FROM leaves)")},
{_ways("top", "(SELECT e.id, 0 AS g, s.i, e.now, e.proof FROM doc_end e JOIN subroots s ON s.source = e.g)")},
root AS (SELECT h FROM top_all WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.now AS folded_root, e.now = r.h AS verified
FROM leaves l JOIN subroots s ON s.source = l.g JOIN top_end e ON e.id = l.id, root r"""


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op12(window: int = 10) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '{word}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w FROM (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{word}') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[i:i + {window - 1}], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS i FROM b)),
ns AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
hit AS MATERIALIZED (SELECT p.r, p.i, p.n, win.item FROM p JOIN win ON win.n = p.n AND win.g = p.g),
words AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY 1),
met AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items, sha256(coalesce(met.items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN met USING (r)"""


def op13() -> str:
    """Near words by deleted and replaced places instead of letter counts."""
    return f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
runs AS (SELECT id, w, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY 1, 2),
h AS (SELECT w, n, {_crc(_bytes("id || ':' || w"))} AS h FROM runs, crc WHERE length(w) >= 5),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
one_less AS (SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cut c JOIN words w ON w.word = c.a || c.b),
pair AS (SELECT x.word, y.word AS near, y.n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word UNION ALL SELECT long, short, short_n FROM one_less UNION ALL SELECT short, long, long_n FROM one_less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'near': near}}) AS best FROM pair GROUP BY 1),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN best USING (word)),
step AS (SELECT word, word AS root, 0 AS k FROM form UNION ALL SELECT s.word, f.form, s.k + 1 FROM step s JOIN form f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT word, form, r.root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(root, k) AS root FROM step GROUP BY 1) r USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": op3(),
        "op4_quality_rules": op4(),
        "op7_line_dedup": op7(),
        "op8_near_dedup": op8(),
        "op11_merkle": op11(),
        "op12_decontamination": op12(),
        "op13_spelling": op13(),
    }
