"""DuckDB SQL for the operators whose results SQL can express, written from their definitions and not from their plans."""

from __future__ import annotations

from . import centroids, decontaminate, fill_middle, licenses, line_templates, quality, sharding, substring_dedup
from .words_sql import LOWER, UPPER

TEXT = "coalesce(text, '')"
LOW = f"translate({TEXT}, '{UPPER}', '{LOWER}')"
BLANK_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULE = "CASE rule " + " ".join(f"WHEN '{r}' THEN r_{r}" for r in quality.RULES) + " END"
_CUTS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r in quality.RULES for i, c in enumerate(quality.CUTOFFS[r]))
_RATE = quality.ALPHA / len(quality.RULES)

OP1 = rf"""WITH x AS (SELECT doc_id, lang, {TEXT} AS text, {BLANK_WORDS.format(TEXT)} AS w, list_filter(string_split({TEXT}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM x)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, 8)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT x.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM x LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (100 * n_symbols)::DOUBLE / greatest(word_chars, 1) AS r_symbol, (100 * n_dup_lines)::DOUBLE / greatest(n_lines, 1) AS r_dup_line,
    (100 * n_repeat_words)::DOUBLE / greatest(n_words, 1) AS r_repeat, word_chars::DOUBLE / greatest(n_words, 1) AS r_long_word FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
held AS (SELECT s.* FROM s JOIN good USING (doc_id) WHERE NOT base_failed),
cut(rule, step, cutoff) AS (VALUES {_CUTS}),
k AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE {_RULE} > cutoff) AS k FROM held, cut GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k > n * {_RATE}::DOUBLE THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE}::DOUBLE) + (n - j) * ln(1 - {_RATE}::DOUBLE)))) END
    <= {quality.DELTA}::DOUBLE / ({len(quality.RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM held))) AS ok FROM k),
stop AS (SELECT lang, rule, min(step) FILTER (WHERE NOT ok) AS stop FROM tail GROUP BY ALL),
chosen AS (SELECT tail.lang, rule, min(cutoff) AS most FROM tail JOIN stop USING (rule) WHERE tail.lang IS NOT DISTINCT FROM stop.lang AND (stop IS NULL OR step < stop) GROUP BY ALL),
beyond AS (SELECT DISTINCT doc_id FROM s JOIN chosen ON s.lang IS NOT DISTINCT FROM chosen.lang WHERE {_RULE} > most)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM s"""

_MARKED = r"\### Assistant: </turn> ok"
OP2 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, {TEXT} AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_MARKED}'), (-7, 1, 'assistant', '{_MARKED}')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, 14 + 2 * length(role || text) - length(regexp_replace(role || text, '[\\<#:]', '', 'g')) AS size FROM t),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY place) AS upto, max(CASE WHEN role = 'assistant' THEN place ELSE 0 END) OVER (PARTITION BY conv_id) AS last FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN upto WHEN place > last THEN size ELSE 0 END) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""

_L = line_templates
#: Rounds of growing templates that the SQL has; the operator goes on until no line is left.
_ROUNDS = 8


def _round(r: int) -> str:
    return f"""p{r} AS MATERIALIZED (SELECT node, own, unnest(tokens[{_L.DEPTH + 1}:]) AS token, unnest(range({_L.DEPTH + 1}, len(tokens) + 1)) AS place FROM m{r}),
c{r} AS MATERIALIZED (SELECT node, place, token AS common, kinds FROM (SELECT node, place, token, row_number() OVER (PARTITION BY node, place ORDER BY count(*) DESC, token DESC) AS r, count(*) OVER (PARTITION BY node, place) AS kinds FROM p{r} GROUP BY node, place, token) WHERE r = 1),
s{r} AS MATERIALIZED (SELECT node, arg_min(place, kinds * 1000000 + place) FILTER (WHERE kinds > 1) AS split FROM c{r} GROUP BY node),
a{r} AS MATERIALIZED (SELECT p.node, own, count(*) FILTER (WHERE token = common) * 100 >= count(*) * {_L.SIMILAR} AS fits FROM p{r} p JOIN c{r} c ON p.node = c.node AND p.place = c.place GROUP BY p.node, own),
l{r} AS MATERIALIZED (SELECT m.node || chr(10) || split || ' ' || tokens[split] AS node, m.own, tokens FROM m{r} m JOIN a{r} a ON m.node = a.node AND m.own = a.own JOIN s{r} s ON m.node = s.node WHERE NOT fits),
m{r + 1} AS MATERIALIZED (SELECT * FROM l{r} WHERE node IN (SELECT node FROM l{r} GROUP BY node HAVING count(*) > 1)),
"""


OP3 = rf"""WITH l AS (SELECT doc_id, pos, line, {BLANK_WORDS.format(r"regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g')")} AS tokens
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents)),
k AS MATERIALIZED (SELECT doc_id, pos, tokens, array_to_string(tokens, ' ') AS own, len(tokens) || ' ' || array_to_string(tokens[1:{_L.DEPTH}], ' ') AS leaf FROM l WHERE len(tokens) > 0),
m0 AS MATERIALIZED (SELECT DISTINCT leaf AS node, own, tokens FROM k WHERE leaf IN (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT own) > 1)),
{"".join(map(_round, range(_ROUNDS)))}g AS ({" UNION ALL ".join(f"SELECT node, own FROM a{r} WHERE fits" for r in range(_ROUNDS))}),
t AS (SELECT doc_id, pos, CASE WHEN g.own IS NULL THEN 'own ' || k.own ELSE 'node ' || g.node END AS template, CASE WHEN g.own IS NULL AND len(tokens) >= {_L.LONG_TOKENS} THEN {_L.LONG_DOCS} ELSE {_L.MIN_DOCS} END AS least FROM k LEFT JOIN g ON k.own = g.own
    UNION ALL SELECT doc_id, pos, 'own ' || own, {_L.LONG_DOCS} FROM k WHERE len(tokens) >= {_L.LONG_TOKENS} AND own IN (SELECT own FROM g)),
h AS (SELECT template, min(doc_id) AS first FROM t GROUP BY template, least HAVING count(DISTINCT doc_id) >= least),
gone AS (SELECT DISTINCT doc_id, pos FROM t JOIN h USING (template) WHERE doc_id <> first),
n AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS kept FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN n USING (doc_id)"""

_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in licenses.TEMPLATES.items())
_G = licenses.GRAM
OP4 = rf"""WITH d AS (SELECT doc_id, {ALNUM_WORDS.format(LOW)} AS w FROM documents), place AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
phrase(phrase, size, label) AS (VALUES {_PHRASES}), template(label, w) AS (VALUES {_TEMPLATES}),
base AS (SELECT doc_id, i, label FROM place, phrase WHERE w[i + 1] = string_split(phrase, ' ')[1] AND array_to_string(w[i + 1:i + size], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
tg AS (SELECT label, n, t, array_to_string(w[t + 1:t + {_G}], ' ') AS g FROM (SELECT label, w, len(w) AS n, unnest(range(0, len(w) - {_G} + 1)) AS t FROM template)),
dg AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {_G}], ' ') AS g FROM place WHERE i + {_G} <= len(w)),
v AS (SELECT DISTINCT doc_id, label, n, t, i - t AS diagonal FROM dg JOIN tg USING (g)),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {licenses.BAND} THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, label, diagonal FROM v) WINDOW w AS (PARTITION BY doc_id, label ORDER BY diagonal)),
m AS (SELECT doc_id, label, diagonal, sum(new) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS part FROM o),
c AS (SELECT doc_id, label, n, part, t + unnest(range(0, {_G})) AS word FROM v JOIN m USING (doc_id, label, diagonal)),
s AS (SELECT doc_id, label, count(DISTINCT word)::DOUBLE / n AS score FROM c GROUP BY doc_id, label, n, part HAVING count(DISTINCT word)::DOUBLE / n >= {licenses.COVER}::DOUBLE),
more AS (SELECT doc_id, list(DISTINCT string_split(label, ':')[1]) AS labels, max(score) AS best FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, more.labels))), ','), '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN more USING (doc_id)"""

OP8 = rf"""WITH RECURSIVE w AS (SELECT doc_id, {BLANK_WORDS.format(LOW)} AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, w.doc_id <= coalesce(b, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = w.doc_id"""

_W = decontaminate.WINDOW
OP9 = rf"""WITH d AS (SELECT doc_id, {ALNUM_WORDS.format(LOW)} AS w FROM documents), b AS (SELECT item_id, {ALNUM_WORDS.format(LOW)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {_W}) AS n, array_to_string(w[i:i + {_W - 1}], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {_W - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
f AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS p FROM f) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM f GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""

_S = substring_dedup.WINDOW
OP10 = rf"""WITH d AS (SELECT doc_id, {BLANK_WORDS.format(TEXT)} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {_S - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_S - 2})) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, {_S})) AS i FROM g JOIN f USING (g) WHERE doc_id > first),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_FLOOR = f"list_transform(embedding, lambda x: floor(x::DOUBLE * {centroids.SCALE}))"


def _nearest(c: str) -> str:
    """vec_id, q, c, d: the nearest of the centroids in a table (c, q)."""
    return f"SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, {c} AS c) GROUP BY vec_id, q"


def _mean(c: str, a: str) -> str:
    return f"SELECT c.c, coalesce(m.q, c.q) AS q FROM {c} AS c LEFT JOIN (SELECT c, list(f ORDER BY i) AS q FROM (SELECT c, i, floor(sum(x) / count(*)) AS f FROM (SELECT c, unnest(q) AS x, unnest(range(0, len(q))) AS i FROM {a}) GROUP BY c, i) GROUP BY c) AS m USING (c)"


_STEPS = ",\n".join(f"a{r} AS MATERIALIZED ({_nearest(f'c{r}')}), c{r + 1} AS MATERIALIZED ({_mean(f'c{r}', f'a{r}')})" for r in range(centroids.ROUNDS))
OP11 = f"""WITH v AS MATERIALIZED (SELECT vec_id, {_FLOOR} AS q FROM embeddings WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('1:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {centroids.CENTROIDS})),
{_STEPS},
z AS ({_nearest(f'c{centroids.ROUNDS}')})
SELECT vec_id, CAST(z.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM z JOIN c{centroids.ROUNDS} AS c ON z.c = c.c"""

_NODES = ", ".join(f"({n}, {level}, '{parent}', '{child}', {weight}::DOUBLE)" for n in (sharding.BASE, sharding.BASE + 1) for level, of in enumerate(sharding._children(sharding.layout(n))) for parent, kids in of.items() for child, weight in kids.items())
_DOWN = "SELECT doc_id, n, arg_min(child, (-ln((('0x' || substr(md5('id ' || doc_id || '@' || child), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / weight, child)) AS leaf FROM {} GROUP BY doc_id, n"
_STEP = lambda k: f"SELECT p{k - 1}.doc_id, node.n, child, weight FROM p{k - 1} JOIN node ON level = {k} AND parent = leaf AND node.n = p{k - 1}.n"
OP12 = f"""WITH node(n, level, parent, child, weight) AS (VALUES {_NODES}),
p0 AS MATERIALIZED ({_DOWN.format('(SELECT doc_id, n, child, weight FROM documents, node WHERE level = 0)')}), p1 AS MATERIALIZED ({_DOWN.format(f'({_STEP(1)})')}), p2 AS MATERIALIZED ({_DOWN.format(f'({_STEP(2)})')}),
s AS (SELECT doc_id, n, CAST(regexp_extract(leaf, '[0-9]+$') AS INT) AS shard FROM p2),
bits AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({TEXT})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, bits)
SELECT doc_id, octet_length(encode({TEXT})) + 1 AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY doc_id) - 1 AS slot, b.shard AS grown_shard
FROM documents JOIN crc USING (doc_id) JOIN s AS a USING (doc_id) JOIN s AS b USING (doc_id) WHERE a.n = {sharding.BASE} AND b.n = {sharding.BASE + 1}"""

_PART = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
_P, _S3, _M = fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE
OP13 = f"""WITH d AS (SELECT doc_id, {TEXT} AS t, length({TEXT}) AS n, sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT *, least({_PART(0)} % (n + 1), {_PART(1)} % (n + 1)) AS a, greatest({_PART(0)} % (n + 1), {_PART(1)} % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{_P}') OR contains(t, '{_S3}') OR contains(t, '{_M}') OR {_PART(2)} % 100 >= {100 - fill_middle.PLAIN_PERCENT} THEN 'plain' WHEN {_PART(3)} % 100 < {fill_middle.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || p || '{_S3}' || x || '{_M}' || m ELSE '{_S3}' || x || '{_P}' || p || '{_M}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op2_chat_formatting": OP2,
    "op3_line_dedup": OP3,
    "op4_license_scan": OP4,
    "op8_near_duplicates": OP8,
    "op9_decontamination": OP9,
    "op10_substring_dedup": OP10,
    "op11_centroid_clustering": OP11,
    "op12_sharding": OP12,
    "op13_fill_in_middle": OP13,
}
