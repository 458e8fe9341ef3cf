"""SQL that gives the same rows as the operators' queries, where SQL can express them.

Not expressible: op4 and op6 deal rows by a 64-bit hash that SQL lacks, op5's cuts are a search, op7 stores bytes in a
media format, op8 is a fitted model. Those are tested against brute force, round trips and held-out labels.
"""

from tideline.llm.licenses import PHRASES, TEMPLATES, WHOLE
from tideline.llm.quality import MARKS, RULES, STOP_WORDS, SYMBOLS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP1 = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
its AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM its) AS sizes)),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_item) AS n_item, round(count(*) / any_value(n_item), 6) AS containment FROM ds JOIN its USING (s, k) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n_item) - 1e-9"""


def _phrase(p: str) -> str:
    return " AND ".join(f"w[p + {k}] = '{x}'" for k, x in enumerate(p.split()))


_PLACES = " UNION ALL ".join(f"SELECT doc_id, p - 1 AS place, '{label}' AS label FROM wp WHERE {_phrase(p)}" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
OP2 = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), wp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d), pl AS ({_PLACES}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM pl GROUP BY doc_id),
t AS (SELECT name, t, n, CASE WHEN len(t) >= {WHOLE} THEN ceil(0.8::DOUBLE * len(t) - 1e-9) ELSE len(t) END AS need FROM (SELECT name, list_distinct(string_split(words, ' ')) AS t, ceil(len(string_split(words, ' ')) / 0.8::DOUBLE - 1e-9)::BIGINT AS n FROM (VALUES {_TEMPLATES}) v(name, words))),
m AS (SELECT doc_id, name, list_max([len(list_intersect(t, w[p:p + n - 1])) FOR p IN range(1, greatest(len(w) - n + 2, 2))]) AS c, len(t) AS k, need FROM d, t WHERE len(list_intersect(t, w)) >= need),
f AS (SELECT doc_id, list(DISTINCT name) AS names, max(c / k) AS best, count(DISTINCT name) AS n_templates FROM m WHERE c >= need GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(names, [])))), ',') AS labels,
 round(CASE WHEN coalesce(n_base, 0) > 0 THEN 1 ELSE coalesce(best, 0) END, 6)::DOUBLE AS score, coalesce(n_templates, 0) AS n_templates FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN f ON d.doc_id = f.doc_id"""

OP3 = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), w AS (SELECT doc_id, p - 1 AS p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d)),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM w WHERE trim(a || b || c, ' ') <> ''), g AS (SELECT DISTINCT doc_id, p + o AS i FROM k, range(3) r(o) WHERE n > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d), r AS (SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(line, chr(10) ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN r USING (doc_id)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM d WHERE len(w) > 0)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2), ln AS (SELECT a, b FROM pr JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
ed AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln), re AS (SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(re.b)) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN re ON re.a = d.doc_id GROUP BY d.doc_id"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of UTF-8 bytes, bit by bit."""
    each = f"list_transform(range(1, octet_length(encode({text})) * 2, 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {each}), lambda c, b: {step}), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    part = lambda v: f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, depth: int) -> str:
    """Tables {name}1 .. {name}depth of (g, p, d) from {name}0, and of each node its siblings in its run (l, r; null at the top)."""
    out = []
    for k in range(depth):
        run = "PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN"
        out.append(f"{name}s{k} AS (SELECT g, p, d, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, p // 16 AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d FROM {name}s{k} GROUP BY g, p // 16)")
    return ", ".join(out)


def _climbed(name: str, depth: int, at: str, place: str) -> str:
    """Joins of a row's siblings on every level."""
    return " ".join(f"JOIN {name}s{k} AS {name}x{k} ON {name}x{k}.g = {at} AND {name}x{k}.p = {place} // {16**k}" for k in range(depth))


_STEPS = [f"a{k}" for k in range(4)] + [f"b{k}" for k in range(3)]
_NESTED = ", ".join(f"f{i + 1} AS (SELECT *, CASE WHEN {x[0]}x{x[1]}n > 1 THEN sha256({x[0]}x{x[1]}l || h{i} || {x[0]}x{x[1]}r) ELSE h{i} END AS h{i + 1} FROM f{i})" for i, x in enumerate(_STEPS))
_FIELDS_11 = ", ".join(f"{x[0]}x{x[1]}.{c} AS {x[0]}x{x[1]}{c}" for x in _STEPS for c in "nlr")
_PROOF = " || ".join(f"CASE WHEN {x[0]}x{x[1]}n > 1 THEN {x[0]}x{x[1]}l || {x[0]}x{x[1]}r ELSE '' END" for x in _STEPS)
#: Sources of up to 65,536 rows, up to 4,096 sources.
OP11 = f"""WITH e AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS later FROM documents),
e2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM e), a0 AS (SELECT g, p, leaf AS d FROM e2), {_levels('a', 4)},
q AS (SELECT g AS s, d, row_number() OVER (ORDER BY encode(g)) - 1 AS p FROM a4), b0 AS (SELECT '' AS g, p, d FROM q), {_levels('b', 3)},
f0 AS (SELECT e2.doc_id, e2.leaf, q.d AS subroot, b3.d AS root, coalesce(later, leaf) AS h0, {_FIELDS_11} FROM e2 JOIN q ON q.s = e2.g JOIN b3 ON true {_climbed('a', 4, 'e2.g', 'e2.p')} {_climbed('b', 3, "''", 'q.p')}), {_NESTED}
SELECT doc_id, leaf, subroot, root, sha256({_PROOF}) AS proof_sha256, h7 AS folded_root, h7 = root AS verified FROM f7"""

_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _rules() -> str:
    measures = {"n_words": "n_words", "mean_word": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)", "mark_ratio": "n_marks / nullif(n_words, 0)", "stop_ratio": "n_stop / nullif(n_words, 0)", "repeat_ratio": "n_repeat_words / nullif(n_words, 0)", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "bullet_ratio": "n_bullets / nullif(n_lines, 0)", "ellipsis_ratio": "n_ellipses / nullif(n_lines, 0)"}
    bound = lambda m, least, most: " AND ".join([f"{m} >= {least}::DOUBLE"] * (least is not None) + [f"{m} <= {most}::DOUBLE"] * (most is not None))
    return ", ".join(f"CASE WHEN coalesce(NOT ({bound(measures[m], least, most)}), true) THEN '{name}' END" for name, m, least, most in RULES)


_among = lambda chars: "len(text) - len(translate(text, '" + chars + "', ''))"
_STOPS = ", ".join(f"'{w}', '{w.capitalize()}'" for w in STOP_WORDS)
OP12 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(text, '') AS text, {_SPACED} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d), p AS (SELECT id, p, x, lead(x, 1) OVER (PARTITION BY id ORDER BY p) AS y, lead(x, 2) OVER (PARTITION BY id ORDER BY p) AS z FROM x), t AS (SELECT id, p, count(*) OVER (PARTITION BY id, x, y, z) AS c FROM p WHERE z IS NOT NULL), r AS (SELECT id, count(DISTINCT p + o) AS n FROM t, range(3) ofs(o) WHERE c > 1 GROUP BY id),
m AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, {_among(SYMBOLS)} AS n_symbols, {_among(MARKS)} AS n_marks, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop,
 len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipses FROM d LEFT JOIN r USING (id)),
f AS (SELECT *, list_filter([{_rules()}], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed FROM f"""

_COUNTED = lambda name, table: f"{name} AS (SELECT b, count(*) AS n FROM (SELECT unnest({_words('text')}) AS w FROM {table}) JOIN v USING (w) GROUP BY b)"
OP13 = f"""WITH v AS (SELECT w, {_crc32('w')} % 10000 AS b FROM (SELECT DISTINCT unnest({_words('text')}) AS w FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))),
{_COUNTED('s', 'documents')}, {_COUNTED('t', 'benchmark')}, n AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (n.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS gain FROM (SELECT DISTINCT b FROM v) LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
d AS (SELECT row_number() OVER () AS id, doc_id, {_words('text')} AS w FROM documents), x AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM (SELECT id, unnest(w) AS w FROM d) JOIN v USING (w) JOIN g USING (b) GROUP BY id),
y AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN floor(total / n::DOUBLE)::BIGINT ELSE 0 END AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN x USING (id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y), o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS c FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * c // 100 THEN k END AS rank FROM o"""

SQL = {"op11_merkle": OP11, "op12_quality_rules": OP12, "op13_resample": OP13, "op1_decontaminate": OP1, "op2_licenses": OP2, "op3_line_dedup": OP3, "op9_jaccard_join": OP9, "op10_warc": OP10}
