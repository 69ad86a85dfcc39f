"""DuckDB statements of what the operators return, written from their definitions alone."""

from __future__ import annotations

from tessella.llm.license_scan import LEAST_DICE, PART_OF, bounds, extended, needed, required, templates, windows
from tessella.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS, WINDOW
from tessella.llm.source_mix import LEVELS, Mix
from tessella.llm.url_filter import DAMPING, DIGITS, LOWER, MARGIN, ROUNDS, UPPER
from tessella.llm.url_filter import RULES as URL_RULES

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def quality_sql() -> str:
    stop = ", ".join(sorted({f"'{w}'" for group in STOP_WORDS.values() for w in group}))
    tests = []
    for r in RULES:
        value = f"{r.top} / greatest({r.of}, 1)"
        ends = [f"{value} < {r.low}"] * (r.low is not None) + [f"{value} > {r.high}"] * (r.high is not None)
        tests.append(f"WHEN n_words >= {r.least_words} AND ({' OR '.join(ends)}) THEN '{r.name}'")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS x
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
again AS (SELECT rid, x FROM win GROUP BY rid, x HAVING count(*) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win JOIN again USING (rid, x), range({WINDOW}) AS r(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
        len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT *, CASE WHEN base_failed THEN NULL {' '.join(tests)} END AS broken FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, n_lines::BIGINT AS n_lines,
  n_upper::BIGINT AS n_upper, n_stop::BIGINT AS n_stop, broken
FROM v"""


def near_duplicate_sql(percent: int, words: int = 5) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(ws) < {words} THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + {words - 1}], ' ') END AS x
      FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - {words - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS p, b.rid AS q, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT p, q FROM c JOIN n AS np ON np.rid = p JOIN n AS nq ON nq.rid = q WHERE 100 * c >= {percent} * (np.n + nq.n - c)),
e AS (SELECT p, q FROM l UNION SELECT q, p FROM l),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.q FROM r JOIN e ON r.other = e.p),
k AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN k USING (rid) LEFT JOIN n USING (rid)"""


def near_vectors_sql(least_cos: float) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM d
       WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND list_dot_product(x, x) > 0),
e AS (SELECT a.rid AS p, b.rid AS q FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {least_cos}),
r AS (SELECT rid, rid AS other FROM d UNION SELECT r.rid, e.q FROM r JOIN e ON r.other = e.p),
k AS (SELECT r.rid, min(d.vec_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid),
n AS (SELECT p AS rid, count(*) AS n FROM e GROUP BY p)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM d JOIN k USING (rid) LEFT JOIN n USING (rid)"""


def url_sql() -> str:
    link = r"""(?:href|src|HREF|SRC)\s*=\s*["'']?(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#"''\s<>]+)"""
    fits = [
        (r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')")
        for r in sorted(URL_RULES, key=lambda r: -len(r.name))
    ]
    rule = " ".join(f"WHEN {test} THEN '{r.name}'" for r, test in fits)
    verdict = " ".join(f"WHEN {test} THEN '{r.verdict}'" for r, test in fits)

    def rank(name: str, mass: str, src: str, dst: str) -> str:
        out = [
            f"{name}s AS MATERIALIZED (SELECT host, CASE WHEN sum({mass}) OVER () > 0 THEN {mass} / sum({mass}) OVER () ELSE 0.0 END::DOUBLE AS seed FROM hosts)",
            f"{name}p AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS part FROM edges)",
            f"{name}0 AS MATERIALIZED (SELECT host, seed AS score FROM {name}s)",
        ]
        for i in range(1, ROUNDS + 1):
            out.append(
                f"{name}{i} AS MATERIALIZED (SELECT s.host, CASE WHEN (SELECT count(*) FROM edges) = 0 THEN s.seed ELSE ({1 - DAMPING} + {DAMPING} * "
                f"(SELECT coalesce(sum(score), 0) FROM {name}{i - 1} WHERE host NOT IN (SELECT src FROM {name}p))) * s.seed + {DAMPING} * coalesce(g.got, 0) END AS score "
                f"FROM {name}s s LEFT JOIN (SELECT dst, sum(part * score) AS got FROM {name}p JOIN {name}{i - 1} ON src = host GROUP BY dst) g ON g.dst = s.host)"
            )
        return ",\n".join(out)

    return f"""
WITH u AS (SELECT page_id, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS fixed FROM p),
edges AS MATERIALIZED (SELECT host AS src, dst, count(*) AS n FROM (
    SELECT host, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{UPPER}', '{LOWER}') AS dst FROM p)
  WHERE host <> dst AND host <> '' GROUP BY 1, 2),
hosts AS MATERIALIZED (SELECT host, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (
    SELECT host, (fixed = 'allow')::INT AS a, (fixed = 'block')::INT AS b FROM f UNION ALL SELECT dst, 0, 0 FROM edges) GROUP BY host),
{rank("t", "coalesce(a, 0)", "src", "dst")},
{rank("d", "coalesce(b, 0)", "dst", "src")},
s AS (SELECT host, round(t.score, {DIGITS}) AS trust, round(d.score, {DIGITS}) AS distrust FROM t{ROUNDS} t JOIN d{ROUNDS} d USING (host))
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN distrust > trust + {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM f JOIN s USING (host)"""


def license_sql() -> str:
    known = []
    for i, t in enumerate(templates()):
        lo, hi = bounds(len(t.bigrams), LEAST_DICE)
        grams = ", ".join(f"'{b}'" for b in t.bigrams)
        must = required(t, templates())
        lists = ", ".join("[" + ", ".join(f"'{b}'" for b in x) + "]" for x in must)
        known.append(f"SELECT {i} AS i, '{t.name}' AS license, [{grams}] AS g, {lo!r} AS lo, {hi!r} AS hi, [{lists}]::VARCHAR[][] AS must, {needed(must, LEAST_DICE)} AS need, "
                     f"{repr(extended(t, templates())[0][0]) if extended(t, templates()) else 'NULL'} AS stop, "
                     f"{list(extended(t, templates())[0][1]) if extended(t, templates()) else []}::VARCHAR[] AS beyond")
    parts = ", ".join(f"('{a}', '{b}')" for a, b in PART_OF.items())
    laid = ", ".join(f"('{w}', {at}, {n})" for w, at, n in windows(templates(), LEAST_DICE))
    return f"""
WITH k AS ({" UNION ALL ".join(known)}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
      regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS t FROM documents),
laid(word, before, long) AS (VALUES {laid}),
h AS (SELECT rid, ws, unnest(range(len(ws))) AS i FROM (SELECT rid, string_split_regex(trim(replace(t, chr(10), ' '), ' '), ' +') AS ws FROM d)),
s AS (SELECT rid, unnest(list_concat(string_split(t, chr(10)),
        list_transform(string_split_regex(t, '\\n *\\n'), lambda x: replace(x, chr(10), ' ')), [replace(t, chr(10), ' ')])) AS x FROM d
      UNION SELECT rid, array_to_string(ws[greatest(i - before, 0) + 1:i - before + long], ' ') FROM h JOIN laid ON ws[i + 1] = word),
w AS (SELECT rid, x, string_split_regex(trim(x, ' '), ' +') AS w FROM s),
b AS (SELECT rid, x, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT rid, x, license, 2.0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice, i, stop IS NULL OR list_has_any(b, beyond) AS sure FROM b JOIN k ON len(b) BETWEEN lo AND hi
      WHERE len(list_filter(must, lambda y: list_has_any(b, y))) >= need AND (stop IS NULL OR NOT list_contains(b, stop) OR list_has_any(b, beyond))),
g AS (SELECT rid, x, max_by(license, (dice, -i)) AS license, max_by(sure, (dice, -i)) AS sure, max(dice) AS dice FROM m WHERE dice >= {LEAST_DICE} GROUP BY rid, x),
po(part, whole) AS (VALUES {parts}),
f AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM po JOIN g AS o ON o.license = whole WHERE part = g.license AND o.rid = g.rid AND o.sure)
      AND NOT EXISTS (SELECT 1 FROM po JOIN g AS o ON o.license = part WHERE whole = g.license AND o.rid = g.rid
                      AND NOT EXISTS (SELECT 1 FROM g AS z WHERE z.rid = g.rid AND z.license = whole AND z.sure))),
r AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best_dice, count(DISTINCT license) AS n FROM f GROUP BY rid)
SELECT doc_id, licenses, best_dice, coalesce(n, 0)::BIGINT AS n_licenses FROM d LEFT JOIN r USING (rid)"""


def mix_sql() -> str:
    mix = Mix()

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in mix.weights.get(level, {}).items())
        return f"CASE {cases} ELSE {mix.other} END" if cases else str(mix.other)

    steps, held = [], []
    for i, name in enumerate(LEVELS):
        on = f"JOIN b{i - 1} USING ({', '.join(held)})" if held else f"CROSS JOIN (SELECT sum(tokens) * {mix.percent} // 100 AS budget FROM leaves) b"
        part = f"PARTITION BY {', '.join(held)} " if held else ""
        cols = ", ".join([*held, name])
        steps.append(
            f"n{i} AS (SELECT n.*, budget FROM (SELECT {cols}, sum(tokens)::BIGINT * {mix.max_epochs} AS cap, {weight(name)} AS w FROM leaves GROUP BY {cols}) n {on}),\n"
            f"f{i} AS (SELECT *, cap * sum(w) OVER ({part}ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= "
            f"(budget - coalesce(sum(cap) OVER ({part}ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled FROM n{i}),\n"
            f"b{i} AS (SELECT {cols}, (CASE WHEN filled THEN cap ELSE ((budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0)) * w) // "
            f"sum(CASE WHEN NOT filled THEN w END) OVER ({part}) END)::BIGINT AS budget FROM f{i})"
        )
        held.append(name)
    names = ", ".join(f"'{d}'" for d in mix.domains)
    leaf = ", ".join(LEVELS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens,
      [{names}][coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % {len(mix.domains)}, 0) + 1] AS domain FROM documents),
leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(steps)},
p AS (SELECT l.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM leaves l JOIN b2 USING ({leaf})),
k AS (SELECT d.*, budget, epochs, budget - epochs * tokens AS part, md5('{mix.seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM d JOIN p USING ({leaf})),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY key) AS upto FROM k)
SELECT doc_id, {leaf}, n_tokens, budget AS leaf_budget, (epochs + (upto <= part)::INT)::BIGINT AS copies FROM u"""


def rollup_sql() -> str:
    return """
SELECT source, lang, 'words_2' AS tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens
FROM (SELECT source, lang, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents) WHERE n >= 5 GROUP BY ALL"""


def trie_sql() -> str:
    """Nodes by the texts of their whole prefixes, subtrees by joining every node with all its ancestors; CRC-32 bit by bit."""
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
        flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
u AS (SELECT h.conv_id, 0 AS own, t.i, role, text FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
      UNION ALL SELECT h.conv_id, 1, t.i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
r AS (SELECT conv_id, row_number() OVER w AS d, text, list([role, text]) OVER w AS p FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
x AS (SELECT conv_id, d, text, p FROM r UNION ALL SELECT conv_id, 0, '', [] FROM h),
ended AS (SELECT conv_id, max(d) AS length FROM x GROUP BY conv_id),
n AS (SELECT d AS depth, p, min(x.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '{WORD}')) AS saved,
        sha256(coalesce(string_agg(x.conv_id::VARCHAR, ',' ORDER BY x.conv_id) FILTER (d = length), '')) AS ends_sha256
      FROM x JOIN ended USING (conv_id) GROUP BY d, p),
k AS (SELECT a.depth, a.p, count(b.p) AS n_children FROM n AS a LEFT JOIN n AS b ON b.depth = a.depth + 1 AND b.p[1:a.depth] = a.p GROUP BY a.depth, a.p),
s AS (SELECT a.depth, a.p, sum((k.n_children = 0)::INT)::BIGINT AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens
      FROM n AS a JOIN n AS b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p JOIN k ON k.depth = b.depth AND k.p = b.p GROUP BY a.depth, a.p)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, k.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN k ON k.depth = n.depth AND k.p = n.p JOIN s ON s.depth = n.depth AND s.p = n.p
  LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.p = n.p[1:n.depth - 1]"""


def audit_sql() -> str:
    """Each order and step counted from the failures of all documents, without states."""
    letters = "(SELECT unnest(range(5)) AS {0})"
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS m
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, m),
o AS (SELECT [a, b, c, d, e] AS o FROM {letters.format('a')}, {letters.format('b')}, {letters.format('c')}, {letters.format('d')}, {letters.format('e')}
      WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: chr((65 + x)::INT)), '') AS filter_order, step::INT AS step, o[step] AS f, 1 << o[step]::INT AS bit,
        coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x::INT)), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER ((m & (before | bit)) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER ((m & before) = 0 AND (m & bit) > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER ((m & before) > 0 AND (m & bit) > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER ((m & before) = 0 AND (m & bit) > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER ((m & before) = 0 AND (m & bit) > 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM r"""
