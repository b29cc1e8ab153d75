"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES as QUALITY_RULES
from .quality_rules import STOP_WORDS
from .secret_scan import BASE
from .secret_scan import RULES as SECRET_RULES
from .url_filter import MIN_GOOD, TWO_LABEL_SUFFIXES, Z


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = f"""
WITH parsed AS (
  SELECT page_id, {_lower("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
trials AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS good FROM labels),
hosts0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k FROM parsed LEFT JOIN trials ON page_id = doc_id GROUP BY host),
named AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\\.$', '', 'g') AS name FROM hosts0),
labelled AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$|^\\[') AS addr FROM named),
tails AS (SELECT *, array_to_string(l[-1:], '.') AS t1, array_to_string(l[-2:], '.') AS t2, array_to_string(l[-3:], '.') AS t3 FROM labelled),
hosts AS (
  SELECT host, n, k, CASE WHEN addr THEN '' WHEN t2 IN ({_quoted(TWO_LABEL_SUFFIXES)}) THEN t2 ELSE t1 END AS suffix,
         CASE WHEN addr THEN name WHEN t2 IN ({_quoted(TWO_LABEL_SUFFIXES)}) THEN t3 ELSE t2 END AS domain FROM tails),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
web AS (SELECT (coalesce(sum(k), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
r0 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4::DOUBLE), 0.99::DOUBLE) - 1 AS s FROM suffixes, web),
sm AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM suffixes, web, r0),
d1 AS (SELECT domain, suffix, n, k, m FROM domains JOIN sm USING (suffix)),
r1 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4::DOUBLE), 0.99::DOUBLE) - 1 AS s FROM d1),
dm AS (SELECT domain, suffix, (k + s * m) / (n + s) AS m FROM d1, r1),
h1 AS (SELECT host, n, k, m FROM hosts JOIN dm USING (domain, suffix)),
r2 AS (SELECT 1 / least(greatest(coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0), 1e-4::DOUBLE), 0.99::DOUBLE) - 1 AS s FROM h1),
ab AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM h1, r2),
known AS (SELECT host, a / (a + b) + {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM ab),
ruled AS (
  SELECT page_id, host, path, upper,
         CASE WHEN host = 'www.example.com' OR ends_with(host, '.www.example.com') THEN starts_with(path, '/en/') ELSE false END AS w,
         CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN starts_with(path, '/en/') ELSE false END AS e,
         host = 'net' OR ends_with(host, '.net') AS net, (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') AS com
  FROM parsed LEFT JOIN known USING (host))
SELECT page_id, host, path,
       CASE WHEN w THEN 'www.example.com/en/' WHEN e THEN 'example.com/en/' WHEN net AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN net AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN com THEN 'com/' END AS rule,
       CASE WHEN w THEN 'allow' WHEN e THEN 'block' WHEN net AND (starts_with(path, '/es/') OR starts_with(path, '/fr/')) THEN 'block'
            WHEN com THEN 'allow' WHEN upper < {MIN_GOOD}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP4 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w[1:10]) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
runs AS (SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS key FROM pos),
hit AS (SELECT rid, i, size, item_id FROM runs JOIN win USING (size, key)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""


def _rule_sql() -> str:
    tests = []
    for r in QUALITY_RULES:
        inside = [f"{r.measure} >= {r.low}::DOUBLE"] * (r.low != float("-inf")) + [f"{r.measure} <= {r.high}::DOUBLE"] * (r.high != float("inf"))
        tests.append(f"(n_words < {r.min_words} OR ({' AND '.join(inside)}))")
    return " AND ".join(tests)


_BLANK = "regexp_replace({}, '[\\x20\\x09-\\x0D]+', '', 'g')"
QUALITY_CTE = f"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_BLANK.format("x")} <> '') AS l FROM documents),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS key FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, key) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length({_BLANK.format("text")})::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: {_lower("x")} IN ({_quoted(STOP_WORDS)}))) AS n_stop
  FROM d LEFT JOIN cov USING (rid)),
ratios AS (
  SELECT *, word_chars / greatest(n_words, 1)::DOUBLE AS mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_ratio,
         n_stop / greatest(n_words, 1)::DOUBLE AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_ratio,
         n_words / greatest(n_lines, 1)::DOUBLE AS words_per_line, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""
OP7 = f"""
WITH {QUALITY_CTE}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rule_sql()} AS kept FROM ratios
"""


def _secret_spans(rank: int) -> str:
    r = SECRET_RULES[rank]
    pattern, flags = (r.pattern.removeprefix("(?i)"), "'i'") if r.pattern.startswith("(?i)") else (r.pattern, "'c'")
    q = pattern.replace("'", "''")
    return f"""
  SELECT rid, {rank} AS rank, '{r.kind}' AS kind, g, list_transform(regexp_extract_all(text, '{q}', 0, {flags}), lambda x: length(x)) AS whole,
         list_transform(regexp_extract_all(text, '{q}', {r.group}, {flags}), lambda x: length(x)) AS part, {r.min_length} AS least
  FROM (SELECT rid, text, list_transform(regexp_split_to_array(text, '{q}', {flags}), lambda x: length(x)) AS g FROM t WHERE regexp_matches(text, '{q}', {flags}))"""


OP8 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_secret_spans(i) for i in range(len(SECRET_RULES)))}),
pos AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM raw),
spans AS (
  SELECT rid, rank, kind, (list_sum(g[1:i]) + coalesce(list_sum(whole[1 : i - 1]), 0))::BIGINT AS s, whole[i] AS n FROM pos WHERE part[i] >= least),
agg AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans,
         coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (kind IN ({_quoted(BASE)})), '') AS base,
         {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}
  FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN agg USING (rid)
"""



def _crc32(s: str) -> str:
    """Of an ASCII string, bit by bit."""
    bits = "list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda b: ascii(b)::BIGINT)), lambda crc, byte: {bits}), 4294967295)"


def _merkle(levels: int = 8, tops: int = 3) -> str:
    """Levels of nodes as tables, siblings by joins; for up to 8^levels documents of a language and 8^tops languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    found = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_lower('text')} ELSE text END"
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf('seen')} AS found FROM (SELECT *, {found} AS seen FROM documents))",
        "l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "g0 AS (SELECT lang AS k, pos, leaf AS hash, n FROM l0)",
    ]

    def tree(t: str, height: int) -> list[str]:
        out = []
        for i in range(height):
            here = f"(SELECT * FROM {t}{i} WHERE n > {8**i})"
            out.append(f"{t}{i + 1} AS MATERIALIZED (SELECT k, pos // 8 AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, any_value(n) AS n FROM {here} GROUP BY k, pos // 8)")
            ends = [f"coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos {op} a.pos), '') AS {side}" for op, side in (("<", "before"), (">", "after"))]
            out.append(f"{t}s{i} AS MATERIALIZED (SELECT a.k, a.pos, {', '.join(ends)} FROM {here} a JOIN {here} b ON a.k IS NOT DISTINCT FROM b.k AND a.pos // 8 = b.pos // 8 GROUP BY a.k, a.pos)")
        return out

    parts += tree("g", levels)
    ends = " UNION ALL ".join(f"SELECT k, hash FROM g{i} WHERE pos = 0 AND n <= {8**i}" + (f" AND n > {8 ** (i - 1)}" if i else "") for i in range(levels + 1))
    parts.append(f"sub AS MATERIALIZED (SELECT k AS lang, hash, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM ({ends}))")
    parts.append("t0 AS (SELECT 0 AS k, pos, hash, n FROM sub)")
    parts += tree("t", tops)
    ends = " UNION ALL ".join(f"SELECT hash FROM t{i} WHERE pos = 0 AND n <= {8**i}" + (f" AND n > {8 ** (i - 1)}" if i else "") for i in range(tops + 1))
    parts.append(f"top AS (SELECT hash AS root FROM ({ends}))")
    parts.append("c0 AS (SELECT doc_id, l0.lang, leaf, l0.pos, sub.pos AS place, sub.hash AS subroot, found AS h, '' AS proof FROM l0 JOIN sub ON l0.lang IS NOT DISTINCT FROM sub.lang)")
    steps = [(f"gs{i}", f"s.k IS NOT DISTINCT FROM c.lang AND s.pos = c.pos // {8**i}") for i in range(levels)] + [(f"ts{i}", f"s.pos = c.place // {8**i}") for i in range(tops)]
    for i, (table, on) in enumerate(steps):
        up = "CASE WHEN s.pos IS NULL THEN h ELSE sha256(before || h || after) END"
        parts.append(f"c{i + 1} AS (SELECT c.* REPLACE ({up} AS h, proof || coalesce(before || after, '') AS proof) FROM c{i} c LEFT JOIN {table} s ON {on})")
    end = f"SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM c{len(steps)}, top"
    return "WITH " + ",\n".join(parts) + "\n" + end


ORACLES: dict[str, str] = {
    "op11_merkle_manifest": _merkle(),
    "op1_url_filter": OP1,
    "op4_decontaminate": OP4,
    "op7_quality_rules": OP7,
    "op8_secret_scan": OP8,
}
