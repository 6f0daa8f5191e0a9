"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from fieldshift.llm import fill_middle, line_dedup, merkle, quality, url_filter

_RULE = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
    for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
)


def _concentration(rows: str) -> str:
    return f"""(SELECT (1 - rho) / rho FROM (SELECT least(greatest(coalesce(
        CASE WHEN e1 > 0 THEN (s - e0) / e1 END, 0.5), 0.001), 0.5) AS rho FROM (
        SELECT sum(n * pow(bad / n::DOUBLE - p, 2)) AS s, sum((1 - n / nu::DOUBLE) * p * (1 - p)) AS e0,
               sum((n - 1) * (1 - n / nu::DOUBLE) * p * (1 - p)) AS e1
        FROM (SELECT *, bu / nu::DOUBLE AS p FROM ({rows}) WHERE n > 0))))"""


URL_FILTER = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS parts
  FROM split LEFT JOIN outcomes USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, n, bad, CASE WHEN len(parts) < 2 THEN host
    WHEN len(parts) > 2 AND length(parts[-1]) = 2 AND parts[-2] IN {url_filter.SECOND_LEVEL}
      THEN array_to_string(parts[-3:], '.')
    ELSE array_to_string(parts[-2:], '.') END AS domain FROM counted),
with_suffix AS (
  SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '(?s)^[^.]*\\.', '') ELSE '' END AS suffix FROM hosts),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM with_suffix GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
root AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM suffixes),
m AS (SELECT
  {_concentration("SELECT s.n, s.bad, r.n AS nu, r.bad AS bu FROM suffixes s, root r")} AS m1,
  {_concentration("SELECT d.n, d.bad, s.n AS nu, s.bad AS bu FROM domains d JOIN suffixes s USING (suffix)")} AS m2,
  {_concentration("SELECT h.n, h.bad, d.n AS nu, d.bad AS bu FROM with_suffix h JOIN domains d USING (domain)")} AS m3),
s_rate AS (SELECT suffix, (s.bad + m1 * (r.bad + 1) / (r.n + 2)) / (s.n + m1) AS up FROM suffixes s, root r, m),
d_rate AS (SELECT domain, (d.bad + m2 * up) / (d.n + m2) AS up FROM domains d JOIN s_rate USING (suffix), m),
beta AS (SELECT host, h.bad + m3 * up AS a, h.n - h.bad + m3 * (1 - up) AS b FROM with_suffix h JOIN d_rate USING (domain), m),
known AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 AS blocked FROM beta),
ruled AS (SELECT *, CASE {_RULE} END AS fit FROM split)
SELECT page_id, host, path, string_split(fit, '|')[1] AS rule,
       CASE WHEN fit IS NOT NULL THEN string_split(fit, '|')[2] WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN known USING (host)
"""

_BLANK = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"


def _cut(r: str) -> str:
    at = lambda level: (
        f"(SELECT CASE WHEN count(*) >= {quality.MIN_DOCS} THEN quantile_disc({r}, 0.75)"
        f" + {quality.FENCE} * (quantile_disc({r}, 0.75) - quantile_disc({r}, 0.25)) + {quality.RATES[r]} END"
        f" FROM rated o WHERE NOT base_failed AND {level})"
    )
    return (
        f"coalesce({at('o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source')}, "
        f"{at('o.lang IS NOT DISTINCT FROM g.lang')}, {at('true')}) AS max_{r}"
    )


QUALITY = f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words)),
again AS (SELECT doc_id, i FROM grams JOIN
  (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
covered AS (SELECT doc_id, sum(least(5, i - coalesce(before, -5))) AS n FROM
  (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z!]', '', 'g')) AS n_shouts, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)),
rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbol_rate,
         coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_rate,
         coalesce(n_shouts / nullif(word_chars, 0)::DOUBLE, 0) AS shout_rate
  FROM counted),
cutoffs AS (SELECT g.lang, g.source, {", ".join(_cut(r) for r in quality.RATES)}
  FROM (SELECT DISTINCT lang, source FROM rated) g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce({r} > max_{r}, false)" for r in quality.RATES)}) AS kept
FROM rated r JOIN cutoffs c ON r.lang IS NOT DISTINCT FROM c.lang AND r.source IS NOT DISTINCT FROM c.source
"""

LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM cut),
word_line AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS nth
  FROM line WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
firsts AS MATERIALIZED (SELECT *, strlen(line) AS size, unnest([0, 1, 2]) AS gap FROM word_line
  WHERE nth = 1 AND strlen(line) >= {line_dedup.MIN_BYTES}),
near AS (SELECT DISTINCT b.doc_id, b.place FROM firsts a JOIN firsts b
  ON b.gap = 0 AND abs(a.size - b.size) <= {line_dedup.EDITS} AND a.gap = abs(a.size - b.size)
  AND (a.doc_id, a.place) < (b.doc_id, b.place) AND levenshtein(a.line, b.line) <= {line_dedup.EDITS}),
gone AS (SELECT doc_id, place FROM word_line WHERE nth > 1 UNION SELECT doc_id, place FROM near),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM line l
  ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id),
n_line AS (SELECT doc_id, count(*) AS n FROM word_line GROUP BY doc_id),
n_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_line.n, 0) AS n_lines, coalesce(n_gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents LEFT JOIN n_line USING (doc_id) LEFT JOIN n_gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split({text}, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN (CASE WHEN x < 0 THEN a ELSE xor(a, x) END) % 2 = 1
      THEN xor((CASE WHEN x < 0 THEN a ELSE xor(a, x) END) >> 1, 3988292384)
      ELSE (CASE WHEN x < 0 THEN a ELSE xor(a, x) END) >> 1 END)"""


def _leaf(n_chars: str) -> str:
    fields = [n_chars if f == "n_chars" else f"{f}::VARCHAR" for f in merkle.FIELDS]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({f}), ':', {f}), '-')" for f in fields) + "))"


def _tree(name: str, leaves: str) -> str:
    """(g, lvl, r, n, h) of every level over leaves (g, r, n, h)."""
    return f"""{name} AS (SELECT g, 0 AS lvl, r, n, h FROM {leaves} UNION ALL
      SELECT g, lvl + 1, r // 2, (n + 1) // 2, h2 FROM
        (SELECT *, sha256(concat(h, coalesce(lead(h) OVER (PARTITION BY g ORDER BY r), ''))) AS h2 FROM {name} WHERE n > 1) WHERE r % 2 = 0)"""


def _path(tree: str, leaves: str) -> str:
    """(g, r, path) of every leaf: sibling digests with their side, empty for a lone node."""
    return f"""(SELECT l.g, l.r, coalesce(list(CASE WHEN s.h IS NULL THEN '' WHEN t.r % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY t.lvl)
        FILTER (t.lvl IS NOT NULL), []::VARCHAR[]) AS path FROM {leaves} l
      LEFT JOIN {tree} t ON t.g = l.g AND t.n > 1 AND t.r = l.r >> t.lvl
      LEFT JOIN {tree} s ON s.g = t.g AND s.lvl = t.lvl AND s.r = xor(t.r, 1) GROUP BY l.g, l.r)"""


MERKLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('v' || lang, 'n') AS g, {_leaf("n_chars::VARCHAR")} AS h,
         CASE WHEN xor({_CRC.format(text="doc_id::VARCHAR")}, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
              THEN {_leaf("(n_chars + 1)::VARCHAR")} END AS altered FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS r,
         count(*) OVER (PARTITION BY g) AS n FROM base),
{_tree("tree", "leaves")},
tops AS MATERIALIZED (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY encode(g)) - 1 AS r, count(*) OVER () AS n FROM tree WHERE n = 1),
{_tree("crown", "tops")},
top AS (SELECT h AS root FROM crown WHERE n = 1),
whole AS (SELECT l.doc_id, l.h AS leaf, l.altered, t.h AS subroot, root, a.path || b.path AS path
  FROM leaves l JOIN tops t ON t.name = l.g JOIN {_path("tree", "leaves")} a ON a.g = l.g AND a.r = l.r
  JOIN {_path("crown", "tops")} b ON b.r = t.r, top),
checked AS (SELECT *, list_reduce([coalesce(altered, leaf)] || path, lambda x, e:
         CASE WHEN starts_with(e, 'L') THEN sha256(substr(e, 2) || x) ELSE sha256(x || substr(e, 2)) END) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda e: substr(e, 2)) || [''], 'string_agg', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM checked
"""

_TOKEN = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
_DRAWN = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))

FILL_MIDDLE = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS t,
         sha256(concat('{fill_middle.SEED}:', doc_id::VARCHAR)) AS h FROM documents),
drawn AS (SELECT *, len(t)::BIGINT AS n, {_DRAWN} FROM cut),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fill_middle.FIM_RATE} THEN 'plain'
       WHEN h4 % 100 < {fill_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM placed),
written AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m)
                           ELSE concat('<P>', p, '<S>', s, '<M>', m) END AS output FROM parts),
parsed AS (SELECT *, string_split(output, '<M>') AS x FROM written)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'spm' THEN concat(string_split(x[1], '<P>')[2], x[2], string_split(x[1], '<P>')[1][4:])
         ELSE concat(string_split(x[1], '<S>')[1][4:], x[2], string_split(x[1], '<S>')[2]) END) AS restored_sha256
FROM parsed
"""
