"""SQL of the text queries that SQL can express, for DuckDB."""

from __future__ import annotations

_W = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_W}) AS ws FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
 g AS (SELECT doc_id, unnest(grams) AS gram FROM sets), n AS (SELECT doc_id, len(grams) AS n FROM sets),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
 edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM reach r JOIN edges e ON r.id = e.x)
 SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM n JOIN (SELECT id AS doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""

WORD_DEDUP = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS ws FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE m < doc_id),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

# texts as hex, cut in pieces, so that taking a window does not go over the text
SUFFIX_DEDUP = """WITH b AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
 p AS (SELECT doc_id, j * 8192 AS base, substr(x, j * 16384 + 1, 16384 + 798) AS x FROM (SELECT doc_id, x, unnest(range(0, greatest(1, CAST(ceil(length(x) / 16384.0) AS BIGINT)))) AS j FROM b)),
 win AS (SELECT doc_id, base + i AS i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, base, x, unnest(range(0, least(8192, length(x) // 2 - 399))) AS i FROM p)),
 often AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
 hit AS (SELECT doc_id, i FROM win SEMI JOIN often USING (h)),
 runs AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
 cuts AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
 SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(1, n_spans + 2), lambda k: substr(x, CASE WHEN k = 1 THEN 1 ELSE 2 * his[k - 1] + 1 END, CASE WHEN k > n_spans THEN length(x) ELSE 2 * los[k] - CASE WHEN k = 1 THEN 0 ELSE 2 * his[k - 1] END END)), '') END)) AS kept_sha256 FROM b LEFT JOIN cuts USING (doc_id)"""

_SEATS = """{out}_b AS (SELECT *, CAST(greatest(0, floor(q) - m) AS BIGINT) AS lo FROM (SELECT *, CAST(ceil(CASE WHEN seats0 > 0 THEN q * cnt / (2 * seats0) ELSE 0 END) AS BIGINT) + 2 AS m FROM
 (SELECT *, CASE WHEN total_share > 0 THEN share / total_share * seats0 ELSE 0.0 END AS q FROM (SELECT *, sum(share) OVER ({part}) AS total_share, count(*) OVER ({part}) AS cnt FROM {src})))),
 {out}_k AS (SELECT *, share / (2 * k + 1) AS quot FROM (SELECT *, unnest(range(lo, CAST(floor(q) AS BIGINT) + m + 1)) AS k FROM {out}_b)),
 {out}_r AS (SELECT *, seats0 - sum(CASE WHEN k = lo THEN lo ELSE 0 END) OVER ({part}) AS left_over, row_number() OVER ({part} ORDER BY quot DESC, {order}, k) AS r FROM {out}_k),
 {out} AS (SELECT {keys}, CAST(min(lo) + sum(CASE WHEN r <= left_over AND share > 0 THEN 1 ELSE 0 END) AS BIGINT) AS seats FROM {out}_r GROUP BY {keys})"""

MIXING = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_W})) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS dice FROM documents),
 src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM sized GROUP BY 1),
 w AS (SELECT *, CAST(([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, 3 * source_size AS most FROM src),
 f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
 sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft FROM w),
 lv AS (SELECT rest, heft FROM f WHERE rest * weight <= most * heft ORDER BY most / weight, source NULLS LAST LIMIT 1),
 t AS (SELECT f.*, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE least(most::DOUBLE, (lv.rest * weight)::DOUBLE / lv.heft::DOUBLE) END AS target FROM f, lv),
 q0 AS (SELECT source, source_size, n_docs, target, target AS share, CAST(floor(total / 256 + 0.5) AS BIGINT) AS seats0 FROM t),
 {_SEATS.format(out="q1", src="q0", part="", order="source NULLS LAST", keys="source, source_size, n_docs, target")},
 placed AS (SELECT doc_id, d.source, size, dice, source_size, target, seats AS source_seats, CAST('0x' || substr(dice, 1, 8) AS BIGINT) % CAST(ceil(n_docs / 2000) AS BIGINT) AS shard FROM sized d JOIN q1 q ON d.source IS NOT DISTINCT FROM q.source),
 s0 AS (SELECT source, shard, source_seats AS seats0, CAST(sum(size) AS BIGINT) AS share FROM placed GROUP BY 1, 2, 3),
 {_SEATS.format(out="s1", src="s0", part="PARTITION BY source", order="shard", keys="source, shard, seats0, share")},
 s AS (SELECT source, shard, share AS shard_size, least(seats * 256, 3 * share) AS words FROM s1),
 e AS (SELECT p.*, shard_size, words, coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY dice, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed p JOIN s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard)
 SELECT doc_id, size, source, source_size, target, CAST(words // greatest(shard_size, 1) * size + least(size, greatest(0, words - words // greatest(shard_size, 1) * shard_size - start)) AS BIGINT) AS taken FROM e"""

_MEASURES = ("symbols_per_word", "dup_lines", "repeat_words", "chars_per_word", "upper_share")
_MARGIN = "CASE measure WHEN 'symbols_per_word' THEN 0.15::DOUBLE WHEN 'dup_lines' THEN 0.35::DOUBLE WHEN 'repeat_words' THEN 0.15::DOUBLE WHEN 'chars_per_word' THEN 1.0::DOUBLE ELSE 0.10::DOUBLE END"


def _quartiles(name: str, keys: str) -> str:
    k = keys + ", " if keys else ""
    edge = lambda q: f"CASE WHEN min(bin) FILTER (upto * 4 >= n_docs * {q}) < 0 THEN 0.0::DOUBLE ELSE 1e-4::DOUBLE * pow(1.02::DOUBLE, min(bin) FILTER (upto * 4 >= n_docs * {q})) END"
    return f"""{name} AS (SELECT {k}measure, {edge(1)} AS q1, {edge(3)} AS q3, max(n_docs) AS n_docs FROM (SELECT *, sum(n) OVER (PARTITION BY {k}measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {k}measure) AS n_docs
 FROM (SELECT {k}measure, bin, sum(n) AS n FROM bins GROUP BY ALL)) GROUP BY ALL)"""


def _toward(of: str, to: str, q: str) -> str:
    return f"({of}.n_docs * {of}.{q} + 100.0::DOUBLE * {to}.{q}) / ({of}.n_docs + 100.0::DOUBLE)"


QUALITY_RULES = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1) GROUP BY 1),
 lines AS (SELECT doc_id, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM w)),
 m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
 r AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeat_words, word_chars / greatest(n_words, 1) AS chars_per_word, n_upper / greatest(word_chars, 1) AS upper_share,
 n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 long AS (SELECT doc_id, lang, source, unnest([{", ".join(f"'{k}'" for k in _MEASURES)}]) AS measure, unnest([{", ".join(_MEASURES)}]) AS v FROM r),
 bins AS (SELECT lang, source, measure, CAST(CASE WHEN v < 1e-4 THEN -1 ELSE ceil(ln(v / 1e-4::DOUBLE) / ln(1.02::DOUBLE)) END AS INT) AS bin, count(*) AS n FROM long GROUP BY ALL),
 {_quartiles("own", "lang, source")}, {_quartiles("by_lang", "lang")}, {_quartiles("by_all", "")},
 own_l AS (SELECT l.lang, l.measure, {_toward("l", "a", "q1")} AS q1, {_toward("l", "a", "q3")} AS q3 FROM by_lang l JOIN by_all a USING (measure)),
 best AS (SELECT o.lang, o.source, measure, {_toward("o", "l", "q1")} AS q1, {_toward("o", "l", "q3")} AS q3 FROM own o JOIN own_l l USING (measure) WHERE o.lang IS NOT DISTINCT FROM l.lang),
 bad AS (SELECT DISTINCT doc_id FROM long JOIN best USING (measure) WHERE long.lang IS NOT DISTINCT FROM best.lang AND long.source IS NOT DISTINCT FROM best.source AND v > q3 + greatest(4.0::DOUBLE * (q3 - q1), {_MARGIN}))
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM r"""
