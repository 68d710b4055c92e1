"""SQL that gives the rows of those training-data queries that SQL can express."""

from __future__ import annotations

from adagium.llm import quality_rules as q, url_filter

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def substring_dedup(window: int = 20) -> str:
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d)),
fst AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS f FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS j FROM win JOIN fst USING (k) WHERE {{'d': doc_id, 'i': i}} > f),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY word.j) FILTER (g.j IS NULL) AS t FROM word LEFT JOIN gone g USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def warc() -> str:
    nibbles = "".join(f"{i:04b}" for i in range(16))
    bits = f"array_to_string([substr('{nibbles}', (strpos('0123456789abcdef', c) - 1) * 4 + 1, 4) FOR c IN string_split(sha1(payload), '')], '')"
    five = " + ".join(f"{16 >> k} * (substr(bits, (i * 5 + {k + 1})::INT, 1) = '1')::INT" for k in range(5))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
b AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {bits} AS bits FROM p),
g AS (SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({five} + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m"""


def quality_rules() -> str:
    metric = lambda k: f"CASE WHEN {q.METRICS[k][1]} > 0 THEN floor({q.METRICS[k][0]} * 10000 / {q.METRICS[k][1]}::DOUBLE)::BIGINT ELSE 0 END"
    step = "(1 << (length(bin(v)) - 5))"
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {metric(k)} AS v FROM s WHERE NOT base_failed" for k in q.METRICS)

    def quartiles(name: str, keys: list[str]) -> str:
        k = ", ".join([*keys, "metric"])
        return f"""{name}0 AS (SELECT {k}, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}1 AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {k}) AS total FROM {name}0),
{name} AS (SELECT {k}, max(total) AS total, min(bucket) FILTER (upto * 4 >= total) AS q25, min(bucket) FILTER (upto * 4 >= total * 3) AS q75 FROM {name}1 GROUP BY ALL)"""

    pick = lambda c: f"CASE WHEN f.total >= {q.MIN_ROWS} THEN f.{c} WHEN l.total >= {q.MIN_ROWS} THEN l.{c} ELSE a.{c} END AS {c}"
    own = lambda side, floor: f"{'q75 +' if side == 'high' else 'q25 -'} {q.SPREAD} * greatest(q75 - q25, {floor})"
    fence = " ".join(f"WHEN '{k}' THEN {own(side, floor)}" for k, (_, _, side, floor) in q.METRICS.items())
    fails = {k: f"coalesce({metric(k)} {'>' if q.METRICS[k][2] == 'high' else '<'} limit_{k}, false)" for k in q.METRICS}
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
ln AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, unnest(starts) AS i FROM (SELECT doc_id, list(i) AS starts FROM win GROUP BY doc_id, k HAVING count(*) > 1)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY 1),
s0 AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s0),
mv AS ({rows}),
sk AS (SELECT lang, source, metric, CASE WHEN v < 16 THEN v ELSE (v // {step}) * {step} END AS bucket, count(*) AS n FROM mv GROUP BY ALL),
{quartiles("f", ["lang", "source"])}, {quartiles("l", ["lang"])}, {quartiles("a", [])},
lim0 AS (SELECT f.lang, f.source, f.metric, {pick("q25")}, {pick("q75")} FROM f JOIN l ON f.lang IS NOT DISTINCT FROM l.lang AND f.metric = l.metric JOIN a ON f.metric = a.metric),
lim1 AS (SELECT *, CASE metric {fence} END AS v FROM lim0),
lim AS (SELECT lang, source, {", ".join(f"max(v) FILTER (metric = '{k}') AS limit_{k}" for k in q.METRICS)} FROM lim1 GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(fails.values())}) AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in fails.items())}) AS reasons
FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source"""


def all_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules(), "op3_substring_dedup": substring_dedup(), "op4_warc": warc(), "op10_url_filter": url_filter.oracle()}
