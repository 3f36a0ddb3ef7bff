"""DuckDB SQL of the registered queries that SQL can express (the rest are tested against brute force)."""

from __future__ import annotations

from orgpulse.llm.licenses import TEMPLATES, needed, reach, template_bigrams

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"


def _grams(table: str, key: str, pattern: str, n: int) -> str:
    """key, words and the distinct n-word shingles; shorter texts are one shingle."""
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return f"""
    SELECT {key}, ws, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: {gram}) END) AS grams
    FROM (SELECT {key}, coalesce(regexp_extract_all({_LOWER}, '{pattern}'), []) AS ws FROM {table})"""


DECONTAMINATION = f"""
WITH d AS ({_grams('documents', 'doc_id', _PLAIN, 5)}),
b AS ({_grams('benchmark', 'item_id', _PLAIN, 5)}),
bg AS (SELECT item_id, len(grams) AS n_item, unnest(grams) AS g FROM b WHERE len(ws) >= 5),
dg AS (SELECT doc_id, unnest(grams) AS g FROM d WHERE len(ws) >= 5)
SELECT doc_id, item_id, count(*) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item,
       CAST(count(*) AS DOUBLE) / any_value(n_item) AS containment
FROM bg JOIN dg USING (g) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9"""

JACCARD = f"""
WITH RECURSIVE s AS ({_grams('documents', 'doc_id', _WORDS, 3)}),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id
          GROUP BY 1, 2 HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT a, a FROM near UNION SELECT near.b, reach.c FROM reach JOIN near ON near.a = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id,
       min(s.doc_id) OVER (PARTITION BY CASE WHEN len(grams) > 0 THEN md5(array_to_string(list_sort(grams), chr(10)))
                                        ELSE CAST(s.doc_id AS VARCHAR) END) AS set_id
FROM s LEFT JOIN comp ON s.doc_id = comp.doc_id"""

CHAT = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 14 + length(regexp_replace(role, '([\\<#:])', '\\\1', 'g'))
                + length(regexp_replace(text, '([\\<#])', '\\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

_BAG = ", ".join(f"({k}, '{name}', {len(grams)}, {needed(len(grams), 0.8)}, {reach(len(grams), 0.8)}, [{', '.join(repr(g) for g in grams)}])"
                 for k, (name, grams) in enumerate((n, template_bigrams(t)) for n, t in TEMPLATES))

LICENSES = f"""
WITH t(k, license_id, nb, need, reach, grams) AS (VALUES {_BAG}),
tg AS (SELECT k, g, count(*) AS times FROM (SELECT k, unnest(grams) AS g FROM t) GROUP BY k, g),
d AS (SELECT row_number() OVER () AS r, doc_id, ws FROM (
        SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS ws
        FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))),
g AS (SELECT r, unnest(range(1, len(ws))) AS p, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM d),
hits AS (SELECT r, k, p, g, times FROM g JOIN tg USING (g)),
enough AS (SELECT r, k FROM hits JOIN t USING (k) GROUP BY r, k, need HAVING count(*) >= need),
q AS (SELECT r, k, p, coalesce(lag(p, CAST(times AS INTEGER)) OVER (PARTITION BY r, k, g ORDER BY p), -1) AS q
      FROM hits SEMI JOIN enough USING (r, k)),
walk AS (SELECT x.r, x.k, x.p AS s, y.p AS e, nb,
                sum(CASE WHEN y.q < x.p THEN 1 ELSE 0 END) OVER (PARTITION BY x.r, x.k, x.p ORDER BY y.p) AS m
         FROM q x JOIN q y ON x.r = y.r AND x.k = y.k AND y.p >= x.p JOIN t ON t.k = x.k WHERE y.p < x.p + t.reach),
best AS (SELECT r, k, s, e, CAST(m AS BIGINT) AS m, CAST(m AS DOUBLE) * 2.0::DOUBLE / (e - s + 1 + nb) AS dice FROM walk
         QUALIFY row_number() OVER (PARTITION BY r, k, s ORDER BY CAST(m AS DOUBLE) * 2.0::DOUBLE / (e - s + 1 + nb) DESC, e DESC) = 1),
u AS (SELECT best.*, license_id FROM best JOIN t USING (k) WHERE dice >= 0.8 - 1e-9),
own AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.r = u.r AND x.k = u.k AND x.s <= u.e AND x.e >= u.s
        AND (x.dice > u.dice OR (x.dice = u.dice AND (x.m > u.m OR (x.m = u.m AND x.s < u.s)))))),
kept AS (SELECT * FROM own WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.r = own.r AND x.s <= own.e AND x.e >= own.s
        AND (x.m > own.m OR (x.m = own.m AND (x.dice > own.dice
             OR (x.dice = own.dice AND x.license_id = own.license_id AND x.k < own.k))))))
SELECT doc_id, license_id, round(max(dice), 6) AS dice, count(*) AS n_units
FROM kept JOIN d USING (r) GROUP BY doc_id, license_id"""

MIXING = f"""
WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT no_source, source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1]::DOUBLE AS weight,
             total * 2.0::DOUBLE AS cap, sum(total) OVER () * 1.5::DOUBLE AS whole FROM s),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(weight) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
p AS (SELECT no_source, source, total,
             least(cap, coalesce(max(lv) FILTER (WHERE lv <= cap / weight) OVER () * weight, cap)) AS target,
             CAST('0x' || substr(md5('mix:' || CAST(no_source AS VARCHAR) || ':' || source), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS start
      FROM l),
r AS (SELECT *, CASE WHEN total > 0 THEN target / total ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY no_source, source ORDER BY CASE WHEN h < '8' THEN size - 1099511627776 ELSE 1099511627776 - size END, h, doc_id) AS k
      FROM d JOIN p USING (no_source, source))
SELECT doc_id, size, total AS source_size, target, CAST(floor(rate * k + start) - floor(rate * (k - 1) + start) AS BIGINT) AS copies,
       CAST(floor(rate * k + start) - floor(rate * (k - 1) + start) AS BIGINT) * size AS taken
FROM r"""

ORACLES = {
    "op1_benchmark_decontamination": DECONTAMINATION,
    "op2_ngram_jaccard_join": JACCARD,
    "op3_chat_formatting": CHAT,
    "op4_license_scan": LICENSES,
    "op5_mixing": MIXING,
}
