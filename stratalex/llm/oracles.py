"""SQL with the same rows, for the queries that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata
from functools import cache

from stratalex.llm.lookalikes import _code_points, shape


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def _form(x: str) -> str:
    """SQL for the shape of a value: composed, every sign replaced by its shape, composed again."""
    one, several, drop = {}, {}, []
    for cp in (0x09, *_code_points()):
        ch = chr(cp)
        to = shape(ch)
        if unicodedata.normalize("NFC", ch) != ch or to == ch:
            continue
        if not to:
            drop.append(ch)
        elif len(to) == 1:
            one[ch] = to
        else:
            several[ch] = to
    wide = f"nfc_normalize({x})"
    for ch, to in several.items():
        wide = f"replace({wide}, {_q(ch)}, {_q(to)})"
    some = f"CASE WHEN regexp_matches(nfc_normalize({x}), {_q('[' + ''.join(several) + ']')}) THEN {wide} ELSE nfc_normalize({x}) END"
    return f"nfc_normalize(translate({some}, {_q(''.join(one) + ''.join(drop))}, {_q(''.join(one.values()))}))"


P1_FOUND = """
SELECT DISTINCT paragraph_id FROM records
WHERE length(paragraph_text) > CASE lower(trim(retrieval_unit, ' \t 　'))
  WHEN 'semantic_child' THEN 320 WHEN 'paragraph_child' THEN 320 WHEN 'paragraph' THEN 800
  WHEN 'semantic_parent' THEN 1200 WHEN 'milvus_passage' THEN 2000 END
"""

P2_FOUND = """
WITH t AS (SELECT DISTINCT paragraph_id AS k, paragraph_text AS t FROM records WHERE length(paragraph_text) >= 64
    UNION SELECT 'quote ' || q, q FROM (SELECT unnest(quotes) AS q FROM core_classics) WHERE length(q) >= 64),
  g AS (SELECT k, substring(t, i, 64) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 62)) AS i FROM t)),
  s AS (SELECT g FROM g GROUP BY g HAVING min(k) <> max(k))
SELECT DISTINCT k AS paragraph_id FROM g SEMI JOIN s USING (g) WHERE NOT starts_with(k, 'quote ')
"""

P3_FOUND = f"""
WITH r AS (SELECT DISTINCT paragraph_id, source, article, paragraph_text FROM records),
  t AS (SELECT {_form('paragraph_text')} AS f, paragraph_text AS v, paragraph_id FROM r WHERE paragraph_text IS NOT NULL),
  c AS (SELECT f FROM t GROUP BY f HAVING min(v) <> max(v)),
  m AS (SELECT source, {_form('title')} AS f, title FROM article_map)
SELECT paragraph_id, 'paragraph_text' AS field_name FROM t SEMI JOIN c USING (f)
UNION SELECT r.paragraph_id, 'article' FROM r JOIN m ON m.source = r.source AND m.f = {_form('r.article')} AND m.title <> r.article
"""

P6_FOUND = r"""
WITH t AS (SELECT DISTINCT paragraph_id AS k, regexp_replace(paragraph_text, '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]+', '', 'g') AS t
    FROM records WHERE length(paragraph_text) >= 60),
  s AS (SELECT DISTINCT k, hash(substring(t, i, 5)) AS g FROM (SELECT k, t, unnest(range(1, length(t) - 3)) AS i FROM t WHERE length(t) >= 60)),
  n AS (SELECT k, count(*) AS n FROM s GROUP BY k), d AS (SELECT g, count(*) AS d FROM s GROUP BY g HAVING count(*) > 1),
  o AS (SELECT s.k, s.g, n.n, row_number() OVER (PARTITION BY s.k ORDER BY d.d, s.g) + (n.n - count(*) OVER (PARTITION BY s.k)) AS r FROM s JOIN d USING (g) JOIN n USING (k)),
  p AS (SELECT k, g, n FROM o WHERE r <= n - ceil(0.7 * n) + 1),
  c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.g = b.g AND a.k < b.k AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n),
  x AS (SELECT c.a, c.b, count(*) AS x FROM c JOIN s u ON u.k = c.a JOIN s v ON v.k = c.b AND v.g = u.g GROUP BY c.a, c.b)
SELECT x.a AS paragraph_id_a, x.b AS paragraph_id_b FROM x JOIN n m ON m.k = x.a JOIN n o ON o.k = x.b WHERE 10 * x.x >= 7 * (m.n + o.n - x.x)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p6_found": P6_FOUND}
