"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from viaduct.llm.collocations import op11_collocations
from viaduct.llm.decontamination import op5_decontamination
from viaduct.llm.exact_dedup import op10_exact_dedup
from viaduct.llm.fill_middle import op13_fill_middle
from viaduct.llm.language import op3_language
from viaduct.llm.language_model import op4_language_model
from viaduct.llm.near_dedup import op9_near_dedup
from viaduct.llm.packing import op2_packing
from viaduct.llm.quality import op8_quality
from viaduct.llm.secrets import op7_secrets
from viaduct.llm.sharding import op12_sharding
from viaduct.llm.token_files import op1_token_files
from viaduct.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_language_model": op4_language_model,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_near_dedup": op9_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_sharding": op12_sharding,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k, length(coalesce(text, '')) AS size FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(k) AS text_sha256
FROM n WINDOW w AS (PARTITION BY k ORDER BY size DESC, doc_id)""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) AS r(k)),
f AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(ws[i : i + j - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM s)) GROUP BY ALL),
c AS (
  SELECT s.lang, s.phrase, s.a, cut, array_to_string(ws[1 : cut], ' ') AS head, array_to_string(ws[cut + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM s) AS s LEFT JOIN inside USING (lang, phrase)
  WHERE most IS NULL OR most < s.a),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f AS l ON l.lang = c.lang AND l.phrase = head JOIN f AS r ON r.lang = c.lang AND r.phrase = tail
  JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t FROM documents),
e AS (
  SELECT *, len(t) AS n, ('0x' || h[1:8])::UBIGINT::BIGINT % (len(t) + 1) AS x, ('0x' || h[9:16])::UBIGINT::BIGINT % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || h[25:32])::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT doc_id, text, n, form, array_to_string(t[1 : least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1 : greatest(x, y)], '') AS m,
    array_to_string(t[greatest(x, y) + 1 : n], '') AS s FROM e),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM c),
b AS (
  SELECT *, strpos(output, '<M>') AS mid, CASE form WHEN 'psm' THEN strpos(output, '<S>') ELSE strpos(output, '<P>') END AS sec FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN output[4 : sec - 1] || output[mid + 3 :] || output[sec + 3 : mid - 1]
    ELSE output[sec + 3 : mid - 1] || output[mid + 3 :] || output[4 : sec - 1] END) AS restored_sha256
FROM b""",
}
