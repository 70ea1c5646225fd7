"""Query op3_licenses: license notices in all documents."""

from pyspark.sql import functions as F

from lodestack.llm.licenses import NAMES, SAID_PATTERN, SPDX, SPDX_END, SPDX_NAME, SPDX_PATTERN, TEMPLATES, scan_licenses, template_table
from lodestack.llm.winnowing import LOWER, UPPER
from lodestack.session import table

NAME = "op3_licenses"

_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))

_NAMES = ", ".join(f"('{name}', ' ({pattern}) ')" for name, pattern in sorted(NAMES.items()))
_IDS = ", ".join(f"('{name.lower()}', '{name}')" for name in (*NAMES, *SPDX))

#: Windows of 3c/2 words at every c/2 words, c being the template's length rounded up to a power of two from 8; shared shingles are counted without MinHash.
SQL = rf"""
WITH templates(template, notice) AS (VALUES {_NOTICES}), tw AS (
  SELECT template, regexp_extract_all(translate(notice, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates
), ts AS (
  SELECT DISTINCT template, greatest(8, CAST(2 ** ceil(log2(len(w))) AS BIGINT)) AS c, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM tw
), tn AS (
  SELECT template, count(*) AS n FROM ts GROUP BY 1
), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ds AS (
  SELECT doc_id, spot, array_to_string(w[spot + 1:spot + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS spot FROM dw WHERE len(w) >= 5)
), hits AS (
  SELECT doc_id, template, c, s, unnest(range(greatest(0, CAST(ceil((spot + 5 - 3 * c / 2) / (c / 2)) AS BIGINT)), spot // (c // 2) + 1)) AS k FROM ds JOIN ts USING (s)
), shared AS (
  SELECT doc_id, template, k, count(DISTINCT s) / any_value(n) AS share FROM hits JOIN tn USING (template) GROUP BY 1, 2, 3
), found AS (
  SELECT doc_id, template, max(share) AS share FROM shared WHERE share >= 0.8 GROUP BY 1, 2
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(template, ',' ORDER BY template) AS names, max(share) AS best FROM found GROUP BY 1
), names(name, pattern) AS (VALUES {_NAMES}), ids(low, name) AS (VALUES {_IDS}), said AS (
  SELECT doc_id, ' ' || regexp_replace(unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SAID_PATTERN}', 1)), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') || ' ' AS s FROM documents
), tagged AS (
  SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(array_to_string(regexp_extract_all(coalesce(text, ''), '{SPDX_PATTERN}', 1), ' '), '{SPDX_NAME}'))), '{SPDX_END}', '') AS low FROM documents
), mentioned AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS mentions FROM (
    SELECT doc_id, name FROM said JOIN names ON regexp_matches(s, pattern) UNION SELECT doc_id, name FROM tagged JOIN ids USING (low)
  ) GROUP BY 1
)
SELECT dw.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(names, '') AS licenses, round(coalesce(best, 0), 6) AS containment,
  coalesce(mentions, '') AS mentions FROM dw LEFT JOIN listed USING (doc_id) LEFT JOIN mentioned USING (doc_id)
"""


def run(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), template_table(spark))
    best = F.coalesce(F.array_max(F.col("licenses.containment")), F.lit(0.0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.template", ",").alias("licenses"), F.round(best, 6).alias("containment"), F.array_join("mentions", ",").alias("mentions"))
