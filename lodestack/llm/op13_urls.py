"""Query op13_urls: the verdict on every page's url."""

from lodestack.llm.urls import judge_urls
from lodestack.session import table

NAME = "op13_urls"

#: Fixed rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_VALUES = ", ".join(map(str, RULES))

SQL = rf"""
WITH rules(rule_host, rule_path, said) AS (VALUES {_VALUES}), cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages
), fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
  FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM cut LEFT JOIN fitting USING (page_id)
"""


def run(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")
