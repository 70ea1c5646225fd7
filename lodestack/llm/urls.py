"""Rules for hosts and paths, applied to urls by a sort-merge range join.

A host's canonical key is its labels from right to left, each with an end mark that sorts before all else. The keys of a host and all its subdomains are
those that begin with the host's key: an interval, and two such intervals are nested or apart. Urls are range-partitioned and sorted by key, path
and row, so that a host of any number of urls spreads over partitions. Each rule goes to the partitions whose keys its interval meets, found
from their first and last keys (two for each partition). There, one sweep over rules and urls in the order of keys keeps a stack of the hosts that are still open,
with the paths of their rules: a rule leaves the stack with the first key outside its interval. The rules that fit a url are on the stack; of those whose path
begins the url's path, the longest wins.

Tasks hold the stack and a batch of rows. A task's stack is as large as the rules of one host and those it lies in.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.store import OWN, in_order, require, shuffle_partitions, without, written
from lodestack.llm.winnowing import LOWER, UPPER

#: Host: from the first :// to the next of / ? # or the end. Path: from there to the next of ? # or the end.
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
VERDICTS = ("allow", "block")
ADDED = ("host", "path", "rule", "verdict")
_PART, _KEY, _KIND, _RULE_HOST, _RULE_PATH, _RULE_VERDICT = (f"{OWN}{x}" for x in ("part", "key", "kind", "rule_host", "rule_path", "rule_verdict"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty where the url is null or has no ://; A-Z of the host are put in lower case."""
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, URL, 1), UPPER, LOWER), F.regexp_extract(known, URL, 2)


def host_key(host: Column) -> Column:
    """Labels from right to left, each ended by a zero character; zero characters of the host itself are written in another way."""
    escaped = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(escaped, r"\.", -1)), "\x00"), F.lit("\x00"))


def _dealt(firsts: list[str], lasts: list[str], parts: list[int]):
    """Hands each rule to all partitions with a key in its interval. Firsts and lasts of partitions are in the order of keys."""

    def run(batches):
        for batch in batches:
            taken, to = [], []
            for i, key in enumerate(batch.column(_KEY).to_pylist()):
                at = bisect_left(lasts, key)
                while at < len(parts) and (firsts[at] <= key or firsts[at].startswith(key)):
                    taken.append(i)
                    to.append(parts[at])
                    at += 1
            chosen = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(to, pa.int32())], names=[*chosen.schema.names, _PART])

    return run


def _verdict(path: str, stack: list) -> tuple[str | None, str | None]:
    """The longest rule on the stack that fits; of equals, that of the longer host."""
    best = None
    for _, host, paths, lengths in stack:
        for n in lengths:
            if n <= len(path) and (verdict := paths.get(path[:n])):
                if best is None or (len(host) + n, len(host)) > best[0]:
                    best = (len(host) + n, len(host)), host + path[:n], verdict
    return best[1:] if best else (None, None)


def _swept(names: list[str], default: str):
    """Rows in the order of keys, a host's rules before its urls; yields the urls with rule and verdict."""

    def run(batches):
        stack: list = []  # (key, host, {path: verdict}, lengths of paths)
        last, judged = None, (None, None)
        for batch in batches:
            keys, kinds, paths = (batch.column(c).to_pylist() for c in (_KEY, _KIND, f"{OWN}path"))
            rules = [batch.column(c).to_pylist() for c in (_RULE_HOST, _RULE_PATH, _RULE_VERDICT)] if 0 in kinds else []
            at, rule, verdict = [], [], []
            for i, key in enumerate(keys):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[i] == 0:
                    host, path, says = (r[i] for r in rules)
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    known, lengths = stack[-1][2:]
                    if len(path) not in lengths:
                        lengths.append(len(path))
                    known[path] = max(says, known.get(path, says))  # block before allow
                    last = None
                    continue
                if last != (key, paths[i]):
                    last, judged = (key, paths[i]), _verdict(paths[i], stack)
                at.append(i)
                rule.append(judged[0])
                verdict.append(judged[1] or default)
            kept = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*names, "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decided; null where none fits) and verdict (the rule's, else default).

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains, if the url's path begins with the rule's (a null path: any).
    Hosts of rules are put in lower case; a rule without a host is an error, as is another verdict. The longest rule (host and path) wins; of equally long
    ones that of the longer host; of equal ones block. Null urls and those without :// have an empty host and path and fit no
    rule. Repeated rows are each judged, columns of pages with the added names are replaced, all others are shuffled along, so leave out large ones.
    Without rules all get default; an empty table gives no rows.
    """
    if default not in VERDICTS:
        raise ValueError(f"default must be one of {VERDICTS}")
    require(pages, url_col)
    require(rules, "host", "path", "verdict")
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    own_path = f"{OWN}path"
    kept = without(pages, *(a for a in ADDED if a != url_col))
    keyed = kept.withColumns({f"{OWN}host": host, own_path: path}).withColumn(_KEY, host_key(F.col(f"{OWN}host")))
    n_parts = shuffle_partitions(spark)
    placed = written(in_order(keyed, F.col(_KEY), F.col(own_path), partitions=n_parts).withColumn(_PART, F.spark_partition_id()), "url-order")
    bounds = placed.groupBy(_PART).agg(F.min(_KEY).alias("first"), F.max(_KEY).alias("last")).orderBy(_PART).collect()

    known = rules.select(F.translate("host", UPPER, LOWER).alias(_RULE_HOST), F.coalesce("path", F.lit("")).alias(_RULE_PATH), F.col("verdict").alias(_RULE_VERDICT))
    known = known.distinct().withColumn(_KEY, host_key(F.col(_RULE_HOST)))
    if (bad := known.where(F.col(_RULE_HOST).isNull() | (F.col(_RULE_HOST) == "") | F.col(_RULE_VERDICT).isNull() | ~F.col(_RULE_VERDICT).isin(*VERDICTS)).limit(1).collect()):
        raise ValueError(f"a rule needs a host and a verdict of {VERDICTS}: {bad[0].asDict()}")
    dealt = known.mapInArrow(_dealt([b["first"] for b in bounds], [b["last"] for b in bounds], [b[_PART] for b in bounds]), T.StructType([*known.schema.fields, T.StructField(_PART, T.IntegerType())]))

    both = placed.withColumn(_KIND, F.lit(1)).unionByName(dealt.withColumn(_KIND, F.lit(0)), allowMissingColumns=True)
    parts = both.repartitionById(n_parts, F.col(_PART)).sortWithinPartitions(_KEY, _KIND, own_path)
    names = [*kept.columns, f"{OWN}host", own_path]
    schema = T.StructType([*[placed.schema[n] for n in names], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    judged = parts.mapInArrow(_swept(names, default), schema)
    return judged.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{OWN}host").alias("host"), F.col(own_path).alias("path"), "rule", "verdict")
