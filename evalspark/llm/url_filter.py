"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed entries are a canonical host and a path beginning (``example.com/en/``)
with an action. An entry fits its host and all subdomains, if the url's path
starts with the entry's path; of the entries that fit, the longest decides,
and a url that none fits is allowed. A url's candidates are its host's
suffixes at label borders, each with the beginnings of its path whose length
some listed path has; an entry fits a url exactly if it is one of them.

Candidates are tested against a blocked Bloom filter of the listed entries:
a hash picks one 512-bit block and eight bits in it, so a test touches one
cache line. What passes is joined with the list by its exact strings, which
removes false hits. The filter has ``bits_per_entry`` bits for each entry but
never more than ``max_bytes``: a longer list only lets more candidates
through to the join. Only the filter is sent to the executors.

Defined results: a url that is null or has no ``://`` has host and path '';
its verdict is allow unless an entry of an empty host lists it; repeated
pages each come back; entries listed twice count once, with block before
allow; among equally long entries that fit, the one with the longer host
decides; null hosts or paths of entries count as ''; other columns of pages
are not carried; an empty list allows every url.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

BITS_PER_ENTRY = 16
MAX_BYTES = 1 << 25
BLOCK_BITS = 512
PROBES = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, '' where it has none."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = lower_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def _place(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its eight bits as a row of eight words."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    word = np.zeros((len(h), 8), np.uint64)
    odd = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D,
                    0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
    bit = ((h[:, None] & np.uint64(0xFFFFFFFF)) * odd >> np.uint64(20)) & np.uint64(63)
    word[:] = np.uint64(1) << bit
    return block.astype(np.int64), word


def build_filter(hashes: DataFrame, entries: int, bits_per_entry: int = BITS_PER_ENTRY,
                 max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Words of the blocked filter, (blocks, 8), from a bigint column ``h``.

    The blocks are made by tasks; the driver receives at most ``max_bytes``.
    """
    blocks = max(1, min(-(-entries * bits_per_entry // BLOCK_BITS), max_bytes * 8 // BLOCK_BITS))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            block, word = _place(batch["h"].to_numpy(), blocks)
            out = pd.DataFrame(word.view(np.int64), columns=[f"w{i}" for i in range(PROBES)])
            yield out.assign(block=block)

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(PROBES))
    cols = ", ".join(f"w{i} long" for i in range(PROBES)) + ", block long"
    rows = hashes.mapInPandas(made, cols).groupBy("block").agg(
        *(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(PROBES))).select(
        *(c.split()[0] for c in schema.split(", "))).toPandas()
    table = np.zeros((blocks, PROBES), np.uint64)
    table[rows["block"].to_numpy(np.int64)] = rows[[f"w{i}" for i in range(PROBES)]].to_numpy(
        np.int64).view(np.uint64)
    return table


def maybe_listed(table: np.ndarray, df: DataFrame):
    """A column function: whether a hash may belong to a listed entry."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        block, word = _place(h.to_numpy(np.int64), len(shared.value))
        return pd.Series(((shared.value[block] & word) == word).all(axis=1))

    return test


def _labels(host: str) -> Column:
    """Number of a host's labels: one more than its dots."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``entries``: host, path, verdict (allow or block).
    """
    listed = entries.select(
        lower_ascii(F.coalesce("host", F.lit(""))).alias("e_host"),
        F.coalesce("path", F.lit("")).alias("e_path"), "verdict").groupBy("e_host", "e_path").agg(
        F.max("verdict").alias("rule_verdict"))
    key = lambda host, path: F.xxhash64(host, path)
    # few numbers, however many entries: path lengths, and labels of hosts
    lengths = [r.n for r in listed.select(F.length("e_path").alias("n")).distinct().collect()]
    labels = [r.n for r in listed.select(_labels("e_host").alias("n")).distinct().collect()]
    table = build_filter(listed.select(key("e_host", "e_path").alias("h")), listed.count())
    test = maybe_listed(table, pages)

    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    # only suffixes with as many labels as some listed host, so that a long host costs no more
    suffixes = F.array_compact(F.array(*(F.when(_labels("host") >= n, F.substring_index("host", ".", -n))
                                         for n in sorted(labels))).cast("array<string>"))
    heads = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"),
                                 lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    urls = rows.select("host", "path").distinct()
    candidates = urls.withColumn("e_host", F.explode(suffixes)).withColumn("e_path", F.explode(heads))
    hits = candidates.where(test(key("e_host", "e_path"))).join(listed, ["e_host", "e_path"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("e_host") + F.length("e_path")).alias("n"), F.length("e_host"),
        F.concat("e_host", "e_path").alias("rule"), "rule_verdict")).alias("best")).select(
        "host", "path", "best.rule", "best.rule_verdict")
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))


ORACLE = """
with u as (
  select page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
s as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u),
r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select s.page_id, s.host, s.path, h || p as rule, v,
         row_number() over (partition by s.host, s.path, s.page_id
                            order by length(h || p) desc nulls last) as k
  from s left join r on (s.host = h or ends_with(s.host, '.' || h)) and starts_with(s.path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
"""
