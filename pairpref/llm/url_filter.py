"""URL filter: a trie over reversed host labels and then path segments, with the longest rule winning.

A rule is (verdict, host, path). It fits its host and all subdomains when the url's path starts with the rule's.
Among the rules that fit, the one with more host labels wins, then the one with the longer path; between an
allow and a block rule for the same place the block rule wins. The rule list is a configuration of bounded
length (``MAX_RULES``, checked), so the trie is broadcast; urls are never shuffled.

Null urls and urls without ``://`` have an empty host and path, which no rule fits. Urls no rule fits get the
default verdict. Repeated rows are judged alike; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairpref.llm.catalog import query, table

MAX_RULES = 1_000_000
DEFAULT = "allow"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PLACE = re.compile(r"[^/?#]*")
PATH = re.compile(r"[^?#]*")


@dataclass
class Segment:
    """A node below a host: rules end here (``ends``: text of an unfinished last segment -> rule) or go deeper."""

    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    below: dict[str, Segment] = field(default_factory=dict)


@dataclass
class Label:
    below: dict[str, Label] = field(default_factory=dict)
    paths: Segment | None = None


#: Hosts are lowered as those of urls are: A-Z only.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build(rules: Sequence[tuple[str, str, str]]) -> Label:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} may be broadcast")
    root = Label()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        at = root
        for label in reversed(host.translate(LOWER).split(".")):
            at = at.below.setdefault(label, Label())
        at.paths = at.paths or Segment()
        node = at.paths
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Segment())
        if node.ends.get(rest, (None, "allow"))[1] == "allow":
            node.ends[rest] = (host + path, verdict)
    return root


def split_url(url: str | None) -> tuple[str, str]:
    begin = url.find("://") if url is not None else -1
    if begin < 0:
        return "", ""
    host = PLACE.match(url, begin + 3)
    ascii_lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host[0])
    return ascii_lower, PATH.match(url, host.end())[0]


def longest_path(node: Segment, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that ``path`` starts with."""
    found, rest = None, path
    while True:
        fitting = [end for end in node.ends if rest.startswith(end)]
        if fitting:
            found = node.ends[max(fitting, key=len)]
        segment, slash, rest = rest.partition("/")
        if not slash or segment not in node.below:
            return found
        node = node.below[segment]


def judge(root: Label, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fitting rule: hosts are walked from the last label to the first."""
    found, at = None, root
    for label in reversed(host.split(".")):
        at = at.below.get(label)
        if at is None:
            break
        if at.paths is not None:
            found = longest_path(at.paths, path) or found
    return found


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, result: str = "judged"
) -> DataFrame:
    """``pages`` with a column ``result`` in place of any of that name: struct of host, path, rule (null where none fits) and verdict, from its url."""
    trie = pages.sparkSession.sparkContext.broadcast(build(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for urls in batches:
            rows = []
            for url in urls:
                host, path = split_url(url if isinstance(url, str) else None)
                rule, verdict = judge(root, host, path) or (None, default)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.withColumn(result, judged("url"))


SQL = r"""
with parts as (
  select page_id,
    case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
  select page_id, host, path, verdict, h, p,
    row_number() over (partition by page_id order by length(h) desc nulls last, length(p) desc) as r
  from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, h || p as rule, coalesce(verdict, 'allow') as verdict from fits where r = 1
"""


@query("op3_url_filter", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "judged.*")
