"""URL filters: allow and block rules, and a logistic model of hashed character n-grams for the rest.

Everything a page passes through is a Column expression. The model is fitted once, on the driver, from a small
labelled table; its weights are whole numbers of
millionths, so a score is an exact sum wherever it is computed.

Defined results: a null url, or one without "://", has an empty host and path and is judged by the
model's bias alone; repeated rows are judged alike; extra columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylode.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 4096
SCALE = 1_000_000
MAX_RULES = 512
#: The most labelled rows that fit() takes.
MAX_LABELLED = 5000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules of the registered query.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits (of equally long ones the first in alphabetical order), or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules: they are compiled into the plan")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def gram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of all 3-grams and 4-grams of code points; the text is fenced by ^ and $."""
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))

    def grams(codes: Column) -> Column:
        three = F.transform(
            F.slice(codes, 1, F.greatest(F.size(codes) - 2, F.lit(0))),
            lambda c, i: F.pmod((c * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2)) * 2654435, F.lit(buckets)),
        )
        four = F.transform(
            F.slice(codes, 1, F.greatest(F.size(codes) - 3, F.lit(0))),
            lambda c, i: F.pmod((c * 79507 + F.get(codes, i + 1) * 1849 + F.get(codes, i + 2) * 43 + F.get(codes, i + 3)) * 40503 + 7, F.lit(buckets)),
        )
        return F.array_distinct(F.concat(three, four))

    return F.get(F.transform(F.array(codes), grams), F.lit(0))


@dataclass(frozen=True)
class UrlModel:
    """Weights and bias in millionths of a logit."""

    weights: tuple[int, ...]
    bias: int

    def logit_micros(self, host: Column, path: Column) -> Column:
        weights = F.lit(list(self.weights)).cast("array<bigint>")
        buckets = gram_buckets(F.concat(host, path), len(self.weights))
        return F.aggregate(buckets, F.lit(self.bias).cast("bigint"), lambda total, b: total + F.get(weights, b.cast("int")))


_ADDRESS = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S)


def grams_of(url: str, buckets: int) -> list[int]:
    """The buckets of gram_buckets() for one labelled url."""
    m = _ADDRESS.match(url)
    k = [ord(c) for c in "^" + (m[1].translate(str.maketrans(UPPER, LOWER)) + m[2] if m else "") + "$"]
    three = {(k[i] * 961 + k[i + 1] * 31 + k[i + 2]) * 2654435 % buckets for i in range(len(k) - 2)}
    return sorted(three | {((k[i] * 79507 + k[i + 1] * 1849 + k[i + 2] * 43 + k[i + 3]) * 40503 + 7) % buckets for i in range(len(k) - 3)})


def fit(labelled: list[tuple[str, int]], buckets: int = BUCKETS, epochs: int = 150, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
    """Plain batch descent on a small table of (url, bad: 0 or 1); at most MAX_LABELLED rows, in order of a hash."""
    weights, bias = [0.0] * buckets, 0.0
    data = [(grams_of(url, buckets), float(bad)) for url, bad in sorted(labelled, key=lambda x: (zlib.crc32(x[0].encode()), x))[:MAX_LABELLED]]
    for _ in range(epochs if data else 0):
        slope, lean = {}, 0.0
        for grams, bad in data:
            z = bias + sum(weights[g] for g in grams)
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - bad
            lean += miss
            for g in grams:
                slope[g] = slope.get(g, 0.0) + miss
        bias -= rate * 0.1 * lean / len(data)
        for g, v in slope.items():
            weights[g] -= rate * (v / len(data) + decay * weights[g])
    return UrlModel(tuple(round(w * SCALE) for w in weights), round(bias * SCALE))


def fit_table(labelled: DataFrame, **options) -> UrlModel:
    """Fits to a DataFrame's columns url and bad; it must be small, as only MAX_LABELLED rows count."""
    rows = labelled.where("url IS NOT NULL AND bad IS NOT NULL").select("url", "bad").orderBy(F.crc32(F.col("url").cast("binary")), "url", "bad").limit(MAX_LABELLED).collect()
    return fit([(r["url"], r["bad"]) for r in rows], **options)


#: Words of the labelled table, after what such hosts and paths are usually made of.
BAD_WORDS = "cheap-pills adult-x casino-win viagra poker-online porn xxx-video free-cash payday-loan replica-watch sexcam betting-bonus torrent-crack keygen lottery-prize weight-loss-pill escort hot-singles hentai forex-profit".split()
GOOD_WORDS = "library university news weather museum cooking garden science history music travel school health-guide city-council open-data journal forum-archive docs mapping theatre orchestra gallery railway botany carpentry weaving".split()


@lru_cache(maxsize=1)
def labelled_urls() -> tuple[tuple[str, int], ...]:
    """The small labelled table: each word in the same four kinds of address, so that only the word tells them apart."""
    out = []
    for bad, words in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for i, word in enumerate(words):
            tld = ("com", "net", "org")[i % 3]
            lang = ("en", "de", "fr", "es")[i % 4]
            out += [(f"https://{word}.example.{tld}/{lang}/{1000 + 37 * i}", bad), (f"http://www.{word}.example.{('org', 'com', 'net')[i % 3]}/{('fr', 'es', 'en', 'de')[i % 4]}/{200 + i}.html", bad), (f"https://blog.host.example.{tld}/{word}/{i}", bad)]
    return tuple(out)


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return fit(list(labelled_urls()))


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, logit (of the url being bad) of every row of pages."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), model.logit_micros(F.col("host"), F.col("path")).alias("micros"))
    said = F.coalesce("ruled", F.when(F.col("micros") >= 0, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", said.alias("verdict"), (F.col("micros") / F.lit(float(SCALE))).alias("logit"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), default_model())


def oracle(model: UrlModel, rules=RULES) -> str:
    """The same verdicts in SQL, with the fitted weights written out."""
    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    )
    says = "\n".join(f"    WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in rules)
    size = len(model.weights)
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE
{fits}
    END AS rule FROM parts),
coded AS (SELECT *, list_transform(string_split('^' || host || path || '$', ''), lambda c: unicode(c)::BIGINT) AS k FROM ruled),
model AS (SELECT {list(model.weights)}::BIGINT[] AS w),
scored AS (
  SELECT page_id, host, path, rule, {model.bias}
    + coalesce(list_sum(list_transform(list_distinct(list_concat(
      list_transform(range(1, len(k) - 1), lambda i: ((k[i] * 961 + k[i+1] * 31 + k[i+2]) * 2654435) % {size}),
      list_transform(range(1, len(k) - 2), lambda i: ((k[i] * 79507 + k[i+1] * 1849 + k[i+2] * 43 + k[i+3]) * 40503 + 7) % {size}))), lambda b: w[b + 1])), 0) AS micros
  FROM coded, model)
SELECT page_id, host, path, rule, CASE
{says}
    WHEN micros >= 0 THEN 'block' ELSE 'allow' END AS verdict, micros / 1000000.0::DOUBLE AS logit
FROM scored"""
