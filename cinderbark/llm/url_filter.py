"""URL filtering with boosted trees over lexical features (DataFrame functions only).

Training happens on the driver, from a table of labelled URLs of bounded size
(at most ``SAMPLE`` rows, those with the smallest hash); their features come
from the same column expressions that score the corpus.  The forest is then
written out as one SQL expression, so scoring a URL is a projection inside the
scan's stage: no shuffle, no Python.

Features: lengths, path depth, shares of digits and of other signs, entropy of
the characters, numbers of labels and of parameters, and how often the host's
suffix (its last label) was blocked among the training URLs.  No words: what a
URL says decides nothing, only its form does.

Explicit rules (host, path prefix, verdict) go before the model: a rule fits its
host and all subdomains if the URL's path starts with the rule's; the longest
rule wins, among equals the one given first.

Results.  A null URL, or one without ``://``, has empty host and path and meets
only the model.  Very long URLs are measured whole.  Repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbark.llm import boosting

#: Labelled URLs that training reads at most.
SAMPLE = 5_000
TREES, DEPTH = 20, 3
BLOCK_FROM = 0.5

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "digit_share", "host_digit_share", "sign_share", "entropy", "host_entropy", "labels", "parameters", "query_length", "suffix_blocked",
]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` match the class."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def features(suffixes: dict[str, float], usual: float) -> list[Column]:
    """The features of columns ``url``, ``host`` and ``path``, none of them null."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    share = lambda text, chars: _count(text, chars) / F.greatest(F.length(text), F.lit(1))
    suffix = F.substring_index(host, ".", -1)
    rate = F.lit(usual)
    for name in sorted(suffixes):
        rate = F.when(suffix == name, suffixes[name]).otherwise(rate)
    values = [
        F.length(url),
        F.length(host),
        F.length(path),
        _count(path, "/"),
        share(url, "[0-9]"),
        share(host, "[0-9]"),
        share(url, "[^A-Za-z0-9/.:]"),
        F.when(url == "", 0.0).otherwise(_entropy(url)),
        F.when(host == "", 0.0).otherwise(_entropy(host)),
        _count(host, r"\."),
        F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        F.length(query),
        rate,
    ]
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES)]


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and url, host and path without nulls."""
    url = F.col("url").cast("string")
    return pages.select(*keep, F.coalesce(url, F.lit("")).alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))


def with_features(rows: DataFrame, suffixes: dict[str, float], usual: float) -> DataFrame:
    return rows.select("*", *features(suffixes, usual))


# Suffixes that the made URLs draw from, common ones often and those of throw-away hosts among the blocked ones.
_COMMON = "com com com com org org net net edu gov info io de fr uk".split()
_CHEAP = "top xyz click icu buzz cyou rest gq tk".split()
_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def seed_urls(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled URLs (1: block) of made forms; equal seeds give equal lists.

    Allowed: home pages, articles, dated posts, manuals, threads and searches.
    Blocked: trackers with many parameters, hosts of random signs, digit mills,
    very deep mirrors, long keyword chains and session links.  Each kind overlaps
    with the others in all features but one or two, a tenth of each side has the
    other side's suffixes, and words are random letters throughout.
    """
    r = random.Random(seed)
    word = lambda low=3, high=9: "".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(low, high) // 2 + 1))
    token = lambda k: "".join(r.choice(_ALPHABET + "0123456789") for _ in range(k))
    number = lambda k: str(r.randrange(10 ** r.randint(1, k)))
    slug = lambda k: "-".join(word(2, 8) for _ in range(k))
    tail = lambda: r.choice(["", "", "/", ".html", "#top", f"?page={number(2)}", f"?id={number(4)}&ref={word()}"])
    good = [
        lambda: "/" * r.randint(0, 1),
        lambda: f"/{word()}/{slug(r.randint(2, 6))}{tail()}",
        lambda: f"/{r.randint(1999, 2025)}/{r.randint(1, 12):02d}/{slug(r.randint(2, 5))}{tail()}",
        lambda: "/" + "/".join(word() for _ in range(r.randint(2, 4))) + tail(),
        lambda: f"/{word(2, 3)}/{number(5)}{tail()}",
        lambda: f"/{word()}?q={word()}+{word()}&page={number(2)}",
    ]
    bad = [
        lambda: f"/{word(2, 4)}?" + "&".join(f"{word(2, 4)}={token(r.randint(1, 8))}" for _ in range(r.randint(4, 12))),
        lambda: f"/{word()}{tail()}",
        lambda: "/" + "/".join(number(6) for _ in range(r.randint(2, 4))) + f"/{number(8)}.html",
        lambda: "/" + "/".join(word(2, 4) for _ in range(r.randint(7, 14))) + tail(),
        lambda: f"/{slug(r.randint(12, 25))}{tail()}",
        lambda: f"/{word(2, 4)}/{token(r.randint(24, 48))}",
    ]
    out = []
    for i in range(n):
        label, kind = i % 2, r.randrange(6)
        cheap = r.random() < (0.45 if label else 0.04)
        suffix = r.choice(_CHEAP if cheap else _COMMON)
        host = f"{token(r.randint(9, 18))}" if label and kind == 1 else word(4, 10) + r.choice(["", "", "-" + word(3, 6)])
        front = r.choice(["", "www.", "m.", "blog.", f"{word(2, 4)}."])
        out.append((f"http{'s' * r.randint(0, 1)}://{front}{host}.{suffix}{(bad if label else good)[kind]()}", label))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """The default labelled URLs: url, label (1: block)."""
    return spark.createDataFrame(seed_urls(), "url string, label int")


def fit(labels: DataFrame, sample: int = SAMPLE) -> tuple[boosting.Forest, dict[str, float], float]:
    """Forest, suffix statistics and their default, from at most ``sample`` labelled URLs."""
    rows = parsed(labels.filter("url IS NOT NULL AND label IN (0, 1)"), "label").orderBy(F.xxhash64("url"), "url", "label").limit(sample)
    found = [(r["host"].rpartition(".")[2], r["label"]) for r in rows.select("host", "label").collect()]
    usual = (sum(y for _, y in found) + 1) / (len(found) + 2)
    counts: dict[str, list[int]] = {}
    for suffix, y in found:
        counts.setdefault(suffix, []).append(y)
    common = sorted(counts, key=lambda s: (-len(counts[s]), s))[:50]
    suffixes = {s: (sum(counts[s]) + 5 * usual) / (len(counts[s]) + 5) for s in common}
    data = with_features(rows, suffixes, usual).select(*FEATURES, "label").collect()
    x = np.array([r[:-1] for r in data], float).reshape(-1, len(FEATURES))
    return boosting.train(x, np.array([r[-1] for r in data], float), trees=TREES, depth=DEPTH, rate=0.4), suffixes, usual


def expression(forest: boosting.Forest, names: list[str]) -> str:
    """The forest's score as SQL over columns ``names``."""

    def node(t: int, k: int) -> str:
        inner = forest.feature.shape[1]
        if k >= inner:
            return f"{float(forest.leaf[t, k - inner])!r}D"
        if not np.isfinite(forest.cut[t, k]):
            return node(t, 2 * k + 1)
        return f"IF({names[forest.feature[t, k]]} > {float(forest.cut[t, k])!r}D, {node(t, 2 * k + 2)}, {node(t, 2 * k + 1)})"

    total = " + ".join([f"{forest.bias!r}D", *(node(t, 0) for t in range(len(forest.leaf)) if forest.leaf[t].any())])
    return f"1.0D / (1.0D + exp(-({total})))"


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of columns host and path; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, block_from: float = BLOCK_FROM, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the model's, of every URL)."""
    forest, suffixes, usual = fit(labelled(pages.sparkSession) if labels is None else labels, sample)
    rows = with_features(parsed(pages, "page_id"), suffixes, usual).withColumn("score", F.expr(expression(forest, FEATURES)))
    rule, said = rule_columns(rules)
    own = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "score")
