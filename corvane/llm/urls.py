"""URL filter: longest-prefix rules first, then gradient-boosted trees on lexical features.

Everything on the path of a row is a built-in expression: the features, and the
trees, which become CASE expressions. The trees are trained once by the ML
library's boosting on a small table of labelled URLs, whose size is a parameter;
suffix statistics come from the same table. No feature knows a word: a verdict
rests on lengths, depth, digits, entropy, parameters, hyphens and the suffix.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled URLs made for training; boosting rounds and depth.
LABELLED = 4_000
ROUNDS = 16
DEPTH = 4

# Syllables of made-up words, and the parts of made-up URLs.
SYLLABLES = ["ba", "be", "cor", "da", "del", "en", "fi", "ga", "har", "in", "ka", "la", "lo", "ma", "mon", "na", "nor", "o", "pa", "per", "qui", "ra", "ri", "sa", "sel", "ta", "ter", "ul", "va", "win"]
SUBDOMAINS = ["", "", "www.", "www.", "m.", "blog.", "news.", "docs."]
BAD_SUBDOMAINS = ["", "", "", "www.", "go.", "track."]
SUFFIXES = ["com", "com", "com", "net", "org", "org", "de", "fr", "es", "edu", "gov", "uk", "info"]
BAD_SUFFIXES = ["com", "com", "net", "info", "biz", "xyz", "top", "click", "online", "ru"]
SECTIONS = ["en", "de", "fr", "es", "wiki", "news", "articles", "docs", "blog"]
KEYS = ["id", "q", "page", "ref", "sid", "aff", "sub", "utm_source", "c", "k"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; null or without ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; null or without ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host, then the path's beginning with its slash

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1] if "/" in self.rule else ""

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def first_rule(rules: list[Rule], host: Column, path: Column, of: str) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        out = F.when(r.fits(host, path), F.lit(getattr(r, of))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL's letters; url must not be null."""
    n = F.length(url)
    chars = F.array_distinct(F.split(url, ""))
    entropy = F.aggregate(chars, F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise((n - F.length(F.replace(url, c, F.lit("")))) / n * -F.log2((n - F.length(F.replace(url, c, F.lit("")))) / n)))
    return {
        "url_length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double"),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*)$", 1)


def made_url(r: random.Random, bad: bool) -> str:
    """A URL by rule. Every trait occurs in both classes, and no trait decides alone."""

    def word() -> str:
        return "".join(r.choice(SYLLABLES) for _ in range(r.choice([2, 2, 3])))

    def token(most: int) -> str:
        return f"{r.getrandbits(64):016x}"[: r.randint(3, most)]

    def parameters(n: int) -> str:
        return "".join(f"{'&' if k else '?'}{r.choice(KEYS)}={r.choice([str(r.randrange(10_000)), str(r.randrange(100)), token(12)])}" for k in range(n))

    def one_of(*weighted) -> str:
        return r.choices([make for _, make in weighted], [w for w, _ in weighted])[0]()

    plain = lambda: f"{r.choice(SECTIONS)}/{r.choice([str(r.randrange(10_000)), str(r.randrange(10_000)), word()])}"
    slug = lambda: f"{r.choice(SECTIONS)}/{word()}-{word()}-{word()}"
    dated = lambda: f"20{r.randrange(10, 25)}/0{r.randrange(1, 9)}/{word()}-{word()}"
    deep = lambda: "/".join(r.choice([str(r.randrange(1_000)), token(8)]) for _ in range(r.randint(4, 7)))
    drawn = lambda: f"{r.choice(['r', 'go', 'lp', 'x', 'click'])}/{token(16)}/{token(16)}"
    none = lambda: ""
    if bad:
        host = one_of((40, lambda: f"{word()}-{word()}"), (20, lambda: f"{word()}-{word()}-{word()}"), (20, lambda: token(16)), (10, lambda: f"{word()}{word()}{word()}{r.randrange(1_000)}"), (10, word))
        path = one_of((35, plain), (10, slug), (20, deep), (25, drawn), (10, none))
        end = one_of((35, none), (15, lambda: ".html"), (15, lambda: parameters(1)), (10, lambda: parameters(2)), (15, lambda: parameters(3)), (10, lambda: parameters(5)))
    else:
        host = one_of((76, word), (12, lambda: word() + word()), (8, lambda: f"{word()}-{word()}"), (4, lambda: f"{word()}{r.randrange(100)}"))
        path = one_of((45, plain), (25, slug), (15, dated), (7, none), (4, deep), (4, drawn))
        end = one_of((40, none), (15, lambda: "/"), (15, lambda: ".html"), (10, lambda: "#top"), (8, lambda: parameters(1)), (10, lambda: parameters(2)), (2, lambda: parameters(4)))
    middle = "." + word() if r.random() < 0.5 else ""
    return f"{r.choice(['http', 'https'])}://{r.choice(BAD_SUBDOMAINS if bad else SUBDOMAINS)}{host}{middle}.{r.choice(BAD_SUFFIXES if bad else SUFFIXES)}/{path}{end}"


def labelled_urls(spark: SparkSession, rows: int = LABELLED, seed: int = 0) -> DataFrame:
    """url, label (1: to block), made by rule, one half each.

    URLs to block tend to long or hyphenated hosts, hosts and paths of random
    letters and digits, many parameters, deep paths and cheap suffixes; others to
    short hosts and paths of words.
    """
    r = random.Random(seed)
    made = json.dumps([{"url": made_url(r, k % 2 == 0), "label": float(k % 2 == 0)} for k in range(rows)])
    return spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<url:string,label:double>>")).alias("r")).select("r.url", "r.label")


@dataclass(frozen=True)
class Trees:
    """Margin as an expression: over zero is to block."""

    parts: list[tuple[float, object]]
    names: list[str]
    rates: dict[str, float]
    rate: float

    def features(self, url: Column, host: Column, path: Column) -> list[Column]:
        f = lexical(url, host, path)
        known = F.lit(self.rate)
        for suffix, rate in sorted(self.rates.items()):
            known = F.when(suffix_of(host) == suffix, F.lit(rate)).otherwise(known)
        return [*f.values(), known]

    def margin(self, features: list[Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            k, at, left, right = node
            return F.when(features[k] <= at, walk(left)).otherwise(walk(right))

        total = F.lit(0.0)
        for weight, tree in self.parts:
            total = total + F.lit(weight) * walk(tree)
        return total


def _walked(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _walked(node.leftChild()), _walked(node.rightChild())


def boosted(rows: DataFrame, names: list[str], rounds: int, depth: int) -> GBTClassificationModel:
    """rows: label, features (a vector)."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=20, seed=7).fit(rows)


def table_of(labelled: DataFrame, trees: Trees) -> DataFrame:
    """url, label, features of the labelled rows; the suffix rates are those of `trees`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = labelled.select(url.alias("url"), F.col("label").cast("double").alias("label")).where("label is not null")
    f = trees.features(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))
    rows = rows.select("url", "label", *[c.alias(k) for k, c in zip(trees.names, f, strict=True)])
    return VectorAssembler(inputCols=trees.names, outputCol="features").transform(rows).select("url", "label", "features")


def train(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """labelled: url, label; a bounded table, as its suffix rates become literals. Null urls count as empty, null labels are left out."""
    url = F.coalesce(F.col("url"), F.lit(""))
    by = labelled.where("label is not null").groupBy(suffix_of(host_of(url)).alias("suffix")).agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()
    bad, n = sum(r["bad"] for r in by), sum(r["n"] for r in by)
    rate = (bad + 1) / (n + 2)
    rates = {r["suffix"]: (r["bad"] + 20 * rate) / (r["n"] + 20) for r in by if r["n"] >= 5}
    names = [*lexical(F.lit(""), F.lit(""), F.lit("")), "suffix_rate"]
    if not 0 < bad < n:  # one class only: no tree, the rows' own verdict
        return Trees([(1.0, 1.0 if bad else -1.0)], names, rates, rate)
    model = boosted(table_of(labelled, Trees([], names, rates, rate)).select("label", "features").coalesce(1), names, rounds, depth)
    return Trees([(float(w), _walked(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)], names, rates, rate)


def judge(pages: DataFrame, rules: list[Rule], trees: Trees, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    The longest rule that fits decides; else the trees, where a null url counts
    as empty. Ties in length go to the later rule in code-point order. URLs are
    read whole, however long. Repeated rows are judged each; a null id is kept;
    only the two named columns are read, so others may have any name. Empty
    tables give no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = [f"f{k}" for k in range(len(trees.names))]
    rows = rows.select("page_id", "host", "path", *[c.alias(k) for k, c in zip(names, trees.features(F.col("url"), F.col("host"), F.col("path")), strict=True)])
    score = 1 / (1 + F.exp(-2 * trees.margin([F.col(k) for k in names])))
    rows = rows.select("page_id", "host", "path", first_rule(rules, F.col("host"), F.col("path"), "rule").alias("rule"), first_rule(rules, F.col("host"), F.col("path"), "verdict").alias("said"), F.round(score, 9).alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


#: The rules of the registered query.
RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]
