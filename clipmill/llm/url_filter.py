"""URL filter: longest fitting rule, else gradient-boosted trees on lexical features.

Features, tree scores and rules are column expressions. The trees are fitted on
the driver from at most ``max_train`` distinct labelled URLs, those of the
smallest hashes, so the fit has a fixed cost whatever the size of the table.
Suffix statistics count all URLs, and for the rate all labelled ones of other
folds than the URL's own, so that no label reaches its own URL's features.

The query has no table of labels. Its labels come from a weak labeller that
looks at addresses, not at rules: an address with tracking or session parameters
is another address of a page that has one of its own (block), one without a query
is that address (allow), all others have no label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "depth", "digit_ratio", "entropy", "params", "param_chars", "host_length", "host_labels", "suffix_count", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


# The rule list of the query.
RULES = (Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block"))


# Names of parameters that track visitors or sessions.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "ref", "sid", "sessionid", "phpsessid", "jsessionid")
FOLDS = 5


def weak_label(url: Column) -> Column:
    """1 for an address with tracking parameters, 0 for one without a query, else null."""
    tracked = url.rlike(rf"(?i)[?&;](?:{'|'.join(TRACKING)})=")
    return F.when(tracked, 1).when(url.contains("://") & ~url.contains("?"), 0)


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(5)), F.lit(FOLDS)).cast("int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """ASCII-lower-cased host and the path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def chosen(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return F.coalesce(*[F.when(r.fits(host, path), F.lit(getattr(r, value))) for r in ordered], F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.transform(kinds, part), F.lit(0.0), lambda a, x: a + x))


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """``row`` with host, path, suffix and the features that need no statistics."""
    packed = df.select(F.struct("*").alias("row"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    parts = packed.select("row", "url", host.alias("host"), path.alias("path"), query.alias("query"))
    share = F.when(F.length("url") == 0, 0.0).otherwise(F.length(F.regexp_replace("url", "[^0-9]", "")) / F.length("url"))
    return parts.select(
        "row", "url", "host", "path",
        F.substring_index("host", ".", -1).alias("suffix"),
        F.length("url").cast("double").alias("length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        share.alias("digit_ratio"),
        let(F.col("url"), entropy).alias("entropy"),
        (F.length(F.regexp_replace("query", "[^=]", ""))).cast("double").alias("params"),
        F.length("query").cast("double").alias("param_chars"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
    )


def with_suffixes(lexed: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``lexed`` with suffix_count and suffix_rate; the labels of the URL's own fold don't count for its rate.

    An ordinary join, as the number of suffixes isn't bounded.
    """
    joined = lexed.join(suffixes.select("suffix", "suffix_count", "labelled", "blocked"), "suffix", "left")
    own = fold(F.col("url"))
    left = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x) - F.get(name, own)
    rate = F.when(F.col("labelled").isNull(), 0.5).otherwise((left("blocked") + 1) / (left("labelled") + 2))
    return joined.withColumn("suffix_count", F.coalesce("suffix_count", F.lit(0.0))).withColumn("suffix_rate", rate).drop("labelled", "blocked")


@dataclass
class Boosted:
    """Boosted regression trees for a log-odds score; a tree is (feature, cut, left, right) or a leaf."""

    base: float = 0.0
    trees: list = field(default_factory=list)

    def score(self) -> Column:
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, at, left, right = tree
            return F.when(F.col(name) <= at, node(left)).otherwise(node(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + node(tree)
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray, names: tuple[str, ...] = FEATURES) -> np.ndarray:
        """The same score of rows of an array."""

        def node(tree, rows: np.ndarray) -> np.ndarray:
            if not isinstance(tree, tuple):
                return np.full(len(rows), tree)
            name, at, left, right = tree
            low = rows[:, names.index(name)] <= at
            out = np.empty(len(rows))
            out[low], out[~low] = node(left, rows[low]), node(right, rows[~low])
            return out

        return 1 / (1 + np.exp(-(self.base + sum((node(t, x) for t in self.trees), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 16, leaf: float = 5.0, ridge: float = 1.0) -> Boosted:
    """Newton boosting of logistic loss on binned features; the same input gives the same trees."""
    if not len(y):
        return Boosted()
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Boosted(float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1)
    logit = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int):
        value = lambda r: float(-rate * g[r].sum() / (h[r].sum() + ridge))
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
        for j, at in enumerate(cuts):
            if not left_depth or not len(at):
                continue
            gs = np.cumsum(np.bincount(code[rows, j], g[rows], len(at) + 1))[:-1]
            hs = np.cumsum(np.bincount(code[rows, j], h[rows], len(at) + 1))[:-1]
            gr, hr = g[rows].sum() - gs, h[rows].sum() - hs
            gain = np.where((hs * 4 >= leaf) & (hr * 4 >= leaf), gs**2 / (hs + ridge) + gr**2 / (hr + ridge) - whole, -1)
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            logit[rows] += value(rows)
            return value(rows)
        _, j, b = best
        below = code[rows, j] <= b
        return (names[j], float(cuts[j][b]), grow(rows[below], g, h, left_depth - 1), grow(rows[~below], g, h, left_depth - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        model.trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return model


def suffix_table(marked: DataFrame) -> DataFrame:
    """Per suffix: log count of all URLs, rate of blocks among labelled ones, and counts of both by fold."""
    per = lambda name, value: F.array(*[F.sum(F.when(fold(F.col("url")) == k, value).otherwise(0)).cast("bigint") for k in range(FOLDS)]).alias(name)
    rate = (F.coalesce(F.sum("label"), F.lit(0)) + 1) / (F.count("label") + 2)
    labelled, blocked = per("labelled", F.col("label").isNotNull().cast("int")), per("blocked", F.coalesce("label", F.lit(0)))
    return marked.groupBy("suffix").agg(F.log1p(F.count("*").cast("double")).alias("suffix_count"), rate.alias("suffix_rate"), labelled, blocked)


def labelled_sample(marked: DataFrame, suffixes: DataFrame, max_train: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, folds) of at most ``max_train`` distinct labelled URLs.

    A bound on the hash, from a count of distinct URLs, keeps about twice as many
    before anything is put in order, however often a URL repeats.
    """
    known = marked.filter("label IS NOT NULL").select("url", "suffix", "label", *FEATURES[:-2])
    total = known.agg(F.approx_count_distinct("url")).first()[0] or 0
    share = min(1.0, 2.0 * max_train / max(total, 1))
    h = F.xxhash64("url")
    near = known.filter(F.shiftrightunsigned(h, 24) < int(share * (1 << 40))) if share < 1 else known
    sample = cut(near.groupBy("url", "suffix", *FEATURES[:-2]).agg(F.max("label").alias("label")).orderBy(h, "url").limit(max_train))
    rows = with_suffixes(sample, suffixes).select("label", fold(F.col("url")).alias("fold"), *FEATURES).collect()
    data = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 2 + len(FEATURES))
    return data[:, 2:], data[:, 0], data[:, 1]


def train(lexed: DataFrame, label: Column, max_train: int = 20_000) -> tuple[Boosted, DataFrame]:
    """Fit on at most ``max_train`` distinct URLs whose ``label`` (1 block, 0 allow) isn't null; also gives the suffix table of all rows.

    Of contradicting labels of one URL the block counts.
    """
    marked = lexed.withColumn("label", label)
    suffixes = cut(suffix_table(marked))  # the join then has two plain exchanges, so that hot suffixes can be split
    x, y, _ = labelled_sample(marked, suffixes, max_train)
    return fit(x, y), suffixes


def held_out_report(lexed: DataFrame, label: Column, max_train: int = 20_000) -> dict[str, float]:
    """auc, mean score and share of blocks on fold 0 of the labelled sample, by trees fitted on the other folds."""
    marked = lexed.withColumn("label", label)
    x, y, folds = labelled_sample(marked, cut(suffix_table(marked)), max_train)
    test = folds == 0
    s = fit(x[~test], y[~test]).predict(x[test])
    bad, good = np.sort(s[y[test] == 1]), np.sort(s[y[test] == 0])
    below = np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")
    return {"n": float(test.sum()), "auc": float(below.sum() / 2 / max(1, len(bad) * len(good))), "mean_score": float(s.mean()), "blocked": float(y[test].mean())}


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", label: Column | None = None, max_train: int = 20_000, cutoff: float = 0.5) -> DataFrame:
    """All rows as struct ``row`` with host, path, rule, verdict and score (how likely a block).

    ``label`` marks labelled URLs by 1 (block) or 0 (allow); where it is not
    given, ``weak_label`` does, whatever the rules say. A null URL counts as empty
    and, like one without ``://``, has empty host and path and no rule; without
    any labelled URL the method allows all. Repeated rows are each judged.
    """
    lexed = lexical(df, url_col)
    said = chosen(rules, F.col("host"), F.col("path"), "verdict")
    model, suffixes = train(lexed, weak_label(F.col("url")) if label is None else label, max_train)
    scored = with_suffixes(lexed, suffixes).select("row", "host", "path", model.score().alias("score"))
    return scored.select(
        "row", "host", "path",
        chosen(rules, F.col("host"), F.col("path"), "text").alias("rule"),
        F.coalesce(said, F.when(F.col("score") > cutoff, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
