"""URL filter: longest matching rule first, else gradient-boosted trees on lexical features.

The trees are trained from labelled URLs: those that a rule decides. Training takes at most ``max_train`` distinct labelled URLs,
those with the smallest hashes (a documented bound, so the driver's share is bounded); every URL is then scored by the trees
compiled to column expressions, without Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rules of the query: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path by the contract; null or no ``://`` gives two empty strings."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = common.ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls. Equal lengths: the first in order of text."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):  # later ones override
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, h + p).otherwise(which), F.when(fits, v).otherwise(verdict)
    return which, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the code points of a text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    runs = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(runs, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def endings(host: Column, path: Column) -> dict[str, Column]:
    """What a URL has statistics for: its last host label and the first part of its path, if others follow."""
    return {"suffix": F.substring_index(host, ".", -1), "section": F.regexp_extract(path, r"^/([^/]*)/", 1)}


def features(url: Column, host: Column, path: Column, shares: dict[str, dict[str, float]]) -> dict[str, Column]:
    """Lexical features only. ``shares``: for each kind of ending, smoothed shares of blocked URLs among the training URLs; "" stands for unseen ones."""
    u = F.coalesce(url, F.lit(""))
    n = F.char_length(u)
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    known = {}
    for kind, key in endings(host, path).items():
        held = shares.get(kind, {})
        unseen = F.lit(held.get("", 0.5))
        pairs = [F.lit(x) for s in sorted(held) if s for x in (s, held[s])]
        known[kind] = F.coalesce(F.element_at(F.create_map(*pairs), key), unseen) if pairs else unseen
    count = lambda c, what: (F.char_length(c) - F.char_length(F.regexp_replace(c, what, ""))).cast("double")
    return {
        "length": n.cast("double"), "host_length": F.char_length(host).cast("double"), "path_length": F.char_length(path).cast("double"), "depth": count(path, "/"), "labels": count(host, r"\."),
        "digit_ratio": count(u, "[^0-9]") * -1 / F.greatest(n, F.lit(1)) + n / F.greatest(n, F.lit(1)), "entropy": F.round(_entropy(host), 6), "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "fragment": F.contains(u, F.lit("#")).cast("double"), "hyphens": count(host, "-"), "trailing_slash": path.endswith("/").cast("double"), "secure": u.startswith("https").cast("double"), **known,
    }


def shares_of(seen: list[tuple[dict[str, str], float]], least: int = 20, weight: float = 5.0) -> dict[str, dict[str, float]]:
    """The shares for ``features`` from (endings, label) of the training URLs: smoothed towards the base rate, and that of all for endings seen less than ``least`` times."""
    base = (sum(y for _, y in seen) + 1) / (len(seen) + 2)
    out: dict[str, dict[str, float]] = {}
    for kind in seen[0][0] if seen else ():
        by: dict[str, list[float]] = {}
        for ends, y in seen:
            by.setdefault(ends[kind], []).append(y)
        out[kind] = {s: round((sum(v) + weight * base) / (len(v) + weight), 6) for s, v in by.items() if s and len(v) >= least} | {"": base}
    return out


@dataclass
class Tree:
    """A node: a split (feature < cut goes left) or a leaf value."""

    value: float = 0.0
    feature: str = ""
    cut: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None

    def column(self, cols: dict[str, Column]) -> Column:
        return F.lit(self.value) if self.left is None else F.when(cols[self.feature] < self.cut, self.left.column(cols)).otherwise(self.right.column(cols))

    def predict(self, names: list[str], x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, names.index(self.feature)] < self.cut, self.left.predict(names, x), self.right.predict(names, x))


def _grow(names: list[str], x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, cuts: list[np.ndarray], l2: float, least: int) -> Tree:
    g, h = grad.sum(), hess.sum()
    leaf, best = Tree(float(-g / (h + l2))), (1e-6, -1, 0.0)
    if depth and len(x) >= 2 * least:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            at = np.searchsorted(cut, x[:, f], side="right")  # x < cut[i] goes left of cut i
            gs, hs, ns = (np.bincount(at, w, len(cut) + 1).cumsum()[:-1] for w in (grad, hess, np.ones(len(x))))
            gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
            gain[(ns < least) | (len(x) - ns < least)] = -1
            if (i := int(gain.argmax())) >= 0 and gain[i] > best[0]:
                best = (float(gain[i]), f, float(cut[i]))
    if best[1] < 0:
        return leaf
    go = x[:, best[1]] < best[2]
    down = [_grow(names, x[m], grad[m], hess[m], depth - 1, cuts, l2, least) for m in (go, ~go)]
    return Tree(0.0, names[best[1]], best[2], *down)


def boost(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 64, l2: float = 1.0, least: int = 10) -> tuple[float, list[Tree]]:
    """Logistic gradient boosting with histogram splits. Deterministic; one class or no rows give the base score only."""
    n, up = len(y), float(y.sum()) if len(y) else 0.0
    base = float(np.log((up + 1) / (n - up + 1)))
    out: list[Tree] = []
    if up in (0.0, float(n)):
        return base, out
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(mid if len(mid) <= bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins))))
    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = _grow(names, x, p - y, p * (1 - p), depth, cuts, l2, least)
        t = _scaled(t, rate)
        out.append(t)
        score = score + t.predict(names, x)
    return base, out


def _scaled(t: Tree, rate: float) -> Tree:
    return Tree(t.value * rate) if t.left is None else Tree(0.0, t.feature, t.cut, _scaled(t.left, rate), _scaled(t.right, rate))


def judge(pages: DataFrame, rules=RULES, max_train: int = 20_000, trees: int = 20, depth: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, score: a row for every row of ``pages``.

    Null URLs and URLs without ``://`` have an empty host and path and no rule; the trees judge them. With no labelled URL
    or one class only, the score is the base rate. Very long URLs are read whole. Null page_ids and repeated rows are kept; an empty table gives none.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(F.col("u_url"))
    t = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("u_url"))
    t = t.withColumn("host", host).withColumn("path", path)
    which, verdict = rule_for(F.col("host"), F.col("path"), rules)
    t = t.withColumn("rule", which).withColumn("u_rule_verdict", verdict)
    # distinct labelled URLs with the smallest hashes: an even sample whose size is a parameter, kept as a top-k
    labelled = t.where(F.col("rule").isNotNull()).select("u_url", "host", "path", (F.col("u_rule_verdict") == "block").cast("double").alias("u_y")).distinct()
    labelled = labelled.orderBy(F.xxhash64("u_url"), "u_url").limit(max_train)
    ends = endings(F.col("host"), F.col("path"))
    cols = features(F.col("u_url"), F.col("host"), F.col("path"), {})
    names = [*cols]
    got = labelled.select(*[c.alias(k) for k, c in cols.items()], *[c.alias(f"u_e_{k}") for k, c in ends.items()], "u_y").collect()
    y = np.array([r["u_y"] for r in got])
    shares = shares_of([({k: r[f"u_e_{k}"] for k in ends}, r["u_y"]) for r in got])
    x = np.array([[r[k] for k in names] for r in got], dtype=float).reshape(len(got), len(names))
    for k in ends if len(got) else ():
        x[:, names.index(k)] = [shares[k].get(r[f"u_e_{k}"], shares[k][""]) for r in got]
    start, grown = boost(names, x, y, trees, depth)
    feats = features(F.col("u_url"), F.col("host"), F.col("path"), shares)
    t = t.withColumns({f"u_f_{k}": c for k, c in feats.items()})
    held = {k: F.col(f"u_f_{k}") for k in feats}
    total = F.lit(start)
    for g in grown:
        total = total + g.column(held)
    score = F.round(1 / (1 + F.exp(-total)), 9)
    t = t.withColumn("score", score)
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return t.select("page_id", "host", "path", "rule", F.coalesce("u_rule_verdict", by_trees).alias("verdict"), "score")
