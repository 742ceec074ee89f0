"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host and all subdomains when the path of the URL starts with the
rule's; the longest rule wins, of equal ones the smaller string.  Where no rule fits, a logistic
model on hashed n-grams of host and path decides; it is trained in numpy from a small table of
labelled URLs.

Defined results: host and path of NULL or of a text without ``://`` are empty, no rule fits them
and, without any n-gram, the model's bias decides; repeated rows are judged each; other columns
are ignored.  An empty table gives no rows; an empty table of labels gives a model that allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the rules of the query ------------------------------------------------
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]
# --- fixed values: a small labelled table (word of a host, block) -------------------------
BLOCKED_NAMES = [
    "cheap-pills", "spam-farm", "free-casino", "casino-bonus", "online-casino", "buy-pills", "cheap-meds", "viagra-shop",
    "adult-cams", "xxx-videos", "payday-loans", "fast-loans", "win-prizes", "free-prizes", "click-farm", "link-farm",
    "replica-watches", "cheap-watches", "spam-links", "ad-farm", "torrent-warez", "crack-keygen", "fake-pharmacy", "pills-online",
    "adult-chat", "adult-site", "sports-bets", "free-slots", "poker-win", "win-money", "bets-now", "porn-tube", "xxx-cams",
    "hot-singles", "diet-pills", "casino",
]
ALLOWED_NAMES = [
    "news", "daily-news", "university", "library", "museum", "weather", "recipes", "gardening", "city-council", "open-data",
    "science", "history", "language-school", "docs", "developer", "football", "travel-notes", "book-review", "music-school",
    "health-service", "farm-museum", "family-doctor", "public-radio", "local-paper",
]
# ----------------------------------------------------------------------------------------
FEATURES, GRAMS = 1 << 16, (3, 4, 5)
#: Hosts of the table at hand that join the labelled table as ordinary ones, at most.
SAMPLE_HOSTS = 500
#: Bytes of host and path the n-grams of one URL are taken from at a time; all of it counts.
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, NULL where none fits."""
    chosen = verdict = None
    for rule, say in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & F.startswith(path, F.lit("/" + start)) & (host != "")
        chosen = F.when(fits, F.lit(rule)) if chosen is None else chosen.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(say)) if verdict is None else verdict.when(fits, F.lit(say))
    return (F.lit(None).cast("string"),) * 2 if chosen is None else (chosen, verdict)


def gram_rows(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of all texts, vectorised over their joined bytes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    buckets, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, 1469598103934665603 + n, np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] % np.uint64(FEATURES)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def _features(host: bytes, path: bytes) -> bytes:
    return b"^" + host + b"/" + path + b"$"


def scores(model: Model, hosts: Sequence[bytes], paths: Sequence[bytes]) -> np.ndarray:
    """Log-odds of blocking: mean weight of the n-grams times the root of their number."""
    texts = [_features(h, p) for h, p in zip(hosts, paths, strict=True)]
    buckets, owners = gram_rows(texts)
    n = np.bincount(owners, minlength=len(texts))
    total = np.bincount(owners, weights=model.weights[buckets], minlength=len(texts))
    return model.bias + total / np.sqrt(np.maximum(n, 1))


def train(urls: Sequence[tuple[str, str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit on (host, path, blocked) with full-batch gradient steps; a few thousand rows."""
    if not urls:
        return Model(np.zeros(FEATURES), -1.0)
    texts = [_features(h.encode(), p.encode()) for h, p, _ in urls]
    y = np.array([b for *_, b in urls], float)
    buckets, owners = gram_rows(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(texts)), 1))
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias, seen = np.zeros(FEATURES), 0.0, np.zeros(FEATURES)
    for _ in range(rounds):
        z = bias + np.bincount(owners, weights=w[buckets], minlength=len(texts)) * scale
        error = (1 / (1 + np.exp(-z)) - y) * balance
        g = np.bincount(buckets, weights=(error * scale)[owners], minlength=FEATURES) + decay * w
        seen += g * g
        w -= rate * g / (np.sqrt(seen) + 1e-8)
        bias -= rate * error.sum()
    return Model(w, float(bias))


def labelled_urls(pages: DataFrame, url: str = "url", hosts: int = SAMPLE_HOSTS) -> list[tuple[str, str, int]]:
    """(host, path, blocked): the labelled names under usual hosts and paths, and at most
    ``hosts`` hosts of the table (smallest hash) that bear no blocked name, as ordinary ones."""
    tops, heads = ["com", "net", "org", "example.com", "example.net", "example.org"], ["", "www.", "m.", "blog."]
    paths = ["/", "/en/12", "/fr/825", "/de/612.html", "/es/533/", "/index.html"]
    rows = []
    for blocked, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            for j, top in enumerate(tops):
                rows.append((heads[(i + j) % len(heads)] + name + "." + top, paths[(i * 5 + j) % len(paths)], blocked))
    host, path = host_and_path(F.col(url))
    words = sorted({w for n in BLOCKED_NAMES for w in n.split("-") if len(w) > 3} - {w for n in ALLOWED_NAMES for w in n.split("-")})
    own = pages.select(host.alias("host"), path.alias("path")).where((F.col("host") != "") & ~F.col("host").rlike("|".join(words)))
    some = own.groupBy("host").agg(F.min("path").alias("path")).orderBy(F.xxhash64("host"), "host").limit(hosts).collect()
    return rows + [(r["host"], r["path"], 0) for r in some]


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, score``: one row per URL; ``score`` is the model's
    log-odds of blocking, where it decided."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("key", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    weights, bias = model.weights, model.bias

    def work(batches):
        import pyarrow as pa

        own = Model(weights, bias)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                hosts, paths, size, to = [], [], 0, at
                while to < batch.num_rows and (to == at or size < SLICE):
                    h, p = batch.column(1)[to].as_py().encode(), batch.column(2)[to].as_py().encode()
                    hosts.append(h), paths.append(p)
                    size, to = size + len(h) + len(p), to + 1
                part, z = batch.slice(at, to - at), scores(own, hosts, paths)
                given = part.column(4).to_pylist()
                said = [v if v is not None else "block" if s > 0 else "allow" for v, s in zip(given, z, strict=True)]
                score = pa.array([None if v is not None else round(float(s), 6) for v, s in zip(given, z, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(said, pa.string()), score],
                                                 ["key", "host", "path", "rule", "verdict", "score"])
                at = to

    kind = pages.schema[key].dataType.simpleString()
    out = ruled.mapInArrow(work, f"key {kind}, host string, path string, rule string, verdict string, score double")
    return out.withColumnRenamed("key", key)
