"""URL filtering by rules and, where no rule fits, by gradient-boosted trees on lexical features."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from . import storage

if TYPE_CHECKING:
    from pyspark.ml.classification import GBTClassificationModel

BLOCK, ALLOW = "block", "allow"
FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "query_length", "hyphens", "longest_digits", "suffix_rate", "suffix_count", "ending_rate", "ending_count")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: list[Rule], of: Callable[[Rule], str]) -> Column:
    """of(rule) for the longest rule that fits the columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))
        out = F.when(fits, F.lit(of(rule))).otherwise(out)
    return out


def _suffix(host: str) -> str:
    """The last two labels of a host."""
    return ".".join(host.rsplit(".", 2)[-2:])


def _ending(path: str) -> str:
    """The first directory of a path and its file ending."""
    last = path.rsplit("/", 1)[-1]
    return path[1:].split("/", 1)[0] + "." + (last.rsplit(".", 1)[-1] if "." in last else "")


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features that need no statistics."""
    n = len(url)
    counts = Counter(url).values()
    query = url.partition("?")[2].partition("#")[0]
    digits = runs = longest = 0
    for c in url:
        runs = runs + 1 if "0" <= c <= "9" else 0
        digits += runs > 0
        longest = max(longest, runs)
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0
    parameters = sum(1 for p in query.split("&") if p)
    return [float(x) for x in (n, len(host), len(path), sum(1 for p in path.split("/") if p), host.count(".") + 1 if host else 0, digits / max(n, 1), entropy, parameters, len(query), url.count("-"), longest)]


#: Buckets of the statistics of suffixes, and as many of those of endings; parts that labelled URLs are dealt into.
BUCKETS, FOLDS = 1 << 16, 5


def _groups(host: str, path: str) -> tuple[int, int]:
    """The buckets of a URL's suffix and ending."""
    return zlib.crc32(_suffix(host).encode()) % BUCKETS, BUCKETS + zlib.crc32(_ending(path).encode()) % BUCKETS


def fold_of(url: str) -> int:
    return zlib.crc32(url.encode()) % FOLDS


@dataclass
class UrlModel:
    """Trees and, for each bucket of suffixes and endings, how many labelled URLs it has and how many of them are blocked.

    Without trees there is one verdict for all, that of the prior.
    """

    trees: GBTClassificationModel | None
    counts: Broadcast | None
    prior: float
    folds: Broadcast | None = None  # the same of each fold

    def features(self, df: DataFrame, *, out_of_fold: bool = False) -> DataFrame:
        """Replaces url by features, for rows with url, host and path.

        Out of fold, statistics are those of the other folds alone, so that rows to learn from do not tell their own labels.
        """
        counts, folds, prior = self.counts, self.folds if out_of_fold else None, self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = [counts.value - own for own in folds.value] if folds else [counts.value] * FOLDS
            for batch in batches:
                urls, hosts, paths = (batch.column(c).to_pylist() for c in ("url", "host", "path"))
                found = []
                for u, h, p in zip(urls, hosts, paths, strict=True):
                    seen = [known[fold_of(u or "")][g] for g in _groups(h, p)]
                    # Rates are smoothed by ten rows of the overall rate.
                    found.append(lexical(u or "", h, p) + [float(x) for n, blocked in seen for x in ((blocked + 10 * prior) / (n + 10), math.log1p(n))])
                kept = [i for i, c in enumerate(batch.schema.names) if c != "url"]
                arrays = [batch.column(i) for i in kept] + [pa.array(found, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + ["features"])

        rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "url")
        return df.mapInArrow(run, f"{rest}, features array<double>")

    def score(self, df: DataFrame) -> DataFrame:
        """Replaces url by blocked, the probability of block."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        if self.trees is None:
            return df.drop("url").withColumn("blocked", F.lit(self.prior))
        scored = self.trees.transform(self.features(df).withColumn("features", array_to_vector("features")))
        return scored.withColumn("blocked", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _bucket_counts(labelled: DataFrame) -> np.ndarray:
    """Rows and blocked rows of every fold and bucket, over all labelled URLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS * 2 * BUCKETS, 2), dtype=np.int64)
        for batch in batches:
            for u, h, p, y in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path", "label")), strict=True):
                first = fold_of(u or "") * 2 * BUCKETS
                for g in _groups(h, p):
                    total[first + g] += 1, int(y)
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["bucket", "n", "blocked"])

    out = np.zeros((FOLDS * 2 * BUCKETS, 2))
    merged = labelled.select("url", "host", "path", "label").mapInArrow(run, "bucket long, n long, blocked long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    rows = merged.toArrow()  # at most FOLDS * 2 * BUCKETS
    out[rows.column("bucket").to_numpy()] = np.stack([rows.column("n").to_numpy(), rows.column("blocked").to_numpy()], axis=1)
    return out.reshape(FOLDS, 2 * BUCKETS, 2)


def train(labelled: DataFrame, *, max_rows: int = 20_000, trees: int = 20, depth: int = 4) -> UrlModel:
    """Fits trees to rows with url, host, path and verdict.

    At most max_rows distinct URLs are used, half of them from each class, those with the lowest hashes; each counts as many as it
    stands for in its class.  Statistics of suffixes and endings are over all rows, in buckets by hash: those that share one share
    its rate; the trees learn from those of the folds that a URL is not in.  With one class, or no rows, there are no trees.
    """
    from pyspark.ml.classification import GBTClassifier  # with its 60 MB, for drivers that fit
    from pyspark.ml.functions import array_to_vector

    rows = labelled.select("url", "host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label"))
    hashed = F.xxhash64("url")
    sizes = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("url").alias("urls")).collect()}
    n = sum(r["n"] for r in sizes.values())
    prior = float(sizes[1.0]["n"] / n) if 1.0 in sizes else 0.0
    if len(sizes) < 2:
        return UrlModel(None, None, prior)
    taken = []
    for label, size in sizes.items():
        # About twice as many distinct URLs as are wanted have hashes below this, so copies of one never fill the sample.
        below = min(2**63 - 1, 2**64 * max_rows // max(1, size["urls"]) - 2**63)
        own = rows.where((F.col("label") == label) & (hashed <= below)).dropDuplicates(["url"])
        taken.append(own.orderBy(hashed, "url").limit(max_rows // 2))
    sample = storage.materialise(taken[0].unionByName(taken[1]), "urls")
    used = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    counts, share = _bucket_counts(rows), labelled.sparkSession.sparkContext.broadcast
    model = UrlModel(None, share(counts.sum(axis=0)), prior, share(counts))
    weight = F.when(F.col("label") == 1, prior / used[1.0]).otherwise((1 - prior) / used[0.0]) * sum(used.values())
    data = model.features(sample, out_of_fold=True).select("label", array_to_vector("features").alias("features"), weight.alias("weight"))
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.2, weightCol="weight").fit(data)
    return model


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdicts for pages (page_id, url): page_id, host, path, rule, verdict, blocked.

    A rule decides where one fits; of several the longest does.  The trees, trained on the URLs
    that rules decide, judge the others and block from a probability of one half.  A null URL or
    one without :// has empty host and path and is judged by the trees like any other.  Rows are
    judged each on its own; further columns are ignored; an empty table gives an empty table.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", fitting_rule(rules, lambda r: r.text)).withColumn("fixed", fitting_rule(rules, lambda r: r.verdict))
    model = train(rows.where("fixed is not null").select("url", "host", "path", F.col("fixed").alias("verdict")))
    scored = model.score(rows)
    own = F.when(F.col("blocked") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("fixed", own).alias("verdict"), "blocked")
