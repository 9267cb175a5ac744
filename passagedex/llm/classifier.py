"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from the statistics of a bounded sample of labelled
rows, over histograms of at most 64 bins a feature, and flattened into arrays;
executors measure their texts and walk all rows of a batch down all trees with
numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagedex.llm.common import column

# Labelled rows a model is fitted on, at most: those with the smallest hashes.
MAX_LABELLED = 20_000


TO_SPACE = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Shares of the bytes of words: name and the bytes that count.
BYTE_SHARES = {
    "symbols": b"#*$%&<>~^_={}[]\\@",
    "upper": UPPER,
    "digits": b"0123456789",
    "bars": b"|",
    "shouts": b"!?",
    "stops": b".:;",
    "commas": b",",
    "frequent_letters": b"etaoin",
    "beyond_ascii": bytes(range(128, 256)),
}
STATISTICS = (
    "log_words",
    "word_bytes",
    "distinct_words",
    "line_words",
    "distinct_lines",
    *BYTE_SHARES,
)
COUNTED = np.array([[b in marks for b in range(256)] for marks in BYTE_SHARES.values()], dtype=float)


def document_statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text in the order of STATISTICS; of null as of the empty text.

    Shares of nothing are 0.
    """
    raw = (text or "").encode().translate(TO_SPACE)
    words, lines = raw.split(), (text or "").split("\n")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size, n = len(raw) - counts[0x20], len(words)
    general = (
        np.log1p(n),
        size / max(n, 1),
        len(set(words)) / max(n, 1),
        n / len(lines),
        len(set(lines)) / len(lines),
    )
    return np.concatenate((general, COUNTED @ counts / max(size, 1)))


def _table(texts: pd.Series) -> np.ndarray:
    rows = [document_statistics(t) for t in texts]
    return np.stack(rows) if rows else np.empty((0, len(STATISTICS)))


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays; node i is a leaf if feature[i] < 0.

    Rows go left where the feature is at most the threshold. Children stand at
    left[i] and left[i] + 1; `depth` steps reach a leaf from every root, as a
    leaf is its own child.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        at = np.arange(len(rows))[:, None]
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        for _ in range(self.depth):
            feature = self.feature[node]
            leaf = feature < 0
            right = rows[at, np.maximum(feature, 0)] > self.threshold[node]
            node = np.where(leaf, node, self.left[node] + right)
        margin = self.base + self.value[node].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


def grow_forest(
    rows: np.ndarray,
    labels: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    least_rows: int = 8,
    damping: float = 1.0,
) -> Forest:
    """Boosted trees for the logistic loss.

    Features are cut at quantiles into at most `bins` bins; every node sums
    gradients and curvatures by bin and takes the split of highest gain. Without
    rows, or with labels of one kind, the forest scores the smoothed share of
    label 1 everywhere (0.5 without rows).
    """
    n, n_features = len(labels), rows.shape[1] if rows.size else 0
    share = (labels.sum() + 1.0) / (n + 2.0)
    nodes = {k: [] for k in ("feature", "threshold", "left", "value")}

    def node(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("value", value)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    base, roots = float(np.log(share / (1 - share))), []
    if n and 0 < labels.sum() < n:
        quantiles = np.linspace(0, 1, bins + 1)[1:-1]
        cuts = [np.unique(np.quantile(rows[:, f], quantiles)) for f in range(n_features)]
        binned = np.stack(
            [np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(n_features)], axis=1
        )
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            gradient, curvature = labels - p, p * (1 - p)

            def leaf_value(members, g=gradient, h=curvature):
                return rate * g[members].sum() / (h[members].sum() + damping)

            everyone = np.arange(n)
            roots.append(node(leaf_value(everyone)))
            level = [(roots[-1], everyone)]
            for _ in range(depth):
                following = []
                for at, members in level:
                    split = _best_split(
                        binned[members], gradient[members], curvature[members], cuts, least_rows, damping
                    )
                    if split is None:
                        continue
                    f, cut = split
                    goes_right = binned[members, f] > cut
                    parts = (members[~goes_right], members[goes_right])
                    children = [node(leaf_value(part)) for part in parts]
                    nodes["feature"][at], nodes["threshold"][at] = f, float(cuts[f][cut])
                    nodes["left"][at] = children[0]
                    following += zip(children, parts, strict=True)
                level = following
            tree = Forest(*_arrays(nodes), np.array(roots[-1:]), depth, 0.0)
            margin += _margin(tree, rows)
    return Forest(*_arrays(nodes), np.array(roots, dtype=np.int64), depth, base)


def _arrays(nodes: dict[str, list]) -> tuple[np.ndarray, ...]:
    return tuple(
        np.array(nodes[k], dtype=np.float64 if k in ("threshold", "value") else np.int64)
        for k in ("feature", "threshold", "left", "value")
    )


def _margin(tree: Forest, rows: np.ndarray) -> np.ndarray:
    p = tree.score(rows)
    return np.log(p / (1 - p))


def _best_split(binned, gradient, curvature, cuts, least_rows, damping):
    """(feature, last bin of the left side) of highest gain, or None."""
    best, choice = 1e-6, None
    g_all, h_all = gradient.sum(), curvature.sum()
    for f, edges in enumerate(cuts):
        size = len(edges) + 1
        g = np.cumsum(np.bincount(binned[:, f], gradient, size))[:-1]
        h = np.cumsum(np.bincount(binned[:, f], curvature, size))[:-1]
        rows = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        gain = g**2 / (h + damping) + (g_all - g) ** 2 / (h_all - h + damping)
        gain = gain - g_all**2 / (h_all + damping)
        gain[(rows < least_rows) | (len(gradient) - rows < least_rows)] = 0
        if len(gain) and gain.max() > best:
            best, choice = gain.max(), (f, int(gain.argmax()))
    return choice


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learnt from: crc32 of its id as text, mod 4, is not 2."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; a null id is not."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    max_rows: int = MAX_LABELLED,
) -> Forest:
    """A forest from labelled documents outside the held-out quarter.

    Of more than `max_rows` labelled ids those with the smallest hashes are used;
    only their statistics come to the driver, of at most as many documents as have
    one of these ids. Null labels and ids are left out.
    """
    chosen = (
        labels.select(column(labels, doc_id).alias("id"), column(labels, label).alias("label"))
        .dropna()
        .where(learnable(F.col("id")))
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(max_rows)
    )

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_table(texts)))

    joined = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text")).join(
        F.broadcast(chosen), "id"
    )
    rows = joined.select("id", "label", measured("text").alias("statistics")).collect()
    # Ids may repeat; what is used does not depend on the order of arrival.
    rows = sorted((r.id, list(r.statistics), r.label) for r in rows)[:max_rows]
    table = np.array([statistics for _, statistics, _ in rows]).reshape(-1, len(STATISTICS))
    return grow_forest(table, np.array([label for *_, label in rows], dtype=np.float64))


def quality_score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The table with one more column `score`, from 0 to 1; empty and null texts get one too.

    An input column `score` is replaced. Repeated rows score alike.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(_table(texts)))

    return docs.withColumn("score", scored(column(docs, text)))
