"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import labelled_sample

SAMPLE_ROWS = 20_000
PREDICT_AT = 0.3
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.2
LEAST_WEIGHT = 3.0


def _byte_classes() -> np.ndarray:
    """Byte x class indicator: what the shares of a text are counted over."""
    groups = [
        range(97, 123), range(65, 91), range(48, 58), range(128, 256), b" \t", b"\n\r", b".,;:'\"()-", b"!?", b"|", b"#$%&*",
        b"<>{}[]\\/=+_~^`@", b".", b",",
    ]
    table = np.zeros((256, len(groups)))
    for k, g in enumerate(groups):
        table[list(g), k] = 1
    return table


_CLASSES = _byte_classes()
_TERMINAL = (b".", b"!", b"?", b'"', b"\xe2\x80\x9d")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for a null or empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * N_FEATURES
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    shares = counts @ _CLASSES / n
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()] or [b""]
    lengths = np.fromiter(map(len, filled), np.int64, len(filled))
    letters = max(1.0, (shares[0] + shares[1]) * n)
    used = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), float(sizes.max()),
        *shares.tolist(), shares[1] * n / letters,
        distinct / max(1, len(words)), (len(words) - distinct) / max(1, len(words)) ** 0.5,
        np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), 1 - len(set(filled)) / len(filled),
        sum(x.rstrip().endswith(_TERMINAL) for x in filled) / len(filled),
        len(words) / (1 + counts[33] + counts[46] + counts[63]), float(-(used * np.log(used)).sum()),
    ]


N_FEATURES = 5 + _CLASSES.shape[1] + 1 + 2 + 4 + 1 + 2


class Trees:
    """Trees flattened into parallel arrays; node 0 of each tree is its root.

    ``feature`` is -1 in a leaf. Prediction walks all rows down one level at a time.
    """

    def __init__(self, base: float) -> None:
        self.base = base
        self.feature: list[int] = []
        self.split: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.roots: list[int] = []

    def node(self, feature: int = -1, split: float = 0.0, value: float = 0.0) -> int:
        for column, v in (
            (self.feature, feature), (self.split, split), (self.left, -1), (self.right, -1), (self.value, value)
        ):
            column.append(v)
        return len(self.feature) - 1

    def freeze(self) -> Trees:
        self.feature, self.left, self.right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        self.split, self.value = np.array(self.split), np.array(self.value)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] <= self.split[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for logistic loss over quantile-binned features."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model.freeze()
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    logits = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logits))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        where = np.zeros(len(x), np.int64)
        model.roots.append(model.node())
        level = [model.roots[-1]]
        of_node = np.zeros(len(x), np.int64)  # position in ``level``; -1 below a leaf
        for depth in range(DEPTH + 1):
            inside = of_node >= 0
            m = len(level)
            g_all = np.bincount(of_node[inside], grad[inside], m)
            h_all = np.bincount(of_node[inside], hess[inside], m)
            best = [(1e-3, -1, 0)] * m
            for k in range(x.shape[1]) if depth < DEPTH else ():
                cell = of_node[inside] * BINS + binned[inside, k]
                g = np.bincount(cell, grad[inside], m * BINS).reshape(m, BINS).cumsum(axis=1)
                h = np.bincount(cell, hess[inside], m * BINS).reshape(m, BINS).cumsum(axis=1)
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + 1) + gr**2 / (hr + 1) - (g_all**2 / (h_all + 1))[:, None]
                gain[(h < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = -1
                top = gain.argmax(axis=1)
                for j in range(m):
                    if top[j] < len(edges[k]) and gain[j, top[j]] > best[j][0]:
                        best[j] = (gain[j, top[j]], k, int(top[j]))
            following: list[int] = []
            moved = np.full(len(x), -1)
            for j, node in enumerate(level):
                own = of_node == j
                _, k, b = best[j]
                if k < 0:
                    model.value[node] = -RATE * g_all[j] / (h_all[j] + 1)
                    where[own] = node
                    continue
                model.feature[node], model.split[node] = k, float(edges[k][b])
                goes = binned[:, k] <= b
                for side, rows in ((model.left, own & goes), (model.right, own & ~goes)):
                    child = model.node()
                    side[node] = child
                    moved[rows] = len(following)
                    following.append(child)
            level, of_node = following, moved
            if not level:
                break
        logits += np.array(model.value)[where]
    return model.freeze()


def _features(batch_texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in batch_texts]).reshape(-1, N_FEATURES)


def train_quality(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_column: str = "doc_id", text: str = "text"
) -> Trees:
    """Fits the trees on about ``rows`` labelled documents (``labels``: doc_id, quality).

    The sample is chosen by a hash of the id; its ids are broadcast (at most about
    ``rows`` numbers) and only the statistics of its documents reach the driver. Without
    labels, or with one class only, every document gets the class's share.
    """
    known = labelled_sample(docs.sparkSession, labels, "quality", rows)

    def run(batches):
        for b in batches:
            x = _features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(known), "id")
    found = chosen.select("y", "t").mapInArrow(run, "y int, x array<double>").toArrow()
    if not found.num_rows:
        return Trees(0.0).freeze()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees, whatever order the rows came in
    return fit_trees(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row: the probability of quality 1 of the whole text.

    Null and empty texts have all-zero statistics and a score like any other; null ids and
    repeated rows stay; further columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                p = 1 / (1 + np.exp(-shared.value.logits(_features(part.column(1).to_pylist()))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p), pa.array((p >= PREDICT_AT).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
