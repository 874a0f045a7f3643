"""Toxicity categories by a chain of linear classifiers.

Category after category gets a logistic model over the words of a document. A
later model also sees the probabilities of the earlier categories; when it is
trained these come from models that had not seen the document (out-of-fold), when
it is applied from the final earlier models.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.workdir import removed, written

WORD = re.compile(r"\w+")


PREFIXES = (4, 5, 6)


def vocabulary_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a whole text."""
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words and the beginnings of longer words (inflected and compound forms share them)."""
    found = set(words)
    for n in PREFIXES:
        found.update([w[:n] + "^" for w in words if len(w) > n])
    return found


@dataclass(frozen=True)
class Link:
    """One category's model: a weight for each feature, for each earlier category's probability, and a bias."""

    name: str
    words: dict
    earlier: tuple
    bias: float


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return float(np.clip(np.log(max(p, 1e-9) / max(1 - p, 1e-9)), -6, 6))


def _fit(idx, row, n_words, n_rows, extra, y, rows, l2, max_iter=40):
    """L2-regularised logistic regression by L-BFGS over binary word features and dense extras.

    ``idx``/``row``: word and row of each entry; only ``rows`` (a mask) count.
    Entries are summed up in runs, so that nothing of their number is copied.
    """
    y, k = y.astype(float), extra.shape[1]
    weight = rows.astype(float)
    size = n_words + k + 1
    runs = [slice(at, at + (1 << 18)) for at in range(0, len(idx), 1 << 18)]

    def margin(w):
        out = extra @ w[n_words:-1] + w[-1]
        for r in runs:
            out += np.bincount(row[r], weights=w[idx[r]], minlength=n_rows)
        return out

    def loss(w):
        z = margin(w)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        r = weight * (p - y)
        grad = np.zeros(size)
        for part in runs:
            grad[:n_words] += np.bincount(idx[part], weights=r[row[part]], minlength=n_words)
        grad[n_words:-1] = extra.T @ r
        grad[-1] = r.sum()
        grad[:-1] += l2 * w[:-1]
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * (w[:-1] ** 2).sum(), grad

    w = np.zeros(size)
    f, g = loss(w)
    past: list = []
    for _ in range(max_iter):
        q, alphas = g.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, t, rho), a in zip(past, reversed(alphas), strict=True):
            q += (a - rho * (t @ q)) * s
        step, slope = 1.0, -(g @ q)
        while True:
            nf, ng = loss(w - step * q)
            if nf <= f + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = -step * q, ng - g
        w, done = w + s, abs(f - nf) <= 1e-6 * max(1.0, abs(f))
        f, g = nf, ng
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        if done or np.linalg.norm(g) < 1e-4:
            break
    return w, margin


def fit_chain(rows: list[np.ndarray], vocabulary: list[str], picked: list[np.ndarray], marks: list[tuple], fold: np.ndarray, names: tuple[str, ...], l2: float = 0.5) -> list[Link]:
    """Fit the chain on documents given as sorted indices into ``vocabulary``; a null mark leaves its document out of that category.

    ``picked[j]``: the features that category ``j`` may use; ``fold``: the fold of
    each document. Earlier categories enter as probabilities, in training those of
    models that had not seen the document's fold. A category without both marks
    gets a constant model: its share of ones.
    """
    n, folds = len(rows), range(int(fold.max()) + 1 if len(fold) else 0)
    all_idx = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    all_row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in rows])
    chain, earlier = [], np.zeros((n, 0))
    for j, name in enumerate(names):
        raw = [m[j] for m in marks]
        known = np.array([v is not None for v in raw], bool)
        y = np.array([int(bool(v)) for v in raw], np.int64)
        share = float(y[known].mean()) if known.any() else 0.0
        if share in (0.0, 1.0):
            chain.append(Link(name, {}, (0.0,) * j, _logit(share)))
            earlier = np.column_stack([earlier, np.full(n, _sigmoid(_logit(share)))])
            continue
        new = np.full(len(vocabulary), -1, np.int32)
        new[picked[j]] = np.arange(len(picked[j]))
        idx, size = new[all_idx], len(picked[j])
        take = idx >= 0
        idx, row = idx[take], all_row[take]
        w, _ = _fit(idx, row, size, n, earlier, y, known, l2)
        mine = np.full(n, share)
        for k in folds:
            train = known & (fold != k)
            if 0 < y[train].sum() < train.sum():
                wk, margin = _fit(idx, row, size, n, earlier, y, train, l2)
                mine[fold == k] = _sigmoid(margin(wk)[fold == k])
        chain.append(Link(name, {vocabulary[f]: float(w[i]) for i, f in enumerate(picked[j]) if abs(w[i]) > 1e-3}, tuple(map(float, w[size:-1])), float(w[-1])))
        earlier = np.column_stack([earlier, mine])
    return chain


class Scorer:
    """Applies a chain to batches of texts, category after category."""

    def __init__(self, chain: list[Link]):
        self.chain = chain
        self.index = {f: i for i, f in enumerate(sorted({f for link in chain for f in link.words}))}
        self.weights = np.zeros((len(self.index), len(chain)))
        for j, link in enumerate(chain):
            for f, w in link.words.items():
                self.weights[self.index[f], j] = w
        self.seen: dict[str, tuple] = {}

    def _places(self, word: str) -> tuple:
        """The indices of the word's features that the chain weighs; a bounded memory of words."""
        found = tuple(i for f in features_of({word}) if (i := self.index.get(f)) is not None)
        if len(self.seen) >= 200_000:
            self.seen.clear()
        if len(word) <= 64:
            self.seen[word] = found
        return found

    def probabilities(self, texts) -> np.ndarray:
        """One row a text, one column a category."""
        flat, sizes, seen = [], [], self.seen
        for text in texts:
            own: set[int] = set()
            for word in vocabulary_of(text):
                places = seen.get(word)
                own.update(self._places(word) if places is None else places)
            flat.append(np.fromiter(own, np.int64, len(own)))
            sizes.append(len(own))
        idx = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), len(self.chain)))
        for j, link in enumerate(self.chain):
            out[:, j] = _sigmoid(link.bias + np.bincount(row, weights=self.weights[idx, j], minlength=len(sizes)) + out[:, :j] @ np.array(link.earlier))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict, doc_id: str = "doc_id", text: str = "text", max_rows: int = 8_000, folds: int = 3, min_docs: int = 4, max_features: int = 6_000) -> list[Link]:
    """Fit a chain for ``categories`` (name to a Column of 0/1 over ``labels``, in chain order).

    The fit uses at most ``max_rows`` labelled documents, those with the smallest
    id hashes; labels repeated for an id count as their maximum, labels and
    documents with null ids are left out. Copies of a text fall into one fold.
    ``min_docs`` and ``max_features`` set the size of the model: a category uses
    the ``max_features`` features of at least ``min_docs`` of the sampled
    documents whose shares differ most, in standard errors, between its ones and
    zeros. Spark counts them; only the chosen features come to the driver, and
    for each document the numbers of those it has.
    """
    spark, names = docs.sparkSession, tuple(categories)
    marked = [f"y{i}" for i in range(len(names))]
    marks = labels.where(labels[doc_id].isNotNull()).select(labels[doc_id].cast("long").alias("id"), *[categories[n].cast("int").alias(y) for n, y in zip(names, marked, strict=True)])
    marks = marks.groupBy("id").agg(*[F.max(y).alias(y) for y in marked]).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(docs[doc_id].cast("long").alias("id"), F.xxhash64(docs[text].cast("string")).alias("th"), docs[text].cast("string").alias("t")).join(F.broadcast(marks), "id")  # max_rows rows

    def features(batches):
        for batch in batches:
            found = [sorted(features_of(vocabulary_of(t.as_py()))) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), *batch.columns[3:]], names=["id", "th", "features", *marked])

    shape = ", ".join(f"{y} int" for y in marked)
    sample = written(rows.select("id", "th", "t", *marked).mapInArrow(features, f"id long, th long, features array<string>, {shape}"), "toxicity-sample")
    many = sample.agg(F.count("*").alias("n"), *[F.sum(F.when(F.col(y) == v, 1).otherwise(0)).alias(f"{y}_{v}") for y in marked for v in (0, 1)]).first()
    counts = sample.select(F.explode("features").alias("f"), *marked).groupBy("f").agg(F.count("*").alias("docs"), *[F.sum(F.when(F.col(y) == v, 1).otherwise(0)).alias(f"{y}_{v}") for y in marked for v in (0, 1)])
    counts = written(counts.where(F.col("docs") >= min_docs), "toxicity-features")
    chosen = []
    for y in marked:
        ones, zeros = many[f"{y}_1"] or 0, many[f"{y}_0"] or 0
        a, b = F.col(f"{y}_1") / max(1, ones), F.col(f"{y}_0") / max(1, zeros)
        z = F.abs(a - b) / F.sqrt((a * (1 - a) + 1 / max(1, many["n"])) / max(1, ones) + (b * (1 - b) + 1 / max(1, many["n"])) / max(1, zeros))
        chosen.append([r[0] for r in counts.orderBy(F.desc(z), "f").limit(max_features).select("f").collect()] if ones and zeros else [])
    vocabulary = sorted(set().union(*chosen))
    place = {f: i for i, f in enumerate(vocabulary)}
    shared = spark.sparkContext.broadcast(place)

    def numbered(batches):
        at = shared.value
        for batch in batches:
            idx = [np.array(sorted(at[f] for f in fs if f in at), np.int32).tobytes() for fs in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.binary()), *batch.columns[3:]], names=["id", "th", "idx", *marked])

    got = sorted(sample.mapInArrow(numbered, f"id long, th long, idx binary, {shape}").collect(), key=lambda r: (r[0], r[1] or 0))
    for table in (sample, counts):
        removed(spark, table._scratch)
    shared.unpersist()
    own = [np.frombuffer(r["idx"], np.int32) for r in got]
    fold = np.array([(r["th"] or 0) % folds for r in got], np.int64)
    return fit_chain(own, vocabulary, [np.array(sorted(place[f] for f in c), np.int64) for c in chosen], [tuple(r[3:]) for r in got], fold, names)


def classify(docs: DataFrame, chain: list[Link], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id`` and a probability ``p_<category>`` for every row, repeated rows and null ids too; null and empty texts have no words."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c.name}" for c in chain]

    def run(batches):
        own = Scorer(model.value)
        for batch in batches:
            p = own.probabilities(t.as_py() for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, j]) for j in range(len(names))]], names=["doc_id", *names])

    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))


def standard_chain(docs: DataFrame, labels: DataFrame, **options) -> list[Link]:
    """The chain over the ``labels`` table: low quality first, then toxic."""
    return train(docs, labels, {"low_quality": 1 - labels["quality"], "toxic": labels["toxic"]}, **options)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.2, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Return ``doc_id, p_low_quality, p_toxic, toxic`` of the documents that the chain rejects.

    All rows are scored on their whole texts; repeated rows and rows with a null
    id each count. Probabilities equal to ``threshold`` reject. Without labels
    nothing is rejected, an empty table gives an empty result, and other columns
    may have any names.
    """
    scored = classify(docs, standard_chain(docs, labels, doc_id=doc_id, text=text, **options), doc_id, text)
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold).where("toxic")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.2, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Keep the documents that the chain does not reject, with all their columns, repeated rows and null ids.

    The decision is taken row by row, next to the row: nothing is joined. Null
    and empty texts are judged by the model's bias alone; an empty table gives an
    empty one.
    """
    chain = docs.sparkSession.sparkContext.broadcast(standard_chain(docs, labels, doc_id=doc_id, text=text, **options))
    at = docs.columns.index(text)

    def run(batches):
        own = Scorer(chain.value)
        for batch in batches:
            yield batch.filter(pa.array(own.probabilities(t.as_py() for t in batch.column(at))[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)
