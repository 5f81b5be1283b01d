"""Mixing sources to target weights (operator 3): soft membership and distributed projected-gradient least squares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, begin_task, materialise, steps, texts_of

#: Labelled rows that the classifier learns from at most, those of the smallest hashed ids.
TRAIN_ROWS = 8_000
#: Domains at most: posteriors are one number a domain and document. More raise an error, none is left out.
MOST_DOMAINS = 512
#: Columns that words are hashed to, two for each word; a table of fixed size.
BUCKETS = 1 << 16


@dataclass
class DomainModel:
    """Naive Bayes evidence of hashed words, averaged over a text, turned to posteriors by a softmax layer."""

    domains: list[str]
    evidence: np.ndarray  # buckets x domains
    weights: np.ndarray  # (domains + 1) x domains

    def posteriors(self, t) -> np.ndarray:
        x = np.column_stack([_mean_evidence(t, self.evidence), np.ones(t.n)]) @ self.weights
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)


def _bucket(t) -> np.ndarray:
    return (t.word_hash() >> np.uint64(48)).astype(np.int64) % BUCKETS


def _mean_evidence(t, evidence: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(t.starts) + 1, evidence.shape[1]))
    np.cumsum(evidence[_bucket(t)], 0, out=sums[1:])
    return np.diff(sums[t.first], axis=0) / np.maximum(t.words, 1)[:, None]


def fit_domains(docs: DataFrame, labels: DataFrame, domain: str, max_rows: int = TRAIN_ROWS) -> DomainModel:
    """Learn domain posteriors from labelled documents, at most ``max_rows`` of them.

    The labelled table says whose ``domain`` column is trusted: rows with a null id or domain, or
    without a document, are left out. Word counts are summed by Spark; the softmax layer is fitted
    on the averaged evidence of the same bounded sample. Without labels there is one domain; more than ``MOST_DOMAINS``
    are an error.
    """
    chosen = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text", F.col(domain).cast("string").alias("domain")).where("domain is not null")
    rows = materialise(rows.join(F.broadcast(chosen), "doc_id").select("text", "domain"))
    domains = [r[0] for r in rows.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(MOST_DOMAINS + 1).collect()]
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"{domain} has more than {MOST_DOMAINS} values among the labelled documents")
    if not domains:
        return DomainModel(["all"], np.zeros((BUCKETS, 1)), np.zeros((2, 1)))
    place = {d: i for i, d in enumerate(sorted(domains))}
    k = len(place)

    def count(batches):
        total = np.zeros((k, BUCKETS))
        for batch in batches:
            domain = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            for row, t in steps(texts_of(batch), lower=True):
                of = np.repeat(domain[row : row + t.n], t.words)
                keep = of >= 0
                np.add.at(total, (of[keep], _bucket(t)[keep]), 1)
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(b, pa.int32()), pa.array(total[d, b])], ["d", "b", "n"])

    counts = np.full((k, BUCKETS), 0.5)
    for x in rows.mapInArrow(count, "d int, b int, n double").groupBy("d", "b").agg(F.sum("n")).toArrow().to_batches():
        counts[x.column(0).to_numpy(), x.column(1).to_numpy()] += x.column(2).to_numpy()
    evidence = np.log(counts / counts.sum(1, keepdims=True)).T
    evidence -= evidence.mean(1, keepdims=True)

    def mean(batches):
        for batch in batches:
            domain = [place.get(x, -1) for x in batch.column(1).to_pylist()]
            for row, t in steps(texts_of(batch), lower=True):
                yield pa.RecordBatch.from_arrays([pa.array(domain[row : row + t.n], pa.int32()), pa.array(list(_mean_evidence(t, evidence)), pa.list_(pa.float64()))], ["d", "x"])

    table = rows.mapInArrow(mean, "d int, x array<double>").toArrow()
    y = table.column("d").to_numpy()
    x = np.array(table.column("x").to_pylist(), float).reshape(len(y), k)
    order = np.lexsort((*x.T, y))
    x, y = np.column_stack([x[order], np.ones(len(y))])[y[order] >= 0], y[order][y[order] >= 0]
    weights = np.vstack([np.eye(k), np.zeros((1, k))])
    for _ in range(200):  # plain gradient steps; the size is bounded by the mean squared norm of a row
        z = np.exp(x @ weights - (x @ weights).max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        weights -= (x.T @ p / len(y) + 1e-4 * weights) / (0.5 * np.square(x).sum(1).mean() + 1e-4)
    return DomainModel(sorted(place), evidence, weights)


def _fold(p: np.ndarray, history: list[np.ndarray], start: float) -> np.ndarray:
    """Rates after the gradient steps so far; each keeps them nonnegative."""
    r = np.full(len(p), start)
    for g in history:
        r = np.maximum(0, r - p @ g)
    return r


def fit_rates(features: DataFrame, targets: np.ndarray, start: float = 1.0, rounds: int = 40, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradient steps for rates r >= 0 whose expected token totals meet ``targets``; and the totals met.

    ``features`` has tokens and posteriors p. The problem is the least squares of sum(r * tokens * p) - targets,
    in the metric that weighs each rate by its tokens, so a step is r - p.g with one vector g for
    all rows. Rates are never stored: rows fold the steps so far. A round is one aggregate of as many
    numbers as there are domains.
    """
    k = len(targets)

    def totals(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def add(batches):
            total, gram = np.zeros(k), np.zeros((k, k))
            for b in batches:
                if b.num_rows:
                    p = b.column(1).flatten().to_numpy().reshape(-1, k)
                    n = b.column(0).to_numpy().astype(float)
                    r = _fold(p, history, start)
                    total += (r * n) @ p
                    gram += (p * (n * (r > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(k * (k + 1)), pa.int32()), pa.array(np.concatenate([total, gram.ravel()]))], ["i", "v"])

        out = np.zeros(k * (k + 1))
        for i, v in features.select("tokens", "posteriors").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out[:k], out[k:].reshape(k, k)

    history: list[np.ndarray] = []
    got, gram = totals(history)
    for _ in range(rounds):
        error = got - targets
        if np.abs(error).sum() <= tolerance * max(targets.sum(), 1.0) or not gram.any():
            break
        # The gradient is one number a domain, so it is scaled by the inverse Gram matrix of the free rates.
        history.append(np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(k), error, rcond=None)[0])
        got, gram = totals(history)
    return history, got


def raised_rates(p: np.ndarray, share: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Rates of one or more: one, raised along the gaps of posteriors to the shares."""
    return np.maximum(1, 1 - (p - share) @ g)


def fit_raised(features: DataFrame, share: np.ndarray, rounds: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, int]:
    """The vector g of ``raised_rates`` with which token totals have the shares ``share``; the totals met; and the rounds.

    Of all rates r >= 1 that meet the shares these have the least sum(tokens * (r - 1)^2). Where no such rates
    exist the gap is as small as they allow, as a ridge bounds g. The dual is convex and quadratic in pieces: a round is a
    Newton step over the raised rates, and one aggregate that tries 16 lengths of it.
    """
    k = len(share)
    lengths = 0.5 ** np.arange(16)
    size = 1 + 2 * k + k * k  # dual value, totals, gradient and curvature at a tried point

    def tried(points: np.ndarray) -> np.ndarray:
        def add(batches):
            out = np.zeros((len(points), size))
            for b in batches:
                if b.num_rows:
                    p = b.column(1).flatten().to_numpy().reshape(-1, k)
                    n = b.column(0).to_numpy().astype(float)
                    q = p - share
                    for row, g in zip(out, points):
                        u = -q @ g
                        up = np.maximum(u, 0)
                        row[0] += n @ (u + up * up / 2)
                        row[1 : 1 + k] += (n * (1 + up)) @ p
                        row[1 + k : 1 + 2 * k] += (n * (1 + up)) @ q
                        row[1 + 2 * k :] += ((q * (n * (u >= 0))[:, None]).T @ q).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], ["i", "v"])

        out = np.zeros(len(points) * size)
        for i, v in features.select("tokens", "posteriors").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v")).collect():
            out[i] = v
        return out.reshape(len(points), size)

    g, done = np.zeros(k), 0
    at = tried(g[None])[0]
    words = max(at[1 : 1 + k].sum(), 1.0)
    ridge = 1e-9 * words
    for done in range(rounds):
        slope = ridge * g - at[1 + k : 1 + 2 * k]
        if np.abs(at[1 + k : 1 + 2 * k]).sum() <= tolerance * words or np.abs(slope).sum() <= 1e-3 * tolerance * words:
            break
        step = -np.linalg.solve(at[1 + 2 * k :].reshape(k, k) + ridge * np.eye(k), slope)
        points = g + lengths[:, None] * step
        results = tried(points)
        values = results[:, 0] + ridge / 2 * np.square(points).sum(1)
        best = int(values.argmin())
        if values[best] >= at[0] + ridge / 2 * g @ g:
            break
        g, at = points[best], results[best]
    return g, at[1 : 1 + k], done


def smoothed_targets(current: np.ndarray, power: float) -> np.ndarray:
    """Weights proportional to a power below one of the current totals: small domains gain."""
    w = np.where(current > 0, np.maximum(current, 1e-12) ** power, 0)
    return w / w.sum() if w.sum() else w


def mixing_rates(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, power: float = 0.7, total: float | None = None, max_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict]:
    """A rate for every document, so that expected domain token totals meet target weights.

    Returns (rows, report). Rows have all columns of ``docs`` but the text, and n_tokens (words), posteriors (in
    the order of report["domains"]) and rate: how often to take the document, 0 or more. ``weights`` by
    domain name default to ``power`` smoothing. Without ``total`` tokens no rate is below one: the rates that meet
    the least total are scaled by one factor, and where one of them may be 0 the rates are fitted
    under that bound (``fit_raised``), which keeps the shares where any such rates have them. A weight for a domain that no labelled document has is an error. Null and empty texts have no tokens; their rate counts for nothing. An empty
    table gives none. Columns with the added names are replaced.
    """
    model = fit_domains(batched(docs), labels, domain, max_rows)
    k = len(model.domains)
    rest = [c for c in docs.columns if c not in ("text", "tokens", "posteriors", "n_tokens", "rate")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def classify(batches):
        begin_task("mixing")
        for batch in batches:
            keep = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest], rest)
            for row, t in steps(texts_of(batch), lower=True):
                part = keep.slice(row, t.n)
                p = pa.FixedSizeListArray.from_arrays(pa.array(model.posteriors(t).ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(t.words.astype(np.int64)), p], [*rest, "tokens", "posteriors"])

    features = materialise(docs.select(*rest, "text").mapInArrow(classify, f"{schema}, tokens long, posteriors array<double>"))
    sums = features.agg(*(F.sum(F.col("tokens") * F.col("posteriors")[i]) for i in range(k))).first()
    current = np.array([x or 0.0 for x in sums])
    if weights is None:
        share = smoothed_targets(current, power)
    else:
        if unknown := sorted(d for d, w in weights.items() if w and d not in model.domains):
            raise ValueError(f"weights for domains that no labelled document has: {', '.join(unknown)}")
        share = np.array([float(weights.get(d, 0.0)) for d in model.domains])
        share = share / share.sum() if share.sum() > 0 else share
    free = total is None
    if free:
        total = float(max((c / w for c, w in zip(current, share) if w > 0), default=0.0))
    targets = share * total
    history, got = fit_rates(features, targets)
    least = float(1 - np.sum(history, 0).max()) if history else 1.0
    scale = 1 / least if free and 0 < least < 1 else 1.0  # one factor for all keeps the shares
    rates, fitted = (lambda p: scale * _fold(p, history, 1.0)), len(history)
    if free and least <= 0:
        raised, got, more = fit_raised(features, share)
        rates, fitted, targets = (lambda p: raised_rates(p, share, raised)), fitted + more, share * got.sum()

    def rated(batches):
        for b in batches:
            p = b.column(b.schema.get_field_index("posteriors")).flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(rates(p), 9))], [*b.schema.names, "rate"])

    rows = features.mapInArrow(rated, f"{schema}, tokens long, posteriors array<double>, rate double").withColumnRenamed("tokens", "n_tokens")
    return rows, {"domains": model.domains, "current": current, "targets": scale * targets, "reached": scale * got, "rounds": fitted}


def take_copies(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as their rates say: the whole part always, one more with the chance of the rest.

    The chance is drawn from a hash of the row, so a repeated run gives the same rows; equal rows are taken alike.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn("_key", key)
    rates, _ = mixing_rates(keyed, labels, **options)
    rates = rates.select("_key", "rate").groupBy("_key").agg(F.max("rate").alias("rate"))
    whole = F.floor("rate")
    more = (F.pmod(F.xxhash64("_key", F.lit(11)), F.lit(1 << 30)) / (1 << 30)) < F.col("rate") - whole
    copies = (whole + more.cast("long")).cast("int")
    return keyed.join(rates, "_key").withColumn("_n", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
