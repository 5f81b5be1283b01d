"""Toxicity (operator 8): gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import batched, begin_task, texts_of

#: Labelled rows that training reads at most, those with the smallest hashed ids.
TRAIN_ROWS = 16_000
#: Words and stems that the learned lexicon keeps at most.
LEXICON_SIZE = 4_000
STEMS = (4, 5, 6)

#: Insults to begin with; the labelled rows add theirs.
SEED_LEXICON = frozenset("idiot moron stupid loser trash scum pathetic worthless disgusting clown dumb jerk fool liar creep freak coward filth vermin garbage".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi vous ton ta vos votre tú ti usted ustedes vosotros vuestro".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”„«»…"
_STRETCHED = regex.compile(r"(.)\1{2,}")
_INSIDE = regex.compile(r"\p{L}[*@$!0-9#]+\p{L}")
_SPELLED = re.compile(rb"[\x80-\xff]{4,}")

#: kinds of a word, as bits
SEED, LEARNED, STEM, YOU, UPPER, OBFUSCATED, STRETCHED, SINGLE = 1, 2, 4, 8, 16, 32, 64, 128
FEATURES = ("seed_density", "learned_density", "stem_density", "any_density", "distinct_hits", "near_you", "you_density", "upper_words", "capitals", "exclamations", "questions", "signs", "obfuscated", "stretched", "spelled", "longest_run", "log_words")


class WordKinds(dict):
    """The bits of a word as written; kept for up to 100,000 words."""

    def __init__(self, learned: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.learned, self.stems = learned, stems

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        low = word.strip(_EDGE).lower()
        out = 0
        if not low.isalpha() and _INSIDE.search(low):
            plain = low.translate(_LEET)
            out |= OBFUSCATED if plain in SEED_LEXICON or plain in self.learned or "*" in low else 0
            low = plain
        if _STRETCHED.search(low):
            short = _STRETCHED.sub(r"\1", low)
            out |= STRETCHED if short in SEED_LEXICON or short in self.learned else 0
            low = short if out & STRETCHED else low
        out |= SEED * (low in SEED_LEXICON) | LEARNED * (low in self.learned) | YOU * (low in SECOND_PERSON)
        out |= STEM * any(low[:k] in self.stems for k in STEMS if len(low) > k)
        out |= UPPER * (len(word) > 2 and word.isupper()) | SINGLE * (len(word) == 1 and word.isalpha())
        self[word] = out
        return out


def lexicon_terms(text: str) -> set[str]:
    """The words of a text in lower case, and as ``stem*`` the first letters of longer ones."""
    words = {w.strip(_EDGE).lower() for w in text.split()}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def learn_lexicon(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int) -> tuple[frozenset[str], frozenset[str]]:
    """Words and stems at least 20 times as frequent in toxic texts, in five of them or more; the clearest first."""
    odds = {w: (n / n_toxic) / ((clean[w] + 0.5) / (n_clean + 1)) for w, n in toxic.items() if n >= max(5, 0.004 * n_toxic)}
    best = sorted((w for w, x in odds.items() if x >= 20), key=lambda w: (-odds[w], w))[:LEXICON_SIZE]
    return frozenset(w for w in best if not w.endswith("*")), frozenset(w[:-1] for w in best if w.endswith("*"))


def features(text: str, kinds: WordKinds) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    codes = bytes(map(kinds.__getitem__, words))
    seen = Counter(codes)
    have = lambda bit: sum(c for k, c in seen.items() if k & bit)
    hits = have(SEED | LEARNED | STEM)
    near = run = 0
    distinct: set[str] = set()
    if hits:
        you = [i for i, k in enumerate(codes) if k & YOU]
        at = [i for i, k in enumerate(codes) if k & (SEED | LEARNED | STEM)]
        distinct = {words[i].strip(_EDGE).lower() for i in at}
        if you:
            place = np.searchsorted(you, at)
            y = np.array([-(10**6), *you, 10**6])
            near = int((np.minimum(np.array(at) - y[place], y[place + 1] - np.array(at)) <= 5).sum())
        gaps = np.diff(at)
        run = 1 + max((len(x) for x in bytes((gaps <= 3).astype(np.uint8)).split(b"\0")), default=0)
    chars = max(1, len(text))
    raw = np.frombuffer(text.encode(), np.uint8)
    capitals = int(np.count_nonzero(raw - np.uint8(65) < 26))
    signs = sum(text.count(c) for c in "*#$%&@~^")
    return [
        1000 * have(SEED) / n, 1000 * have(LEARNED) / n, 1000 * have(STEM) / n, 1000 * hits / n, len(distinct), near, 1000 * have(YOU) / n,
        1000 * have(UPPER) / n, capitals / chars, 1000 * text.count("!") / chars, 1000 * text.count("?") / chars, 1000 * signs / chars,
        1000 * have(OBFUSCATED) / n, 1000 * have(STRETCHED) / n, len(_SPELLED.findall(codes)), run, float(np.log1p(len(words))),
    ]


@dataclass
class Boosted:
    """Trees of the boosted log-odds over binned features, and the isotonic map from log-odds to probability."""

    edges: list[np.ndarray]
    start: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        return self.start + sum((self._tree(bins, t) for t in self.trees), np.zeros(len(x)))

    @staticmethod
    def _tree(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            i = np.flatnonzero(inner)
            at[i] = 2 * at[i] + 1 + (bins[i, feature[at[i]]] > cut[at[i]])
        return value[at]

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        # A little of the uncalibrated order stays, so that equal steps of the map keep a ranking.
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-raw)), 0, 1)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, leaf: float = 5.0) -> Boosted:
    """Second-order boosting of the logistic loss over at most 64 bins a feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(p / (1 - p))), [])
    score, size = np.full(len(y), model.start), 2 ** (depth + 1) - 1
    for _ in range(rounds if len(y) else 0):
        prob = 1 / (1 + np.exp(-score))
        g, h = y - prob, prob * (1 - prob)
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = rate * gs / (hs + leaf)
            if node >= 2**depth - 1:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                gl = np.cumsum(np.bincount(bins[rows, j], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, j], h[rows], len(e) + 1))[:-1]
                if len(gl):
                    gain = gl**2 / (hl + leaf) + (gs - gl) ** 2 / (hs - hl + leaf) - gs**2 / (hs + leaf)
                    gain[(hl < 1e-3) | (hs - hl < 1e-3)] = 0
                    k = int(gain.argmax())
                    best = max(best, (float(gain[k]), j, k))
            if best[1] >= 0:
                _, feature[node], cut[node] = best
                right = bins[rows, best[1]] > best[2]
                at[rows] = 2 * node + 1 + right
        model.trees.append((feature, cut, value))
        score += Boosted._tree(bins, model.trees[-1])
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit of 0/1 labels by pooling adjacent violators: knots and values.

    Each block's mean is drawn a little to the overall one, so no block of few rows claims certainty.
    """
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, sum of raw
    for r, v in zip(raw[order], y[order]):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    mean = y.mean()
    return np.array([t / n for _, n, t in blocks]), np.array([(s + mean) / (n + 1) for s, n, _ in blocks])


@dataclass
class ToxicityModel:
    learned: frozenset[str]
    stems: frozenset[str]
    boosted: Boosted


def held_out(doc_id) -> bool:
    """Rows that no training sees: crc32 of the id's digits is 1 modulo 3. Null ids are not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def _part(doc_id) -> int:
    """Which of the three parts of the labelled rows a document is in."""
    return zlib.crc32(f"part {doc_id}".encode()) % 3


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, those of the smallest hashed ids, never on held-out ones.

    By the id's hash the rows are in three parts: the lexicon is learned on one, the trees on
    another and the calibration on the third. Labels whose document is missing, null labels and null ids
    are left out; of repeated ids the highest label and one text count. Without toxic rows every score is low.
    """
    want = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    want = want.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    want = want.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = batched(docs).select("doc_id", "text").join(F.broadcast(want), "doc_id")

    def terms(batches):
        part: dict[str, list[int]] = {}
        n = [0, 0]
        for batch in batches:
            for i, text, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if _part(i) == 0:
                    n[toxic] += 1
                    for w in lexicon_terms(text or ""):
                        part.setdefault(w, [0, 0])[toxic] += 1
        part["\0n"] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(part), pa.string()), pa.array([v[0] for v in part.values()], pa.int64()), pa.array([v[1] for v in part.values()], pa.int64())], ["term", "clean", "toxic"])

    counts = rows.mapInArrow(terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Terms of fewer than five toxic texts, or as frequent in clean ones, are never in the lexicon.
    found = counts.where("term = '\\0n' or (toxic >= 5 and clean * 2 <= toxic)").orderBy(F.desc("toxic"), "term").limit(20 * LEXICON_SIZE).collect()
    total = next((r for r in found if r["term"] == "\0n"), None) or next(iter(counts.where("term = '\\0n'").collect()), None)
    n_clean, n_toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    learned, stems = learn_lexicon(Counter({r["term"]: r["toxic"] for r in found if r["term"] != "\0n"}), Counter({r["term"]: r["clean"] for r in found}), max(1, n_toxic), max(1, n_clean))

    def dense(batches):
        kinds = WordKinds(learned, stems)
        for batch in batches:
            ids, texts, toxic = (batch.column(k).to_pylist() for k in range(3))
            keep = [i for i, d in enumerate(ids) if _part(d)]
            x = [features(texts[i] or "", kinds) for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array([_part(ids[i]) for i in keep], pa.int32()), pa.array([toxic[i] for i in keep], pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["part", "toxic", "x"])

    table = rows.mapInArrow(dense, "part int, toxic int, x array<double>").toArrow()
    part, y = table.column("part").to_numpy(), table.column("toxic").to_numpy().astype(float)
    x = np.array(table.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, part))  # the fit does not depend on the order of the rows
    part, y, x = part[order], y[order], x[order]
    boosted = fit_trees(x[part == 1], y[part == 1])
    if (part == 2).any():
        boosted.knots = isotonic(boosted.raw(x[part == 2]), y[part == 2])
    return ToxicityModel(learned, stems, boosted)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = TRAIN_ROWS, model: ToxicityModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every whole text.

    The score depends on the text alone. Null and empty texts get the score of a text without
    words. Repeated rows get equal scores; null ids are scored too. Other columns are left out,
    or with ``keep`` these columns come before the three new ones.
    """
    model = model or fit_toxicity(docs, labels, max_rows)
    keep = keep or ["doc_id"]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    read = list(dict.fromkeys(["doc_id", "text", *keep]))

    def run(batches):
        begin_task("toxicity")
        kinds = WordKinds(model.learned, model.stems)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            if not batch.num_rows:
                continue
            x = np.array([features(t or "", kinds) for t in texts_of(batch).to_pylist()])
            score = model.boosted.probability(x)
            out = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array([held_out(i) for i in ids.to_pylist()]), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "held_out", "score", "predicted"])

    return batched(docs.select(*read)).mapInArrow(run, schema)
