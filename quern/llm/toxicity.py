"""Toxicity: a subsequence-kernel SVM over Nystroem landmarks, trained on labelled sentences, so gapped and padded insults still match.

The kernel compares two units (words as typed, or runs of lone letters) by their shared gapped subsequences of 3 and 4
symbols, each weighing DECAY to the power of the span it takes, up to SPAN symbols; it is divided by the norms that
strings of those lengths with distinct subsequences have. A sentence's image is that of its worst unit, its Nystroem
features the kernel values with landmark strings. As the SVM is linear in these, it collapses to one weight a
subsequence, which is what workers evaluate: exactly the SVM's value, at the cost of a table look-up a subsequence.

Labels are of documents, and most sentences of a toxic one are clean. Toxic examples are therefore its sentences that
hold a string which comes far more often in sentences of toxic documents, and such sentences with a letter put into that
word; clean examples are sentences of clean documents, first with a unit drawn by hash for their worst, then, in rounds,
with the unit that the SVM takes for the worst. A document is judged, by a logistic fit, on the values of its TOP worst
sentences, on how many are above 0, and on the log of their number: among many sentences one looks toxic by chance.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, col, fresh, spread, table, written

FOLDS, HELD = 5, 0
DECAY, SPAN = 0.75, 6
#: Bounds of what is learned from: labelled documents a class, and of them toxic and clean examples and landmarks that reach the driver.
DOCS, CANDIDATES, NEGATIVES, LANDMARKS = 3000, 400, 6000, 160
#: log-likelihood ratio of a string's share of toxic sentences, and how often the base rate its share must be, to mark a sentence; where no string reaches that, the first MARKS do
EVIDENCE, TIMES, MARKS = 28.0, 8, 40
#: rounds of training; words of a sentence at most, longer ones count as several
ROUNDS, WIDEST = 3, 48
CACHE = 120_000
SAMPLE_PARTS = 16
BASE = 32
#: sentences of a document that count, and the value below which one counts as clean
TOP, FLOOR = 4, -0.6
#: a clean document taken for a toxic one costs so many times the other error
CLEAN_COST = 3.0
OFFSETS = [(0, *c) for n in (2, 3) for c in combinations(range(1, SPAN), n)]
PUNCTUATION = ".,;:?\"'()"
MARKS_BESIDE = PUNCTUATION + "!*-_~|/+="  # what may stand beside a lone letter
LEET = str.maketrans("013457@$!|", "oieastasil")


def _symbol(c: str) -> int:
    """1 to 26: a Latin letter, marked or not; 27 to 30: digits and what isn't a letter; letters of other scripts: by their code points over 1 to 26, so that words of these can be told apart as well."""
    if "a" <= c <= "z":
        return ord(c) - 96
    base = unicodedata.normalize("NFD", c)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    return 1 + ord(base) % 26 if base.isalpha() else 27 + ord(c) % 4


SYMBOLS = np.fromiter((_symbol(chr(i)) for i in range(0x3000)), dtype=np.uint8, count=0x3000)
SYMBOLS = np.concatenate([SYMBOLS, (1 + np.arange(0x3000, 0x110000) % 26).astype(np.uint8)])


def encode(units: list[str]) -> np.ndarray:
    """Symbols 1 to 30 of each unit after a 31 that stands for its start; 0 pads, SPAN - 1 of them at least."""
    n = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
    out = np.zeros((len(units), int(n.max(initial=0)) + SPAN), dtype=np.int32)
    out[:, 0] = 31
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out[np.repeat(np.arange(len(units)), n), np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n) + 1] = SYMBOLS[points]
    return out


def _weights(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each offset pattern the subsequences' numbers (3 symbols first, then 4), where they exist, and their weight."""
    n = codes.shape[1] - SPAN + 1
    for o in OFFSETS:
        cols = [codes[:, i : i + n] for i in o]
        f = cols[0].copy()
        for c in cols[1:]:
            f *= BASE
            f += c
        if len(o) == 4:
            f += BASE**3
        yield f, (cols[-1] > 0) & (cols[0] > 0), DECAY ** (o[-1] + 1)


def norms(lengths: np.ndarray) -> np.ndarray:
    """Of strings of these lengths (their start symbol included) whose subsequences are all distinct."""
    total = np.zeros(len(lengths))
    for o in OFFSETS:
        total += np.maximum(lengths - o[-1], 0) * DECAY ** (2 * (o[-1] + 1))
    return np.sqrt(np.maximum(total, 1e-12))


def features(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, subsequence, value), one entry for each that a unit has, by unit."""
    codes = encode(units)
    rows, feats, vals = [], [], []
    for f, there, w in _weights(codes):
        r, _ = np.nonzero(there)
        rows.append(r)
        feats.append(f[there])
        vals.append(np.full(len(r), w))
    if not rows:
        return np.array([], int), np.array([], int), np.array([])
    r, f, v = np.concatenate(rows), np.concatenate(feats).astype(np.int64), np.concatenate(vals)
    key, inv = np.unique(r.astype(np.int64) * (BASE**3 + BASE**4) + f, return_inverse=True)
    v = np.bincount(inv, weights=v)
    r, f = key // (BASE**3 + BASE**4), key % (BASE**3 + BASE**4)
    n = norms((codes > 0).sum(axis=1))
    return r, f, v / n[r]


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    r2, f2, v2 = features(landmarks)
    known = np.unique(f2)
    m = np.zeros((len(known), len(landmarks)))
    m[np.searchsorted(known, f2), r2] = v2
    r1, f1, v1 = features(units)
    at = np.minimum(np.searchsorted(known, f1), max(len(known) - 1, 0))
    hit = known[at] == f1 if len(known) else np.zeros(len(f1), bool)
    r1, at, v1 = r1[hit], at[hit], v1[hit]
    out = np.zeros((len(units), len(landmarks)))
    for i in range(0, len(r1), 50_000):
        np.add.at(out, r1[i : i + 50_000], m[at[i : i + 50_000]] * v1[i : i + 50_000, None])
    return out


def train(positive: list[str], negative: list[str], landmarks: list[str], cost: float = 10.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Squared-hinge linear SVM on the Nystroem features of sentences, given by their images, by Newton steps: (subsequences, their weights, bias)."""
    k_mm = kernel(landmarks, landmarks)
    val, vec = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])
    x = np.hstack([kernel(positive + negative, landmarks) @ root, np.ones((len(positive) + len(negative), 1))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    c = np.where(y > 0, cost * len(y) / (2 * len(positive)), cost * len(y) / (2 * len(negative))) / len(y) * 100
    w = np.zeros(x.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-3
    def loss(v):
        return v @ reg @ v / 2 + (c * np.maximum(1 - y * (x @ v), 0) ** 2).sum()
    for _ in range(30):
        m = 1 - y * (x @ w)
        on = m > 0
        g = reg @ w - 2 * x[on].T @ (c[on] * y[on] * m[on])
        step = np.linalg.solve(reg + 2 * (x[on] * c[on, None]).T @ x[on], g)
        s = 1.0
        while s > 1e-4 and loss(w - s * step) > loss(w):
            s /= 2
        w = w - s * step
        if np.abs(s * step).max() < 1e-7:
            break
    beta = root @ w[:-1]
    r, f, v = features(landmarks)
    feats, inv = np.unique(f, return_inverse=True)
    return feats, np.bincount(inv, weights=v * beta[r]), float(w[-1])


class Scorer:
    def __init__(self, feats: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(BASE**3 + BASE**4, dtype=np.float32)
        self.table[feats] = weights
        self.bias, self.known = bias, {}

    def units(self, units: list[str]) -> np.ndarray:
        """The SVM's values of sentences of one unit each; a sentence's is that of its worst."""
        out = np.empty(len(units))
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        at = 0
        while at < len(order):  # units of like lengths together, so padding and memory stay small
            width = max(len(units[order[at]]) * 5 // 4, 16)
            to = at
            while to < len(order) and to - at < max(1, 400_000 // (width + 1)) and len(units[order[to]]) <= width:
                to += 1
            part = order[at : max(to, at + 1)]
            codes = encode([units[i] for i in part])
            total = np.zeros(len(part))
            for f, _, w in _weights(codes):  # no subsequence that runs into the padding has a weight
                total += self.table.take(f).sum(axis=1) * w
            out[part] = total / norms((codes > 0).sum(axis=1)) + self.bias
            at += len(part)
        return out

    def words(self, words: set[str]) -> dict[str, float]:
        """The values of all words kept so far, these among them: of each its worst unit's; words without one: minus infinity."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(words - self.known.keys())
        if new:
            parts, owner = [], []
            for i, t in enumerate(new):
                for u in units_of(t):
                    parts.append(u)
                    owner.append(i)
            worst = np.full(len(new), -np.inf)
            if parts:
                np.maximum.at(worst, owner, self.units(parts))
            self.known.update(zip(new, worst.tolist()))
        return self.known

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: the values of its TOP worst sentences, worst first, the number above 0, and the log of the number of different words; sentences of the same worst word count once."""
        said = [sentences(t) for t in texts]
        own = [{w for s in ss for w in s} for ss in said]
        known = self.words(set().union(*own))
        out = np.full((len(texts), TOP + 2), FLOOR)
        for row, ss, words in zip(out, said, own):
            worst = sorted((known[w] for w in {max(s, key=known.__getitem__) for s in ss if s} if known[w] > FLOOR), reverse=True)
            row[: min(TOP, len(worst))] = worst[:TOP]
            row[TOP], row[TOP + 1] = min(sum(v > 0 for v in worst), 2 * TOP), math.log1p(len(words))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias, of a ridge logistic fit in which both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    c[y == 0] *= CLEAN_COST
    w, reg = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(reg + (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x, reg @ w + x.T @ (c * (p - y)))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


END = re.compile(r"(?<=\w\w)[.!?]+\s|\n")


def sentences(text: str | None, widest: int = WIDEST) -> list[list[str]]:
    """The words of each sentence in lower case, runs of three or more lone letters joined to one; sentences end at . ! ? behind a word of two letters, and at newlines."""
    out = []
    for s in END.split((text or "").lower()):
        words = s.split()
        lone = [i for i, w in enumerate(words) if len(w) < 4 and len(w.strip(MARKS_BESIDE)) == 1]
        if len(lone) > 2:
            for i, j in reversed(list(pairwise([k for k in range(len(lone) + 1) if not 0 < k < len(lone) or lone[k] != lone[k - 1] + 1]))):
                if j - i > 2:
                    words[lone[i] : lone[j - 1] + 1] = ["".join(w.strip(MARKS_BESIDE) for w in words[lone[i] : lone[j - 1] + 1])]
        out += [words[i : i + widest] for i in range(0, len(words), widest)]
    return out


def units_of(token: str) -> list[str]:
    """What of a token is scored: its letters and digits without what lies between, digits read as letters too, and its parts."""
    if token.isalpha() or (token := token.strip(PUNCTUATION)).isalpha():
        return [token]
    parts = re.split(r"[\W_]+", token)
    whole = "".join(parts)
    out = {whole, *(p for p in parts if len(p) > 3)}
    out |= {"".join(filter(str.isalpha, token.translate(LEET)))} if not whole.isalpha() or any(c in token for c in "@$!|") else set()
    return sorted(u for u in out if u)


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(string, sentences of toxic documents that hold it, and of others): units, and their first 4 to 6 letters; the empty string: all sentences."""
    for pdf in batches:
        count: dict = {}
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            for s in sentences(text):
                seen = {""}
                for u in {u for t in s for u in units_of(t)}:
                    seen.add(u)
                    seen.update(u[:n] for n in (4, 5, 6) if n < len(u))
                for k in seen:
                    count.setdefault(k, [0, 0])[1 - toxic] += 1
        if count:
            yield pd.DataFrame([(k, v[0], v[1]) for k, v in count.items()], columns=["s", "a", "b"])


def _images(marks: dict[str, float]):
    """(unit, toxic): of each sentence of a toxic document that holds a mark the unit with the most evidence; of each clean one a unit drawn by hash."""

    def evidence(u: str) -> float:
        return max(marks.get(x, 0.0) for x in (u, u[:4], u[:5], u[:6]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                for s in sentences(text):
                    units = sorted({u for w in s for u in units_of(w)})
                    if units and not toxic:
                        out.append((min(units, key=lambda u: hashlib.md5(f"{len(units)} {u}".encode("utf-8", "surrogatepass")).digest()), 0))
                    elif units and evidence(u := max(units, key=evidence)):
                        out.append((u, 1))
            yield pd.DataFrame(out, columns=["s", "toxic"]).astype({"toxic": int})

    return run


def _hard(model: dict, key: str):
    """(unit, value) of the words above FLOOR in the sentences of clean documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = scorer(key, model)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                said = sentences(text)
                known = scores.words({w for s in said for w in s})
                out += [(u, known[w]) for w in {w for s in said for w in s} if known[w] > FLOOR for u in units_of(w)]
            yield pd.DataFrame(out, columns=["s", "v"]).astype({"v": float})

    return run


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD, n_docs: int = DOCS, min_evidence: float = EVIDENCE) -> dict | None:
    """The model, or None without labelled documents of both classes that have a sentence.

    At most n_docs labelled documents a class are read, first by a hash of their id; only their ids are broadcast. What
    reaches the driver is bounded by CANDIDATES, NEGATIVES and LANDMARKS. A document labelled both ways is toxic. Null
    labels, ids and texts, and labels of unknown documents, don't count; of rows that repeat an id one is read.
    """
    lab = labels.where(col("toxic").isNotNull() & (bucket(col(id_col), folds) != held)).groupBy(col(id_col).alias("id")).agg(F.max(col("toxic")).cast("int").alias("toxic"))
    lab = written(lab, "labels")
    taken = [(r["id"], r["toxic"]) for t in (0, 1) for r in first_by_hash(lab.where(F.col("toxic") == t), n_docs)]
    if len({t for _, t in taken}) < 2:
        return None
    spark = docs.sparkSession
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    ids = F.broadcast(spark.createDataFrame(taken, f"id {kind}, toxic int"))  # 2 * n_docs rows
    sample = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text")).join(ids, "id").dropDuplicates(["id"]).select("text", "toxic")
    sample = written(sample.repartition(SAMPLE_PARTS), "labelled")
    counts = written(sample.mapInPandas(_strings, "s string, a long, b long").groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    total = counts.where("s = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return None
    n_a, n_b = total["a"], total["b"]
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), F.col("a") + F.col("b")
    g = 2 * (a * F.log(a * (n_a + n_b) / (n * n_a)) + F.when(b > 0, b * F.log(b * (n_a + n_b) / (n * n_b))).otherwise(0))
    words = counts.where("s <> ''").withColumn("g", F.when(F.col("a") > 0, g).otherwise(0.0)).withColumn("marks", a * n_b > TIMES * b * n_a)
    first = words.where("marks").orderBy(F.desc("g"), F.length("s").desc(), "s").limit(CANDIDATES).collect()
    marks = {r["s"]: r["g"] for i, r in enumerate(first) if r["g"] >= min_evidence} or {r["s"]: r["g"] for r in first[:MARKS]}
    if not marks:
        return None
    images = written(sample.mapInPandas(_images(marks), "s string, toxic int").groupBy("s").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "images")
    insults = [r["s"] for r in images.where("toxic > 0").join(words.where("marks").select("s"), "s").orderBy(F.desc("toxic"), "s").limit(CANDIDATES).collect()]
    if not insults:
        return None
    known = set(insults)
    whole = [m for m in marks if m in known]
    starts = [m for m in marks if m not in known and not any(w.startswith(m) and len(w) - len(m) <= 6 for w in whole)]
    starts = [m for m in starts if not any(m != x and m.startswith(x) for x in starts)]
    clean = images.where("clean > 0")
    negative = {r["s"] for r in clean.orderBy(F.xxhash64("s"), "s").limit(NEGATIVES).collect()}
    negative |= {r["s"] for r in clean.orderBy(F.desc("clean"), "s").limit(NEGATIVES // 4).collect()}
    negative -= known
    if not negative:
        return None
    positive = [*insults, *starts]
    for u in [*whole, *starts]:
        for i in range(1, len(u)):
            positive += [u[:i] + u[i] + u[i:], u[:i] + "xqjz"[i % 4] + u[i:]]
    order = lambda u: hashlib.md5(u.encode("utf-8", "surrogatepass")).digest()
    lead = [*starts, *whole, *sorted(insults, key=order)]
    hard: list[str] = []
    for i in range(ROUNDS):  # what the SVM takes for toxic in clean sentences joins their images, and lends landmarks
        landmarks = list(dict.fromkeys(lead[: LANDMARKS // 2] + hard[: LANDMARKS // 4] + sorted(negative, key=order)))[:LANDMARKS]
        feats, weights, bias = train(positive, sorted(negative), landmarks)
        model = {"feats": feats, "weights": weights, "bias": bias}
        if i + 1 < ROUNDS:
            found = sample.where("toxic = 0").mapInPandas(_hard(model, key_of(model)), "s string, v double").groupBy("s").agg(F.max("v").alias("v"))
            hard = [r["s"] for r in found.orderBy(F.desc("v"), "s").limit(NEGATIVES // 4).collect() if r["s"] not in known]
            if not set(hard) - negative:
                break
            negative |= set(hard)
    seen = features_of(sample, model).select("toxic", "units").collect()
    model["logistic"] = logistic(np.array([r["units"] for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    return model


def first_by_hash(ids: DataFrame, n: int) -> list:
    """The n rows first by a hash of their id. Only rows below a hash that about 4 * n of them have are sorted, so partitions send few each."""
    total, share = ids.count(), 4.0
    while True:
        f = min(1.0, share * n / max(total, 1))
        below = F.xxhash64("id") <= F.lit(int(-(1 << 63) + f * ((1 << 64) - 4096)) if f < 1 else (1 << 63) - 1)
        out = ids.where(below).orderBy(F.xxhash64("id"), "id").limit(n).collect()
        if len(out) >= min(n, total) or f == 1:
            return out
        share *= 4


def key_of(model: dict) -> str:
    return hashlib.md5(model["weights"].tobytes() + model["feats"].tobytes()).hexdigest()


_SCORERS: dict = {}


def scorer(key: str, model: dict) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model["feats"], model["weights"], model["bias"])
    return _SCORERS[key]


def features_of(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs and units, the values of each text's worst sentences (under a free name if that is taken)."""
    key = key_of(model)

    @F.pandas_udf("array<double>")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scorer(key, model)
        for texts in batches:
            texts, out = texts.tolist(), []
            for i in range(0, len(texts), 200):
                out += list(s.documents(texts[i : i + 200]))
            yield pd.Series(out, dtype="object")

    (units,) = fresh(docs, "units")
    return docs.withColumn(units, worst(col(text_col)))


def score(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and score in [0, 1] and predicted (under free names if those are taken).

    Null texts and texts without a word are scored as ones without an insult. Without a model: 0. Long texts are
    scored whole, repeated rows alike; no rows: no rows.
    """
    s, predicted = fresh(docs, "score", "predicted")
    if model is None:
        return docs.withColumn(s, F.lit(0.0)).withColumn(predicted, F.lit(0))
    out = features_of(docs, model, text_col)
    units, w = col(out.columns[-1]), [float(v) for v in model["logistic"]]
    z = sum((units[i] * F.lit(v) for i, v in enumerate(w[:-1])), F.lit(w[-1]))
    return out.withColumn(s, 1 / (1 + F.exp(-z))).withColumn(predicted, (col(s) >= 0.5).cast("int")).select(*[col(c) for c in docs.columns], col(s), col(predicted))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(bucket(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")
