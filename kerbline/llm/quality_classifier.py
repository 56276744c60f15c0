"""Quality classifier by co-training of two views.

One logistic classifier sees only the text: what it looks like, and its words by
hashed buckets.  Another sees only the page's metadata: source, language and
stated length, and how they cross.  Both start from the labelled rows.  In each
round both score every unlabelled document; each passes the share that it is
surest of to the other as pseudo-labels, a larger share from round to round,
while labelled rows left out of its fit bear such labels out.  The two log-odds
are then calibrated and combined on labelled rows left out of the fits in turn,
and all documents are scored.

Rounds read stored features of all unlabelled documents; thresholds come from
counts by score.  What a fit holds is a bounded sample of labelled rows, in a
fixed order by hash: at most ``max_labels`` labelled ones and ``max_pseudo``
pseudo-labelled ones of those that a view passes.

Null labels are left out; a document labelled twice counts twice.  With labels
of one class only, or none, there is nothing to learn and every document is kept
with that class's share (1.0 without labels).  Null or empty texts have all-zero
text features; very long ones are read whole.  Repeated rows are scored alike.
An empty table gives an empty one.  Extra columns pass unchanged whatever their
names; one named as the result is replaced.  Equal scores are passed on in the
order of the id's hash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from kerbline.llm.arrow import bound_batches, texts
from kerbline.plans.scratch import Scratch

UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
LETTER = UPPER + bytes(range(97, 123))
SPACE = b" \t\n\x0b\x0c\r"
SYMBOL = b"#*$%&|<>{}[]=\\^~_@"
WORDS = 64  # buckets of hashed words
N_LOOK = 17
N_TEXT = N_LOOK + WORDS
N_META = 2 + 32 + 8 + 64
#: Bins of equal width that scores are counted in.
BINS = 2000


def text_features(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * N_TEXT
    count = lambda chars: size - len(data.translate(None, chars))
    seen = Counter(words)
    letters, upper = count(LETTER), count(UPPER)
    lines = [x for x in data.split(b"\n") if x.strip()]
    black = size - count(SPACE)
    buckets = [0.0] * WORDS
    for w, k in seen.items():
        buckets[zlib.crc32(w) % WORDS] += k / n
    return [
        np.log1p(n),
        black / n,
        upper / max(1, letters),
        letters / size,
        count(DIGIT) / size,
        count(SYMBOL) / black,
        data.count(b"!") / n,
        data.count(b"|") / n,
        data.count(b".") / n,
        data.count(b",") / n,
        len(seen) / n,
        max(seen.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        (size - len(text)) / size,
        max(map(len, words)) / (20 + max(map(len, words))),
        *(b**0.5 for b in buckets),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[float]:
    out = [0.0] * N_META
    out[0] = float(np.log1p(max(0, n_chars or 0)))
    out[1] = float(n_chars is None)
    out[2 + zlib.crc32((source or "").encode()) % 32] = 1.0
    out[34 + zlib.crc32((lang or "").encode()) % 8] = 1.0
    crossed = f"{source or ''}\t{lang or ''}\t{int(max(0, n_chars or 0)).bit_length() // 2}"
    out[42 + zlib.crc32(crossed.encode()) % 64] = 1.0
    return out


@dataclass(frozen=True)
class Logistic:
    """Standardised features, L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 0.1, rounds: int = 30) -> Logistic:
    """Newton steps on the penalised likelihood; the intercept is not penalised."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, sw = np.zeros(z.shape[1]), np.ones(len(x)) if weight is None else weight
    penalty = np.full(len(w), l2)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (sw * (p - y)) + penalty * w
        hess = (z * (sw * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


@dataclass(frozen=True)
class CoTrained:
    """Both views' classifiers and the calibrated combination of their log-odds; ``constant`` where there was nothing to learn."""

    text: Logistic | None = None
    meta: Logistic | None = None
    combine: Logistic | None = None
    constant: float = 1.0
    passed: tuple[tuple[int, int], ...] = ()

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, combined; all as probabilities."""
        if self.combine is None:
            return np.full((len(text), 3), self.constant)
        a, b = self.text.logit(text), self.meta.logit(meta)
        return 1 / (1 + np.exp(-np.column_stack([a, b, self.combine.logit(np.column_stack([a, b]))])))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _at_least(k: int, n: int, z: float = 1.96) -> float:
    """Lower end of the Wilson interval of k out of n."""
    if not n:
        return 0.0
    p = k / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


class ArrayPool:
    """Unlabelled rows in memory; ``counts`` and ``take`` are all that co-training asks of a pool."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = (text, meta)

    def counts(self, models: list[Logistic]) -> list[np.ndarray]:
        """Rows by bin of each view's score."""
        return [np.bincount(bin_of(_sigmoid(m.logit(x))), minlength=BINS) for m, x in zip(models, self.views, strict=True)]

    def take(self, models: list[Logistic], asked: list[list[tuple[int, int, int, int]]]) -> list[list[np.ndarray]]:
        """Per view and (lowest bin, highest bin, rows wanted, rows there): the other view's features of the wanted rows at most, in the pool's order."""
        out = []
        for k, (model, x) in enumerate(zip(models, self.views, strict=True)):
            at = bin_of(_sigmoid(model.logit(x)))
            out.append([self.views[1 - k][(at >= lo) & (at <= hi)][:n] for lo, hi, n, _ in asked[k]])
        return out


def bin_of(p: np.ndarray) -> np.ndarray:
    return np.minimum((p * BINS).astype(int), BINS - 1)


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool, rounds: int = 4, share: float = 0.1,
    max_pseudo: int = 2000, pseudo_weight: float = 0.2, trust: float = 0.8, folds: int = 5,
) -> CoTrained:
    """Fit on labelled rows (in their fixed order) and a pool of unlabelled ones.

    In round r a view passes the r * ``share`` of the pool that it is surest of,
    each class in the labelled rows' proportion.  It passes a class only while,
    of labelled rows left out of its fit, fold by fold, at least a share
    ``trust`` of those it is as sure of have that class, at 95 % certainty; all
    of a bin of scores count or none.  The combination is fitted on the left-out
    rows' log-odds too.
    """
    if len(y) == 0 or y.min() == y.max():
        return CoTrained(constant=float(y.mean()) if len(y) else 1.0)
    fold = np.zeros(len(y), int)
    for label in (0, 1):  # each class spread over all folds
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % folds
    views = (text, meta)
    extra = [(np.zeros((0, x.shape[1])), np.zeros(0)) for x in views]  # features and pseudo-labels that each view was given

    def fit(k: int, rows: np.ndarray) -> Logistic:
        given, labels = extra[k]
        weight = np.r_[np.ones(len(rows)), np.full(len(given), pseudo_weight)]
        return fit_logistic(np.r_[views[k][rows], given], np.r_[y[rows], labels], weight)

    def left_out(k: int) -> np.ndarray:
        """Each labelled row's log-odds by a fit without its fold."""
        out = np.zeros(len(y))
        for f in range(folds):
            rest = np.flatnonzero(fold != f)
            if (fold == f).any() and len(set(y[rest])) == 2:
                out[fold == f] = fit(k, rest).logit(views[k][fold == f])
        return out

    every = np.arange(len(y))
    passed = []
    for turn in range(1, rounds + 1):
        models = [fit(k, every) for k in range(2)]
        asked, labels = [], []
        for k, counts in enumerate(pool.counts(models)):
            check = bin_of(_sigmoid(left_out(k)))
            want = min(1.0, turn * share) * counts.sum()
            spans = []
            for label, part in ((1, y.mean()), (0, 1 - y.mean())):
                # bins from the surest on, while they hold what is wanted and on their class's side
                order = np.arange(BINS - 1, BINS // 2 - 1, -1) if label else np.arange(BINS // 2)
                reach = np.cumsum(counts[order])
                edge = order[min(np.searchsorted(reach, max(1.0, want * part)), len(order) - 1)]
                lo, hi = (edge, BINS - 1) if label else (0, edge)
                claimed = (check >= lo) & (check <= hi)
                if reach[-1] and _at_least(int((y[claimed] == label).sum()), int(claimed.sum())) >= trust:
                    spans.append((int(lo), int(hi), int(round(max_pseudo * part)), int(counts[lo : hi + 1].sum()), label))
            asked.append([x[:4] for x in spans])
            labels.append([x[4] for x in spans])
        for k, found in enumerate(pool.take(models, asked)):
            extra[1 - k] = (np.concatenate([np.zeros((0, views[1 - k].shape[1])), *found]), np.concatenate([np.zeros(0), *(np.full(len(x), float(c)) for x, c in zip(found, labels[k], strict=True))]))
        passed.append((len(extra[1][1]), len(extra[0][1])))
        if not any(passed[-1]):
            break
    combine = fit_logistic(np.column_stack([left_out(0), left_out(1)]), y)
    return CoTrained(fit(0, every), fit(1, every), combine, passed=tuple(passed))


def _batch(x: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features from stored text features and metadata columns."""
    meta = [meta_features(*r) for r in zip(source.to_pylist(), lang.to_pylist(), n_chars.to_pylist(), strict=True)]
    return np.array(x.to_pylist(), float).reshape(-1, N_TEXT), np.array(meta, float).reshape(-1, N_META)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def looks(text: pa.Array) -> pa.Array:
    """text -> the text view's features."""
    return pa.array([text_features(t) for t in texts(text)], pa.list_(pa.float32()))


def _bins(models: list[Logistic]):
    """Stored features -> the bin of each view's score."""

    @F.arrow_udf(T._parse_datatype_string("text int, meta int"))
    def apply(x: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        found = [bin_of(_sigmoid(m.logit(v))) for m, v in zip(models, _batch(x, source, lang, n_chars), strict=True)]
        return pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in found], names=["text", "meta"])

    return apply


class TablePool:
    """Unlabelled documents with stored text features: (id, x, source, lang, n_chars)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _scored(self, models: list[Logistic]) -> DataFrame:
        return self.table.withColumn("bin", _bins(models)("x", "source", "lang", "n_chars"))

    def counts(self, models: list[Logistic]) -> list[np.ndarray]:
        each = self._scored(models).select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("bin.text").alias("b")), F.struct(F.lit(1).alias("k"), F.col("bin.meta").alias("b")))).alias("s"))
        out = [np.zeros(BINS, int) for _ in range(2)]
        for r in each.groupBy("s.k", "s.b").count().collect():  # at most two rows for each bin
            out[r.k][r.b] = r["count"]
        return out

    def take(self, models: list[Logistic], asked: list[list[tuple[int, int, int, int]]]) -> list[list[np.ndarray]]:
        """In one pass: ids' hashes below a bound that some more than the wanted rows have are brought, in order, and cut to what is wanted."""
        spans = [(k, *x) for k in range(2) for x in asked[k]]
        out: list[list[np.ndarray]] = [[], []]
        if not spans:
            return out

        def bring(spare: float) -> pa.Table:
            def meets(k: int, lo: int, hi: int, n: int, have: int) -> Column:
                most = min(2**63 - 1, -(2**63) + int(min(1.0, (spare * n + 100) / max(1, have)) * 2**64))
                return F.col(f"bin.{('text', 'meta')[k]}").between(lo, hi) & (F.col("h") <= F.lit(most))

            scored = self._scored(models).withColumn("h", F.xxhash64("id")).withColumn("in", F.array(*(meets(*x) for x in spans)))
            rows = scored.where(F.array_contains("in", True)).orderBy("h", "id").limit(int(2 * sum(spare * x[3] + 100 for x in spans)))  # a few times max_pseudo rows
            return rows.select("x", "source", "lang", "n_chars", "in").toArrow()

        for spare in (1.3, 4.0):
            rows = bring(spare)
            inside = np.array(rows["in"].to_pylist(), bool).reshape(-1, len(spans))
            if all(inside[:, i].sum() >= min(n, have) for i, (_, _, _, n, have) in enumerate(spans)):
                break
        both = _batch(*(rows[c].combine_chunks() for c in ("x", "source", "lang", "n_chars")))
        for i, (k, _, _, n, _) in enumerate(spans):
            out[k].append(both[1 - k][inside[:, i]][:n])
        return out


def _scores(model: CoTrained):
    """(text, source, lang, n_chars) -> scores."""

    @F.arrow_udf(T._parse_datatype_string("p_text double, p_meta double, score double"))
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, source, lang, n_chars in batches:
            # rounded as stored features are
            x = pa.array([text_features(t) for t in texts(text)], pa.list_(pa.float32()))
            p = model.score(*_batch(x, source, lang, n_chars))
            yield pa.StructArray.from_arrays([pa.array(p[:, k], pa.float64()) for k in range(3)], names=["p_text", "p_meta", "score"])

    return apply


def _inputs() -> list:
    return [F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, label_col: str = "quality", max_labels: int = 6000, **options) -> CoTrained:
    """Co-train on at most ``max_labels`` labelled documents and all others; the order by hash makes the sample the same in every run."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y in (0.0, 1.0)")
    names = ("text", "source", "lang", "n_chars")
    pure = docs.select(F.col("doc_id").alias("id"), *(c.alias(n) for c, n in zip(_inputs(), names, strict=True)))
    order = [F.xxhash64("id"), "id", "y"]
    taught = known.join(pure.select("id").distinct(), "id", "left_semi").orderBy(*order).limit(max_labels)
    # at most max_labels rows of two numbers
    rows = pure.join(F.broadcast(taught), "id").select("id", "y", looks("text").alias("x"), "source", "lang", "n_chars").orderBy(*order, "source", "lang", "n_chars").toArrow()
    y = rows["y"].to_numpy().astype(float)
    text, meta = _batch(*(rows[c].combine_chunks() for c in ("x", "source", "lang", "n_chars")))
    if len(y) == 0 or y.min() == y.max():
        return co_train(text, meta, y, None)
    # features are found before the join, so that it moves no texts
    every = scratch.write(pure.select("id", looks("text").alias("x"), "source", "lang", "n_chars"), "features")
    stored = scratch.write(every.join(known.select("id").distinct(), "id", "left_anti"), "unlabelled")
    scratch.drop(every)
    model = co_train(text, meta, y, TablePool(stored), **options)
    scratch.drop(stored)
    return model


def score(docs: DataFrame, model: CoTrained, out: str = "quality", threshold: float = 0.5) -> DataFrame:
    """Every row with a struct ``out``: p_text, p_meta, score, and kept (score at least ``threshold``).  A column of that name is replaced."""
    bound_batches(docs.sparkSession)
    scored = docs.withColumn(out, _scores(model)(*_inputs()))
    return scored.withColumn(out, F.col(out).withField("kept", F.col(out)["score"] >= threshold))
