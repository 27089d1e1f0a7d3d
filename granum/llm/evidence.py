"""Style measures of a text, the words that mark a class, and logistic regression on a bounded sample."""

from __future__ import annotations

import math
import operator
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import SPACE

STYLE = ["symbols", "marks", "upper", "digits", "distinct", "repeats", "word_length", "log_words", "tiny"]
_ASCII, _UPPER, _LATER = bytes(range(128)), bytes(range(65, 91)), bytes(range(128, 192))


def _measured(text: str, marked: frozenset[bytes] | None) -> list[float]:
    whole = text.encode()
    words = whole.split()
    bare = b"".join(words)
    n, size = max(_length(bare), 1), max(len(words), 1)
    letters = bare.translate(None, _ASCII).decode()
    upper = len(bare) - len(bare.translate(None, _UPPER)) + sum(unicodedata.category(c) == "Lu" for c in letters)
    same = sum(map(operator.eq, words, words[1:]))
    out = [
        (len(bare) - len(bare.translate(None, b"#*$%&|<>"))) / n, (len(bare) - len(bare.translate(None, b"!?.,;:"))) / n, upper / n, (len(bare) - len(bare.translate(None, b"0123456789"))) / n,
        len(set(words)) / math.sqrt(size), same / size, _length(bare) / size / 10, math.log(size) / 5, float(size < 20), float(len(words)),
    ]
    if marked is not None:
        hits = sum(map(marked.__contains__, text.lower().encode().translate(None, b".,;:!?").split())) if marked else 0
        out += [float(hits > 0), min(hits * 50 / size, 5.0)]
    return out


def _length(text: bytes) -> int:
    """Code points of UTF-8."""
    return len(text.translate(None, _LATER))


def style(text: Column, marked: list[str] | None = None) -> Column:
    """A struct of doubles: STYLE, n_words, and with `marked` the presence and the rate of those words (hit, hit_rate).

    Whole texts; null counts as empty, for which all shares are 0. A text is read a few times by the byte routines of
    Python's library, in Arrow batches: built-in functions take several times as long, as they look at single
    characters and words by interpreted expressions. The caller ships the package.
    """
    names = [*STYLE, "n_words", *(["hit", "hit_rate"] if marked is not None else [])]
    telling = None if marked is None else frozenset(w.encode() for w in marked)

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([_measured(t.as_py() or "", telling) for t in texts]).reshape(len(texts), len(names))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=names)

    return measure(text)


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled rows, by hash of id; what classifiers are fitted on. Of rows that repeat an id the least counts."""
    own = [c for c in labels.columns if c in ("quality", "toxic")]
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*own)).alias("_l")).select("doc_id", "_l.*")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def marking_words(texts: DataFrame, flag: str, most: int = 200, least_docs: int = 5) -> list[str]:
    """The words most telling of rows where the column `flag` is true: by log odds of document counts, over 3 nats, at most `most`."""
    words = texts.select(F.col(flag).cast("int").alias("y"), F.explode(F.array_distinct(F.split(F.lower(F.translate(F.coalesce("text", F.lit("")), ".,;:!?", "")), SPACE))).alias("w"))
    total = texts.agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("int")).alias("y")).first()
    pos, neg = (total["y"] or 0) + 1, total["n"] - (total["y"] or 0) + 1
    odds = F.log((F.col("y") + 0.5) / pos) - F.log((F.col("n") - F.col("y") + 0.5) / neg)
    counted = words.where("w <> ''").groupBy("w").agg(F.sum("y").alias("y"), F.count("*").alias("n")).where(F.col("y") >= least_docs).withColumn("odds", odds).where("odds > 3")
    return [r.w for r in counted.orderBy(F.desc(F.col("odds") * F.sqrt("y")), "w").limit(most).collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights (the constant first) by Newton's method on the ridge-penalized likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
    w[0] = np.log(rate / (1 - rate))
    penalty = np.full(len(w), ridge * max(len(x), 1))
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (penalty * w * w)[1:].sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + penalty * np.where(np.arange(len(w)), w, 0)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w


def log_odds(weights: np.ndarray, features: list[str], of: str) -> Column:
    """The fitted linear score over the fields of the struct `of`."""
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features):
        z = z + F.lit(float(w)) * F.col(f"{of}.{f}")
    return z
