"""Mixing to target weights with soft membership.

Classifiers fitted on a labelled table give each document a probability for every domain, so a document belongs to
several in part. Document rates, how often each is to be used, are the nonnegative least-squares fit of the domains'
expected token totals to their targets, held near 1 by a penalty that goes to zero. Gradient steps on one multiplier
per domain find it, scaled by Newton's matrix: a step needs a few sums over all documents, and a document's rate is the
projection to 0 or more of a sum over its own probabilities, so no state is written between steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import freed, held, saved, ship
from granum.llm.evidence import STYLE, fit_logistic, labelled_sample, log_odds, marking_words, style

DOMAINS = {"clean": "quality = 1 and toxic = 0", "toxic": "toxic = 1", "low": "quality = 0"}
#: Shares that classifiers of a few hundred labels can tell apart: at a toxic target of 0.02 the fit for the 1,000 documents of sf0.01 took a few of them 300 times each.
TARGETS = {"clean": 0.85, "toxic": 0.05, "low": 0.10}
FEATURES = [*STYLE, "hit", "hit_rate"]
SAMPLE_LABELS = 10_000
PENALTY, LEAST_PENALTY = 5e-3, 5e-9


def rate_at(pull: np.ndarray, domains: list[str]) -> Column:
    """The rate nearest to 1 among those that the domains' multipliers allow: max(0, 1 + p . pull)."""
    r = F.lit(1.0)
    for d, x in zip(domains, pull):
        r = r + F.col(f"p_{d}") * F.lit(float(x))
    return F.greatest(F.lit(0.0), r)


def reachable(share: np.ndarray, mass: np.ndarray, most_repeats: float | None) -> np.ndarray:
    """Target shares of which none asks for more than most_repeats times what is there; the excess goes to the others in proportion. Unchanged if that is None."""
    if most_repeats is None:
        return share
    held = np.zeros(len(share), bool)
    out = share.copy()
    for _ in share:
        over = ~held & (out > most_repeats * mass)
        if not over.any() or (held | over).all():
            break
        held |= over
        out = np.where(held, np.minimum(share, most_repeats * mass), share)
        out[~held] *= (1 - out[held].sum()) / out[~held].sum()
    return out / out.sum()


def fit_rates(known: DataFrame, targets: dict[str, float], most_repeats: float | None = None, rounds: int = 100, close: float = 1e-4) -> tuple[Column, list[float]]:
    """The rate as an expression over p_<domain>, and the relative misses of the declared targets by domain. `known` has n_tokens and p_<domain>.

    Rates minimise the squared misses, weighted by 1 / present share, plus penalty * (rate - 1)^2. At the optimum a
    rate is max(0, 1 + p . pull), so only the domains' multipliers are sought: gradient steps with Newton's scaling,
    halved until the dual objective grows. The penalty goes from PENALTY toward LEAST_PENALTY until the relative misses
    of the targets that `reachable` leaves are under `close`; if no rates meet them the least-squares fit remains. The
    misses returned are of the declared targets, so those that were lowered show too.
    """
    domains = list(targets)
    p = [F.col(f"p_{d}") for d in domains]
    total = known.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0.0
    if not total:
        return F.lit(1.0), [0.0] * len(domains)
    declared = np.array([targets[d] for d in domains]) / sum(targets.values())
    w, n = F.col("n_tokens") / total, len(domains)
    mass = np.maximum(np.array(known.agg(*[F.sum(w * x) for x in p]).first(), float), 1e-9)
    share = reachable(declared, mass, most_repeats)

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Half the sum of squared rates, the domains' totals, and their derivatives, at these multipliers."""
        r = rate_at(pull, domains)
        on = F.when(r > 0, w).otherwise(0.0)
        got = np.array(known.agg(F.sum(w * r * r) / 2, *[F.sum(w * x * r) for x in p], *[F.sum(on * a * b) for a in p for b in p]).first(), float)
        return got[0], got[1 : n + 1], got[n + 1 :].reshape(n, n)

    def short(sums: np.ndarray, goal: np.ndarray) -> np.ndarray:
        return np.where(goal > 0, sums / np.maximum(goal, 1e-12) - 1, sums)

    pull, penalty = np.zeros(n), PENALTY
    at = look(pull)
    for _ in range(rounds):
        if np.abs(short(at[1], share)).max() < close:
            break
        slope = share - at[1] - penalty * mass * pull
        if np.abs(slope).max() < 1e-3 * close * max(share.min(), 1e-4):
            if penalty <= LEAST_PENALTY:
                break
            penalty /= 100
            continue
        step = np.linalg.solve(at[2] + penalty * np.diag(mass) + 1e-12 * np.eye(n), slope)
        before = pull @ share - at[0] - penalty * (mass @ pull**2) / 2
        length = 1.0
        while length > 1e-6:
            there = pull + length * step
            then = look(there)
            if there @ share - then[0] - penalty * (mass @ there**2) / 2 >= before + 1e-4 * length * (slope @ step) - 1e-13:
                break
            length /= 2
        else:
            break
        pull, at = there, then
    return rate_at(pull, domains), short(at[1], declared).tolist()


def mix_softly(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_LABELS, carry: list[str] | None = None, most_repeats: float | None = None) -> DataFrame:
    """The columns `carry` of docs (all if None) with n_tokens (words), p_<domain>, rate, copies, and miss_<domain>.

    `copies` is rate rounded up or down by a draw that id and seed fix, with the rate as its mean. Domains are those
    of DOMAINS over `labels` (doc_id, quality, toxic); null labels are ignored. A domain with no labelled document has
    probability 0, and its target goes to the others in proportion. Targets are sought as they are declared; only if
    `most_repeats` is given, what is beyond that many times a domain's present share goes to the others too, which
    bounds how often documents are repeated. miss_<domain>, the same on every row, is the domain's expected share under
    the rates over its declared one, less 1; it is null for a domain without documents or target. Classifiers are fitted
    on at most `sample` labelled rows; totals are over all documents. A null or empty text has no words and takes part
    without weight. Repeated rows get equal rates and copies, an empty table gives an empty result. A carried column
    that bears the name of a new one gives way to it; other names don't matter.

    Shuffled: labelled texts' words, and one row of sums per task and step.
    """
    ship(docs.sparkSession)
    targets = dict(targets or TARGETS)
    carry = docs.columns if carry is None else carry
    chosen = labelled_sample(labels.where("quality is not null and toxic is not null"), sample).select("doc_id", "quality", "toxic")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    texts = saved(texts.select("_id", "text", *[F.expr(sql).alias(d) for d, sql in DOMAINS.items() if d in targets]))
    marked = marking_words(texts, "toxic") if "toxic" in targets else []
    rows = texts.select(style(F.col("text"), marked).alias("f"), *targets).select("f.*", *targets).limit(2 * sample).collect()  # repeated ids only
    data = np.array([[r[f] for f in FEATURES] for r in rows]).reshape(len(rows), len(FEATURES))
    fitted = {d: fit_logistic(data, y, ridge=1e-5) for d in targets if (y := np.array([float(r[d]) for r in rows])).any()}
    targets = {d: t for d, t in targets.items() if d in fitted}

    odds = {d: F.greatest(F.least(log_odds(w, FEATURES, "_f"), F.lit(30.0)), F.lit(-30.0)) for d, w in fitted.items()}
    known = docs.select(held(carry), F.col(id_col).alias("_id"), style(F.col(text_col), marked).alias("_f"))
    known = known.select("_doc", "_id", F.col("_f.n_words").alias("n_tokens"), *[(1 / (1 + F.exp(-z))).alias(f"_{d}") for d, z in odds.items()])
    whole = sum((F.col(f"_{d}") for d in fitted), F.lit(0.0))
    known = saved(known.select("_doc", "_id", "n_tokens", *[(F.col(f"_{d}") / whole).alias(f"p_{d}") for d in fitted]))
    rate, miss = fit_rates(known, targets, most_repeats) if targets else (F.lit(1.0), [])
    misses = [F.lit(dict(zip(targets, miss)).get(d)).cast("double").alias(f"miss_{d}") for d in DOMAINS]
    draw = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) / float(1 << 30)
    probabilities = [F.col(f"p_{d}") if d in fitted else F.lit(0.0).alias(f"p_{d}") for d in DOMAINS]
    out = known.withColumn("rate", rate)
    new = [F.col("n_tokens").cast("long").alias("n_tokens"), *probabilities, "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"), *misses]
    names = ["n_tokens", "rate", "copies", *[f"{x}_{d}" for d in DOMAINS for x in ("p", "miss")]]
    return out.select(*freed(carry, names), *new)


def take_copies(mixed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`columns` of each row (all if None) as often as its `copies` says; rows with none go."""
    rows = mixed.where("copies > 0").select(held(mixed.columns if columns is None else columns), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return rows.select("_doc.*")
