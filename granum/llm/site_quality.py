"""Quality by hierarchical empirical Bayes: evidence of the document, posteriors of its host and path.

A logistic classifier, fitted on labelled documents, gives each document's probability of low quality. Hosts are
averaged over all their documents and shrunk toward the average of all; paths are shrunk toward their host. How much
follows from how far the averages spread beyond chance. A document's posterior odds are its evidence, relative to the
overall odds, times the odds of its path by the path's other documents: its own share is taken out, so that no evidence
counts twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import freed, held, maybe_broadcast, saved, ship
from granum.llm.evidence import STYLE, fit_logistic, labelled_sample, log_odds, marking_words, style

SAMPLE_LABELS = 20_000


def strength(groups: DataFrame, mean: Column, low: float = 5.0, high: float = 1e6) -> float:
    """Prior strength in documents, by moments: `groups` has n, s (sum), s2 (sum of squares) of each group's scores, `mean` the mean to shrink to."""
    r = groups.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
    ).first()
    if not r["n"] or r["n"] <= r["k"]:
        return high
    within = max(r["within"], 0.0) / (r["n"] - r["k"])
    between = (r["between"] - (r["k"] - 1) * within) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(min(max(within / between, low), high)) if between > 1e-12 else high


#: Features of a document: its style, and whether and how often words occur that mark the labelled low ones.
FEATURES = [*STYLE, "hit", "hit_rate"]
BROADCAST_PATHS = 500_000


def judge_sites(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", most_low: float = 0.5, sample: int = SAMPLE_LABELS, carry: list[str] | None = None, twice: bool | None = None) -> DataFrame:
    """The columns `carry` of docs (all if None) with evidence, host_rate, path_rate, p_low (probabilities of low quality) and kept (p_low <= most_low).

    `labels` has doc_id and quality (0 low); null labels are ignored, and without any of one kind nothing is
    rejected on evidence. At most `sample` labelled documents are fitted on; rates are over all documents. A null or
    empty text is judged by its measures, as a text without words. Null hosts or paths are groups of their own.
    path_rate is that of the path without the document itself; alone on its path it has the host's. Repeated rows are
    judged alike, an empty table gives an empty result. A carried column that bears the name of a new one gives way to
    it; other names don't matter.

    Hosts and paths are summed before the shuffle, so one of them may hold any share of the rows. Rates are broadcast
    under BROADCAST_PATHS paths, and joined beyond. With `twice`, which is the default where the text is carried, texts
    are read and measured twice and neither written nor, below that number, shuffled; otherwise rows are checkpointed.
    """
    spark = docs.sparkSession
    ship(spark)
    carry = docs.columns if carry is None else carry
    chosen = labelled_sample(labels.where("quality is not null"), sample).select(F.col("doc_id").alias("_label_id"), (F.col("quality") == 0).alias("_low"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    texts = saved(texts.select("_low", "text"))
    marked = marking_words(texts, "_low")
    rows = texts.select(style(F.col("text"), marked).alias("_f"), "_low").select("_low", "_f.*").limit(2 * sample).collect()  # repeated ids only
    if len({r["_low"] for r in rows}) == 2:
        data = np.array([[r[f] for f in FEATURES] for r in rows])
        weights = fit_logistic(data, np.array([float(r["_low"]) for r in rows]), ridge=1e-5)
    else:
        weights = np.array([-4.0] + [0.0] * len(FEATURES))
    known = docs.select(held(carry), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), style(F.col(text_col), marked).alias("_f"))
    z = F.greatest(F.least(log_odds(weights, FEATURES, "_f"), F.lit(30.0)), F.lit(-30.0))
    scored = known.select("_doc", "_host", "_path", z.alias("_z"))
    scored = scored if (text_col in carry if twice is None else twice) else saved(scored)
    scored = scored.withColumn("_e", 1 / (1 + F.exp(-F.col("_z"))))

    sums = [F.count("*").alias("n"), F.sum("_e").alias("s"), F.sum(F.col("_e") * F.col("_e")).alias("s2")]
    paths = saved(scored.groupBy("_host", "_path").agg(*sums))
    hosts = paths.groupBy("_host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((total["s"] or 0.0) / (total["n"] or 1), 1e-4), 1 - 1e-4)
    a = strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("_host").alias("h"), ((F.col("s") + a * mean) / (F.col("n") + a)).alias("host_rate"))
    paths = paths.join(hosts, paths["_host"].eqNullSafe(hosts["h"])).drop("h")
    b = strength(paths, F.col("host_rate"))
    rates = saved(paths.select(F.col("_host").alias("h"), F.col("_path").alias("p"), "n", "s", "host_rate"))
    out = scored.join(maybe_broadcast(rates, BROADCAST_PATHS), scored["_host"].eqNullSafe(rates["h"]) & scored["_path"].eqNullSafe(rates["p"]), "left")
    out = out.withColumn("path_rate", (F.col("s") - F.col("_e") + b * F.col("host_rate")) / (F.col("n") - 1 + b))
    rate = F.greatest(F.least("path_rate", F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.col("_z") - float(np.log(mean / (1 - mean))) + F.log(rate / (1 - rate))
    out = out.withColumn("p_low", 1 / (1 + F.exp(-odds)))
    new = ["evidence", "host_rate", "path_rate", "p_low", "kept"]
    return out.select(*freed(carry, new), F.col("_e").alias("evidence"), "host_rate", "path_rate", "p_low", (F.col("p_low") <= most_low).alias("kept"))
