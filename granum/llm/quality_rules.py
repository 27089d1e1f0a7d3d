"""Quality rules per document and per host, in DataFrame functions only.

Each document is measured and held against base rules. Failures are counted by host; a host's rate for every rule is
shrunk toward the rate of all hosts by a beta prior fitted to the hosts' rates by moments, and a host whose shrunk
rate is above a limit takes its documents with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granum.llm.common import SPACE, SPACES, freed, held, maybe_broadcast, saved

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: The rules whose failures are counted by host: name, SQL over a document's measures.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "n_lines > 1 and 2 * n_dup_lines > n_lines",
}
BASE = ("short", "repeats")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: a lambda's argument is held, while a repeated expression is computed anew for each element of a loop that mentions it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of 8 that occurs twice or more, the first time included.

    Words are hashed once and windows by the hashes of their words. Only a text with equal hashes goes on: its windows
    are sorted by hash, then by the words themselves, so that those with an equal neighbour are the repeated ones
    whatever the hashes; the lengths of the union of their spans are summed up. All is linear but for the sorts.
    """

    def covered(places: Column) -> Column:  # sorted starts; each adds what the next one doesn't cover
        n = F.size(places)
        return F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda acc, i: acc + F.when(i < n, F.least(F.lit(WINDOW), F.element_at(places, (i + 1).cast("int")) - F.element_at(places, i.cast("int")))).otherwise(WINDOW),
        )

    def twice(windows: Column) -> Column:
        n = F.size(windows)
        at = lambda i: F.element_at(windows, i.cast("int"))
        equal = lambda x, i: (at(i)["h"] == x["h"]) & (at(i)["w"] == x["w"])
        same = lambda x, i: F.when(i > 0, equal(x, i)).otherwise(False) | F.when(i + 2 <= n, equal(x, i + 2)).otherwise(False)
        return F.sort_array(F.transform(F.filter(windows, same), lambda x: x["i"]))

    def of_hashes(w: Column, hashes: Column) -> Column:
        windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(w, i + 1, WINDOW).alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(windows, lambda s: let(twice(s), covered)))

    def of_words(w: Column) -> Column:
        windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return F.when(F.size(w) < WINDOW + 1, 0).otherwise(let(hashes, lambda h: of_hashes(w, h)))

    return let(words, of_words)


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text as columns; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return {
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "words": let(words, lambda w: F.struct(F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))),
        "lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


def measured(text: Column) -> Column:
    """A struct of measures: n_symbols, words (word_chars, n_words, n_repeat_words), lines (n_lines, n_dup_lines)."""
    return F.struct(*[c.alias(k) for k, c in measures(text).items()])


def host_verdicts(judged: DataFrame, host_col: str, most_rate: float) -> DataFrame:
    """Per host: host, n_docs, rate_<rule> (shrunk), host_bad. `judged` has a boolean fails_<rule> for each rule.

    The beta prior of a rule has the mean of all documents and the strength that explains the spread of the hosts'
    rates beyond chance, by moments; with no such spread hosts fully follow the mean. Counts are combined before the
    shuffle, so a host may hold any share of the rows; a null host is one of its own.
    """
    hosts = saved(judged.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"f_{r}") for r in RULES]))
    sums = [F.sum("n_docs").alias("n"), F.count("*").alias("k"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2")]
    total = hosts.agg(*sums, *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES]).first()
    if not total["n"]:
        return hosts.select("host", "n_docs", *[F.lit(0.0).alias(f"rate_{r}") for r in RULES], F.lit(False).alias("host_bad"))
    mean = {r: total[f"f_{r}"] / total["n"] for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n_docs") * F.pow(F.col(f"f_{r}") / F.col("n_docs") - mean[r], 2)).alias(r) for r in RULES]).first()
    rates = {}
    for r in RULES:
        chance = mean[r] * (1 - mean[r])
        beyond = (spread[r] - (total["k"] - 1) * chance) / max(total["n"] - total["n2"] / total["n"], 1e-9)
        strength = min(max(chance / beyond - 1, 1.0), 1e9) if beyond > 1e-12 else 1e9
        rates[r] = (F.col(f"f_{r}") + mean[r] * strength) / (F.col("n_docs") + strength)
    bad = reduce(lambda a, b: a | b, [c > most_rate for c in rates.values()])
    return hosts.select("host", "n_docs", *[c.alias(f"rate_{r}") for r, c in rates.items()], bad.alias("host_bad"))


#: Hosts that are rejected; beyond so many they are joined instead of broadcast.
BROADCAST_HOSTS = 500_000


def judge_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", most_rate: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all if None) with measures `m`, base_failed and kept, each text being measured once.

    kept is false for a document that fails a base rule (under 20 words, or over 30 % of words in repeated windows of
    8) and for every document of a host whose shrunk failure rate of any rule is above `most_rate`. A null or empty
    text has no words and fails. A null host is one of its own. Repeated rows are judged alike, an empty table gives an
    empty result. A carried column called m, base_failed or kept gives way to the new one; other names don't matter.

    Rows are checkpointed with their measures, as measuring costs far more than writing; only counts by host are
    shuffled, and the hosts that are rejected broadcast, under BROADCAST_HOSTS of them.
    """
    carry = docs.columns if carry is None else carry
    raw = docs.select(held(carry), F.col(host_col).alias("_host"), measured(F.col(text_col)).alias("_raw"))
    judged = raw.select("_doc", "_host", F.struct("_raw.n_symbols", "_raw.words.*", "_raw.lines.*").alias("m"))
    judged = judged.select("*", *[F.expr(_over(sql)).alias(f"fails_{r}") for r, sql in RULES.items()])
    judged = saved(judged.withColumn("base_failed", reduce(lambda a, b: a | b, [F.col(f"fails_{r}") for r in BASE])))
    bad = saved(host_verdicts(judged, "_host", most_rate).where("host_bad").select(F.col("host").alias("_bad"), F.lit(True).alias("host_bad")))
    out = judged.join(maybe_broadcast(bad, BROADCAST_HOSTS), judged["_host"].eqNullSafe(bad["_bad"]), "left")
    kept = ~F.col("base_failed") & F.col("host_bad").isNull()
    return out.select(*freed(carry, ["m", "base_failed", "kept"]), "m", "base_failed", kept.alias("kept"))


def _over(sql: str) -> str:
    for name in ("n_words", "n_repeat_words", "n_symbols", "n_lines", "n_dup_lines"):
        sql = sql.replace(name, f"m.{name}")
    return sql
