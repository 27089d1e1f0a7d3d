"""Change logs, time-to-live views, ownership and delivery state over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(log: DataFrame, key: str, sequence: str, op: str, removed: str, values: list[str], after: int | None = None) -> DataFrame:
    """State after the log: per key the values of its last entry, keys whose last entry removes them left out. Combined before the shuffle.

    With `after` only entries of a higher sequence are read: what follows a high-water mark.
    """
    log = log if after is None else log.where(F.col(sequence) > after)
    last = log.groupBy(key).agg(F.max_by(F.struct(*dict.fromkeys([op, *values])), sequence).alias("x"))
    return last.where(F.col(f"x.{op}") != removed).select(key, *[F.col(f"x.{v}").alias(v) for v in dict.fromkeys(values)])


def intact_prefix(log: DataFrame, sequence: str, intact: Column) -> DataFrame:
    """Entries before the first one that is damaged; replay stops there."""
    bad = log.where(~F.coalesce(intact, F.lit(False))).agg(F.min(sequence).alias("_bad"))
    return log.crossJoin(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(sequence) < F.col("_bad"))).drop("_bad")  # one row


def advance_mark(events: DataFrame, at: str, acked: Column, mark: int) -> DataFrame:
    """One row: the high-water mark after acknowledged events; it never goes back."""
    return events.where(acked).agg(F.greatest(F.coalesce(F.max(at), F.lit(mark)), F.lit(mark)).alias("mark"))


def newer_than(files: DataFrame, at: str, mark: int) -> DataFrame:
    return files.where(F.col(at) > mark)


def live_values(puts: DataFrame, key: str, at: str, value: str, ttl: str, now: int, tie: str | None = None) -> DataFrame:
    """Last put of each key that hasn't expired by `now` (seconds); a ttl of -1 never does. With the seconds left, -1 for no end.

    Of puts of one key at the same second the least by `tie` counts; without it, any.
    """
    order = F.when(F.col(at).isNotNull(), F.struct((-F.col(at)).alias("_at"), *([tie] if tie else [])))
    last = puts.groupBy(key).agg(F.min_by(F.struct(at, value, ttl), order).alias("x")).select(key, "x.*")
    ends = F.col(at) + F.col(ttl)
    left = F.when(F.col(ttl) < 0, F.lit(-1)).otherwise(ends - now)
    return last.where((F.col(ttl) < 0) | (ends > now)).select(key, value, left.cast("long").alias("seconds_left"))


def read_values(live: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """Each asked key with its value and seconds left; null and -2 where it is missing or expired."""
    out = keys.select(key).join(live, key, "left")
    return out.select(key, value, F.coalesce("seconds_left", F.lit(-2)).cast("long").alias("seconds_left"))


def increments(log: DataFrame, key: str, sequence: str, op: str, amount: str) -> DataFrame:
    """Counters after a log of SET, INCR and DEL: what is added since a key's last SET or DEL, to what that set."""
    since = Window.partitionBy(key).orderBy(sequence)
    based = log.withColumn("_g", F.count_if(F.col(op) != "INCR").over(since))
    per = based.groupBy(key, "_g").agg(F.sum(F.when(F.col(op) == "DEL", 0).otherwise(F.col(amount))).alias("total"), F.max_by(op, sequence).alias("_last"))
    last = per.groupBy(key).agg(F.max_by(F.struct("total", "_last"), "_g").alias("x"))
    return last.where("x._last <> 'DEL'").select(key, F.col("x.total").alias("total"))


def lock_holders(log: DataFrame, key: str, sequence: str, op: str, owner: str, at: str, ttl: str, now: int) -> DataFrame:
    """Who holds each lock at `now`, by a log of ACQUIRE, RENEW and RELEASE in which only what succeeded is written; expired ones are free."""
    last = log.groupBy(key).agg(F.max_by(F.struct(op, owner, at, ttl), sequence).alias("x")).select(key, "x.*")
    return last.where((F.col(op) != "RELEASE") & (F.col(at) + F.col(ttl) > now)).select(key, owner, (F.col(at) + F.col(ttl) - now).cast("long").alias("seconds_left"))


def owners(events: DataFrame, key: str, event: str, stamp: str, since: object = None) -> DataFrame:
    """Who holds each key: the event of newest stamp, of equal ones the later id; events with a stamp under `since` have expired."""
    live = events if since is None else events.where(F.col(stamp) >= F.lit(since))
    return live.groupBy(key).agg(F.max_by(event, F.struct(stamp, event)).alias("owner"))


#: Candidates that one task holds at most when it plays rounds for all who still ask.
CANDIDATES = 2_000_000


def _played(listed: DataFrame, most: int) -> DataFrame:
    """Rounds of pair_moves on lists of candidates, one task for all: they are CANDIDATES at most, whatever the input's size.

    A list of `most` may go on: before the round in which one of these has run out play ends, so that every round is as on whole lists.
    """
    import numpy as np
    import pyarrow as pa

    names = "d", "c", "score", "d_n", "d_used", "c_n", "c_used"

    def play(batches):
        if not (batches := list(batches)):
            return
        table = pa.Table.from_batches(batches)
        d, c, score, d_n, d_used, c_n, c_used = (table[x].to_numpy() for x in names)
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        ends, place = np.append(first[1:], len(d)), first.copy()
        cut = ends - first == most
        left_d, used_d = (d_n - d_used)[first], d_used[first]
        creates, which, of = np.unique(c, return_index=True, return_inverse=True)
        left_c, used_c = (c_n - c_used)[which], c_used[which]
        # Those that ask are numbers of lists, which come in the order that decides between equal scores.
        asking, taken = np.arange(len(first)), []
        while True:
            on = asking
            while len(on := on[place[on] < ends[on]]) and len(on := on[left_c[of[place[on]]] == 0]):
                place[on] += 1
            ended = place[asking] == ends[asking]
            asking = asking[~ended] if not cut[asking[ended]].any() else asking[:0]
            if not len(asking):
                break
            asking = asking[np.lexsort((asking, score[place[asking]], of[place[asking]]))]
            asked, wanted = of[place[asking]], left_d[asking]
            before = np.cumsum(wanted) - wanted
            before -= np.maximum.accumulate(np.where(np.append(True, asked[1:] != asked[:-1]), before, 0))
            n = np.clip(left_c[asked] - before, 0, wanted)
            got = n > 0
            taken.append(tuple(x[got] for x in (d[place[asking]], creates[asked], score[place[asking]], used_d[asking], used_c[asked] + before, n)))
            left_d[asking], used_d[asking] = wanted - n, used_d[asking] + n
            np.subtract.at(left_c, asked, n)
            np.add.at(used_c, asked, n)
            asking = np.sort(asking[left_d[asking] > 0])
        if taken:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*taken)], ["d", "c", "score", "d_used", "c_used", "n"])

    rows = listed.repartition(1).sortWithinPartitions("d_at", "d_size", "d_m", "d", "_k").select(*names)
    return rows.mapInArrow(play, f"d long, c long, score {dict(rows.dtypes)['score']}, d_used long, c_used long, n long")


def pair_moves(deletes: DataFrame, creates: DataFrame, seconds: int, most_score: int = 10_000_000) -> DataFrame:
    """Deletes with the create that moves them: at most `seconds` later, those of equal size and mtime first, then the lowest score.

    Both have path, at (seconds), size, mtime. score is the size difference plus 1000 times the mtime difference, up to
    `most_score`. In each round each delete asks for its best create and each create takes its best delete; who is left
    asks again, until no pair is. Others stay deletes. Kinds: RENAME within one folder, MOVE else, DELETE unmatched.

    Equal ones are paired by rank among their equals, so a bulk move of any size makes one row for each file. The rest
    is joined on buckets of time, size and mtime, two of which hold any difference that `most_score` allows. There rows
    of one time, size and mtime ask and are taken as one group, member by member in order of path. Rounds have no end
    but that no pair is left: while many ask, each is a job; of fewer, the best candidates of all are listed, as many
    as CANDIDATES allows, and one task plays the rounds that those lists decide. All joins are merges: checkpoints and
    buckets have no size that Spark knows, and by its estimates it would broadcast them.
    """
    from granum.sources.tables import settled

    def side(rows: DataFrame, x: str, path: str) -> DataFrame:
        return settled(rows.select(C("path").alias(path), C("at").alias(f"{x}_at"), C("size").alias(f"{x}_size"), C("mtime").alias(f"{x}_m"), F.monotonically_increasing_id().alias(f"{x}_id")))

    def groups(rows: DataFrame, x: str) -> DataFrame:
        return settled(rows.groupBy(f"{x}_at", f"{x}_size", f"{x}_m").agg(F.count("*").alias(f"{x}_n")).select("*", F.lit(0).cast("long").alias(f"{x}_used"), F.monotonically_increasing_id().alias(x)))

    def members(rows: DataFrame, grouped: DataFrame, x: str, path: str) -> DataFrame:
        same = [rows[f"{x}_{k}"] == grouped[f"{x}_{k}"] for k in ("at", "size", "m")]
        rank = F.row_number().over(Window.partitionBy(x).orderBy(path, f"{x}_id")) - 1
        return rows.join(grouped.select(x, *[f"{x}_{k}" for k in ("at", "size", "m")]).hint("merge"), same).select(x, f"{x}_id", path, rank.cast("long").alias(f"{x}_rank"))

    def left_of(grouped: DataFrame, taken: DataFrame, x: str) -> DataFrame:
        now = taken.groupBy(x).agg(F.sum("n").alias("_now"))
        return settled(grouped.join(now.hint("merge"), x, "left").withColumn(f"{x}_used", C(f"{x}_used") + F.coalesce("_now", F.lit(0))).drop("_now").where(C(f"{x}_used") < C(f"{x}_n")))

    C = F.col
    d, c = side(deletes, "d", "from_path"), side(creates, "c", "to_path")
    in_time = (C("c_at") >= C("d_at")) & (C("c_at") - C("d_at") <= seconds)
    rank = lambda x, *by: F.row_number().over(Window.partitionBy(f"{x}_size", f"{x}_m").orderBy(*by, f"{x}_id"))
    equal = d.withColumn("_r", rank("d", "d_at", "from_path")).join(c.withColumn("_q", rank("c", "c_at", "to_path")).hint("merge"), (C("d_size") == C("c_size")) & (C("d_m") == C("c_m")) & (C("_r") == C("_q")) & in_time)
    equal = settled(equal.select("d_id", "c_id", "to_path", F.lit(0).cast("long").alias("score")))
    left_d, left_c = d.join(equal.select("d_id").hint("merge"), "d_id", "left_anti"), c.join(equal.select("c_id").hint("merge"), "c_id", "left_anti")
    all_d, all_c = groups(left_d, "d"), groups(left_c, "c")
    open_d, open_c = all_d, all_c
    near = lambda name, width: [F.expr(f"floor({name}) div {width} + {i}") for i in (0, 1, -1)]
    widths = {"at": int(seconds) + 2, "size": int(most_score) + 1, "m": int(most_score) // 1000 + 1}
    score = F.abs(C("d_size") - C("c_size")) + 1000 * F.abs(C("d_m") - C("c_m"))
    best = Window.partitionBy("d").orderBy("score", "c_at", "c_size", "c_m")
    before = Window.partitionBy("c").orderBy("score", "d_at", "d_size", "d_m").rowsBetween(Window.unboundedPreceding, -1)
    rounds = []
    while asking := open_d.count():
        most = max(1, CANDIDATES // asking)
        asks, asked = open_d, open_c
        for x, w in widths.items():
            asks, asked = asks.withColumn(f"_{x}", near(f"d_{x}", w)[0]), asked.withColumn(f"_{x}", F.explode(F.array(*near(f"c_{x}", w))))
        pairs = asks.join(asked.hint("merge"), ["_at", "_size", "_m"]).where(in_time).withColumn("score", score).where(C("score") <= most_score)
        listed = settled(pairs.withColumn("_k", F.row_number().over(best)).where(C("_k") <= most).drop("_at", "_size", "_m"))
        if most > 1:
            taken = _played(listed, most)
        else:
            free = C("c_n") - C("c_used") - F.coalesce(F.sum(C("d_n") - C("d_used")).over(before), F.lit(0))
            taken = listed.withColumn("_free", free).where("_free > 0").select("d", "c", "score", "d_used", (C("c_n") - C("_free")).alias("c_used"), F.least(C("d_n") - C("d_used"), "_free").alias("n"))
        taken = settled(taken)
        rounds = [*rounds, taken] if len(rounds) < 50 else [settled(reduce(DataFrame.union, [*rounds, taken]))]
        # Who has no candidate now will have none later: creates only become fewer.
        open_d, open_c = left_of(listed.where("_k = 1").select(all_d.columns), taken, "d"), left_of(open_c, taken, "c")
    paired = equal.select("d_id", "to_path", "score")
    if rounds:
        taken = reduce(DataFrame.union, rounds).select("d", "c", "score", F.posexplode(F.sequence("d_used", C("d_used") + C("n") - 1)).alias("_i", "d_rank"), "c_used")
        taken = taken.withColumn("c_rank", C("c_used") + C("_i"))
        found = taken.join(members(left_d, all_d, "d", "from_path").hint("merge"), ["d", "d_rank"]).join(members(left_c, all_c, "c", "to_path").hint("merge"), ["c", "c_rank"])
        paired = paired.union(found.select("d_id", "to_path", C("score").cast("long").alias("score")))
    out = d.join(paired.hint("merge"), "d_id", "left")
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    kind = F.when(C("to_path").isNull(), "DELETE").when(folder("from_path") == folder("to_path"), "RENAME").otherwise("MOVE")
    return out.select("from_path", "to_path", "score", kind.alias("kind"))


def delivery(acks: DataFrame, event: str, replica: str, acked: str) -> DataFrame:
    """Per event: replicas, those still outstanding in order, and whether all have it."""
    return acks.groupBy(event).agg(F.count("*").alias("replicas"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col(acked), F.col(replica)))), ",").alias("outstanding"), F.bool_and(acked).alias("done"))
