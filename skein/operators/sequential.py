"""Operators that are defined by order: folds over a key's rows, greedy choice, elimination rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.ordered import running
from skein.plans.scratch import materialise

#: Rows of a key that are added in order as one list.
TOGETHER = 1024


def q_learning(steps: DataFrame, alpha: float = 0.1, gamma: float = 0.9) -> DataFrame:
    """``(session, state, action, q)`` after one pass over ``(session, at, state, action, reward, next_state)`` in order of ``at``.

    Sessions are dealt out by hash and sorted, and each is folded as its rows stream by: a
    task holds one session's table of states and actions, never its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, q, best = None, {}, {}
        for b in batches:
            rows = []
            for new, state, action, reward, ahead in zip(*[b.column(c).to_pylist() for c in ("session", "state", "action", "reward", "next_state")]):
                if new != session or not q:
                    rows += [(session, s, a, v) for (s, a), v in q.items()]
                    session, q, best = new, {}, {}
                value = max(best.get(ahead, {None: 0.0}).values()) if ahead is not None else 0.0
                old = q.get((state, action), 0.0)
                q[state, action] = best.setdefault(state, {})[action] = old + alpha * (reward + gamma * value - old)
            yield batch(rows)
        yield batch([(session, s, a, v) for (s, a), v in q.items()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["session", "state", "action", "q"])

    dealt = steps.repartition("session").sortWithinPartitions("session", "at")
    return dealt.mapInArrow(run, "session long, state string, action string, q double")


def bandit(df: DataFrame, key: str, order: list[str], reward: str, start: float = 1.0) -> DataFrame:
    """``(key, n, mean, spread)``: running mean, and spread 0.9 of the old plus 0.1 of the gap to the mean so far, in order.

    Unrolled, the spread is a sum of gaps weighted by powers of 0.9; numbers and running
    sums come from ranges of a key's rows and partial sums meet, so no key is one task.
    Rewards of up to ``TOGETHER`` rows are added one after another in order, whatever ranges
    they lie in, so the last bits of such a mean are the same on every run.
    """
    rows = running(df.select(key, *order, F.col(reward).cast("double").alias("r")), [key], [F.col(c) for c in order], "n", {"total": F.col("r")})
    most = materialise(rows.groupBy(F.col(key).alias("of")).agg(F.max("n").alias("most")), "arms")
    so_far = F.coalesce(F.try_divide(F.col("total") - F.col("r"), F.col("n") - 1), F.lit(0.0))
    fade = F.pow(F.lit(0.9), F.col("most") - F.col("n"))
    few = F.collect_list(F.when((F.col("most") <= TOGETHER) & F.col("r").isNotNull(), F.struct("n", "r")))
    known, total = F.count("r"), F.when(F.max("most") <= TOGETHER, F.aggregate(F.array_sort(few), F.lit(0.0), lambda s, x: s + x["r"])).otherwise(F.sum("r"))
    g = rows.join(most, F.col(key).eqNullSafe(F.col("of"))).groupBy(key).agg(F.max("n").alias("n"), F.try_divide(total, known).alias("mean"), F.sum(0.1 * fade * F.abs(F.col("r") - so_far)).alias("s"))
    return g.select(key, "n", "mean", (F.col("s") + start * F.pow(F.lit(0.9), F.col("n"))).alias("spread"))


def hitting_set(cover: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(query, chunk, step)``: greedy least set of chunks of ``(query, chunk, requirement)`` that meets all requirements; ties to the least chunk.

    A round is two aggregates and a join over what is left: each query takes the chunk that
    meets most, and what it meets goes. A query has as many rounds as its set has chunks.
    """
    left, out = materialise(cover.select("query", "chunk", "requirement").distinct(), "cover"), None
    for step in range(1, max_rounds + 1):
        if left.isEmpty():
            return out if out is not None else left.select("query", "chunk", F.lit(0).cast("long").alias("step"))
        met = left.groupBy("query", "chunk").agg(F.count("*").alias("n"))
        best = materialise(met.groupBy("query").agg(F.max_by("chunk", F.struct("n", (-F.col("chunk")).alias("low"))).alias("chunk")), "chosen")
        chosen = best.select("query", "chunk", F.lit(step).cast("long").alias("step"))
        out = chosen if out is None else out.unionByName(chosen)
        gone = left.join(best, ["query", "chunk"], "left_semi").select("query", "requirement")
        left = materialise(left.join(gone, ["query", "requirement"], "left_anti"), "cover")
    raise RuntimeError(f"covers did not settle in {max_rounds} rounds")


def instant_runoff(ballots: DataFrame) -> list[tuple[int, str, int, bool]]:
    """Rounds of ``(round, candidate, votes, out)`` over ballots ``(voter, choices array)``; the least candidate goes, ties to the greater name.

    There are fewer rounds than candidates; a round is one aggregation.
    """
    gone: list[str] = []
    rounds = []
    while True:
        left = F.filter("choices", lambda c: ~c.isin(*gone)) if gone else F.col("choices")
        tally = ballots.select(F.try_element_at(left, F.lit(1)).alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).collect()
        votes = sorted(((r.n, r.c) for r in tally), key=lambda x: (x[0], tuple(-ord(ch) for ch in x[1])))
        total = sum(n for n, _ in votes)
        done = len(votes) <= 1 or votes[-1][0] * 2 > total
        rounds += [(len(gone) + 1, c, n, not done and i == 0) for i, (n, c) in enumerate(votes)]
        if done:
            return rounds
        gone.append(votes[0][1])
