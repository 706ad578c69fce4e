"""Global ranking from pairwise comparisons: spring energy with a regularised sparse linear system.

Each comparison is a spring of rest length one that pulls the winner one unit above the loser; a draw is a spring of rest
length zero. The energy, plus alpha/2 * strength^2 per item (a weak spring to zero, which makes the system regular and keeps
rarely compared items near the middle), is least where (D + alpha I - W) s = wins - losses. It is solved by conjugate
gradients with the Jacobi preconditioner, in the form with one reduction per iteration: each iteration is one sparse product
(a join and a pre-aggregated sum) and one global sum of two numbers. Springs and vectors are written tables in buckets of the
same hash of the item, so an iteration shuffles nothing but the partial sums of the product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import Buckets, cut, global_rank, hot_keys, read

#: Weight of the spring to zero, in comparisons.
ALPHA = 1.0
#: Relative residual at which the solution counts as found.
TOLERANCE = 1e-4
#: Iterations after which the system counts as unsolvable, which is an error.
MOST = 1000


def judgments(outcomes: DataFrame) -> DataFrame:
    """pairwise_outcomes -> (a, b, won): one row per judgment; won 1 if a beat b, 0 for a draw, a < b never needed.

    A comparison_id sent again counts once (all copies are the same judgment; null ids are kept one by one). A null is_draw
    is read from winner; draws without ids take theirs from hyp_a and hyp_b. Rows without two different items say nothing.
    """
    draw = F.coalesce(F.col("is_draw"), F.col("winner") == "draw", F.lit(False))
    a = F.when(draw, F.coalesce("winner_id", "hyp_a")).otherwise(F.col("winner_id"))
    b = F.when(draw, F.coalesce("loser_id", "hyp_b")).otherwise(F.col("loser_id"))
    rows = outcomes.select("comparison_id", a.alias("a"), b.alias("b"), F.when(draw, 0).otherwise(1).alias("won")).filter("a is not null and b is not null and a <> b")
    first = rows.filter("comparison_id is not null").groupBy("comparison_id").agg(F.min(F.struct("a", "b", "won")).alias("r")).select("r.*")
    return first.unionByName(rows.filter("comparison_id is null").drop("comparison_id"))


def spring_rank(items: DataFrame, comparisons: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE, most: int = MOST, hot: list | None = None) -> DataFrame:
    """items(id), comparisons(a, b, won) -> (id, strength, comparisons) for every distinct non-null item.

    Comparisons with ids that are no items are left out. An item without comparisons has strength 0. No comparisons at all:
    all strengths are 0. Raises an error if `most` iterations do not reach the tolerance.
    """
    ids = items.filter("id is not null").select("id").distinct()
    known = comparisons.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = known.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("won").alias("w"))
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "n", "w").unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), "n", (-F.col("w")).alias("w")))
    both = cut(both.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    hot = hot_keys(both, "j") if hot is None else hot
    diag = both.groupBy(F.col("i").alias("id")).agg(F.sum("n").alias("deg"), F.sum("w").alias("b"))
    zero = F.lit(0.0)
    state = ids.join(diag, "id", "left").select("id", F.coalesce(F.col("deg"), F.lit(0)).alias("deg"), (F.coalesce(F.col("deg"), F.lit(0)) + F.lit(float(alpha))).alias("d"), F.coalesce(F.col("b"), F.lit(0)).cast("double").alias("r"), zero.alias("s"), zero.alias("p"), zero.alias("q"))
    is_hot = F.coalesce(F.col("j").isin(hot), F.lit(False)) if hot else F.lit(False)
    with Buckets(both.sparkSession) as buckets:
        # springs of hot items meet the one row of each by broadcast, the others their bucket
        cold, warm = buckets.write(both.filter(~is_hot).select("i", "j", "n"), "j"), both.filter(is_hot).select("i", "j", "n")
        state = buckets.write(state, "id")
        gamma0 = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
        gamma_old, step_old, gamma = None, None, gamma0
        for k in range(most + 1):
            if k == most:
                raise RuntimeError(f"not converged after {most} iterations: residual {(gamma / gamma0) ** 0.5:.2g}")
            if gamma0 == 0.0:
                break
            z = F.col("r") / F.col("d")
            there = state.select(F.col("id").alias("j"), z.alias("z"))
            around = cold.join(there, "j")
            if hot:
                around = around.unionByName(warm.join(F.broadcast(there.filter(is_hot)), "j"))
            pull = around.groupBy(F.col("i").alias("id")).agg(F.sum(F.col("n") * F.col("z")).alias("pull"))
            here = buckets.write(state.join(pull, "id", "left").withColumn("z", z).withColumn("az", F.col("d") * F.col("z") - F.coalesce(F.col("pull"), zero)).drop("pull"), "id")
            gamma, delta = here.agg(F.sum(F.col("r") * F.col("z")), F.sum(F.col("az") * F.col("z"))).first()
            if gamma <= tolerance**2 * gamma0:
                break
            beta = 0.0 if gamma_old is None else gamma / gamma_old
            step = gamma / (delta - (0.0 if step_old is None else beta * gamma / step_old))
            p, q = F.col("z") + beta * F.col("p"), F.col("az") + beta * F.col("q")
            state = here.select("id", "deg", "d", (F.col("r") - step * q).alias("r"), (F.col("s") + step * p).alias("s"), p.alias("p"), q.alias("q"))
            gamma_old, step_old = gamma, step
        return cut(state.select("id", F.col("s").alias("strength"), F.col("deg").alias("comparisons")))


def items_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "hypotheses").select(F.col("hypothesis_id").alias("id")).unionByName(read(spark, d, "seed_hypotheses").select(F.col("hypothesis_id").alias("id")))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Every item with strength and rank; equal strengths (to 9 decimals) rank by id."""
    found = spring_rank(items_of(spark, d), judgments(read(spark, d, "pairwise_outcomes")))
    found = found.withColumn("order", F.round("strength", 9))
    return global_rank(found, [F.col("order").desc(), F.col("id").asc()]).select(F.col("id").alias("hypothesis_id"), "strength", "comparisons", "rank")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The floor(n/10) strongest of the n items."""
    ranked = p2_ranking(spark, d)
    top = ranked.count() // 10
    return ranked.filter(F.col("rank") <= top).select("hypothesis_id")


QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking}
SQL: dict[str, str] = {}
