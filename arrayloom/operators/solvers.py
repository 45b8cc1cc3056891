"""Iterative methods: loops on the driver over scalars, arrays cut at each step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.operators.arrays import stencil
from arrayloom.operators.sparse import multiply
from arrayloom.plans.lineage import cut


def power_method(a: DataFrame, x: DataFrame, steps: int) -> tuple[DataFrame, list[float]]:
    """The vector after ``steps`` products, each scaled to norm 1, and the norms met."""
    norms = []
    for _ in range(steps):
        x = cut(multiply(a, x))
        norms.append(math.sqrt(x.agg(F.sum(F.col("v") * F.col("v"))).first()[0]))
        x = x.withColumn("v", F.col("v") / F.lit(norms[-1]))
    return x, norms


def conjugate_gradients(apply, b: DataFrame, steps: int, tolerance: float = 1e-12, precondition=None) -> tuple[DataFrame, list[float]]:
    """Solve apply(x) = b from x = 0; residual norms come along.

    ``apply`` maps (i, v) to (i, v) and is symmetric and positive definite.  x, r and p
    are columns of one frame, so that updates are projections and only the product
    needs an exchange.  ``precondition`` maps the residual of a row to a column, and may
    use other columns of ``b``; without one it is the identity.
    """
    z = precondition or (lambda r: r)
    kept = [c for c in b.columns if c not in ("i", "v")]
    dot = [F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * z(F.col("r"))).alias("rz")]
    state = b.select("i", *kept, F.lit(0.0).alias("x"), F.col("v").alias("r"))
    state = cut(state.withColumn("p", z(F.col("r"))))
    rr, rz = state.agg(*dot).first()
    history = [math.sqrt(rr or 0.0)]
    for _ in range(steps):
        if history[-1] <= tolerance * max(history[0], 1e-300):
            break
        q = apply(state.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("q"))
        state = cut(state.join(q, "i"))
        pq = state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        alpha = F.lit(rz / pq)
        state = cut(state.select("i", *kept, (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p"))
        rr, new = state.agg(*dot).first()
        state = state.withColumn("p", z(F.col("r")) + F.lit(new / rz) * F.col("p"))
        rz = new
        history.append(math.sqrt(rr))
    return state.select("i", F.col("x").alias("v")), history


def fused_conjugate_gradients(apply, b: DataFrame, steps: int, tolerance: float = 1e-12) -> tuple[DataFrame, list[float]]:
    """Conjugate gradients by other recurrences, with one reduction a step instead of two.

    The product is applied to the residual; w = apply(r) gives (r, r) and (w, r) in one
    pass, and apply(p) follows by the recurrence of p.
    """
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"))
    rr = alpha = None
    history: list[float] = []
    for _ in range(steps + 1):
        w = apply(state.select("i", F.col("r").alias("v"))).select("i", F.col("v").alias("w"))
        state = cut(state.join(w, "i"))
        new, wr = state.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("w") * F.col("r"))).first()
        history.append(math.sqrt(new or 0.0))
        if history[-1] <= tolerance * max(history[0], 1e-300) or len(history) > steps:
            break
        beta = new / rr if rr else 0.0
        alpha = new / (wr - (beta * new / alpha if rr else 0.0))
        rr = new
        state = state.withColumn("p", F.col("r") + F.lit(beta) * F.col("p")).withColumn("s", F.col("w") + F.lit(beta) * F.col("s"))
        state = state.select("i", (F.col("x") + F.lit(alpha) * F.col("p")).alias("x"), (F.col("r") - F.lit(alpha) * F.col("s")).alias("r"), "p", "s")
    return state.select("i", F.col("x").alias("v")), history


def heat(x: DataFrame, steps: int, damp: float = 1 / 6) -> DataFrame:
    """``steps`` diffusion steps: the damped central difference, again and again."""
    for _ in range(steps):
        x = cut(stencil(x, {0: 2 * damp, -1: -damp, 1: -damp}))
    return x
