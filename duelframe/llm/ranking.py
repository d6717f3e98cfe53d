"""Problem 3: one global ranking from pairwise comparisons, with draws and an order effect.

Davidson's model with a first-position effect, on counts per (first, second) pair: with
strengths a and b, s = exp(a + order), t = exp(b), u = exp(draw + (a + order + b) / 2),
P(first wins) = s / (s + t + u), P(draw) = u / (s + t + u). The penalised log-likelihood
(strengths, order and draw pulled to 0 or to a prior mean) is maximised by truncated Newton steps: each step solves
H d = g with conjugate gradients, preconditioned with the diagonal. Every product with H is
one pass over the pair counts: two look-ups of vectors, then sums per item with map-side
aggregation, so an item with very many comparisons makes no large task. Vectors are tables in the
shared folder; the driver only sees a few scalars per step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from duelframe.functions.text import key
from duelframe.session import Scratch

#: Vectors of at most so many items are sent to all tasks (32 bytes an item); larger ones are joined by shuffle.
BROADCAST_ITEMS = 2_000_000
PENALTY = 0.5
#: Prior of the draw parameter: without any draw its estimate runs to minus infinity.
DRAW_MEAN, DRAW_PENALTY = -4.0, 0.5
#: Newton that does not end within so many steps is an error; an inner solution is cut after INNER_STEPS,
#: which costs further Newton steps but changes no result.
NEWTON_STEPS, INNER_STEPS = 60, 12
#: The inner system is solved to this share of its right side; Newton ends when no strength moves by MOVE.
INNER_SHARE, MOVE = 0.1, 0.005


class NotConverged(RuntimeError):
    """The fit did not reach its end within the allowed steps."""


def decided_battles(players: DataFrame) -> DataFrame:
    """(first, second, win): decided battles, users as keys; win is 1.0 if the first side won.

    A battle is decided if it has exactly two sides with one row each, one WIN and one LOSS,
    and both usernames. Repeated rows count once; a contradictory or incomplete battle gives nothing,
    nor does one of an account against itself. The first side is the smaller side text (p1).
    """
    rows = players.select(key("battle_id").alias("battle"), key("side").alias("side"), key("username").alias("user"), F.upper(F.trim("result")).alias("result"))
    rows = rows.where("battle IS NOT NULL AND side IS NOT NULL")
    # min and max over (side, user, result) tell whether there are just two distinct rows, without collecting them
    entry = F.struct("side", "user", "result")
    games = rows.groupBy("battle").agg(
        F.min(entry).alias("a"), F.max(entry).alias("b"), F.sum(F.when(F.col("user").isNull(), 1).otherwise(0)).alias("no_user"),
        F.min("side").alias("low_side"), F.max("side").alias("high_side"),
        F.sum(F.when(F.col("result") == "WIN", 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("result") == "LOSS", 1).otherwise(0)).alias("losses"),
        F.max(F.when(F.col("result") == "WIN", F.col("side"))).alias("win_side"), F.min(F.when(F.col("result") == "WIN", F.col("side"))).alias("win_side_low"),
        F.count(F.lit(1)).alias("n"),
        F.min(F.xxhash64("side", "user", "result")).alias("low"), F.max(F.xxhash64("side", "user", "result")).alias("high"),
        F.sum(F.xxhash64("side", "user", "result").cast("decimal(38,0)")).alias("total"),
    )
    # n rows are copies of two distinct rows when their digests add up to k * low + (n - k) * high
    k = F.when(F.col("a.result") == "WIN", F.col("wins")).otherwise(F.col("losses"))
    copies_only = F.col("total") == k * F.xxhash64("a.side", "a.user", "a.result").cast("decimal(20,0)") + (F.col("n") - k) * F.xxhash64("b.side", "b.user", "b.result").cast("decimal(20,0)")
    fit = games.where(
        "a.side <> b.side AND no_user = 0 AND wins > 0 AND losses > 0 AND wins + losses = n AND a.result <> b.result AND a.user <> b.user AND win_side = win_side_low"
    ).where(copies_only)
    return fit.select(F.col("a.user").alias("first"), F.col("b.user").alias("second"), (F.col("a.result") == "WIN").cast("double").alias("win"))


def pair_table(comparisons: DataFrame) -> DataFrame:
    """(first, second, n, wins, draws) from (first, second, win), where win 0.5 is a draw; aggregated counts."""
    return comparisons.where("first <> second AND win IS NOT NULL").groupBy("first", "second").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum((F.col("win") == 1.0).cast("double")).alias("wins"),
        F.sum((F.col("win") == 0.5).cast("double")).alias("draws"),
    )


class PairedComparison:
    """Fits strengths on a pair table; `fit()` gives (item, games, strength, spread, rank inputs)."""

    def __init__(self, pairs: DataFrame, penalty: float = PENALTY, broadcast_items: int = BROADCAST_ITEMS, label: str = "ranking"):
        self.scratch = Scratch(pairs.sparkSession, label)
        self.penalty = penalty
        named = self.scratch.save(pairs)
        games = named.select(F.col("first").alias("item"), "n").unionByName(named.select(F.col("second").alias("item"), "n")).groupBy("item").agg(F.sum("n").alias("games"))
        # 64-bit ids of the names; two names with one digest would share it, so they are told apart here
        ids = games.withColumn("id", F.xxhash64("item"))
        self.items = self.scratch.save(ids)
        counts = self.items.agg(F.count(F.lit(1)), F.approx_count_distinct("id")).first()
        self.size = counts[0]
        if self.size and self.items.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("two item names share one digest")
        self.pairs = self.scratch.save(named.select(F.xxhash64("first").alias("i"), F.xxhash64("second").alias("j"), "n", "wins", "draws"))
        self.small = self.size <= broadcast_items
        self.order, self.draw = 0.0, DRAW_MEAN

    def _observed(self, df: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
        """The written table and sums over it, which are taken while it is written."""
        seen = Observation()
        made = self.scratch.save(df.observe(seen, *[c.alias(n) for n, c in sums.items()]))
        return made, seen.get

    def _with(self, vectors: DataFrame, *names: str) -> DataFrame:
        """The pair rows with the named vectors of both ends (name_i, name_j)."""
        side = lambda v: vectors.select(F.col("id").alias(v), *[F.col(n).alias(f"{n}_{v}") for n in names])
        hint = F.broadcast if self.small else (lambda d: d)
        return self.pairs.join(hint(side("i")), "i").join(hint(side("j")), "j")

    def _chances(self) -> tuple[Column, Column, Column]:
        """Probabilities of a first win, a draw and a second win."""
        z = F.col("theta_i") - F.col("theta_j") + F.lit(self.order)
        win, draw, loss = F.exp(z / 2), F.lit(math.exp(self.draw)), F.exp(-z / 2)
        total = win + draw + loss
        return win / total, draw / total, loss / total

    @staticmethod
    def _summed(rows: DataFrame, at_i: dict[str, Column], at_j: dict[str, Column]) -> DataFrame:
        """Contributions of every pair to both its items, summed per item."""
        ends = F.array(F.struct(F.col("i").alias("id"), *[c.alias(n) for n, c in at_i.items()]), F.struct(F.col("j").alias("id"), *[c.alias(n) for n, c in at_j.items()]))
        return rows.select(F.explode(ends).alias("e")).select("e.*").groupBy("id").agg(*[F.sum(n).alias(n) for n in at_i])

    def _slope(self, state: DataFrame) -> DataFrame:
        """(id, theta, g, h): gradient and diagonal of the curvature of the penalised likelihood."""
        win, draw, loss = self._chances()
        got = F.col("wins") + F.col("draws") / 2
        g = got - F.col("n") * (win + draw / 2)
        # variance of the score (1, 1/2, 0) of one comparison
        w = F.col("n") * (win + draw / 4 - (win + draw / 2) * (win + draw / 2))
        sums = self._summed(self._with(state, "theta"), {"g": g, "h": w}, {"g": -g, "h": w})
        return state.select("id", "theta").join(sums, "id").select(
            "id", "theta", (F.col("g") - self.penalty * F.col("theta")).alias("g"), (F.col("h") + self.penalty).alias("h")
        )

    def _product(self, vectors: DataFrame) -> DataFrame:
        """(id, ap): the curvature times p."""
        win, draw, _ = self._chances()
        w = F.col("n") * (win + draw / 4 - (win + draw / 2) * (win + draw / 2))
        d = w * (F.col("p_i") - F.col("p_j"))
        return self._summed(self._with(vectors, "theta", "p"), {"ap": d}, {"ap": -d})

    def _globals(self, state: DataFrame) -> None:
        """One Newton step of the order and draw parameters, from five sums over all pairs."""
        win, draw, loss = self._chances()
        n, m = F.col("n"), win + draw / 2
        sums = self._with(state, "theta").agg(
            F.sum(F.col("wins") + F.col("draws") / 2 - n * m), F.sum(n * (win + draw / 4 - m * m)),
            F.sum(F.col("draws") - n * draw), F.sum(n * draw * (1 - draw)), F.sum(n * draw * (F.lit(0.5) - m)),
        ).first()
        go, ho, gd, hd, hod = (float(x or 0.0) for x in sums)
        go, gd = go - self.penalty * self.order, gd - DRAW_PENALTY * (self.draw - DRAW_MEAN)
        ho, hd = ho + self.penalty, hd + DRAW_PENALTY
        det = ho * hd - hod * hod
        self.order += max(-1.0, min(1.0, (go * hd - gd * hod) / det))
        self.draw += max(-1.0, min(1.0, (gd * ho - go * hod) / det))

    def fit(self, newton_steps: int = NEWTON_STEPS, inner_steps: int = INNER_STEPS) -> DataFrame:
        """(item, games, strength, spread): spread is the approximate standard error of the strength.

        Raises NotConverged instead of giving a fit that has not come to its end.
        """
        save, drop = self.scratch.save, self.scratch.drop
        state = save(self.items.select("id", F.lit(0.0).alias("theta")))
        moved = math.inf if self.size else 0.0
        while moved >= MOVE:
            if newton_steps == 0:
                raise NotConverged(f"strengths still move by {moved:.3g}")
            newton_steps -= 1
            slope, seen = self._observed(self._slope(state), gg=F.sum(F.col("g") * F.col("g") / F.col("h")))
            drop(state)
            # conjugate gradients: x the step, r the rest, p the direction; z = r / h
            z = F.col("r") / F.col("h")
            cg = slope.select("id", "theta", "h", F.lit(0.0).alias("x"), F.col("g").alias("r"), (F.col("g") / F.col("h")).alias("p"))
            rz = goal = float(seen["gg"] or 0.0)
            if rz == 0.0:
                state = slope
                break
            held: DataFrame | None = None
            for _ in range(inner_steps):
                both = cg.join(self._product(cg), "id").withColumn("ap", F.col("ap") + self.penalty * F.col("p"))
                both, s = self._observed(both, pap=F.sum(F.col("p") * F.col("ap")), rap=F.sum(F.col("r") * F.col("ap") / F.col("h")), apap=F.sum(F.col("ap") * F.col("ap") / F.col("h")))
                alpha = rz / s["pap"]
                rz_new = max(0.0, rz - 2 * alpha * s["rap"] + alpha * alpha * s["apap"])
                beta, rz = rz_new / rz, rz_new
                moved = both.select("id", "theta", "h", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
                cg = moved.select("id", "theta", "h", "x", "r", (z + beta * F.col("p")).alias("p"))
                drop(held)
                held = both
                if rz <= goal * INNER_SHARE * INNER_SHARE:
                    break
            # a step is at most 2 long in each strength, so that early steps do not overshoot
            state = cg.select("id", (F.col("theta") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("x")))).alias("theta"), F.abs("x").alias("step"))
            state, seen = self._observed(state, step=F.max("step"))
            drop(held)
            drop(slope)
            self._globals(state)
            moved = float(seen["step"] or 0.0)
        last = self._slope(state)
        return self.items.join(last.select("id", "theta", "h"), "id").select("item", "games", F.col("theta").alias("strength"), (1 / F.sqrt("h")).alias("spread"))


def strongest(players: DataFrame, count: int = 12, least_games: int = 12) -> DataFrame:
    """(username): the `count` strongest players with at least `least_games` decided battles."""
    fitted = PairedComparison(pair_table(decided_battles(players))).fit()
    return fitted.where(F.col("games") >= least_games).orderBy(F.desc("strength"), "item").limit(count).select(F.col("item").alias("username"))
