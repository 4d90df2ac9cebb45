"""Comparison of embeddings: pairs, centroids, gates, thresholds.

Tables of vectors have recording, id, label and vector (array of double, unit length). Pairs are made
within a recording only, by an equality join, so they grow with the number of recordings and not with
the square of all vectors.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions import vectors as V
from palaver.operators.evaluation import index_pick
from palaver.streaming.run import shared_dir

T_ASSIGN, T_MARGIN, COHORT_MIN, T_ZNORM, T_RETIRE, T_MINT_MARGIN, T_MINT_CEILING, T_GAP_CHANGE, MAX_BRIDGED = 0.45, 0.10, 4, 2.0, 0.80, 0.20, 0.55, 0.37, 2


def pairs(rows: DataFrame) -> DataFrame:
    """Unordered pairs of one recording with their cosine; ``same`` label or not."""
    a = rows.select("recording", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("vector").alias("va"))
    b = rows.select("recording", F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("vector").alias("vb"))
    return a.join(b, "recording").filter("a < b").select("recording", "a", "b", (F.col("label_a") == F.col("label_b")).alias("same"), V.cosine(F.col("va"), F.col("vb")).alias("cos"))


def means(rows: DataFrame) -> DataFrame:
    """The unit mean of the vectors (of one size) of each recording and label, and how many there are.

    Whole vectors are averaged, and partial sums are combined before the shuffle.
    """
    told = rows.select("recording", "label", array_to_vector("vector").alias("v")).groupBy("recording", "label").agg(Summarizer.metrics("mean", "count").summary(F.col("v")).alias("s"))
    return told.select("recording", "label", F.col("s.count").alias("n"), V.l2_normalize(vector_to_array("s.mean")).alias("vector"))


def cohesion(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """The least cosine of a centroid with its members."""
    c = centroids.select("recording", "label", F.col("vector").alias("c"))
    return rows.join(c, ["recording", "label"]).groupBy("recording", "label").agg(F.min(V.cosine(F.col("c"), F.col("vector"))).alias("cohesion"))


def scores(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every vector against the centroids of its recording: (recording, id, label, cos)."""
    c = centroids.select("recording", F.col("label").alias("c_label"), F.col("vector").alias("c"))
    return rows.join(c, "recording").select("recording", "id", F.col("c_label").alias("label"), V.cosine(F.col("vector"), F.col("c")).alias("cos"))


def nearest(scored: DataFrame) -> DataFrame:
    """The best label by cosine; scores that aren't numbers are left out, ties go to the highest label."""
    return scored.filter(~F.isnan("cos")).groupBy("recording", "id").agg(F.max(F.struct("cos", "label")).alias("b")).select("recording", "id", F.col("b.label").alias("label"), F.col("b.cos").alias("cos"))


def gated(scored: DataFrame, t_assign: float = T_ASSIGN, margin: float = T_MARGIN, cohort: int = COHORT_MIN, t_z: float = T_ZNORM) -> DataFrame:
    """The label that stands out, or null: the best score reaches ``t_assign``, leads the second by
    ``margin``, and, among at least ``cohort`` scores, lies ``t_z`` deviations above the others.
    Scores that are not finite refuse; a margin of 0 turns the last two off."""
    by = Window.partitionBy("recording", "id")
    ranked = scored.withColumn("_r", F.row_number().over(by.orderBy(F.desc("cos"), F.desc("label"))))
    rest = F.when(F.col("_r") > 1, F.col("cos"))
    sums = ranked.groupBy("recording", "id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_r") == 1, F.struct("cos", "label"))).alias("b"), F.max(rest).alias("s2"), F.avg(rest).alias("mean"), F.stddev_samp(rest).alias("sd"),
    )
    s1 = F.col("b.cos")
    passes = V.finite(s1) & (s1 >= t_assign)
    if margin > 0:
        z = (s1 - F.col("mean")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1e-6))
        passes = passes & (F.col("s2").isNull() | (s1 - F.col("s2") >= margin)) & ((F.col("n") < cohort) | (~F.isnan(z) & (z >= t_z)))
    return sums.select("recording", "id", F.when(passes, F.col("b.label")).alias("label"), s1.alias("cos"))


def may_mint(cohesion_: Column, rival: Column, t_assign: float = T_ASSIGN, margin: float = T_MARGIN, ceiling: float = T_MINT_CEILING, t_retire: float = T_RETIRE, lead: float = T_MINT_MARGIN) -> Column:
    """Whether a new centroid may be made beside its nearest rival (null: none)."""
    crowded = F.lit(False) if margin <= 0 else (rival < min(ceiling, t_retire)) & (cohesion_ - rival >= lead)
    return F.when(rival.isNull(), True).when(F.isnan(rival), False).when(rival < t_assign, True).otherwise(crowded)


def crowding(centroids: DataFrame) -> DataFrame:
    """Pairs of centroids of a recording with their cosine, closest first by ``rank``."""
    made = pairs(centroids.withColumn("id", F.col("label")))
    rank = F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("cos"), "a", "b"))
    return made.select("recording", "a", "b", "cos", rank.alias("rank"))


def best_split(pair_rows: DataFrame, steps: int = 100) -> DataFrame:
    """Per recording the threshold on a grid of hundredths with the least mean of both error rates; the
    first of equals. Scores are put on the grid first, so no score meets every threshold."""
    cell = F.greatest(F.lit(-1), F.least(F.floor(F.col("cos") * steps), F.lit(steps)))
    at = F.when(F.col("cos") < 0, F.lit(-1)).otherwise(cell).cast("int")
    cells = pair_rows.withColumn("k", at).groupBy("recording", "k").agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("d"))
    grid = pair_rows.select("recording").distinct().withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(steps))))
    by = Window.partitionBy("recording")
    run = by.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    full = grid.join(cells, ["recording", "k"], "left").fillna(0, ["s", "d"])
    full = full.withColumns({"below": F.coalesce(F.sum("s").over(run), F.lit(0)), "diff_below": F.coalesce(F.sum("d").over(run), F.lit(0)), "all_s": F.sum("s").over(by), "all_d": F.sum("d").over(by)})
    error = (F.col("below") / F.nullif("all_s", F.lit(0)) + (F.col("all_d") - F.col("diff_below")) / F.nullif("all_d", F.lit(0))) / 2
    best = full.filter(F.col("k").between(0, steps - 1)).withColumn("error", error).filter("error IS NOT NULL").groupBy("recording").agg(F.min(F.struct("error", "k")).alias("b"))
    return best.select("recording", (F.col("b.k") / steps).alias("threshold"), F.col("b.error").alias("error"))


def gap_tally(decisions: DataFrame, thresholds: list[float], most_restarts: int = MAX_BRIDGED) -> DataFrame:
    """Per threshold the seams discarded within a speaker (correct) and across two (crossings).

    Decisions have cos, before, after and restarts. A comparison over too many silences, or that is
    not finite, never discards. The thresholds are a short list and become aggregates of one pass.
    """
    bounded = F.lit(False) if most_restarts == 0 else F.col("restarts") > most_restarts
    known = F.col("before").isNotNull() & F.col("after").isNotNull()
    sums = [F.count_if(V.finite(F.col("cos")) & ~bounded & (F.col("cos") >= t) & known & c).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in (("c", F.col("before") == F.col("after")), ("x", F.col("before") != F.col("after")))]
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("correct"), F.col(f"x{i}").alias("crossings")) for i, t in enumerate(thresholds)]
    return decisions.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def hop_decisions(hops_: DataFrame, order_by: str = "chunk") -> DataFrame:
    """Each hop (recording, chunk, vector, label, restarts since the hop before it) against the one before:
    cos, before, after, restarts, before_chunk, after_chunk. The first of a recording has nothing before it.
    Where hops of a recording share a chunk, ``order_by`` has to name a column that tells them apart."""
    order = Window.partitionBy("recording").orderBy(order_by)
    lag = lambda c: F.lag(c).over(order)
    out = hops_.select("recording", V.cosine(F.col("vector"), lag("vector")).alias("cos"), lag("label").alias("before"), F.col("label").alias("after"), "restarts", lag("chunk").alias("before_chunk"), F.col("chunk").alias("after_chunk"))
    return out.filter("before_chunk IS NOT NULL")


def gap_decisions(hops_: DataFrame, order_by: str = "chunk") -> DataFrame:
    """Of :func:`hop_decisions` those over at least one silence."""
    return hop_decisions(hops_, order_by).filter("restarts > 0")


def worst_crossings(decisions: DataFrame, most: int = 5) -> DataFrame:
    """Per recording the ``most`` real changes of speaker that sound most alike, equal ones in order of their
    hops; ``rank`` from 1."""
    real = decisions.filter(F.col("before") != F.col("after"))  # both are known
    rank = F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("cos"), "after_chunk", "before_chunk"))
    return real.withColumn("rank", rank).filter(F.col("rank") <= most)


def bridged(decisions: DataFrame) -> DataFrame:
    """Per recording how many chunks decisions bridge (median, ninth decile, most), and how many bridge
    more than one silence. Order statistics are by floor index."""
    chunks = decisions.withColumn("bridged", F.greatest(F.col("after_chunk") - F.col("before_chunk"), F.lit(0)))
    picks = index_pick(chunks, ["recording"], "bridged", {"p50": (1, 2), "p90": (9, 10), "most": (1, 1)}, minus=1)
    return picks.join(chunks.groupBy("recording").agg(F.count_if(F.col("restarts") > 1).alias("several")), "recording")


def normalise_features(rows: DataFrame, variance: bool) -> DataFrame:
    """Features (recording, frame, feats) with the mean of each dimension taken off, and scaled to unit
    deviation of the population (floor 1e-5) if asked."""
    stats = rows.select("recording", array_to_vector("feats").alias("v")).groupBy("recording").agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s"))
    whole = F.col("s.count")
    spread = F.transform(vector_to_array("s.variance"), lambda x: F.greatest(F.sqrt(x * (whole - 1) / whole), F.lit(1e-5)))
    stats = stats.select("recording", vector_to_array("s.mean").alias("m"), spread.alias("s"))
    off = F.zip_with("feats", "m", lambda x, m: x - m)
    scaled = F.zip_with(off, "s", lambda x, s: x / s) if variance else off
    return rows.join(stats, "recording").select("recording", "frame", F.posexplode(scaled).alias("d", "x"))


def transposed(rows: Column) -> Column:
    """An array of equally long rows as an array of its columns."""
    width = F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(rows, lambda r: F.get(r, j)))).otherwise(F.slice(rows, 1, 0))


def resolve(forwards: DataFrame) -> DataFrame:
    """Follows (label, retired_into) to a label that is live, however long the chain: the steps double each
    round, until no label moves. A chain that ends in a circle has no live label, and is an error."""
    now = forwards.select("label", F.coalesce("retired_into", "label").alias("to"))
    shared_dir(forwards.sparkSession)
    longest, steps = forwards.count(), 1
    while True:
        step = now.select(F.col("label").alias("to"), F.col("to").alias("next"))
        after = now.join(step, "to", "left").select("label", F.coalesce("next", "to").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        after = after.checkpoint()
        moved = after.filter("moved").limit(1).count()
        now, steps = after.select("label", "to"), 2 * steps
        if not moved:
            return now
        if steps > 2 * longest:
            raise ValueError("labels retired into each other in a circle")
