"""Losses of scored pixels: ``image, truth`` and class probabilities ``probs`` (an array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bound
from .distance import distance_transforms, kind_of

# Smoothing of the region losses, Tversky weights, focal exponent.
SMOOTH, TVERSKY_FP, TVERSKY_FN, GAMMA = 1e-5, 0.5, 0.5, 2.0
# A class is predicted above this probability, and the exponent of the distance.
PREDICTED, ALPHA = 0.5, 2.0
LOSSES = ["crossentropyloss", "diceloss", "generalizeddiceloss", "focalloss", "tverskyloss", "hausdorffdtloss"]


def log_softmax(scores: Column) -> Column:
    """Log-probabilities of class scores by log-sum-exp, finite however far the scores lie apart."""
    top = bound(scores, lambda s: bound(F.array_max(s), lambda m: F.transform(s, lambda v: v - m)))
    total = lambda d: F.log(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + F.exp(x)))
    return bound(top, lambda d: bound(total(d), lambda t: F.transform(d, lambda v: v - t)))


def _ln(p: Column) -> Column:
    """Logarithm with minus infinity at 0, where the built-in one gives NULL and a sum would pass over the pixel."""
    return F.when(p > 0, F.log(p)).when(p == 0, F.lit(float("-inf")))


def _logs(scored: DataFrame) -> DataFrame:
    """``scored`` with ``logp``: from ``scores`` where the table has them, else from ``probs``, which it makes up if absent."""
    if "scores" in scored.columns:
        rows = scored.withColumn("logp", log_softmax(F.col("scores")))
        return rows if "probs" in scored.columns else rows.withColumn("probs", F.transform("logp", F.exp))
    return scored.withColumn("logp", F.transform("probs", _ln))


def cross_entropy(
    scored: DataFrame,
    weights: Sequence[float] | None = None,
    smoothing: float = 0.0,
    include_background: bool = True,
    reduction: str = "mean",
) -> DataFrame:
    """Weighted cross entropy with label smoothing, as one row ``loss``.

    Takes class ``scores`` where the table has them (finite for any scores), else ``probs``: a true class of
    probability 0 then makes the loss infinite. Pixels of class 0 are skipped without ``include_background``.
    The mean divides by the summed weights of the true classes.
    """
    rows = _logs(scored if include_background else scored.where("truth <> 0"))
    count = F.size("logp")
    own = -F.col("logp")[F.col("truth")]
    if weights is None:
        weight, spread = F.lit(1.0), F.aggregate("logp", F.lit(0.0), lambda acc, p: acc - p)
    else:
        table = F.array(*[F.lit(float(w)) for w in weights])
        weight = table[F.col("truth")]
        term = F.zip_with("logp", table, lambda p, w: F.when(w == 0, 0.0).otherwise(-w * p))
        spread = F.aggregate(term, F.lit(0.0), lambda acc, t: acc + t)
    pixel = F.when(weight == 0, 0.0).otherwise(weight * own)
    if smoothing:
        pixel = pixel * (1.0 - smoothing) + spread * smoothing / count
    total = F.sum("pixel")
    if reduction == "mean":
        total = total / F.sum("weight")
    elif reduction != "sum":
        raise ValueError(f"unknown reduction: {reduction}")
    return rows.select(pixel.alias("pixel"), weight.alias("weight")).agg(total.alias("loss"))


def _overlaps(scored: DataFrame, include_background: bool) -> DataFrame:
    """``image, class_id, tp, p, y``: soft overlap, soft size and true size, summed before the shuffle."""
    scored = scored if "probs" in scored.columns else _logs(scored)
    rows = scored.select("image", "truth", F.posexplode("probs").alias("class_id", "prob"))
    if not include_background:
        rows = rows.where("class_id > 0")
    hit = (F.col("truth") == F.col("class_id")).cast("double")
    return rows.groupBy("image", "class_id").agg(
        F.sum(F.col("prob") * hit).alias("tp"), F.sum("prob").alias("p"), F.sum(hit).alias("y")
    )


def region_loss(
    scored: DataFrame, kind: str, include_background: bool = True, reduction: str = "mean"
) -> DataFrame:
    """Dice, generalised Dice, Tversky, focal or Hausdorff loss as one row ``loss``.

    Region losses are taken per image and class (generalised Dice: per image), then reduced.
    """
    reducers = {"mean": F.avg, "sum": F.sum}
    if reduction not in reducers:
        raise ValueError(f"unknown reduction: {reduction}")
    reduce = reducers[reduction]
    if kind == "focalloss":
        return _focal(scored, include_background, reduction)
    if kind == "hausdorffdtloss":
        return _hausdorff(scored, include_background, reduction)
    tp, p, y = F.col("tp"), F.col("p"), F.col("y")
    parts = _overlaps(scored, include_background)
    if kind == "diceloss":
        return parts.agg(reduce(1.0 - (tp * 2 + SMOOTH) / (p + y + SMOOTH)).alias("loss"))
    if kind == "tverskyloss":
        missed = (p - tp) * TVERSKY_FP + (y - tp) * TVERSKY_FN
        return parts.agg(reduce(1.0 - (tp + SMOOTH) / (tp + missed + SMOOTH)).alias("loss"))
    if kind == "generalizeddiceloss":
        # A class that an image lacks takes the largest weight of that image.
        weight = F.when(y > 0, 1.0 / (y * y))
        sums = parts.groupBy("image").agg(
            F.sum(weight * tp).alias("tp_known"), F.sum(weight * (p + y)).alias("size_known"),
            F.sum(F.when(y == 0, p)).alias("size_absent"), F.max(weight).alias("top"),
        )
        zero = F.lit(0.0)
        top = F.coalesce(F.col("tp_known"), zero) * 2 + SMOOTH
        bottom = F.coalesce("size_known", zero) + F.coalesce(F.col("size_absent") * F.col("top"), zero) + SMOOTH
        return sums.agg(reduce(1.0 - top / bottom).alias("loss"))
    raise ValueError(f"unknown loss: {kind}")


def _focal(scored: DataFrame, include_background: bool, reduction: str) -> DataFrame:
    """Focal loss over the class axis. Without background the other classes are renormalised; such
    pixels then add nothing but still count in the mean, which is over pixels and classes (the sum
    is over images and classes of the mean per image)."""
    scored = _logs(scored)
    count = F.size("logp") if include_background else F.size("logp") - 1
    logp = F.col("logp")[F.col("truth")]
    if not include_background:
        # The others' total by log-sum-exp over their own largest; all zero gives minus infinity.
        rest = F.slice("logp", 2, F.greatest(F.size("logp") - 1, F.lit(0)))
        top = F.array_max(rest)
        summed = F.aggregate(rest, F.lit(0.0), lambda acc, p: acc + F.exp(p - top))
        logp = F.when(logp == float("-inf"), logp).otherwise(logp - top - F.log(summed))
    pixel = F.pow(1.0 - F.exp(logp), F.lit(GAMMA)) * -logp
    if not include_background:
        pixel = F.when(F.col("truth") > 0, pixel).otherwise(0.0)
    rows = scored.select("image", pixel.alias("pixel"), count.alias("classes"))
    if reduction == "mean":
        return rows.agg((F.sum("pixel") / F.sum("classes")).alias("loss"))
    return rows.groupBy("image").agg(F.avg("pixel").alias("m")).agg(F.sum("m").alias("loss"))


def _hausdorff(scored: DataFrame, include_background: bool, reduction: str) -> DataFrame:
    """Hausdorff loss by distance transforms; needs the places ``row_no, col_no`` of the pixels.

    Per image and class: the squared error of the probability times the mean over pixels of the distances to the
    predicted and to the true boundary, raised to ``ALPHA``. A mask that holds no or all pixels has no boundary and
    adds no distance.
    """
    scored = scored if "probs" in scored.columns else _logs(scored)
    rows = scored.select("image", "row_no", "col_no", "truth", F.posexplode("probs").alias("class_id", "prob"))
    if not include_background:
        rows = rows.where("class_id > 0")
    hit = F.col("truth") == F.col("class_id")
    errors = rows.groupBy("image", "class_id").agg(F.sum(F.pow(F.col("prob") - hit.cast("double"), F.lit(2.0))).alias("error"), F.count("*").alias("n"))
    # Both masks of every class are one raster: the predicted one of class c at 2c, the true one at 2c + 1, from the first class on.
    first = 0 if include_background else 1
    wanted = F.slice("probs", first + 1, F.greatest(F.size("probs") - first, F.lit(0)))
    masks = F.flatten(F.transform(wanted, lambda p, k: F.array(kind_of(p > PREDICTED), kind_of(F.col("truth") == k + first))))
    cells = scored.select("image", "row_no", "col_no", masks.alias("masks")).where(F.size("masks") > 0)
    far = distance_transforms(cells, ["image"], "masks").select("image", F.posexplode("d2").alias("mask", "d2"))
    # Masks that hold no or all pixels have no boundary: their distances are infinite.
    far = far.where((F.col("d2") >= 0) & (F.col("d2") < float("inf"))).withColumn("class_id", F.floor(F.col("mask") / 2).cast("int") + first)
    reach = far.groupBy("image", "class_id").agg(F.sum(F.pow("d2", F.lit(ALPHA / 2))).alias("far"))
    parts = errors.join(reach, ["image", "class_id"], "left")
    total = F.sum(F.col("error") * F.coalesce(F.col("far"), F.lit(0.0)) / F.col("n"))
    return parts.agg((total / F.sum("n") if reduction == "mean" else total).alias("loss"))


def compound_loss(
    scored: DataFrame,
    names: str | Sequence[str],
    lambdas: Sequence[float] | None = None,
    weights: Sequence[float] | None = None,
    include_background: bool = True,
    reduction: str = "mean",
    smoothing: float = 0.0,
) -> DataFrame:
    """Weighted sum of losses as one row ``loss``; each part is a scalar of its own aggregate."""
    names = [names] if isinstance(names, str) else list(names)
    lambdas = [1.0] * len(names) if lambdas is None else list(lambdas)
    if len(names) != len(lambdas):
        raise ValueError("names and lambdas differ in length")
    unknown = [n for n in names if n.lower() not in LOSSES]
    if unknown:
        raise ValueError(f"expected losses out of {LOSSES}, got {unknown}")
    total = F.lit(0.0)
    for name, factor in zip(names, lambdas):
        if name.lower() == "crossentropyloss":
            part = cross_entropy(scored, weights, smoothing, include_background, reduction)
        else:
            part = region_loss(scored, name.lower(), include_background, reduction)
        total = total + part.scalar() * float(factor)
    return scored.sparkSession.range(1).select(total.alias("loss"))
