"""Column functions on vectors (``array<float>`` / ``array<double>``), in double precision.

Two forms of the same maths:

* higher-order functions, which stay in the JVM and suit short vectors;
* Arrow functions (``*_arrow``), one numpy call per batch, for wide vectors.

``PYTHON_WIDTH`` is where the second starts to win; ``score`` picks by ``width``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from echoframe.functions import constants as C
from echoframe.functions.text import ColumnLike, _col, let

PYTHON_WIDTH = 256
SQRT_D = "sqrt_d_model"

Scale = float | int | str | None


RAW = (None, "raw", "none")


def scale_for(scale: Scale, width, root=math.sqrt):
    """The norm that a scale setting asks of vectors of this width; None leaves them raw.

    The one rule for numbers and columns: a column width comes with a column root.
    """
    if scale in RAW:
        return None
    return root(width) if scale == SQRT_D else float(scale)


def default_injection_scale(d_model: int) -> float:
    return C.INJECTION_SCALE_FACTOR * math.sqrt(d_model)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(v: ColumnLike) -> Column:
    return F.aggregate(
        _col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def l2_norm(v: ColumnLike) -> Column:
    return F.sqrt(squared_norm(v))


def _scale_column(v: Column, scale: Scale) -> Column | None:
    target = scale_for(scale, F.size(v).cast("double"), F.sqrt)
    return F.lit(target) if isinstance(target, float) else target


def normalize(v: ColumnLike, scale: Scale = SQRT_D) -> Column:
    """Bring ``v`` to L2 norm ``scale``; the identity for a raw scale.

    The norm is folded once per row into a one-element array, because a lambda
    body that mentions the norm directly would recompute it per element.
    """
    v = _col(v)
    target = _scale_column(v, scale)
    doubles = v.cast("array<double>")
    if target is None:
        return doubles
    factor = F.greatest(l2_norm(v), F.lit(C.NORM_FLOOR)) / target
    return let(factor, lambda f: F.transform(doubles, lambda x: x / f))


def same_length(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where two vectors differ in length; NULL vectors pass."""
    message = F.concat(F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(message).cast("double")).otherwise(value)


def mse(pred: ColumnLike, gold: ColumnLike, scale: Scale = SQRT_D) -> Column:
    """Mean squared difference of the two normalised vectors.

    Uses |p|^2 - 2 p.g + |g|^2 with the norms known after scaling, so neither
    normalised vector is ever built; a raw scale takes plain differences.
    """
    p, g = _col(pred), _col(gold)
    size = F.size(g).cast("double")
    target = _scale_column(g, scale)
    if target is None:
        diff = F.zip_with(p, g, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
        return same_length(p, g, _sum(diff) / size)
    np_, ng = F.greatest(l2_norm(p), F.lit(C.NORM_FLOOR)), F.greatest(l2_norm(g), F.lit(C.NORM_FLOOR))
    fp, fg = target / np_, target / ng
    total = (
        squared_norm(p) * fp * fp - F.lit(2.0) * dot(p, g) * fp * fg + squared_norm(g) * fg * fg
    )
    # Rounding may leave a tiny negative; greatest() would turn a NULL into 0.
    return same_length(p, g, F.when(total < 0, F.lit(0.0)).otherwise(total) / size)


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    norms = F.greatest(l2_norm(a), F.lit(C.NORM_FLOOR)) * F.greatest(l2_norm(b), F.lit(C.NORM_FLOOR))
    return same_length(_col(a), _col(b), dot(a, b) / norms)


def value_at_last_valid(values: ColumnLike, mask: ColumnLike) -> Column:
    """Entry at ``sum(mask) - 1``, NULL when nothing is valid."""
    valid = F.aggregate(_col(mask), F.lit(0), lambda acc, m: acc + m.cast("int"))
    return F.when(valid > 0, F.try_element_at(_col(values), F.when(valid > 0, valid)))


def token_logprob(logits: ColumnLike, target: ColumnLike) -> Column:
    """Log-softmax of ``logits`` at the 0-based ``target`` id."""
    logits = _col(logits)
    lse = let(
        F.array_max(logits),
        lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
    )
    return F.get(logits, _col(target).cast("int")) - lse


# ---- Arrow forms --------------------------------------------------------------


def as_matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list array -> (row mask of non-NULL vectors, matrix of those vectors)."""
    present = np.asarray(values.is_valid())
    lists = values.drop_null()
    if len(lists) == 0:
        return present, np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.size % len(lists):
        raise ValueError("vectors of different lengths in one column")
    return present, flat.reshape(len(lists), -1)


def scale_rows(m: np.ndarray, target: float | None) -> np.ndarray:
    if target is None:
        return m
    norms = np.maximum(np.linalg.norm(m, axis=1, keepdims=True), C.NORM_FLOOR)
    return m / (norms / target)


def score_arrow(scale: Scale = SQRT_D):
    """Arrow function ``(pred, gold) -> struct<mse, cos>``; NULL where a side is NULL."""

    @F.arrow_udf("struct<mse:double,cos:double>")
    def score_batch(pred: pa.Array, gold: pa.Array) -> pa.Array:
        both = np.asarray(pred.is_valid()) & np.asarray(gold.is_valid())
        out_mse, out_cos = np.zeros(len(both)), np.zeros(len(both))
        if both.any():
            _, p = as_matrix(pred.filter(pa.array(both)))
            _, g = as_matrix(gold.filter(pa.array(both)))
            target = scale_for(scale, g.shape[1])
            out_mse[both] = ((scale_rows(p, target) - scale_rows(g, target)) ** 2).mean(axis=1)
            norms = np.maximum(np.linalg.norm(p, axis=1), C.NORM_FLOOR) * np.maximum(
                np.linalg.norm(g, axis=1), C.NORM_FLOOR
            )
            out_cos[both] = (p * g).sum(axis=1) / norms
        missing = ~both
        return pa.StructArray.from_arrays(
            [pa.array(out_mse, mask=missing), pa.array(out_cos, mask=missing)], names=["mse", "cos"]
        )

    return score_batch


def normalize_arrow(scale: Scale = SQRT_D):
    """Arrow function ``v -> array<double>``, the wide twin of :func:`normalize`."""

    @F.arrow_udf("array<double>")
    def normalize_batch(v: pa.Array) -> pa.Array:
        present, m = as_matrix(v)
        width = m.shape[1]
        rows = scale_rows(m, scale_for(scale, width)) if len(m) else m
        offsets = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(rows.reshape(-1)), mask=pa.array(~present)
        )

    return normalize_batch


def score(pred: ColumnLike, gold: ColumnLike, scale: Scale = SQRT_D, width: int | None = None) -> Column:
    """Struct (mse, cos) of a prediction against gold.

    Pass ``width`` when it is known: wide vectors go through numpy.
    """
    if width is not None and width > PYTHON_WIDTH:
        return score_arrow(scale)(_col(pred), _col(gold))
    return F.struct(mse(pred, gold, scale).alias("mse"), cosine(pred, gold).alias("cos"))
