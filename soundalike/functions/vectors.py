"""Vector expressions over ``array<double>`` columns (inventory C1-C14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundalike.functions.layout import FOCUS

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity; 0 where either norm is 0, NULL where a side is NULL."""
    scale = norm(a) * norm(b)
    missing = col(a).isNull() | col(b).isNull()
    return F.when(missing, F.lit(None).cast("double")).when(
        scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """C2."""
    return F.lit(1.0) - cosine(a, b)


def gather(v: ColumnOrName, dims: Sequence[int]) -> Column:
    """The elements at ``dims`` (0-based); positions past the end are skipped."""
    dims = list(dims)
    if dims and dims == list(range(dims[0], dims[0] + len(dims))):
        return F.slice(col(v), dims[0] + 1, len(dims))
    picked = F.array(*[F.get(col(v), F.lit(i)) for i in dims])
    return F.filter(picked, lambda x: x.isNotNull())


def parse_vector(c: ColumnOrName) -> Column:
    """``"[0.1, 0.2]"`` -> ``array<double>``; NULL where it is not a JSON list."""
    return F.from_json(col(c), "array<double>")


def midpoint(a: ColumnOrName, b: ColumnOrName) -> Column:
    """C5."""
    return F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2)


def unit(v: ColumnOrName, floor: float | None = None) -> Column:
    """L2-normalised vector; a zero vector is returned unchanged.

    With ``floor`` the norm is floored instead, which also keeps zeros at zero.
    """
    n = norm(v)
    scale = F.greatest(n, F.lit(floor)) if floor is not None else F.when(
        n == 0, F.lit(1.0)).otherwise(n)
    # The one-element array makes the norm a lambda variable, evaluated once per row.
    return F.get(
        F.transform(F.array(scale), lambda s: F.transform(col(v), lambda x: x / s)), F.lit(0))


def exact_in_float(v: ColumnOrName) -> Column:
    """Whether every element keeps its value in four bytes."""
    return F.forall(col(v), lambda x: x.isNull() | (x == x.cast("float").cast("double")))


def packed(v: ColumnOrName) -> Column:
    """A vector to be moved: four bytes an element if that is exact, else as it is.  See :func:`unpacked`."""
    exact = F.coalesce(exact_in_float(v), F.lit(False))
    return F.struct(F.when(exact, col(v).cast("array<float>")).alias("narrow"), F.when(~exact, col(v)).alias("wide"))


def unpacked(p: ColumnOrName) -> Column:
    """The vector that :func:`packed` packed, the same in every element."""
    return F.coalesce(col(p)["narrow"].cast("array<double>"), col(p)["wide"])


def fold_chroma(h36: ColumnOrName, bins: int = 12, per_bin: int = 3) -> Column:
    """Sum groups of consecutive sub-bins."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.aggregate(
            F.slice(col(h36), i * per_bin + 1, per_bin), F.lit(0.0), lambda s, x: s + x))


def diagonal_sqrt(matrix: ColumnOrName) -> Column:
    """Square roots of the diagonal of an ``array<array<double>>``."""
    return F.transform(col(matrix), lambda row, i: F.sqrt(F.get(row, i)))


def assemble(mfcc_mean: ColumnOrName, mfcc_cov: ColumnOrName, chroma36: ColumnOrName,
             scalars: Sequence[ColumnOrName]) -> Column:
    """Descriptor columns -> one feature vector."""
    return F.concat(
        col(mfcc_mean), diagonal_sqrt(mfcc_cov), fold_chroma(chroma36),
        F.array(*[col(s).cast("double") for s in scalars]))


def zscore(v: ColumnOrName, mean: ColumnOrName, std: ColumnOrName) -> Column:
    """Element-wise ``(x - mean) / std``; a std of 0 counts as 1.

    Where there are no statistics the vector is returned as it is.
    """
    scaled = F.transform(
        F.arrays_zip(col(v).alias("x"), col(mean).alias("m"), col(std).alias("s")),
        lambda e: (e["x"] - e["m"]) / F.when(e["s"] == 0, F.lit(1.0)).otherwise(e["s"]))
    return F.when(col(mean).isNull() | col(std).isNull(), col(v)).otherwise(scaled)


def valid_vector(v: ColumnOrName, n: int) -> Column:
    """Right length, no missing and no NaN element."""
    return F.coalesce(
        (F.size(col(v)) == n)
        & ~F.exists(col(v), lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def category_units(v: ColumnOrName, layout: Mapping[str, Sequence[int]] = FOCUS,
                   weights: Mapping[str, Column] | None = None) -> Column:
    """Each category slice scaled to unit length (times its weight), in place.

    The dot product of two such vectors is the weighted sum of the per-category
    cosines, so a pair costs one pass instead of five.
    """
    width = 1 + max(i for dims in layout.values() for i in dims)
    owner = {i: name for name, dims in layout.items() for i in dims}
    runs = [(name, len(list(group)))
            for name, group in groupby(owner.get(i) for i in range(width))]

    def factor(n: Column, name: str) -> Column:
        w = weights[name] if weights else F.lit(1.0)
        return F.when(n == 0, F.lit(0.0)).otherwise(w / n).alias(name)

    factors = F.struct(*[factor(norm(gather(v, dims)), name) for name, dims in layout.items()])

    def scaled(f: Column) -> Column:
        by_position = F.concat(*[
            F.array_repeat(f[name] if name else F.lit(0.0), count) for name, count in runs])
        return F.zip_with(col(v), by_position, lambda x, y: F.coalesce(x * y, F.lit(0.0)))

    return F.get(F.transform(F.array(factors), scaled), F.lit(0))


def category_part(v: ColumnOrName, name: str, layout: Mapping[str, Sequence[int]] = FOCUS) -> Column:
    """What the units of one category are made of: as many elements of ``v`` as the category has, NULL if ``v`` has none.

    With ``{name: range(n)}`` as its layout the part has the units that ``v`` has there.  Positions past the end
    are 0, and so are missing elements where :func:`gather` skips them.  If a unit of any category of ``v`` is
    NaN, all of the part is, as is a sum over all categories.  Elements past the layout's end follow as zeros.
    """
    v, dims = col(v), list(layout[name])
    skips = dims != list(range(dims[0], dims[0] + len(dims)))
    elements = [F.when(F.size(v) > i, F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)) if skips else F.get(v, F.lit(i)))
                .otherwise(0.0) for i in dims]
    nan = F.array_repeat(F.lit(float("nan")), len(dims))
    part = F.when(F.exists(category_units(v, layout), F.isnan), nan).otherwise(F.array(*elements))
    width = 1 + max(i for own in layout.values() for i in own)
    return F.when(F.size(v) > 0, F.concat(part, F.array_repeat(F.lit(0.0), F.greatest(F.size(v) - width, F.lit(0)))))


def feature_similarity(q: ColumnOrName, r: ColumnOrName,
                       layout: Mapping[str, Sequence[int]] = FOCUS,
                       focus: str | None = None,
                       weights: ColumnOrName | None = None) -> Column:
    """C11: focus slice, genre-weighted slices, or the whole vector.

    ``weights`` is a ``map<string,double>`` column; an absent category counts
    1/number of categories, the weights are then scaled to sum to one.
    """
    if focus is not None:
        dims = layout[focus]
        return cosine(gather(q, dims), gather(r, dims))
    if weights is None:
        return cosine(q, r)
    share = normalised_weights(col(weights), layout)
    mixed = F.lit(0.0)
    for name, dims in layout.items():
        mixed = mixed + share[name] * cosine(gather(q, dims), gather(r, dims))
    return F.when(has_weights(col(weights)), mixed).otherwise(cosine(q, r))


def has_weights(weights: Column) -> Column:
    return F.coalesce(F.size(weights) > 0, F.lit(False))


def normalised_weights(weights: Column, layout: Mapping[str, Sequence[int]] = FOCUS
                       ) -> dict[str, Column]:
    raw = {name: F.coalesce(
        F.try_element_at(weights, F.lit(name)), F.lit(1.0 / len(layout))) for name in layout}
    total = sum(raw.values(), F.lit(0.0))
    return {name: F.when(total > 0, w / total).otherwise(w) for name, w in raw.items()}


def grouped_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Fixed group weights with a tempo-aware rhythm term."""
    # Slice -> weight, the rhythm slice last.
    groups = (((0, 13), 0.30), ((13, 26), 0.10), ((26, 38), 0.25), ((38, 40), 0.20))
    total = F.lit(0.0)
    for (lo, hi), w in groups:
        total = total + w * cosine(gather(a, range(lo, hi)), gather(b, range(lo, hi)))
    tempo = 1.0 - F.least(F.abs(F.get(col(a), F.lit(40)) - F.get(col(b), F.lit(40))) / 50.0,
                          F.lit(1.0))
    rest = cosine(gather(a, range(41, 44)), gather(b, range(41, 44)))
    return total + 0.15 * (0.5 * tempo + 0.5 * rest)
