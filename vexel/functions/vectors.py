"""Column expressions on float vectors, and the same as SQL functions. Sums run left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def l2_sq(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; NULL for unequal lengths."""
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.when(F.size(_col(a)) == F.size(_col(b)), _sum(F.zip_with(_col(a), _col(b), gap)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.when(F.size(_col(a)) == F.size(_col(b)), _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column | str, epsilon: float = 0.0) -> Column:
    """Unit vector in double; NULL elements for the zero vector (unless epsilon is set). The norm is bound once, not for each element."""
    scaled = lambda n: F.transform(_col(a), lambda x: F.try_divide(x.cast("double"), n + F.lit(epsilon)))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def residual(a: Column | str, center: Column | str) -> Column:
    """Differences in single precision, as they enter the product quantizer."""
    return F.zip_with(_col(a), _col(center), lambda x, y: (x.cast("float") - y.cast("float")).cast("float"))


def cosine_unit(distance: Column | str) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return F.lit(1.0) - _col(distance) / F.lit(2.0)


def subtract_scaled(a: Column | str, b: Column | str, alpha: float) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - F.lit(alpha) * y.cast("double"))


def subvector(a: Column | str, s: Column | int, width: int) -> Column:
    return F.slice(_col(a), s * width + 1 if isinstance(s, Column) else F.lit(s * width + 1), F.lit(width))


def token_of_url(url: Column | str) -> Column:
    """Last path segment, without query, fragment and trailing slashes."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(_col(url), r"[?#].*$", ""), F.lit("/")), "/"), -1)


SQL_FUNCTIONS = {
    "l2_sq": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)",
    "dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "normalize": "(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN get(transform(array(sqrt(aggregate(transform(a, x -> x * x), 0D, (s, v) -> s + v))), n -> transform(a, x -> try_divide(x, n))), 0)",
    "cosine_unit": "(d DOUBLE) RETURNS DOUBLE RETURN 1D - d / 2D",
}


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions l2_sq, dot, normalize and cosine_unit; they are inlined into the plan."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
