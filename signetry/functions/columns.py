"""Column helpers: canonical pairs, signs, conductances, labels, vectors, hashed uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def pair_low(source: str = "source", target: str = "target") -> Column:
    return F.least(source, target)


def pair_high(source: str = "source", target: str = "target") -> Column:
    return F.greatest(source, target)


def sign_of(weight: Column | str) -> Column:
    """-1, 0 or 1 as INT."""
    return F.signum(weight).cast("int")


def conductance(sign: Column | str, positive: float = 1.0, negative: float = 0.1) -> Column:
    """Conductance of a physical edge; both values must be positive."""
    if positive <= 0 or negative <= 0:
        raise ValueError("conductances must be positive")
    return F.when(F.col(sign) > 0 if isinstance(sign, str) else sign > 0, F.lit(float(positive))).otherwise(F.lit(float(negative)))


def three_class_label(sign: str = "sign") -> Column:
    """0 for a positive, 1 for a negative edge, 2 where there is none."""
    return F.when(F.col(sign).isNull(), 2).when(F.col(sign) > 0, 0).otherwise(1)


def two_class_label(sign: str = "sign") -> Column:
    """1 for a positive, 0 for a negative edge."""
    return F.when(F.col(sign) > 0, 1).otherwise(0)


def hash_key(seed: int | str, *keys: str) -> Column:
    """Hex digest of a seed and the row's own keys: a random order that does not depend on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_uniform(seed: int | str, *keys: str) -> Column:
    """A number in [0, 1) from the first 32 bits of ``hash_key``."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vec_sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalized(v: Column, floor: float = FLOOR) -> Column:
    """The vector over its length, the length being at least ``floor``."""
    norm = F.greatest(F.sqrt(vec_dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x / norm)
