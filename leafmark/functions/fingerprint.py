"""Content fingerprint: two polynomial lanes over UTF-16 code units, 16 hexadecimal digits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: primes, bases and seeds of the two lanes, and the period of the second lane's place salt
PRIMES = (2147483647, 2147483629)
BASES = (131, 137)
SEEDS = (18652614, 1099511628)
SALT_PERIOD = 251


def fingerprint_sql(s: Column) -> Column:
    """The fingerprint as a Column expression: a fold over the code units. For short strings."""
    data = F.encode(s, "UTF-16BE")
    n = (F.length(data) / 2).cast("int")
    unit = lambda i: F.conv(F.hex(F.substring(data, 2 * i - 1, F.lit(2))), 16, 10).cast("long")
    units = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(unit(i).alias("c"), i.cast("long").alias("i")))).otherwise(F.array().cast("array<struct<c:bigint,i:bigint>>"))
    start = F.struct(F.lit(SEEDS[0]).cast("long").alias("a"), F.lit(SEEDS[1]).cast("long").alias("b"))

    def step(acc: Column, u: Column) -> Column:
        first = (acc["a"] * BASES[0] + u["c"] + 1) % PRIMES[0]
        second = (acc["b"] * BASES[1] + u["c"] + u["i"] % SALT_PERIOD + 1) % PRIMES[1]
        return F.struct(first.alias("a"), second.alias("b"))

    lane = lambda x: F.lpad(F.hex(x), 8, "0")
    return F.aggregate(units, start, step, lambda acc: F.concat(lane(acc["a"]), lane(acc["b"])))


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^n, by doubling."""
    out = np.ones(1, dtype=np.int64)
    while len(out) <= n:
        out = np.concatenate((out, out * (int(out[-1]) * base % prime) % prime))
    return out[: n + 1]


def _units(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-16-le"), dtype="<u2").astype(np.int64)


def _points(t: str) -> np.ndarray:
    """The code points of a text; of an empty one -1, and none of a single null character."""
    if t in ("", "\0"):
        return np.array([] if t else [-1], dtype=np.int64)
    return np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype(np.int64)


def _told(units: list[np.ndarray | None]) -> pd.Series:
    longest = max((len(u) for u in units if u is not None), default=0)
    powers = [_powers(b, p, longest) for b, p in zip(BASES, PRIMES)]
    salts = np.arange(1, longest + 1) % SALT_PERIOD

    def lane(u: np.ndarray, k: int) -> str:
        n, prime = len(u), PRIMES[k]
        terms = (u + 1 + (salts[:n] if k else 0)) * powers[k][:n][::-1] % prime
        return f"{(SEEDS[k] * int(powers[k][n]) + int(terms.sum())) % prime:08X}"

    return pd.Series([None if u is None else lane(u, 0) + lane(u, 1) for u in units])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return _told([None if t is None else _units(t) for t in texts])


def _point_fingerprints(texts: pd.Series) -> pd.Series:
    return _told([None if t is None else _points(t) for t in texts])


def fingerprint(s: Column) -> Column:
    """The same fingerprint for documents: each lane is a sum of terms, added up as whole arrays."""
    return F.pandas_udf(_fingerprints, StringType())(s)


def fingerprint_points(s: Column) -> Column:
    """The fingerprint over code points instead of code units, as the SQL of the registered queries counts them: the two agree but
    for texts with characters beyond the first plane, empty ones and single null characters."""
    return F.pandas_udf(_point_fingerprints, StringType())(s)
