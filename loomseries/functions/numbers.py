"""Number theory, bases, companding and checksums over columns."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SMALL_PRIMES = [p for p in range(2, 1000) if all(p % q for q in range(2, int(p**0.5) + 1))]
# With these bases the test below is exact for all numbers of 64 bits.
_WITNESSES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def _is_prime(n: int) -> bool:
    """Strong probable prime to all witnesses."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in _WITNESSES:
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _split(n: int) -> int:
    """A proper divisor of a composite number, by cycle finding on x -> x * x + c."""
    root = math.isqrt(n)
    if root * root == n:
        return root
    c = 1
    while True:
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(abs(x - y), n)
        if d != n:
            return d
        c += 1


def _factors(n: int) -> list[int]:
    """Prime factors in ascending order, with repeats."""
    found = []
    for p in _SMALL_PRIMES:
        while n % p == 0:
            found.append(p)
            n //= p
        if p * p > n:
            break
    rest = [n] if n > 1 else []
    while rest:
        n = rest.pop()
        if n < 1_000_000 or _is_prime(n):  # no factor below 1000 is left
            found.append(n)
        else:
            d = _split(n)
            rest += [d, n // d]
    return sorted(found)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _factor_arrays(numbers: pd.Series) -> pd.Series:
    known = {n: _factors(int(n)) for n in numbers.dropna().unique() if n >= 2}
    return pd.Series([known.get(n) for n in numbers], dtype=object)


def prime_factors(n: Column) -> Column:
    """Prime factors of n >= 2 in ascending order, with repeats; NULL for others. Exact for all of 64 bits."""
    # NULL would turn the numbers of its batch into doubles.
    return _factor_arrays(F.coalesce(n.cast("long"), F.lit(0).cast("long")))


def divisors(n: Column) -> Column:
    """Divisors of a positive whole number in ascending order, made from its prime factors."""

    def more(found, p):
        # Every divisor so far, and those times p; repeats of a prime give repeats, which the union drops.
        return F.array_union(found, F.transform(found, lambda d: d * p))

    one = F.array(F.lit(1).cast("long"))
    return F.when(n == 1, one).when(n > 1, F.array_sort(F.aggregate(prime_factors(n), one, more)))


def divisor_square_sum(n: Column) -> Column:
    return F.aggregate(divisors(n), F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))


def proper_divisor_sum(n: Column) -> Column:
    return F.aggregate(divisors(n), F.lit(0).cast("long"), lambda acc, d: acc + d) - n


def is_abundant(n: Column) -> Column:
    return proper_divisor_sum(n) > n


# Fixed value: every whole number above it is a sum of two abundant numbers.
ABUNDANT_LIMIT = 28123


def _abundant_sums(spark: SparkSession) -> DataFrame:
    """Every number up to the limit that is the sum of two abundant numbers: a table of at most 28,123 rows."""
    least = spark.range(1, ABUNDANT_LIMIT // 2 + 1).selectExpr("id AS d", f"explode(sequence(2 * id, {ABUNDANT_LIMIT}, id)) AS n")
    abundant = least.groupBy("n").agg(F.sum("d").alias("s")).filter("s > n").select("n")

    def sums(batches):
        marks = np.zeros(ABUNDANT_LIMIT + 1, bool)
        for pdf in batches:
            marks[pdf["n"].to_numpy()] = True
        reached = np.zeros_like(marks)
        for a in np.flatnonzero(marks):
            reached[a:] |= marks[: len(marks) - a]
        yield pd.DataFrame({"_sum": np.flatnonzero(reached)})

    return abundant.coalesce(1).mapInPandas(sums, "_sum bigint")


def sum_of_abundant(df: DataFrame, n: str) -> DataFrame:
    """Add ``is_sum``: is ``n`` the sum of two abundant numbers? NULL for NULL.

    Only numbers up to the limit need a look, in a table of a fixed size.
    """
    number = F.col(n).cast("long")
    met = df.join(_abundant_sums(df.sparkSession), number == F.col("_sum"), "left")
    return met.withColumn("is_sum", F.when(number.isNotNull(), (number > ABUNDANT_LIMIT) | F.col("_sum").isNotNull())).drop("_sum")


def to_base(n: Column, alphabet: str) -> Column:
    """A non-negative number written with the digits of ``alphabet``."""
    base = len(alphabet)
    if base < 2 or len(set(alphabet)) != base:
        raise ValueError("an alphabet needs at least two different digits")
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("text"))
    places = F.sequence(F.lit(1), F.lit(64))

    def digit(acc, i):
        one = F.substring(F.lit(alphabet), (acc["left"] % base + 1).cast("int"), F.lit(1))
        more = (i == 1) | (acc["left"] > 0)
        return F.struct(
            F.when(more, F.call_function("div", acc["left"], F.lit(base).cast("long"))).otherwise(acc["left"]).alias("left"),
            F.when(more, F.concat(one, acc["text"])).otherwise(acc["text"]).alias("text"))

    return F.aggregate(places, start, digit)["text"]


def alaw_encode(pcm: Column) -> Column:
    """16-bit sample to its 8-bit A-law code: sign, segment, four bits, then every second bit inverted."""
    size = F.when(pcm < 0, -pcm - 1).otherwise(pcm).cast("int")
    # The segment is the place of the highest set bit above bit 7, at most 7.
    segment = F.when(size < 256, 0).otherwise(F.floor(F.log2(size.cast("double"))).cast("int") - 7)
    four = F.when(segment == 0, F.shiftright(size, 4)).otherwise(
        F.floor(size / F.pow(F.lit(2.0), segment + 3)).cast("int")).bitwiseAND(F.lit(15))
    sign = F.when(pcm < 0, 128).otherwise(0)
    return (sign + segment * 16 + four).bitwiseXOR(F.lit(0xD5))


def alaw_decode(code: Column) -> Column:
    plain = code.bitwiseXOR(F.lit(0xD5))
    segment = F.shiftright(plain.bitwiseAND(F.lit(0x70)), 4)
    base = plain.bitwiseAND(F.lit(15)) * 16 + 8 + F.when(segment > 0, 256).otherwise(0)
    size = (base * F.pow(F.lit(2.0), F.greatest(segment - 1, F.lit(0)))).cast("int")
    return F.when(plain.bitwiseAND(F.lit(128)) != 0, -size).otherwise(size)


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


@F.pandas_udf(T.StringType())
def blake2b(text: pd.Series) -> pd.Series:
    """BLAKE2b-512 of the UTF-8 bytes, in hex."""
    return text.map(lambda v: None if v is None else hashlib.blake2b(v.encode()).hexdigest())
