"""Whole-number, bit and geographic functions as column expressions, and kernels for number theory."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import kernel

EARTH_KM = 6371.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


# Bits
def popcount(x: Column) -> Column:
    return F.bit_count(x)


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


def gray(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, 1))


def ungray(g: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        g = g.bitwiseXOR(F.shiftrightunsigned(g, shift))
    return g


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def trailing_zeros(x: Column) -> Column:
    """64 for zero."""
    return F.when(x == 0, 64).otherwise(F.bit_count((x.bitwiseAND(-x) - 1)))


def leading_zeros(x: Column) -> Column:
    """Of 64 bits; x is not negative."""
    return F.when(x == 0, 64).otherwise(64 - F.char_length(F.bin(x)))


def subset_members(mask: Column, items: int) -> Column:
    """Numbers of the items in a bit mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(items - 1)), lambda i: F.getbit(mask, i) == 1)


# Whole numbers
def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold: 64-bit numbers need at most 92."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] != 0, s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, 0).otherwise(F.abs(a).cast("long") / g * F.abs(b)).cast("long")


def modpow_of(base: int, exponent: int, modulus: int) -> int:
    return pow(int(base), int(exponent), int(modulus))


def is_prime_of(n: int) -> bool:
    """Miller-Rabin with bases that settle all 64-bit numbers."""
    n = int(n)
    if n < 2:
        return False
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    for p in bases:
        if n % p == 0:
            return n == p
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def factors_of(n: int) -> list[int]:
    n, out, p = int(n), [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1 if p == 2 else 2
    return out + ([n] if n > 1 else [])


def totient_of(n: int) -> int:
    result = int(n)
    for p in set(factors_of(n)):
        result -= result // p
    return result


def extended_gcd_of(a: int, b: int) -> list[int]:
    x0, x1, y0, y1 = 1, 0, 0, 1
    while b:
        q, a, b = a // b, b, a % b
        x0, x1, y0, y1 = x1, x0 - q * x1, y1, y0 - q * y1
    return [int(a), int(x0), int(y0)]


def crt_of(residues: list[int], moduli: list[int]) -> int | None:
    """Least solution of x = r mod m for all pairs, or null if there is none."""
    x, m = 0, 1
    for r, n in zip(residues, moduli):
        g, p, _ = extended_gcd_of(m, int(n))
        if (int(r) - x) % g:
            return None
        x += m * ((int(r) - x) // g * p % (int(n) // g))
        m = m * int(n) // g
        x %= m
    return x


def fibonacci_of(n: int) -> int:
    a, b = 0, 1
    for _ in range(int(n)):
        a, b = b, a + b
    return a


def catalan_of(n: int) -> int:
    return math.comb(2 * int(n), int(n)) // (int(n) + 1)


def partitions_of(n: int) -> int:
    ways = [1] + [0] * int(n)
    for part in range(1, int(n) + 1):
        for total in range(part, int(n) + 1):
            ways[total] += ways[total - part]
    return ways[-1]


def stirling_second_of(n: int, k: int) -> int:
    row = [1] + [0] * int(k)
    for _ in range(int(n)):
        row = [0] + [j * row[j] + row[j - 1] for j in range(1, int(k) + 1)]
    return row[-1]


def stirling_first_of(n: int, k: int) -> int:
    row = [1] + [0] * int(k)
    for m in range(int(n)):
        row = [0 if m else 0] + [m * row[j] + row[j - 1] for j in range(1, int(k) + 1)]
    return row[-1]


def tableaux_of(shape: list[int]) -> int:
    """Standard Young tableaux by hook lengths."""
    shape = [int(x) for x in shape]
    hooks = math.prod(r - j + sum(s > j for s in shape[i:]) - 1 for i, r in enumerate(shape) for j in range(r))
    return math.factorial(sum(shape)) // hooks


modpow = lambda b, e, m: kernel(modpow_of, T.LongType())(b, e, m)
is_prime = lambda n: kernel(is_prime_of, T.BooleanType())(n)
factors = lambda n: kernel(factors_of, T.ArrayType(T.LongType()))(n)
totient = lambda n: kernel(totient_of, T.LongType())(n)
extended_gcd = lambda a, b: kernel(lambda x, y: extended_gcd_of(int(x), int(y)), T.ArrayType(T.LongType()))(a, b)
partitions = lambda n: kernel(partitions_of, T.LongType())(n)


def primes_up_to(spark, n: int):
    """A sieve: every multiple of a prime up to the root is struck out by an anti join."""
    small = [p for p in range(2, math.isqrt(n) + 1) if is_prime_of(p)]
    numbers = spark.range(2, n + 1)
    if not small:
        return numbers.select(F.col("id").alias("prime"))
    struck = numbers.where(~F.exists(F.array(*map(F.lit, small)), lambda p: (F.col("id") % p == 0) & (F.col("id") != p)))
    return struck.select(F.col("id").alias("prime"))


# Geography
def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def destination(lat: Column, lon: Column, degrees: Column, distance: Column, radius: float = EARTH_KM) -> tuple[Column, Column]:
    p, b, d = F.radians(lat), F.radians(degrees), distance / radius
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(q), F.degrees(F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q)))


def geohash(lat: Column, lon: Column, length: int = 8) -> Column:
    """Base-32 cells. Each axis is halved in turn, the value on the middle line falling into the low half."""
    bits = 5 * length
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def cell(x: Column, lo: float, hi: float, n: int) -> Column:
        scaled = (x - lo) / (hi - lo) * (1 << n)
        return F.least(F.greatest(F.ceil(scaled) - 1, F.lit(0)), F.lit((1 << n) - 1)).cast("long")

    x, y = cell(lon, -180.0, 180.0, n_lon), cell(lat, -90.0, 90.0, n_lat)
    out = []
    for k in range(length):
        value = F.lit(0)
        for b in range(5 * k, 5 * k + 5):
            source, shift = (x, n_lon - 1 - b // 2) if b % 2 == 0 else (y, n_lat - 1 - b // 2)
            value = value * 2 + F.shiftright(source, shift).bitwiseAND(F.lit(1))
        out.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


# Planar geometry
def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle: positive if it turns left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_intersect(p: tuple, q: tuple, r: tuple, s: tuple) -> Column:
    """Whether segments pq and rs meet, their ends included; points are pairs of columns."""
    d1, d2, d3, d4 = F.signum(cross(*r, *s, *p)), F.signum(cross(*r, *s, *q)), F.signum(cross(*p, *q, *r)), F.signum(cross(*p, *q, *s))

    def on(a, b, c):
        return (F.least(a[0], b[0]) <= c[0]) & (c[0] <= F.greatest(a[0], b[0])) & (F.least(a[1], b[1]) <= c[1]) & (c[1] <= F.greatest(a[1], b[1]))

    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | ((d1 == 0) & on(r, s, p)) | ((d2 == 0) & on(r, s, q)) | ((d3 == 0) & on(p, q, r)) | ((d4 == 0) & on(p, q, s))
