"""Families of number exercises: parameters to expected answers, difficulty and signatures, as Column functions of bigint columns.

Answers that do not fit bigint, and parameters that are missing, give null.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: The families.
FAMILIES = ("gcd", "gcd_divisor_sum", "units_digit", "divisor_sum", "divisor_sum_mod", "stars_and_bars", "arithmetic_series", "modular_congruence")

#: Words of the workshop that a public statement must not have.
INTERNAL = ("checkpoint", "parent", "certified", "generated", "mutation", "crossover", "pipeline", "operator", "proof obligation", "Lean", "formal")

_MOST = 2**63 - 1

#: How a solution states its answer, best first.
CLAIMS = (r"(?i)(?:answer|therefore|so|hence|remainder)\s*(?:is|=|:)\s*(-?\d+)", r"(?i)(?:boxed|\\boxed)\{?(-?\d+)\}?", r"(-?\d+)")


def _primes(most: int) -> list[int]:
    sieve = np.ones(most + 1, bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(most) + 1):
        sieve[p * p :: p] &= not sieve[p]
    return np.flatnonzero(sieve).tolist()


#: Primes that all numbers of a batch are divided by together; what is left then is split number by number.
_SMALL = _primes(1 << 16)


def _is_prime(n: int) -> bool:
    """Of an odd n over 37, by bases that decide all numbers of 64 bits."""
    shift = (n - 1 & 1 - n).bit_length() - 1
    for base in _SMALL[:12]:
        x = pow(base, n - 1 >> shift, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(shift - 1)):
            return False
    return True


def _split(n: int) -> list[int]:
    """Prime factors, with repeats, of an n without small ones, by Pollard's rho."""
    if n == 1 or n < _SMALL[-1] ** 2 or _is_prime(n):
        return [n] if n > 1 else []
    root = math.isqrt(n)
    if root * root == n:
        return _split(root) * 2
    for c in range(1, n):
        x = y = 2
        d = 1
        while d == 1:
            x, y = (x * x + c) % n, ((y * y + c) ** 2 + c) % n
            d = math.gcd(x - y, n)
        if d < n:
            return _split(d) + _split(n // d)


def _powers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and number of divisors, and number of distinct primes, of numbers above 0."""
    rest, top = n.copy(), int(n.max(initial=1))
    sigma, tau, primes = np.ones(len(n), object if top >> 58 else np.int64), np.ones(len(n), np.int64), np.zeros(len(n), np.int32)
    for p in _SMALL:
        if p * p > top:
            break
        at = np.flatnonzero(rest % p == 0)
        if len(at):
            r, s, t = rest[at], np.ones(len(at), sigma.dtype), np.ones(len(at), np.int64)
            while (more := r % p == 0).any():
                r, s, t = np.where(more, r // p, r), np.where(more, s * p + 1, s), t + more
            rest[at], sigma[at], tau[at], primes[at] = r, sigma[at] * s, tau[at] * t, primes[at] + 1
            top = int(rest.max())
    for i in np.flatnonzero(rest > 1):
        for p, k in Counter(_split(int(rest[i]))).items():
            sigma[i], tau[i], primes[i] = sigma[i] * ((p ** (k + 1) - 1) // (p - 1)), tau[i] * (k + 1), primes[i] + 1
    return sigma, tau, primes


def factored(n: Column) -> Column:
    """sigma (sum of divisors, null if it does not fit bigint), tau (their number) and primes (distinct ones) of n: 0 each for 0, null below 0.

    Numbers are taken apart into primes, the distinct ones of a batch together, so that a row's cost hardly grows with its number.
    """

    @F.arrow_udf("sigma long, tau int, primes int")
    def run(n: pa.Array) -> pa.Array:
        distinct, back = np.unique(n.fill_null(-1).to_numpy(), return_inverse=True)
        known = distinct > 0
        sigma, tau, primes = _powers(distinct[known])
        out = []
        for values, kind in ((sigma, pa.int64()), (tau, pa.int32()), (primes, pa.int32())):
            whole = np.zeros(len(distinct), values.dtype)
            whole[known] = values
            out.append(pa.array(np.where(whole <= _MOST, whole, 0)[back].astype(np.int64), pa.int64(), mask=((distinct < 0) | (whole > _MOST))[back]).cast(kind))
        return pa.StructArray.from_arrays(out, ["sigma", "tau", "primes"])

    return run(n.cast("long"))


def n_divisors(n: Column) -> Column:
    return factored(n)["tau"]


def divisor_sum(n: Column) -> Column:
    return factored(n)["sigma"]


def n_primes(n: Column) -> Column:
    """Distinct prime factors."""
    return factored(n)["primes"]


def is_prime(n: Column) -> Column:
    return F.coalesce(n_divisors(n) == 2, F.lit(False))


def gcd(a: Column, b: Column) -> Column:
    """Of numbers from 0 on; gcd(a, 0) is a."""

    @F.arrow_udf("long")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.gcd(a.fill_null(0).to_numpy(), b.fill_null(0).to_numpy()))

    a, b = a.cast("long"), b.cast("long")
    return F.when(a == 0, b).when(b == 0, a).when((a > 0) & (b > 0), run(a, b))


def last_digit(base: Column, exponent: Column) -> Column:
    """Last digit of base ** exponent: powers repeat with a period that divides 4."""
    b = base % 10
    power = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(1).cast("long"), lambda x, _: x * b % 10)
    return F.when(exponent == 0, F.lit(1).cast("long")).otherwise(power((exponent - 1) % 4 + 1))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient, 0 for k > n; each step of the product is whole."""
    k, above = F.least(k, n - k), k > n
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    whole = F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), lambda x, i: F.floor(x * (n - k + i) / i).cast("decimal(38,0)"))
    return F.when(above, 0).otherwise(whole).cast("long")


def _by(family: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in cases.items():
        out = F.when(family == name, value).otherwise(out)
    return out


def _studied(family: Column, p: Column) -> Column:
    """factored of the number that a family is about."""
    return factored(F.when(family.isin("gcd", "gcd_divisor_sum"), gcd(p["a"], p["b"])).when(family.isin("divisor_sum", "divisor_sum_mod"), p["n"]))


def expected_answer(family: Column, p: Column) -> Column:
    """The answer of a family at the struct p (a, b, m, n, base, exp, vars, total, terms, first, diff)."""
    sigma = _studied(family, p)["sigma"]
    return _by(family, {
        "gcd": gcd(p["a"], p["b"]),
        "gcd_divisor_sum": sigma,
        "units_digit": last_digit(p["base"], p["exp"]),
        "divisor_sum": sigma,
        "divisor_sum_mod": F.try_mod(p["a"], sigma),
        "stars_and_bars": choose(p["total"] + p["vars"] - 1, p["vars"] - 1),
        "arithmetic_series": p["terms"] * p["first"] + F.floor(p["diff"] * p["terms"] * (p["terms"] - 1) / 2),
        "modular_congruence": F.try_mod(p["a"], p["m"]),
    })


def difficulty(family: Column, p: Column) -> Column:
    """A number that grows with the effort of an exercise; comparable within its family only."""
    shared = F.greatest(p["a"], p["b"]) + 50 * _studied(family, p)["primes"]
    return _by(family, {
        "gcd": shared,
        "gcd_divisor_sum": shared,
        "units_digit": p["exp"],
        "divisor_sum": p["n"] + 100 * _studied(family, p)["primes"],
        "divisor_sum_mod": p["n"] + F.floor(p["a"] / 1000),
        "stars_and_bars": 100 * p["vars"] + p["total"],
        "arithmetic_series": p["terms"] * F.greatest(F.lit(1), p["diff"]),
        "modular_congruence": 100 * p["m"] + F.length(p["a"].cast("string")),
    }).cast("long")


def signature(family: Column, pattern: Column, p: Column) -> Column:
    """family:pattern and the marks that make two exercises one piece of reasoning."""
    text = lambda c: c.cast("string")
    x = _studied(family, p)
    shared = F.concat(F.lit("gpf"), text(x["primes"]))
    sums = F.concat(F.lit("pf"), text(x["primes"]), F.lit(":tau"), text(x["tau"]))
    cycle = F.size(F.array_distinct(F.array(*[last_digit(p["base"], F.lit(i)) for i in range(1, 5)])))
    marks = _by(family, {"gcd": shared, "gcd_divisor_sum": shared, "divisor_sum": sums, "divisor_sum_mod": sums, "units_digit": F.concat(F.lit("cycle"), text(cycle)), "modular_congruence": F.concat(F.lit("m_digits"), text(F.length(text(p["m"]))))})
    known = F.coalesce(F.nullif(F.trim(pattern), F.lit("")), F.lit("unknown"))
    return F.concat_ws(":", F.coalesce(family, F.lit("unknown")), known, marks)


def claimed_answer(solution: Column) -> Column:
    """The last number that the best way of stating an answer gives; null without one."""
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(solution, F.lit(p), F.lit(1)), F.lit(-1)) for p in CLAIMS]).cast("long")


def internal_terms(statement: Column) -> Column:
    """Sorted words of the workshop in a statement."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(statement, F.lit("")).rlike(rf"(?i)\b{w}\b"), w) for w in INTERNAL])))
