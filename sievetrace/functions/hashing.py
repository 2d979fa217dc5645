"""Keys, hash splits and n-gram features over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievetrace.functions.arithmetic import let

#: Feature buckets, n-gram orders and the weight of goal grams (fixed values).
BUCKETS = 8192
ORDERS = (2, 3, 4)
GOAL_WEIGHT = 1.5


def nul_ended_key(*parts: Column) -> Column:
    """SHA-256 over parts that each end in a NUL."""
    return F.sha2(F.concat(*(x for p in parts for x in (p, F.lit("\0")))), 256)


def nul_joined_key(*parts: Column) -> Column:
    """SHA-256 over parts with NULs between them: record fingerprints and verdict keys."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def state_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-1."""
    return F.substring(F.sha1(c), 1, 16)


def unit_hash(name: Column, seed: int) -> Column:
    """First 64 bits of SHA-256 of ``name|seed``, as a share of 2**64."""
    digits = F.substring(F.sha2(F.concat(name, F.lit(f"|{seed}")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def check_fractions(train: float, val: float, test: float) -> float:
    """The sum of split fractions, each in [0, 1] and not all 0."""
    if not all(0.0 <= x <= 1.0 for x in (train, val, test)) or train + val + test <= 0:
        raise ValueError("split fractions must lie in [0, 1] and not all be 0")
    return train + val + test


def hash_split(name: Column, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> Column:
    """``train``, ``val`` or ``test`` of a group: the same whatever other groups there are."""
    total = check_fractions(train, val, test)
    x, a, b = unit_hash(name, seed), train / total, val / total
    return F.when(x < a, "train").when(x < a + b, "val").otherwise("test")


def ngrams(c: Column, n: int) -> Column:
    """Array of the character n-grams of a text; empty where it is shorter."""

    def of(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(*(F.get(chars, i + k) for k in range(n))))

    return F.when(F.length(c) >= n, let(F.filter(F.split(c, ""), lambda x: x != ""), of)).otherwise(F.array().cast("array<string>"))


def padded_trigrams(c: Column) -> Column:
    """Character 3-grams of the lower-case text between two spaces on each side."""
    return ngrams(F.concat(F.lit("  "), F.lower(c), F.lit("  ")), 3)


def bounded_ngrams(c: Column, orders: tuple[int, ...] = ORDERS) -> Column:
    """Character n-grams of several orders of the text between ``^`` and ``$``."""
    marked = F.concat(F.lit("^"), c, F.lit("$"))
    return F.concat(*(ngrams(marked, n) for n in orders))


def bucket(tag: str, gram: Column, buckets: int = BUCKETS) -> Column:
    """CRC-32 bucket of a gram of a field."""
    return (F.crc32(F.concat(F.lit(f"{tag}\x1f"), gram).cast("binary")) % buckets).cast("int")


def feature_rows(full: Column, goal: Column, buckets: int = BUCKETS) -> Column:
    """Array of (bucket, value): grams of the full text once each, grams of the goal by occurrence, not normalised."""
    one = F.transform(F.array_distinct(F.transform(bounded_ngrams(full), lambda g: bucket("F", g, buckets))), lambda b: F.struct(b.alias("bucket"), F.lit(1.0).alias("value"), F.lit(True).alias("full")))
    many = F.transform(bounded_ngrams(goal), lambda g: F.struct(bucket("G", g, buckets).alias("bucket"), F.lit(GOAL_WEIGHT).alias("value"), F.lit(False).alias("full")))
    return F.concat(one, many)


def dense_id(alphabet: list[str], c: Column, unknown: int = 3) -> Column:
    """Ids (from 4) of a text's characters in a sorted alphabet; ``unknown`` for the others."""
    table = F.create_map(*reduce(lambda a, kv: [*a, F.lit(kv[1]), F.lit(kv[0] + 4)], enumerate(alphabet), []))
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(unknown)))


def target_ids(ids: Column, most: int | None = None, begin: int = 1, end: int = 2) -> Column:
    """Ids of a target between begin and end marks; one that is longer than ``most`` is cut before its end mark."""
    whole = F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end)))
    return whole if most is None else F.when(F.size(whole) > most, F.concat(F.slice(whole, 1, most - 1), F.array(F.lit(end)))).otherwise(whole)
