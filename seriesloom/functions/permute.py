"""Keyed bijections of row positions, as column arithmetic."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Products of two residues stay below 2**62, in any engine with 64-bit integers.
PRIME = 2**31 - 1
ROUNDS = 48


def round_keys(seed: int, number: int) -> list[tuple[int, int, int]]:
    """(mirror, factor, offset) of each round of permutation ``number``."""
    draw = random.Random(f"{seed}:{number}")
    return [(draw.randrange(2**62), draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(ROUNDS)]


def shuffled_place(place: Column, size: Column, keys: list[tuple[int, int, int]]) -> Column:
    """Where a permutation of 0 .. ``size - 1`` sends ``place``.

    In each round a place and its mirror image (mirror minus place, modulo the size) are
    swapped or not, as a hashed bit of the larger of them says. A round is a bijection of
    any size, so the whole is one, and no place needs to know another one's.
    """
    rounds = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(key, "mab")]) for key in keys])

    def swap(x: Column, key: Column) -> Column:
        image = F.pmod(key["m"] % size - x, size)
        bit = (F.greatest(x, image) % PRIME * key["a"] + key["b"]) % PRIME % 2
        return F.when(bit == 1, image).otherwise(x)

    return F.aggregate(rounds, place.cast("long"), swap)


def shuffled_place_sql(place: str, size: str, keys: list[tuple[int, int, int]]) -> str:
    """The same permutation as an expression of DuckDB."""
    rounds = ", ".join(f"{{'x': 0::BIGINT, 'm': {m}::BIGINT, 'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for m, a, b in keys)
    image = f"((k.m % {size} - s.x) % {size} + {size}) % {size}"
    bit = f"(greatest(s.x, {image}) % {PRIME} * k.a + k.b) % {PRIME} % 2"
    moved = f"CASE WHEN {bit} = 1 THEN {image} ELSE s.x END"
    start = f"{{'x': {place}::BIGINT, 'm': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT}}"
    step = f"{{'x': {moved}, 'm': k.m, 'a': k.a, 'b': k.b}}"
    return f"list_reduce(list_prepend({start}, [{rounds}]), lambda s, k: {step}).x"
