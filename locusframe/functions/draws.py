"""Random numbers by counting: each draw is a function of a seed, an id and a place, wherever and in whatever order it is made."""

from __future__ import annotations

import numpy as np

# Increment and multipliers of the published 64 bit mixing function (splitmix64).
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(z: np.ndarray) -> np.ndarray:
    """64 bits for each of the 64 bit counters."""
    z = np.asarray(z).astype(np.uint64) + np.uint64(STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def uniform(seed: int, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 for ids and places, which broadcast against each other."""
    with np.errstate(over="ignore"):
        start = mix(np.array([seed]))[0]
        h = mix(mix(start + np.asarray(ids).astype(np.uint64)) + np.asarray(places).astype(np.uint64))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def normal(seed: int, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Standard normal numbers: two uniform ones each, at twice the place and the one after it."""
    twice = 2 * np.asarray(places)
    return np.sqrt(-2 * np.log(uniform(seed, ids, twice))) * np.cos(2 * np.pi * uniform(seed, ids, twice + 1))


def uniform_sql(seed: int, key: str, place: str) -> str:
    """The same number in DuckDB's SQL, from expressions for the id and the place (whole numbers from 0 on)."""
    def wrap(x: str) -> str:
        return f"(({x}) % 18446744073709551616::uhugeint)"

    def mixed(z: str) -> str:
        z = wrap(f"({z})::uhugeint + {STEP}::uhugeint")
        for shift, factor in ((30, FIRST), (27, SECOND)):
            z = f"(list_transform([{z}], lambda z: {wrap(f'xor(z, z // {1 << shift}::uhugeint) * {factor}::uhugeint')})[1])"
        return f"(list_transform([{z}], lambda z: xor(z, z // {1 << 31}::uhugeint))[1])"

    start = int(mix(np.array([seed]))[0])
    h = mixed(wrap(f"{mixed(wrap(f'{start}::uhugeint + ({key})::uhugeint'))} + ({place})::uhugeint"))
    return f"((({h} // 2048::uhugeint)::double + 0.5::double) / 9007199254740992.0::double)"
