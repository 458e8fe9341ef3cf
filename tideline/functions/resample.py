"""Counter-based uniforms: the same draw for the same (seed, replicate, item, salt) on any partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, rep, item, salt: str) -> Column:
    rep, item = (F.col(x) if isinstance(x, str) else x for x in (rep, item))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), item.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(seed: int, rep: str, item: str, salt: str) -> str:
    """The same in the oracle's dialect."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', ({rep})::VARCHAR, ({item})::VARCHAR, '{salt}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sign(seed: int, rep, item, salt: str = "sign") -> Column:
    return F.when(uniform(seed, rep, item, salt) < 0.5, -1.0).otherwise(1.0)


def sign_sql(seed: int, rep: str, item: str, salt: str = "sign") -> str:
    return f"CASE WHEN {uniform_sql(seed, rep, item, salt)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


#: Multipliers of the draws: 2^32 over the golden ratio, and two odd numbers of a common 32-bit finaliser.
STEP, MIX_1, MIX_2, MASK = 2654435769, 2246822507, 3266489909, 4294967295


def item_key(seed: int, item, salt: str) -> Column:
    """32 bits of an item, from which all its draws follow."""
    item = F.col(item) if isinstance(item, str) else item
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), item.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("bigint")


def draws(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """(replicates, items): a 32-bit number for each, the same wherever it is computed."""
    x = keys.astype(np.uint32)[None, :] ^ (reps.astype(np.uint64) * np.uint64(STEP) & np.uint64(MASK)).astype(np.uint32)[:, None]
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(16))


def draw(key: Column, rep: Column) -> Column:
    """The same as a column."""
    times = lambda x, c: ((x.bitwiseAND(0xFFFF) * c) + F.shiftleft((F.shiftrightunsigned(x, 16) * c).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)
    folded = lambda x, by: x.bitwiseXOR(F.shiftrightunsigned(x, by))
    x = key.bitwiseXOR((rep.cast("bigint") * STEP).bitwiseAND(MASK))
    return folded(times(folded(times(folded(x, 16), MIX_1), 13), MIX_2), 16)


def draw_sql(seed: int, rep: str, item: str, salt: str) -> str:
    """The same in the oracle's dialect."""
    key = f"('0x' || substr(md5(concat_ws('|', '{seed}', ({item})::VARCHAR, '{salt}')), 1, 8))::UBIGINT"
    folded = lambda x, by: f"xor({x}, {x} >> {by})"
    times = lambda x, c: f"(({x} * {c}::UBIGINT) & {MASK}::UBIGINT)"
    x = f"xor({key}, (({rep})::UBIGINT * {STEP}::UBIGINT) & {MASK}::UBIGINT)"
    return folded(times(folded(times(folded(x, 16), MIX_1), 13), MIX_2), 16)


def flip_sql(seed: int, rep: str, item: str, salt: str = "sign") -> str:
    return f"CASE WHEN {draw_sql(seed, rep, item, salt)} < 2147483648 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
