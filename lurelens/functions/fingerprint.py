"""Content fingerprints that Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# The constants of the public 32-bit MurmurHash3.
_C1, _C2, _MIX1, _MIX2, _ADD = 0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35, 0xE6546B64


def _scrambled(block: np.ndarray) -> np.ndarray:
    block = block * np.uint32(_C1)
    return (block << np.uint32(15) | block >> np.uint32(17)) * np.uint32(_C2)


def murmur3_all(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86 32-bit of many texts as signed integers: block ``i`` of all texts that have one in one step."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.cumsum((lengths + 3) // 4 * 4) - (lengths + 3) // 4 * 4
    words = np.frombuffer(b"".join(texts[i] + b"\0" * (-len(texts[i]) % 4) for i in order), "<u4")
    h, rest = np.full(len(texts), seed, np.uint32), lengths % 4 > 0
    for block in range(int(lengths[0]) // 4 if len(texts) else 0):
        n = int(np.searchsorted(-lengths, -(4 * block + 4), side="right"))  # the longest texts stand first
        h[:n] ^= _scrambled(words[starts[:n] // 4 + block])
        h[:n] = (h[:n] << np.uint32(13) | h[:n] >> np.uint32(19)) * np.uint32(5) + np.uint32(_ADD)
    h[rest] ^= _scrambled(words[(starts + lengths // 4 * 4)[rest] // 4])
    h ^= lengths.astype(np.uint32)
    for shift, factor in ((16, _MIX1), (13, _MIX2)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    out = np.empty(len(texts), np.int32)
    out[order] = (h ^ h >> np.uint32(16)).view(np.int32)
    return out


def murmur3_signed(data: bytes, seed: int = 0) -> int:
    return int(murmur3_all([data], seed)[0])


@F.pandas_udf(IntegerType())
def _murmur3(texts: pd.Series) -> pd.Series:
    out = pd.Series(pd.NA, texts.index, "Int32")
    known = texts.notna()
    out[known] = murmur3_all([t.encode("ascii") for t in texts[known]])
    return out


def favicon_hash(content: Column) -> Column:
    """Signed murmur3 over MIME base64 (76 characters per line, a line feed after each, also the last)."""
    wrapped = F.concat(F.replace(F.base64(content), F.lit("\r\n"), F.lit("\n")), F.lit("\n"))
    return _murmur3(F.when(F.length(content) > 0, wrapped))
