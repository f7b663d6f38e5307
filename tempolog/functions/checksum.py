"""CRC-32 of a whole from the checksums of its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value of the checksum: its polynomial, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
_BITS = 32
#: Bits of a length.
_LENGTH_BITS = 63


def _times_x(p: int) -> int:
    return (p >> 1) ^ (POLYNOMIAL if p & 1 else 0)


def _shifts(p: int) -> list[int]:
    """``p`` times x to the power 0 to 31."""
    out = [p]
    while len(out) < _BITS:
        out.append(_times_x(out[-1]))
    return out


def _product(p: int, q: int) -> int:
    out = 0
    for i, s in enumerate(_shifts(p)):
        if q >> (_BITS - 1 - i) & 1:
            out ^= s
    return out


def _doublings() -> list[list[int]]:
    """For each bit k of a length: what 2**k zero bytes make of every single bit."""
    p = 1 << (_BITS - 1)
    for _ in range(8):
        p = _times_x(p)
    out = []
    for _ in range(_LENGTH_BITS):
        out.append(_shifts(p))
        p = _product(p, p)
    return out


def combined(first: Column, second: Column, second_length: Column) -> Column:
    """The checksum of two pieces one after the other, from theirs and the length of the second in bytes.

    So parts of a file that no task holds whole can be checked by many tasks, and a payload's checksum goes on without
    reading what came before.  Null where any of the three is.
    """
    table = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _doublings()])

    def shifted(p: Column, k: Column) -> Column:
        row = F.get(table, k)
        return F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseXOR(F.get(row, i) * F.getbit(p, F.lit(_BITS - 1) - i)))

    moved = F.aggregate(F.sequence(F.lit(0), F.lit(_LENGTH_BITS - 1)), first.cast("long"), lambda p, k: F.when(F.getbit(second_length.cast("long"), k) == 1, shifted(p, k)).otherwise(p))
    return F.when(second_length.isNotNull(), moved.bitwiseXOR(second.cast("long")))
