"""Hash-based folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 1 << 20


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def unit(id_col: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) for each id."""
    return F.pmod(F.xxhash64(id_col.cast("string"), F.lit("sample")), F.lit(_UNIT)) / F.lit(float(_UNIT))


def class_rates(rows: DataFrame, label: str, quotas: dict | int) -> dict:
    """Share of each class's rows to take so that about ``quotas`` rows of it (an int: in all, split evenly) remain."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if isinstance(quotas, int):
        quotas = dict.fromkeys(counts, quotas / max(1, len(counts)))
    return {k: min(1.0, quotas.get(k, 0) / n) for k, n in counts.items() if n}


def below_rate(id_col: Column, label: Column, rates: dict) -> Column:
    """Whether a row is in the sample that ``rates`` describe."""
    if not rates:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    return F.coalesce(unit(id_col) < table[label], F.lit(False))
