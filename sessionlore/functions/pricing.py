"""Model families and token prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families by a part of the lower-cased model name, and US dollars for a
# million tokens of input, output, cache writes and cache reads. Any other name is the last.
PRICES = {
    "opus": ("Opus", 15.0, 75.0, 18.75, 1.50),
    "haiku": ("Haiku", 0.80, 4.0, 1.00, 0.08),
    "": ("Sonnet", 3.0, 15.0, 3.75, 0.30),
}
#: Costs are held as whole numbers of this part of a dollar, so that sums do not depend on their order.
UNITS = 100_000_000
COUNTERS = ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")


def _by_family(model: Column, values: dict[str, object]) -> Column:
    name = F.lower(F.coalesce(model, F.lit("")))
    out = F.lit(values[""])
    for part in reversed([p for p in values if p]):
        out = F.when(F.contains(name, F.lit(part)), F.lit(values[part])).otherwise(out)
    return out


def family(model: Column) -> Column:
    """The family that prices a model; a missing or unknown name is priced as Sonnet."""
    return _by_family(model, {part: p[0] for part, p in PRICES.items()})


def cost_units(model: Column, counters: tuple[Column, ...]) -> Column:
    """Cost of the four token counts in whole units."""
    out = F.lit(0).cast("long")
    for i, tokens in enumerate(counters):
        out = out + tokens.cast("long") * _by_family(model, {part: round(p[i + 1] * UNITS / 1e6) for part, p in PRICES.items()})
    return out.cast("long")


def usd(units: Column) -> Column:
    return units / F.lit(float(UNITS))
