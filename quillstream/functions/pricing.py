"""What a model call costs, at the price of its moment."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions import dates

# Peak prices in dollars of a million tokens by tier: cached input, other input, output; and the exchange rate.
PRICES = {"flash": ("0.014", "0.44", "1.32"), "pro": ("0.044", "1.32", "3.96")}
RATE = "32.5"


def compute_cost(model: Column, cached: Column, uncached: Column, output: Column, moment: Column, prices: dict[str, tuple[str, str, str]] | None = None, rate: str = RATE) -> Column:
    """struct<usd, ntd, peak>; off-peak calls cost half. A model without a price is an error, never free."""
    table = F.create_map(*[x for k, v in (prices or PRICES).items() for x in (F.lit(k), F.array(*[F.lit(Decimal(p)).cast("decimal(12,6)") for p in v]))])
    price = F.coalesce(F.try_element_at(table, model), F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(model, F.lit("null")))))
    peak = dates.is_peak(moment)
    dollars = lambda n, k: n.cast("decimal(12,0)") * F.get(price, F.lit(k))
    whole = (dollars(cached, 0) + dollars(uncached, 1) + dollars(output, 2)).cast("decimal(30,8)")
    usd = (whole * F.when(peak, F.lit(Decimal("1.0"))).otherwise(F.lit(Decimal("0.5"))) / 1_000_000).cast("decimal(12,8)")
    return F.struct(usd.alias("usd"), (usd * F.lit(Decimal(rate))).cast("decimal(12,4)").alias("ntd"), peak.alias("peak"))
