"""Number builders: scores, bands, the rubric's dimensions, sizes and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette import fixed


def clamped(x: Column) -> Column:
    """Within 0..1; NaN is 0, null is null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def score_of(text: Column) -> Column:
    """Clamped score of a response's text: missing is 0, what is no number is null."""
    return F.when(text.isNull(), F.lit(0.0)).otherwise(clamped(text.try_cast("double")))


def on_grid(x: Column, tolerance: float = 0.001) -> Column:
    near = F.abs(x - F.rint(x / fixed.GRID_STEP) * fixed.GRID_STEP) <= tolerance
    return (x >= 0) & (x <= 1) & near


def band_of(x: Column) -> Column:
    """Band of the nearest anchor; of two as near the lower one."""
    anchors = F.array(*[F.struct(F.round(F.abs(x - a), 6).alias("distance"), F.lit(a).alias("anchor"), F.lit(b).alias("band")) for a, b in fixed.ANCHOR_BANDS])
    return F.array_min(anchors)["band"]


def anchor_score(band: Column) -> Column:
    """Highest grid value of a band, 0 for an unknown one."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k / 20)
    return F.coalesce(F.array_max(F.filter(grid, lambda x: band_of(x) == band)), F.lit(0.0))


def reading_minutes(text: Column, language: str) -> Column:
    """Whole minutes, half to even, one at least."""
    unit, speed = fixed.READING_SPEED.get(language, fixed.READING_SPEED["en"])
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    amount = F.length(text) if unit == "chars" else words
    return F.greatest(F.lit(1), F.rint(amount / speed).cast("int"))


def density(hits: Column, length: Column, band: tuple[float, float]) -> Column:
    """1 up to the band's first rate for a thousand characters, 0 from its second; 0 without text."""
    rate = 1000 * hits / length
    return F.when(length == 0, 0.0).when(rate <= band[0], 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (rate - band[0]) / (band[1] - band[0])))


def rubric(m: dict[str, Column]) -> dict[str, Column]:
    """The eleven dimensions from the measurements, in their order."""
    low, high = fixed.LENGTH_BAND
    n = m["length"]
    floor = lambda x: F.greatest(F.lit(0.0), x)
    distance = F.when(n < low, low - n).otherwise(n - high)
    evidence = F.least(F.lit(1.0), 0.5 * (m["code_blocks"] + m["tables"]))
    numbers = F.least(F.lit(1.0), 1000 * m["quantity_count"] / n / fixed.SPECIFICITY_SATURATION)
    lede = 1.0 - F.when(m["lede_length"].between(*fixed.LEDE_BAND), 0.0).otherwise(0.4) - F.when(m["lede_sentences"] == 1, 0.0).otherwise(0.3) - F.when(m["lede_banned"], 0.3).otherwise(0.0)
    return {
        "length": F.when(n.between(low, high), 1.0).otherwise(floor(1 - distance / low)),
        "structure": floor(m["required_sections"] / 2 - 0.25 * m["subheads"] - 0.25 * m["absence_filler"]),
        "register": floor(1 - 0.2 * m["plain_sentences"]),
        "terminal_colon": F.when(m["terminal_colons"] == 0, 1.0).otherwise(0.0),
        "distinctiveness": floor(1 - 0.2 * m["repeated"]),
        "specificity": F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.7 * numbers + 0.3 * evidence)),
        "boilerplate": F.when(m["closings"] == 0, 1.0).otherwise(0.0),
        "lede": F.when(m["lede_length"] == 0, 0.0).otherwise(floor(lede)),
        "caption": F.when(m["images"] == 0, 1.0).otherwise(m["captioned"] / m["images"]),
        "translationese": density(m["translationese_hits"], n, fixed.TRANSLATIONESE_BAND),
        "cliche": density(m["cliche_hits"], n, fixed.CLICHE_BAND),
    }


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt (from 0): what the server asks, 30 at most, else growing."""
    asked = F.when(retry_after.rlike(r"^\d+$"), F.least(F.lit(30.0), retry_after.try_cast("double")))
    return F.coalesce(asked, F.pow(F.lit(2.0), attempt) + 0.1 * (attempt + 1))


def backoff(attempt: Column) -> Column:
    """Seconds before a model call is tried again (from 0)."""
    return F.least(F.lit(120.0), 30 * F.pow(F.lit(2.0), attempt))


def band_distance(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low) - x, x - F.lit(high), F.lit(0))


def share_of_clip(size: Column) -> Column:
    return 100 * size / fixed.CLIP_BYTES
