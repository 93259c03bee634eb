"""Scalar helpers as Column expressions; all but ``fmt_number`` stay inside the JVM."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted coordinate text and the metre-to-model factor.
DMS_PATTERN = (
    r"(?i)([+-]?\d+(?:\.\d+)?)\s*°\s*(\d+(?:\.\d+)?)?\s*['′]?\s*(\d+(?:\.\d+)?)?\s*[\"″]?\s*([NSEW])?"
)
MODEL_SCALE = 0.02


def rounded(c: Column, digits: int = 6) -> Column:
    """Value for comparing and export."""
    return F.round(c, digits)


def number_or_null(text: Column) -> Column:
    """Number in ``text`` after trimming and dropping thousands commas."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("double")


def parse_dms(text: Column) -> Column:
    """Degrees, minutes, seconds text to decimal degrees; null without a match."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, DMS_PATTERN, i)

    degrees = part(1).try_cast("double")
    minutes = F.coalesce(part(2).try_cast("double"), F.lit(0.0))
    seconds = F.coalesce(part(3).try_cast("double"), F.lit(0.0))
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(part(4)).isin("S", "W"), -value).otherwise(value)


def slugify(text: Column) -> Column:
    """Lower-case identifier; null when nothing is left."""
    slug = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_-]+", "_")
    slug = F.regexp_replace(slug, "[_-]{2,}", "_")
    slug = F.regexp_replace(slug, "^_+|_+$", "")
    return F.when(slug != "", slug)


def case_name(slug: Column) -> Column:
    """Words of a slug joined in capitals, letters and digits only."""
    words = F.filter(F.split(slug, "[-_]+"), lambda w: w != "")
    name = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))),
        "",
    )
    name = F.regexp_replace(name, "[^A-Za-z0-9_]", "")
    return F.when(name == "", "Site").otherwise(name)


def metres_to_model(metres: Column) -> Column:
    return metres * MODEL_SCALE


def speed(vx: Column, vy: Column, vz: Column) -> Column:
    """Magnitude; 0 where there is no velocity."""
    return F.coalesce(F.sqrt(vx * vx + vy * vy + vz * vz), F.lit(0.0))


def speed_color(t: Column) -> Column:
    """Blue, cyan, yellow, red ramp over a value clamped to 0..1."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    a = x / 0.33
    b = (x - 0.33) / 0.33
    c = (x - 0.66) / 0.34
    return (
        F.when(x < 0.33, F.array(40 + 60 * a, 90 + 150 * a, 230 - 40 * a))
        .when(x < 0.66, F.array(100 + 155 * b, 240 - 20 * b, 190 - 160 * b))
        .otherwise(F.array(F.lit(255.0), 220 - 150 * c, 30 - 20 * c))
    )


def elevation_color(z: Column, low: Column, high: Column) -> Column:
    """Brown ramp between the lowest and the highest terrain."""
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    t = (z - low) / span
    return F.array(
        F.floor(58 + t * 150 + 0.5), F.floor(50 + t * 135 + 0.5), F.floor(40 + t * 115 + 0.5)
    )


def fmt_number(value: Column, digits: int = 2) -> Column:
    """Short text of a number: fixed digits, exponent form when tiny or large.

    Digits are those of the double itself. The JVM rounds its shortest text
    instead, half up, so a tie in the text that is none in the double goes wrong.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _short_number(v, digits))

    return text(value.cast("double"))


def _short_number(v: float | None, digits: int) -> str:
    if v is None or not math.isfinite(v):
        return "—"
    size = abs(v)
    if size == 0 or 0.01 <= size < 10000:
        return f"{v:.{digits}f}"
    return re.sub(r"e([+-])0(\d)$", r"e\1\2", f"{v:.1e}" if size < 0.01 else f"{v:.2e}")


def time_ago(at: Column, now: Column) -> Column:
    """Short relative time; a date once a day has passed."""
    delta = (F.unix_micros(now) - F.unix_micros(at)) / 1e6
    return (
        F.when(at.isNull(), "—")
        .when(delta < 60, "just now")
        .when(delta < 3600, F.concat(F.floor(delta / 60).cast("string"), F.lit(" min ago")))
        .when(delta < 86400, F.concat(F.floor(delta / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.date_format(at, "M/d/yyyy"))
    )


def duration_text(seconds: Column) -> Column:
    """Seconds below a minute, else minutes and seconds."""
    minutes = F.floor(seconds / 60)
    rest = F.floor(seconds - minutes * 60 + 0.5)
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 60, F.format_string("%.1f s", seconds.cast("double")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
    )


def elapsed_seconds(started: Column, finished: Column) -> Column:
    """Seconds between two ISO texts; null when either cannot be read."""
    a, b = F.try_to_timestamp(started), F.try_to_timestamp(finished)
    return F.round((F.unix_micros(b) - F.unix_micros(a)) / 1e6, 3)


def level_to_depth(reference_depth: Column, percent: Column) -> Column:
    """Fill depth at a percentage of the reference; unchanged at 100."""
    return F.when(F.abs(percent - 100.0) > 1e-9, F.round(reference_depth * percent / 100.0, 4)).otherwise(
        reference_depth
    )


def expected_frames(simulation_time: Column, time_out: Column) -> Column:
    """Frames a run writes; an output interval of 0 means 0.05."""
    step = F.when(time_out == 0, F.lit(0.05)).otherwise(time_out)
    return F.floor(simulation_time / step + 1e-9) + 1


def scaled_geometry(height: Column, frl: Column, level_percent: Column) -> dict[str, Column]:
    """Prototype dimensions of a dam, each with its smallest allowed value."""
    reference = F.coalesce(frl, height, F.lit(1.0))
    tall = F.when(height != 0, height).otherwise(reference)
    dam_height = F.greatest(F.lit(0.10), tall * MODEL_SCALE)
    dam_width = F.greatest(F.lit(0.10), dam_height * 0.30)
    return {
        "water_height": F.greatest(F.lit(0.05), reference * level_percent / 100.0 * MODEL_SCALE),
        "dam_height": dam_height,
        "dam_width": dam_width,
        "channel_length": F.greatest(F.lit(1.60), dam_height * 8.0),
        "channel_width": F.greatest(F.lit(0.67), dam_width * 4.0),
        "channel_height": F.greatest(F.lit(0.40), dam_height * 1.5),
    }


def breach_timing_error(breach_width: Column, breach_time: Column) -> Column:
    """Error text of a breach timing, null when it is allowed."""
    return F.when(~(breach_time >= 0), "breach_time must be >= 0.").when(
        (breach_width == 0) & (breach_time != 0), "breach_time must be 0 when breach_width is 0."
    )


def exposure_status(population: Column, hospitals: Column, schools: Column) -> dict[str, Column]:
    """Severity label of each exposure field."""
    return {
        "population_status": F.when(population > 10000, "critical").otherwise("normal"),
        "hospital_status": F.when(hospitals > 0, "warning").otherwise("normal"),
        "school_status": F.when(schools > 0, "warning").otherwise("normal"),
    }
