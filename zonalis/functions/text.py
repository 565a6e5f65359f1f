"""Labels, colours, addresses and progress figures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Indonesian labels by class code, in the legend's order.
TRANSLATIONS = {
    "3": "Formasi Hutan",
    "5": "Mangrove",
    "76": "Hutan Rawa Gambut",
    "13": "Tumbuhan Non-Hutan Lainnya",
    "40": "Sawah",
    "35": "Sawit",
    "9": "Kebun Kayu",
    "21": "Pertanian Lainnya",
    "30": "Lubang Tambang",
    "24": "Permukiman",
    "25": "Non-Vegetasi Lainnya",
    "31": "Tambak",
    "33": "Sungai, Danau, Laut",
    "27": "Citra Tertutup Awan",
}
OVERRIDDEN_YEARS = (1990, 2024)


def hex_colour(c: Column) -> Column:
    """struct(r, g, b) of ``#rrggbb`` (the sign is optional); null if it is none."""
    plain = F.lower(F.ltrim(F.trim(c), F.lit("#")))
    part = lambda i: F.conv(F.substring(plain, i, 2), 16, 10).cast("int")
    return F.when(plain.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def plain_colour(c: Column) -> Column:
    return F.lower(F.ltrim(F.trim(c), F.lit("#")))


def bilingual(label: Column, code: Column) -> Column:
    """The label with its translation after a slash, unless it is empty, has one, or none is known."""
    known = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in TRANSLATIONS.items()])
    return F.when((label == "") | F.contains(label, F.lit(" / ")) | known.isNull(), label).otherwise(F.concat(label, F.lit(" / "), known))


def label_parts(label: Column) -> Column:
    """struct(main, translation) at the first `` / ``."""
    at = F.instr(label, " / ")
    return F.struct(F.when(at > 0, F.substring(label, F.lit(1), at - 1)).otherwise(label).alias("main"), F.when(at > 0, F.substring(label, at + 3, F.length(label))).alias("translation"))


def truncate(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("..."))).otherwise(s)


def general(x: Column) -> Column:
    """A number without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def range_label(lower: Column, upper: Column, unit: str = "m") -> Column:
    return F.when(lower.isNull() & upper.isNull(), "all").when(lower.isNull(), F.concat(F.lit("<"), general(upper), F.lit(unit))).when(upper.isNull(), F.concat(F.lit(">="), general(lower), F.lit(unit))).otherwise(F.concat(general(lower), F.lit("-"), general(upper), F.lit(unit)))


def year_url(year: Column, base: str, overrides: dict[int, str] | None = None, suffix: str = "_landcover.pmtiles") -> Column:
    """The year's address: an override for the first and last year only, else the template."""
    out = F.concat(F.lit(base.rstrip("/") + "/"), year.cast("string"), F.lit(suffix))
    for y, url in (overrides or {}).items():
        if y in OVERRIDDEN_YEARS and url:
            out = F.when(year == y, F.lit(url)).otherwise(out)
    return out


#: A yearly biomass raster's file name, and what follows it for a variable.
RASTER_NAME = "global_agb_100m_landsat0024_all_{}_densenet_l1_agb_mosaic_100m_base_cd_ts"
RASTER_SUFFIX = {"uncertainty": "_uncertainty_sem.tif"}


def raster_url(year: Column, variable: Column, base: str, prefix: str = "", name: str = RASTER_NAME) -> Column:
    """The address of a year's raster of a variable below a store's address and prefix; a variable without a
    suffix of its own has the plain file."""
    before, after = name.split("{}")
    suffix = F.lit(".tif")
    for v, end in RASTER_SUFFIX.items():
        suffix = F.when(variable == v, F.lit(end)).otherwise(suffix)
    return F.concat(F.lit(f"{base.rstrip('/')}/{prefix.lstrip('/')}{before}"), year.cast("string"), F.lit(after), suffix)


def eta_seconds(progress: Column, elapsed: Column) -> Column:
    """Remaining seconds; null before the first and after the last per cent, and without elapsed time."""
    return F.when((progress > 0) & (progress < 100) & (elapsed > 0), F.bround(elapsed * (100 - progress) / progress).cast("bigint"))


def step_progress(done: Column, total: Column, start: int, span: int) -> Column:
    return (F.lit(start) + F.floor(done / total * span)).cast("int")


def crop_progress(p: Column) -> Column:
    return F.least(F.lit(99), F.greatest(F.lit(0), p)).cast("int")


def backoff(attempt: Column, base: float = 0.5, cap: float = 8.0) -> Column:
    """Seconds before the next attempt (from 1), without jitter."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def legend_rows(n: Column) -> tuple[Column, Column, Column]:
    """Columns, rows and height of a legend of n entries."""
    columns = F.when(n >= 2, 2).otherwise(1)
    rows = F.ceil(n / columns).cast("int")
    return columns, rows, F.when(n == 0, 90).otherwise(F.greatest(F.lit(100), 84 + 36 * rows)).cast("int")


def blend(top: Column, bottom: Column, row: Column, height: Column) -> Column:
    """Linear gradient between two channels over the rows of a band."""
    part = row / F.greatest(height - 1, F.lit(1))
    return F.floor(top * (1 - part) + bottom * part).cast("int")


def payload_bytes(value: Column) -> Column:
    """UTF-8 bytes of the value as JSON."""
    return F.octet_length(F.to_json(value))


def utc(value: Column) -> Column:
    """An ISO time; the epoch where there is none."""
    return F.coalesce(F.try_to_timestamp(value), F.timestamp_seconds(F.lit(0)))


def cache_key(url: Column, offset: Column, length: Column) -> Column:
    """Path of a cached range: ranges/<first 16 hex digits of the URL's SHA-1>/<offset>_<length>.bin."""
    return F.concat(F.lit("ranges/"), F.substring(F.sha1(url.cast("binary")), 1, 16), F.lit("/"), offset.cast("string"), F.lit("_"), length.cast("string"), F.lit(".bin"))
