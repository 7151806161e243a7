"""Scalar functions as Column expressions; all stay in generated code."""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: File extensions of videos, and their media types.
MEDIA_TYPES = {
    "mp4": "video/mp4", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "mov": "video/quicktime", "wmv": "video/x-ms-wmv", "flv": "video/x-flv", "webm": "video/webm", "m4v": "video/x-m4v", "mpg": "video/mpeg", "mpeg": "video/mpeg",
}

#: Greatest bitrate in Mbit/s by codec family, for widths from the given one up.
RATE_CAPS = {
    "av1": {3840: 25, 2560: 15, 1920: 6, 1280: 4, 854: 3},
    "hevc": {3840: 35, 2560: 20, 1920: 15, 1280: 8, 854: 4},
    "h264": {3840: 50, 2560: 30, 1920: 20, 1280: 10, 854: 5},
}


def ladder(steps: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda w, s: w.when(*s), steps[1:], F.when(*steps[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def js_round(x: Column) -> Column:
    """To the nearest whole number, halves up, as long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; 0 of nothing."""
    return F.coalesce(js_round(F.try_divide(part * F.lit(100.0), whole.cast("double"))), F.lit(0).cast("long"))


def extension(path: Column) -> Column:
    """The lower-case extension without its dot, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_video(path: Column) -> Column:
    return extension(path).isin(*MEDIA_TYPES)


def media_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves at least 1, with up to two decimals."""
    units = ["Bytes", "KB", "MB", "GB", "TB"]
    k = F.least(F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + F.lit(1e-9)), F.lit(4)).cast("int")
    value = F.round(n.cast("double") / F.pow(F.lit(1024.0), k), 2)
    text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(n == 0, "0 Bytes").otherwise(F.concat(text, F.lit(" "), F.element_at(F.array(*(F.lit(u) for u in units)), k + 1)))


def resolution_class(height: Column) -> Column:
    steps = [(height.isNull(), "Unknown")] + [(height >= h, label) for h, label in ((2160, "4K"), (1440, "1440p"), (1080, "1080p"), (720, "720p"), (480, "480p"))]
    return ladder([(c, F.lit(v)) for c, v in steps], F.lit("Other"))


def target_resolution(width: Column, height: Column, preset_width: Column) -> Column:
    """``WIDTHx-2`` to scale to, or original: no preset width, a height below 720, or no wider than the preset."""
    to = F.concat(preset_width, F.lit("x-2"))
    unknown = F.coalesce(width, F.lit(0)) == 0
    unknown |= F.coalesce(height, F.lit(0)) == 0
    keep = (height < 720) | (width <= preset_width)
    return F.when(preset_width.isNull(), "original").when(unknown, to).when(keep, "original").otherwise(to)


def rate_cap(codec: str, width: Column) -> Column:
    """The cap of the widest step not above ``width``; narrower ones have the last cap."""
    caps = RATE_CAPS[codec]
    return ladder([(width >= w, F.lit(c)) for w, c in caps.items()], F.lit(min(caps.values())))


def target_bitrate(codec: str, source_bps: Column, width: Column) -> tuple[Column, Column, Column]:
    """(target, greatest, buffer) Mbit/s: a tenth above the source, under the cap; twice the greatest as buffer."""
    cap = rate_cap(codec, width)
    source = js_round(source_bps / F.lit(1e6))
    wanted = F.when(F.coalesce(source, F.lit(0)) > 0, F.least(cap.cast("long"), js_round(source * F.lit(1.1)))).otherwise(cap.cast("long"))
    target = F.greatest(wanted, F.lit(1).cast("long"))
    most = F.least(cap.cast("long"), F.greatest(target, js_round(target * F.lit(1.2))))
    return target, most, most * 2


def thumbnail_second(duration: Column, share: float = 0.2, fixed: float = 5.0) -> Column:
    """The second to picture: a share of the duration kept inside it, or a fixed one without a duration."""
    usable = F.coalesce(duration, F.lit(0.0)) > 0
    return F.when(usable, F.greatest(F.lit(0.0), F.least(duration * share, duration - 1))).otherwise(fixed)


def byte_range(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of a ``bytes=a-b`` header; both null if it is not valid for ``size``."""
    pattern = r"bytes=(\d*)-(\d*)"
    a, b = (F.regexp_extract(header, pattern, k).try_cast("long") for k in (1, 2))
    start = F.when(a.isNotNull(), a).when(b.isNotNull(), F.greatest(F.lit(0).cast("long"), size - b))
    end = F.when(a.isNotNull() & b.isNotNull(), b).when(a.isNotNull() | b.isNotNull(), size - 1)
    good = (start <= end) & (start < size) & (end < size)
    return F.when(good, start), F.when(good, end)


def frames_per_second(rational: Column) -> Column:
    """``30000/1001`` or a number as frames per second with two decimals; null for what is neither or has no divisor."""
    n, d = (F.regexp_extract(rational, r"^\s*([0-9.]+)(?:/([0-9.]+))?\s*$", k).try_cast("double") for k in (1, 2))
    return F.round(F.try_divide(n, F.coalesce(d, F.lit(1.0))), 2)


def crop_square(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: float = 0.3) -> list[Column]:
    """x, y and side of the square around a box, padded and moved inside the picture."""
    side = F.greatest(F.lit(0.0), x2 - x1)
    side = F.greatest(side, F.greatest(F.lit(0.0), y2 - y1)) * (1 + 2 * padding)
    side = F.least(F.greatest(side, F.lit(1.0)), F.least(width, height).cast("double"))

    def at(low: Column, high: Column, most: Column) -> Column:
        centre = low + F.greatest(F.lit(0.0), high - low) / 2
        return F.greatest(F.lit(0.0), F.least(centre - side / 2, most - side))

    return [js_round(at(x1, x2, width)), js_round(at(y1, y2, height)), js_round(side)]


def progress(done: Column, whole: Column) -> Column:
    """Whole per cent done, 99 at most before the end."""
    return F.least(F.lit(99).cast("long"), js_round(F.try_divide(done * F.lit(100.0), whole)))


def minutes_to_cron(minutes: Column) -> Column:
    """A cron line that runs about every so many minutes: within an hour, every few hours, or daily."""
    hours = F.floor(minutes / 60).cast("int")
    return F.when(minutes < 60, F.concat(F.lit("*/"), minutes, F.lit(" * * * *"))).when(hours < 24, F.concat(F.lit("0 */"), hours, F.lit(" * * *"))).otherwise("0 0 * * *")


def setting(text: Column) -> dict[str, Column]:
    """A stored setting's text as a flag and as a number, null where it is neither."""
    flag = F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)
    return {"flag": flag, "number": F.trim(text).try_cast("double")}


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays of one length; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@dataclass(frozen=True)
class Preset:
    id: str
    name: str
    target_width: int | None
    codec: str
    quality: int
    max_mbit: int | None
    audio_kbit: int = 128
    container: str = "mkv"


#: The conversion presets, by width and codec; the quality of av1 differs at 1080p.
_SIZES = (("1080p", "1080p", 1920), ("720p", "720p", 1280), ("original", "Original", None))
_CODECS = (("h264", "H.264", "h264", 26), ("h265", "H.265/HEVC", "hevc", 28), ("av1", "AV1", "av1", 35))
PRESETS = [
    Preset(f"{size}_{short}", f"{label} {name}", width, f"{codec}_vaapi", 38 if (size, codec) == ("1080p", "av1") else quality, width and RATE_CAPS[codec][width])
    for size, label, width in _SIZES
    for short, name, codec, quality in _CODECS
]


def presets(spark: SparkSession) -> DataFrame:
    """The presets as a table."""
    return spark.createDataFrame([astuple(p) for p in PRESETS], "id string, name string, target_width int, codec string, quality int, max_mbit int, audio_kbit int, container string")


def frame_times(duration: Column, interval: float) -> tuple[Column, Column]:
    """The number of frames taken every ``interval`` seconds, and their seconds; none without a positive duration."""
    n = F.ceil(F.greatest(duration, F.lit(0.0)) / interval).cast("long")
    return n, F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * F.lit(float(interval)))).otherwise(F.array().cast("array<double>"))


def seconds_left(spent_ms: Column, done: Column, whole: Column) -> Column:
    """Whole seconds that the rest takes at the mean of what is done."""
    return js_round(F.try_divide(spent_ms, done) * (whole - done) / 1000)


def rising(rows: DataFrame, keys: list[str], order: list[str], value: str, step: float) -> DataFrame:
    """The first row of every key, and those whose ``value`` is more than ``step`` above all before it."""
    seen = F.max(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(value) > F.col("_seen") + step)).drop("_seen")


def id_list(text: Column) -> Column:
    """Whole numbers of a comma list, in order; parts that are none are left out."""
    return F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x).try_cast("long")))


def flag(text: Column, default: bool = False) -> Column:
    """true and 1 as true, false and 0 as false, whatever the case; anything else is the default."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(default)
