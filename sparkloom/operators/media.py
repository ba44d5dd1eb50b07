"""Media: what can be planned or computed here. Decoding needs Pillow or FFmpeg on the workers and is gated on them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import ParameterError
from . import pixels

try:
    import PIL.Image as _image
except ImportError:
    _image = None

PROBE = "format struct<duration:string,size:string,bit_rate:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,sample_rate:string,channels:int,avg_frame_rate:string>>"


def perceptual_hash(cells: np.ndarray) -> str:
    """The hash of one grey picture of 32 x 32 as 16 hex digits."""
    if cells.shape != (pixels.CELLS, pixels.CELLS):
        raise ValueError("32 x 32 cells")
    return f"{int(pixels.hashes(cells[None])[0]):016x}"


def blur_score(gray: np.ndarray) -> float:
    return float(pixels.sharpness(gray[None])[0])


def quality_of(blur: Column) -> Column:
    """0 to 100: 25 * log10(1 + blur), at most 100."""
    return F.least(F.lit(100.0), 25 * F.log10(1 + blur))


def inspect_images(binary: DataFrame) -> DataFrame:
    """path, sha256, format, width, height, phash, blur, quality, error of binaryFile rows (needs Pillow on the workers)."""
    src = binary.select("path", "content", F.sha2("content", 256).alias("sha256"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for p in parts:
            rows = []
            for path, content, digest in zip(p["path"], p["content"], p["sha256"], strict=True):
                try:
                    if _image is None:
                        raise RuntimeError("Pillow is not installed")
                    im = _image.open(io.BytesIO(content))
                    gray = im.convert("L")
                    cells, small = gray.resize((32, 32), _image.Resampling.LANCZOS), gray.copy()
                    small.thumbnail((512, 512), _image.Resampling.LANCZOS)
                    rows.append((path, digest, im.format, im.width, im.height, perceptual_hash(np.asarray(cells)), blur_score(np.asarray(small)), None))
                except Exception as e:  # noqa: BLE001  a broken file is a row with an error
                    rows.append((path, digest, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "sha256", "format", "width", "height", "phash", "blur", "error"])

    out = src.mapInPandas(run, "path string, sha256 string, format string, width int, height int, phash string, blur double, error string")
    return out.withColumn("quality", quality_of(F.col("blur")))


def probe_rows(df: DataFrame, column: str = "probe") -> DataFrame:
    """kind, duration, size, width, height, codecs from probe output: video if any stream is; else audio."""
    p = F.from_json(F.col(column), PROBE)
    d = df.withColumn("__p", p)
    of = lambda kind: F.filter("__p.streams", lambda s: s["codec_type"] == kind)
    video, audio = of("video"), of("audio")
    duration = F.coalesce(F.expr("try_cast(__p.format.duration as double)"), F.array_max(F.transform("__p.streams", lambda s: F.try_to_number(s["duration"], F.lit("999999999.999999")).cast("double"))))
    kind = F.when(F.size(video) > 0, "video").when(F.size(audio) > 0, "audio").otherwise("unknown")
    return d.withColumns({"kind": kind, "duration": duration, "size": F.expr("try_cast(__p.format.size as bigint)"), "width": F.get(video, F.lit(0))["width"], "height": F.get(video, F.lit(0))["height"], "video_codec": F.get(video, F.lit(0))["codec_name"], "audio_codec": F.get(audio, F.lit(0))["codec_name"]}).drop("__p")


def frame_times(duration: Column, every: float, most: int = 1000) -> Column:
    """Seconds at which frames are taken: every `every` seconds below the duration, at most `most`."""
    n = F.least(F.lit(most), F.ceil(duration / every).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(float(every))))


#: How frames may be sampled, and the most of them that a plan takes.
SAMPLINGS, MOST_FRAMES = ("seconds", "frames", "count", "scene"), 500


def frame_plan(df: DataFrame, sampling: str, interval: float = 1.0, count: int = 10, start: float = 0.0, length: float = 0.0, duration: str = "duration", fps: str = "fps") -> DataFrame:
    """Adds begin, span, frames, times and problem: what sampling takes of each video from `start` on, for `length` seconds
    (0: to its end).

    seconds: one every `interval` seconds. frames: one every `interval` source frames, which needs their rate. count: so
    many, evenly. scene: at most `count` where the picture changes, so without times. A plan with a problem has none:
    start_out_of_range, unknown_rate, whole_frames or too_many_frames (over MOST_FRAMES).
    """
    if sampling not in SAMPLINGS:
        raise ParameterError(f"sampling is one of {', '.join(SAMPLINGS)}")
    if not (interval > 0 and count > 0 and start >= 0 and length >= 0):
        raise ParameterError("interval and count are positive, start and length not negative")
    whole, rate = F.col(f"`{duration}`").cast("double"), F.col(f"`{fps}`").cast("double")
    left = whole - start
    span = F.least(F.lit(float(length)), left) if length else left
    step = {"seconds": F.lit(float(interval)), "frames": F.try_divide(F.lit(float(interval)), rate), "count": F.col("span") / count, "scene": F.lit(None).cast("double")}[sampling]
    n = {"seconds": F.ceil(F.col("span") / interval), "frames": F.ceil(F.col("span") * rate / interval)}.get(sampling, F.lit(count)).cast("long")
    problem = F.when(~F.coalesce((whole > 0) & (left > 0), F.lit(False)), "start_out_of_range")
    if sampling == "frames":
        problem = problem.when(~F.coalesce(rate > 0, F.lit(False)), "unknown_rate").when(F.lit(interval < 1 or interval != int(interval)), "whole_frames")
    d = df.withColumns({"begin": F.lit(float(start)), "span": span}).withColumn("problem", problem).withColumn("frames", F.when(F.col("problem").isNull(), n))
    d = d.withColumn("problem", F.when(F.col("frames") > MOST_FRAMES, "too_many_frames").otherwise(F.col("problem")))
    d = d.withColumn("frames", F.when(F.col("problem").isNull(), F.col("frames"))).withColumn("__step", step)
    times = F.transform(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1), lambda i: F.col("begin") + i * F.col("__step"))
    return d.withColumn("times", F.when((F.col("frames") > 0) & F.col("__step").isNotNull(), times)).drop("__step")


def segments(duration: Column, length: float) -> Column:
    """array of (start, end) that tile the duration."""
    n = F.ceil(duration / length).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * F.lit(length)).alias("start"), F.least(duration, (i + 1) * F.lit(length)).alias("end"))))


def derivative(kind: str, start: float | None = None, duration: float | None = None) -> str:
    """thumbnail, waveform, or clip if a start or duration is given, else transcode."""
    if kind in ("thumbnail", "waveform"):
        return kind
    return "clip" if start is not None or duration is not None else "transcode"


def size_bucket(width: Column, height: Column) -> Column:
    px = width.cast("long") * height
    return F.when(px < 65_536, "tiny").when(px < 307_200, "small").when(px < 2_073_600, "medium").when(px < 8_294_400, "large").otherwise("huge")


def aspect(width: int, height: int) -> str:
    g = math.gcd(width, height) or 1
    return f"{width // g}:{height // g}"
