"""Target descriptions: what a frame should become, as an ordered list of projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators import layout


@dataclass(frozen=True)
class Target:
    width: int | None = None
    height: int | None = None
    pix_fmt: str | None = None
    color_space: str | None = None
    media_type: str | None = None


#: Pixel formats between which a frame can be changed.
CONVERTIBLE = {"YUV420P", "NV12", "RGB24", "BGR24", "GRAY8", "YUV444P"}


def convert(df: DataFrame, target: Target) -> DataFrame:
    """Size first (a missing side follows the aspect, cut to whole pixels), then colour, then type.

    Rows whose format cannot be changed into the target's become null in ``pix_fmt``.
    """
    w, h = F.col("width"), F.col("height")
    if target.width and target.height:
        df = df.withColumns({"width": F.lit(target.width), "height": F.lit(target.height)})
    elif target.width:
        df = df.withColumns({"width": F.lit(target.width), "height": F.floor(h * target.width / w).cast("int")})
    elif target.height:
        df = df.withColumns({"width": F.floor(w * target.height / h).cast("int"), "height": F.lit(target.height)})
    if target.pix_fmt:
        able = F.col("pix_fmt").isin(sorted(CONVERTIBLE)) & F.lit(target.pix_fmt in CONVERTIBLE) | (F.col("pix_fmt") == target.pix_fmt)
        df = df.withColumn("pix_fmt", F.when(able, target.pix_fmt))
    if target.color_space:
        df = df.withColumn("color_space", F.lit(target.color_space))
    if target.media_type:
        df = df.withColumn("media_type", F.lit(target.media_type))
    return df


def autorotate(df: DataFrame, degrees: str = "rotation") -> DataFrame:
    """Sizes as shown: swapped for a quarter turn; the turn is then done."""
    turned = layout.rotated(F.col("width"), F.col("height"), F.col(degrees))
    out = df.withColumn("_t", turned)
    return out.withColumns({"width": F.col("_t")["w"], "height": F.col("_t")["h"], degrees: F.lit(0)}).drop("_t")


def unpack(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """A struct column's fields as one stream, the other columns as another."""
    return df.select(f"{column}.*"), df.drop(column)


def packets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stream copy: a row of parameters, and the packets as they are (no decoding)."""
    head = df.select("stream_id", "codec", "width", "height").distinct()
    return head, df.select("stream_id", "seq", "pts", "dts", "keyframe", "data")


FILTERS: dict[str, Callable[..., DataFrame]] = {}


def frame_filter(name: str) -> Callable:
    """Register a frame filter under a name."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        FILTERS[name] = f
        return f

    return add


@frame_filter("scale")
def _scale(df: DataFrame, width: int, height: int) -> DataFrame:
    """As ``layout.scaled``; nothing changes if the size is the same."""
    s = layout.scaled(F.col("width"), F.col("height"), width, height)
    return df.withColumn("_s", s).withColumns({"width": F.col("_s")["w"], "height": F.col("_s")["h"]}).drop("_s")


@frame_filter("setsar")
def _setsar(df: DataFrame, ratio: str) -> DataFrame:
    return df.withColumn("sar", F.lit(ratio))


@frame_filter("format")
def _format(df: DataFrame, pix_fmt: str) -> DataFrame:
    return convert(df, Target(pix_fmt=pix_fmt))


def raw_stream_option(option: dict) -> dict:
    """Check the option of a raw pushed stream: a codec, and what its kind needs."""
    if not option.get("video_codec") and not option.get("audio_codec"):
        raise ValueError("a raw stream needs a codec")
    if option.get("video_codec") and not option.get("video_time_base"):
        raise ValueError("raw video needs video_time_base")
    if option.get("audio_codec") and not (option.get("channels") and option.get("sample_rate")):
        raise ValueError("raw audio needs channels and sample_rate")
    return option


def parse_size(text: Column) -> Column:
    """``WxH`` as width and height."""
    p = F.split(text, "x")
    return F.struct(p[0].cast("int").alias("width"), p[1].cast("int").alias("height"))
