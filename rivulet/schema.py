"""Row layouts of streams, control marks, and time arithmetic.

A stream is a DataFrame with a key (``stream_id``), an order (``ts_us``, then
``seq``) and a payload.  Control marks are text in ``ctl``, never special values
of the time column, so that sorting and extremes of times stay meaningful.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control marks a row may carry.
EOF, EOS, PAUSE, DYN_EOS = "EOF", "EOS", "PAUSE", "DYN_EOS"
CONTROL = (EOF, EOS, PAUSE, DYN_EOS)
#: Microseconds in a second.
SECOND = 1_000_000

TIME_BASE = T.StructType([T.StructField("num", T.IntegerType()), T.StructField("den", T.IntegerType())])
STREAM = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ctl", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("pts", T.LongType()),
        T.StructField("tb", TIME_BASE),
        T.StructField("pkt_duration", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
VIDEO = T.StructType(
    STREAM.fields
    + [T.StructField(n, T.IntegerType()) for n in ("width", "height")]
    + [T.StructField(n, T.StringType()) for n in ("pix_fmt", "color_space", "color_range")]
    + [T.StructField("planes", T.ArrayType(T.BinaryType()))]
)
AUDIO = T.StructType(
    STREAM.fields
    + [
        T.StructField("sample_rate", T.DoubleType()),
        T.StructField("layout", T.LongType()),
        T.StructField("planar", T.BooleanType()),
        T.StructField("nsamples", T.IntegerType()),
        T.StructField("samples", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)
PACKET = T.StructType(STREAM.fields + [T.StructField("dts", T.LongType()), T.StructField("keyframe", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("whence", T.IntegerType())])
TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("dtype", T.StringType()), T.StructField("data", T.ArrayType(T.FloatType()))])


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without time zone (taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def pts_to_us(pts: Column, num: Column | int, den: Column | int) -> Column:
    """A time stamp in a rational base as whole microseconds, towards zero."""
    num, den = (x if isinstance(x, Column) else F.lit(x) for x in (num, den))
    return (pts * num / den * SECOND).cast("long")


def is_data(ctl: str = "ctl") -> Column:
    return F.col(ctl).isNull()
