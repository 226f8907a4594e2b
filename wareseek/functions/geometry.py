"""Centre-square cropping: integer geometry in the JVM, pixels in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wareseek.schemas import IMAGE_SIZE


def center_square(width: Column, height: Column, size: int = IMAGE_SIZE) -> Column:
    """Resize so that the shorter side is ``size``, then the offsets of the centred square."""
    w, h = width.cast("long"), height.cast("long")
    scaled = lambda longer, shorter: F.floor(F.lit(size) * longer / shorter).cast("long")
    resized_w = F.when(w <= h, F.lit(size).cast("long")).otherwise(scaled(w, h))
    resized_h = F.when(w <= h, scaled(h, w)).otherwise(F.lit(size).cast("long"))
    half = lambda side: F.floor((side - size) / 2).cast("long")
    return F.struct(
        resized_w.alias("width"),
        resized_h.alias("height"),
        half(resized_w).alias("left"),
        half(resized_h).alias("top"),
    )


def crop_center_square(
    df: DataFrame,
    load: Callable[[bytes, int], "object"],
    image: str = "img",
    size: int = IMAGE_SIZE,
    batch_size: int = 64,
) -> DataFrame:
    """Replace encoded images by the raw bytes of their centred square.

    ``load(data, size)`` is the caller's image library: it decodes one picture, scales its shorter
    side to ``size`` and returns a height x width x channels array. Where it raises, the picture
    becomes NULL.
    """

    def one(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        try:
            pixels = load(data, size)
        except Exception:
            return None
        top, left = (pixels.shape[0] - size) // 2, (pixels.shape[1] - size) // 2
        return pixels[top : top + size, left : left + size].tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                yield part.assign(**{image: [one(data) for data in part[image]]})

    schema = T.StructType(
        [T.StructField(image, T.BinaryType()) if f.name == image else f for f in df.schema]
    )
    return df.mapInPandas(run, schema)
