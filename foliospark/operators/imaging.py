"""Measurements on page images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import fixed

_SCHEMA = (
    "origin string, white_share double, black_share double, mean_level double, dark_bands int"
)


def _measurer(white: int, black: int, bands: int, dark: float) -> Callable:
    """The function that runs on the workers.  It is built here, from plain values, so that it is shipped
    whole: workers need numpy and pandas, but not this package."""

    def gray_levels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
        # Colour data is in blue, green, red order.
        pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        if channels == 1:
            return pixels[:, :, 0]
        blue, green, red = (pixels[:, :, i].astype(np.float64) for i in range(3))
        return np.rint(0.299 * red + 0.587 * green + 0.114 * blue).astype(np.uint8)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.itertuples(index=False):
                gray = gray_levels(page.data, page.height, page.width, page.nChannels)
                band = max(1, page.height // bands)
                means = [float(gray[y : y + band].mean()) for y in range(0, page.height, band)]
                rows.append(
                    (
                        page.origin,
                        float((gray >= white).mean()),
                        float((gray <= black).mean()),
                        float(gray.mean()),
                        sum(mean < dark for mean in means),
                    )
                )
            yield pd.DataFrame(
                rows, columns=["origin", "white_share", "black_share", "mean_level", "dark_bands"]
            )

    return measure


def page_quality(images: DataFrame) -> DataFrame:
    """Blank, dark and dark-band findings for a table with the columns of the ``image`` source.

    Pixels are read as they are; the page is not scaled, padded or straightened first.  Pages are large:
    lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` to fit a batch of them into a worker.
    """
    pixels = images.select("image.*").select("origin", "height", "width", "nChannels", "data")
    readable = pixels.where((F.col("height") > 0) & (F.col("width") > 0))
    measure = _measurer(
        fixed.WHITE_LEVEL, fixed.BLACK_LEVEL, fixed.BANDS, fixed.DARK_BAND_MEAN
    )
    measured = readable.mapInPandas(measure, _SCHEMA)
    white = F.col("white_share") >= fixed.BLANK_SHARE
    black = F.col("black_share") >= fixed.BLANK_SHARE
    dark = F.col("mean_level") < fixed.DARK_PAGE_MEAN
    return measured.select(
        "origin",
        "white_share",
        "black_share",
        "mean_level",
        dark.alias("dark_page"),
        F.when(dark, 0).otherwise(F.col("dark_bands")).alias("dark_bands"),
        F.when(white, fixed.BLANK_WHITE_ERROR).when(black, fixed.BLANK_BLACK_ERROR).alias("error"),
    )
