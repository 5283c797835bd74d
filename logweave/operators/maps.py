"""Maps of places: the part of the world that a map shows, where its places are drawn, and which names fit beside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.lists import extent
from logweave.operators.search import by_language

#: Size and margin of a plot, height of a name and width of one of its characters, room between name and
#: marker, all in plot units; kilometres of a degree.
WIDTH, HEIGHT, PADDING = 900, 460, 34
LABEL_HEIGHT, CHARACTER, ABOVE = 15, 6.2, 14
KM_PER_DEGREE = 111.32


def located(places: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """places with finite coordinates in range; the origin is one like any other here."""
    fit = lambda c, most: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) <= most)
    return places.where(fit(lat, 90) & fit(lon, 180))


def frames(places: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, north, south, east, west, span_km) of each map of located() places: their extent with some room, and how
    far it is across at its middle, to one decimal."""
    e = extent(located(places), by)
    half = lambda c: F.col(c) / 2
    across = F.col("span_lon") * KM_PER_DEGREE * F.cos(F.radians("centre_lat"))
    north, south = F.col("centre_lat") + half("span_lat"), F.col("centre_lat") - half("span_lat")
    east, west = F.col("centre_lon") + half("span_lon"), F.col("centre_lon") - half("span_lon")
    return e.select(*by, "n", north.alias("north"), south.alias("south"), east.alias("east"), west.alias("west"), (F.floor(across * 10 + 0.5) / 10).alias("span_km"))


def drawn(places: DataFrame, by: list[str], width: float = WIDTH, height: float = HEIGHT, padding: float = PADDING) -> DataFrame:
    """located() places with x and y in the plot of their map, to one decimal (halves go up): north is up, y goes down."""
    f = frames(places, by).drop("n", "span_km")
    tenth = lambda v: F.floor(v * 10 + 0.5) / 10
    x = padding + (F.col("lon") - F.col("west")) / (F.col("east") - F.col("west")) * (width - 2 * padding)
    y = padding + (F.col("north") - F.col("lat")) / (F.col("north") - F.col("south")) * (height - 2 * padding)
    return located(places).join(f, by).select(*places.columns, tenth(x).alias("x"), tenth(y).alias("y"))


def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds show_label to rows (map, key, x, y, wide) of one map after the other, the most important place first: whether the
    name's box overlaps none that is drawn already. Kept: the boxes drawn on a map, which cannot be more than fit on it."""
    whose, boxes, n = object(), np.empty((64, 4)), 0
    for batch in batches:
        out = []
        for owner, x, y, wide in zip(*(batch.column(c).to_pylist() for c in ("map", "x", "y", "wide")), strict=True):
            if owner != whose:
                whose, n = owner, 0
            left, right, top, bottom = x - wide * CHARACTER / 2, x + wide * CHARACTER / 2, y - ABOVE - LABEL_HEIGHT, y - ABOVE
            b = boxes[:n]
            fits = not ((left < b[:, 1]) & (right > b[:, 0]) & (top < b[:, 3]) & (bottom > b[:, 2])).any()
            out.append(fits)
            if fits:
                if n == len(boxes):
                    boxes = np.concatenate([boxes, np.empty_like(boxes)])
                boxes[n] = left, right, top, bottom
                n += 1
        yield pa.RecordBatch.from_arrays([batch.column("map"), batch.column("key"), pa.array(out, pa.bool_())], ["map", "key", "show_label"])


def labelled(places: DataFrame, by: str, key: str, name: str, weight: str) -> DataFrame:
    """(by, key, show_label) of drawn() places: names are given room by falling weight, then by_language(), then key, each
    unless it would overlap one that has room. A name of no characters takes no room but may not lie within another's.

    A map's places are read one after the other in one task; they are sorted by Spark and never held.
    """
    kinds = dict(places.dtypes)
    # characters as browsers count them: those beyond the basic plane are two
    wide = F.length(name) + F.length(name) - F.length(F.regexp_replace(name, "[\\x{10000}-\\x{10FFFF}]", ""))
    rows = places.select(F.col(by).alias("map"), F.col(key).alias("key"), "x", "y", F.coalesce(wide, F.lit(0)).alias("wide"), F.col(weight).alias("weight"), by_language(name).alias("name"))
    ordered = rows.repartition("map").sortWithinPartitions("map", F.desc_nulls_last("weight"), "name", "key")
    found = ordered.select("map", "key", "x", "y", "wide").mapInArrow(fitting, f"map {kinds[by]}, key {kinds[key]}, show_label boolean")
    return found.select(F.col("map").alias(by), F.col("key").alias(key), "show_label")
