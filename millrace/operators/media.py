"""Image signals from a table of thumbnail pixels: skin shares, flatness and texture, the verdict, and vision answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Shares from which an image is suspicious or blocked, and from which one colour makes it no photograph.
SUSPICIOUS, BLOCKED, FLAT_IGNORED, FLAT_BLOCKED, TEXTURE = 0.45, 0.70, 0.90, 0.85, 0.05


#: Pixels that a task holds at once; more images than that make several pieces.
PIECE = 1 << 20


def skin(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Skin by RGB or by hue from -10 to 50 degrees; whole numbers only, so every engine agrees."""
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    rgb = (r > 95) & (g > 40) & (b > 20) & (d > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
    warm = (top == r) & (6 * (g - b) >= -d) & (6 * (g - b) <= 5 * d)
    return rgb | (warm & (4 * top >= 255) & (100 * d >= 15 * top) & (10 * d <= 9 * top))


def packed(pixels: DataFrame) -> DataFrame:
    """Images as rows (image_id, width, height, px) from a table of pixels (image_id, width, height, x, y, r, g, b)."""
    px = F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in "xyrgb")))
    return pixels.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), px.alias("px"))


def image_stats(pixels: DataFrame, grid: int = 4) -> DataFrame:
    """``packed_stats`` of a table of pixels."""
    return packed(pixels).transform(packed_stats, grid)


def packed_stats(images: DataFrame, grid: int = 4) -> DataFrame:
    """One row per image of (image_id, width, height, px), an image being one row: nothing is dealt out or sorted by pixel.

    Tasks hold ``PIECE`` pixels (or one image) at a time, however many images they read.
    """

    def piece(of: np.ndarray, n: int, size: np.ndarray, px: pa.StructArray) -> list[pa.Array]:
        x, y, r, g, b = (px.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyrgb")
        place = (of << 40) + (y << 20) + x
        if (place[1:] < place[:-1]).any():
            order = np.argsort(place, kind="stable")
            of, x, y, r, g, b = (v[order] for v in (of, x, y, r, g, b))
        width, height = size[of].T
        is_skin, inner = skin(r, g, b), x + 1 < width
        jump = np.zeros(len(of), np.int64)
        jump[:-1] = np.abs(sum(k * (v[:-1] - v[1:]) for v, k in ((r, 299), (g, 587), (b, 114)))) * (of[:-1] == of[1:])
        sums = lambda at, m, what=None: np.bincount(at, what, m).astype(np.int64)
        pixels, checked = sums(of, n), sums(of, n, inner)
        texture = np.divide(sums(of, n, inner & (jump > 24_000)), checked, out=np.zeros(n), where=checked > 0)
        at, k = of * grid * grid + y * grid // height * grid + x * grid // width, n * grid * grid
        inside, bare = sums(at, k), sums(at, k, is_skin)
        whose = np.flatnonzero(inside)
        inside, bare, whose = inside[whose], bare[whose], whose // (grid * grid)
        most = np.zeros(n)
        np.maximum.at(most, whose, bare / inside)
        bucket, counts = np.unique((of << 32) + r // 16 * 256 + g // 16 * 16 + b // 16, return_counts=True)
        modal = np.zeros(n, np.int64)
        np.maximum.at(modal, bucket >> 32, counts)
        return [pa.array(v) for v in (pixels, sums(of, n, is_skin) / pixels, most, sums(whose, n, bare * 10 >= inside * 6), texture, np.full(n, grid * grid, np.int32), modal / pixels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column("px")), 0))
            px, size = b.column("px"), np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height")], axis=1).astype(np.int64)
            ends = np.cumsum(pc.list_value_length(px).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
                part = px.slice(lo, hi - lo)
                found = piece(np.asarray(pc.list_parent_indices(part)), hi - lo, size[lo:hi], part.flatten())
                yield pa.RecordBatch.from_arrays([b.column("image_id").slice(lo, hi - lo), *found], names)
                lo = hi

    stats = "pixels long, skin_ratio double, max_cell_ratio double, dominant_cells long, texture double, cells int, flat_ratio double"
    names = ["image_id", *(c.split()[0] for c in stats.split(", "))]
    return images.select("image_id", "width", "height", "px").mapInArrow(run, StructType([StructField("image_id", images.schema["image_id"].dataType), *StructType.fromDDL(stats)]))


def verdict(stats: DataFrame) -> DataFrame:
    """Adds ``verdict``: flat, blocked, suspicious or clear.  An image alone never decides about an account."""
    half, third = F.ceil(F.col("cells") / 2), F.ceil(F.col("cells") / 3)
    blocked = (F.col("skin_ratio") >= BLOCKED) & (F.col("dominant_cells") >= half) & (F.col("flat_ratio") < FLAT_BLOCKED)
    suspicious = (F.col("skin_ratio") >= SUSPICIOUS) & ((F.col("dominant_cells") >= third) | (F.col("texture") >= TEXTURE))
    return stats.withColumn("verdict", F.when(F.col("flat_ratio") > FLAT_IGNORED, "flat").when(blocked, "blocked").when(suspicious, "suspicious").otherwise("clear"))


def best_image(judged: DataFrame, most: int = 2) -> DataFrame:
    """Per post of (post_id, position, skin_ratio, verdict): the image with most skin among the first ``most``, up to a blocked one."""
    kept = judged.where(F.col("position") < most)
    stop = F.min(F.when(F.col("verdict") == "blocked", F.col("position"))).over(Window.partitionBy("post_id"))
    kept = kept.withColumn("stop", stop).where("stop is null or position <= stop")
    best = F.max_by(F.struct("position", "skin_ratio", "verdict"), F.struct("skin_ratio", -F.col("position")))
    return kept.groupBy("post_id").agg(best.alias("best")).select("post_id", "best.*")


def suspicion(stats: DataFrame) -> DataFrame:
    """``verdict`` as the flags and the reason that the gate reads."""
    v = F.col("verdict")
    reason = F.when(v == "flat", "flat_image_ignored").when(v == "blocked", "skin_ratio_blocked").when(v == "suspicious", "skin_ratio_suspicious")
    return stats.withColumns({"media_suspicious": v.isin("blocked", "suspicious"), "media_blocked": v == "blocked", "media_reason": reason})


def json_object(raw: Column) -> Column:
    """The first of these that is a JSON object: the reply as such, what stands in a code fence, what lies between the outermost braces."""
    tiers = (F.trim(raw), F.trim(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)), F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    good = lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(*(good(t) for t in tiers))


def vision_answer(raw: Column) -> Column:
    """Probability of adult content from a model's reply; null where there is no answer."""
    parsed = F.from_json(json_object(raw), "adult boolean, confidence double")
    sure = F.least(F.greatest(F.coalesce(parsed["confidence"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(parsed["adult"], F.greatest(sure, F.lit(0.5))).when(~parsed["adult"], F.least(1 - sure, F.lit(0.5)))


def with_vision(images: DataFrame, classify: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> DataFrame:
    """Adds ``vision_adult`` of each image (column ``content``) by a given classifier, which maps batches of bytes to a model's replies."""
    asked = F.pandas_udf(classify, "string")
    return images.withColumn("vision_adult", vision_answer(asked(F.col("content"))))
