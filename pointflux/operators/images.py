"""Images as pixel tables or rows of arrays: foreground, disparities, differences of renders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the foreground mask and of the quality figures.
THRESHOLD, LEAST_ALPHA, GRID = 18, 32, 64
FOREGROUND, WINDOW, K1, K2, RANGE = 25, 7, 0.01, 0.03, 255.0


def foreground(pixels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(image, x, y, mask)`` of ``pixels(image, x, y, r, g, b, a)``: what differs from the border, spread by a pixel.

    The background is each channel's upper median over border pixels, every
    stride-th along the sides. Pixels inside the border mark their four neighbours.
    """
    size = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.withColumn("stride", F.greatest(F.lit(1), F.floor(F.least("w", "h") / GRID)))
    rows = pixels.join(size, "image")
    on = lambda a: F.col(a) % F.col("stride") == 0
    # A row counts once for the first and once for the last line, also where these are the same.
    level = F.when(on("x"), (F.col("y") == 0).cast("int") + (F.col("y") == F.col("h") - 1).cast("int")).otherwise(0)
    upright = F.when(on("y") & (F.col("y") > 0) & (F.col("y") < F.col("h") - 1), (F.col("x") == 0).cast("int") + (F.col("x") == F.col("w") - 1).cast("int")).otherwise(0)
    border = rows.withColumn("times", level + upright).where("times > 0").select("image", F.explode(F.sequence(F.lit(1), F.col("times"))), "r", "g", "b")
    middle = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    back = border.groupBy("image").agg(*[middle(c).alias(f"b{c}") for c in "rgb"])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"b{c}")) for c in "rgb"])
    marked = rows.join(back, "image").withColumn("mask", (far >= threshold) & (F.col("a") >= LEAST_ALPHA))
    inside = (F.col("x") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") > 0) & (F.col("y") < F.col("h") - 1)
    at = lambda dx, dy, m: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), m.alias("m"))
    own = [at(0, 0, F.col("mask"))]
    spread = F.when(inside & F.col("mask"), F.array(*own, *[at(dx, dy, F.lit(True)) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])).otherwise(F.array(*own))
    return marked.select("image", F.explode(spread).alias("p")).groupBy("image", "p.x", "p.y").agg(F.bool_or("p.m").alias("mask"))


def render_error(pixels: DataFrame) -> DataFrame:
    """``(image, psnr, foreground_psnr, ssim, mae, max_error, foreground_pixels)`` of ``pixels(image, channel, x, y, a, b)``.

    PSNR is null where images agree. SSIM takes uniform windows of 7 by 7 pixels
    wholly inside the image, sample covariances, and the mean over channels.
    """
    d = F.col("a") - F.col("b")
    each = pixels.groupBy("image").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"))
    points = pixels.groupBy("image", "x", "y").agg(F.greatest(F.max("a"), F.max("b")).alias("top"), F.sum(d * d).alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("top") > FOREGROUND)
    front = points.groupBy("image").agg((F.sum("s") / F.sum("n")).alias("front_mse"), F.count(F.lit(1)).alias("foreground_pixels"))
    half, area = WINDOW // 2, WINDOW * WINDOW
    box = lambda by, along: Window.partitionBy("image", "channel", by).orderBy(along).rowsBetween(-half, half)
    products = {"p": F.col("a"), "q": F.col("b"), "pp": F.col("a") ** 2, "qq": F.col("b") ** 2, "pq": F.col("a") * F.col("b")}
    wide = pixels.select("image", "channel", "x", "y", *[v.cast("double").alias(k) for k, v in products.items()])
    rows = wide.select("image", "channel", "x", "y", *[F.sum(k).over(box("y", "x")).alias(k) for k in products], F.count("p").over(box("y", "x")).alias("n"))
    both = rows.select("image", "channel", *[F.sum(k).over(box("x", "y")).alias(k) for k in products], F.sum("n").over(box("x", "y")).alias("n")).where(F.col("n") == area)
    mean = {k: F.col(k) / area for k in products}
    sample = area / (area - 1)
    var = lambda k, i, j: sample * (mean[k] - mean[i] * mean[j])
    c1, c2 = (K1 * RANGE) ** 2, (K2 * RANGE) ** 2
    top = (2 * mean["p"] * mean["q"] + c1) * (2 * var("pq", "p", "q") + c2)
    ssim = top / ((mean["p"] ** 2 + mean["q"] ** 2 + c1) * (var("pp", "p", "p") + var("qq", "q", "q") + c2))
    like = both.groupBy("image", "channel").agg(F.avg(ssim).alias("s")).groupBy("image").agg(F.avg("s").alias("ssim"))
    psnr = lambda m: F.when(F.col(m) > 0, 10 * F.log10(RANGE * RANGE / F.col(m)))
    out = each.join(front, "image", "left").join(like, "image", "left")
    return out.select("image", psnr("mse").alias("psnr"), psnr("front_mse").alias("foreground_psnr"), "ssim", "mae", "max_error", F.coalesce("foreground_pixels", F.lit(0)).alias("foreground_pixels"))


_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def _shifted(v: np.ndarray, dy: int, dx: int, fill: int = 0) -> np.ndarray:
    """What lies ``dy`` below and ``dx`` right of each pixel."""
    out = np.full_like(v, fill)
    h, w = v.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = v[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _neighbours(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pixel's known neighbours: their number, upper median and spread."""
    around = np.stack([_shifted(v, dy, dx) for dy, dx in _AROUND]).astype(np.int64)
    n = (around > 0).sum(0)
    ordered = np.sort(np.where(around > 0, around, 1 << 40), axis=0)
    pick = lambda k: np.take_along_axis(ordered, np.clip(k, 0, 7)[None], 0)[0]
    return n, np.where(n > 0, pick(n // 2), 0), np.where(n > 0, pick(n - 1) - ordered[0], 0)


def _speckles(v: np.ndarray, least: int = 7) -> np.ndarray:
    """``v`` without patches of under ``least`` pixels whose neighbouring values are alike."""
    label = np.where(v > 0, np.arange(v.size).reshape(v.shape), -1)
    links = []
    for dy, dx in _AROUND:
        other = _shifted(v, dy, dx).astype(np.int64)
        links.append((dy, dx, (v > 0) & (other > 0) & (np.abs(other - v.astype(np.int64)) <= np.maximum(3, np.minimum(other, v) * 0.16))))
    while True:
        new = label.copy()
        for dy, dx, linked in links:
            new = np.where(linked, np.minimum(new, _shifted(label, dy, dx, -1)), new)
        new = np.where(new >= 0, new.ravel()[np.maximum(new, 0)], -1)
        if (new == label).all():
            break
        label = new
    size = np.bincount(label[label >= 0], minlength=v.size)
    return np.where((label >= 0) & (size[np.maximum(label, 0)] >= least), v, 0)


def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5).astype(np.int64)


def _bridged(v: np.ndarray) -> np.ndarray:
    """The middle of the next known values on both sides, within four pixels, where they agree; of two directions the upper median."""
    found = []
    for dy, dx in ((0, 1), (1, 0)):
        ends = []
        for sign in (-1, 1):
            end = np.zeros(v.shape, np.int64)
            for d in range(1, 5):
                end = np.where(end == 0, _shifted(v, sign * dy * d, sign * dx * d), end)
            ends.append(end)
        middle = (ends[0] + ends[1]) * 0.5
        fits = (ends[0] > 0) & (ends[1] > 0) & (np.abs(ends[0] - ends[1]) <= np.maximum(3, middle * 0.14))
        found.append(np.where(fits, middle, -1.0))
    best = np.maximum(found[0], found[1])  # the upper one of two, or the only one
    return np.where(best > 0, _round(best), 0)


def refined(disparity: np.ndarray, front: np.ndarray, rounds: int = 3) -> np.ndarray:
    """A disparity image without outliers and speckles, small holes in the foreground filled; 0 is unknown."""
    source = disparity.astype(np.int64)
    n, middle, _ = _neighbours(source)
    odd = (n <= 1) | ((n >= 4) & (np.abs(source - middle) > np.maximum(3, middle * 0.12)))
    now = _speckles(np.where(odd, 0, source))
    for _ in range(rounds):
        n, middle, spread = _neighbours(now)
        fill = np.where((n >= 3) & (spread <= np.maximum(4, middle * 0.16)), middle, 0)
        fill = np.where(fill == 0, _bridged(now), fill)
        now = np.where((now == 0) & (front != 0), fill, now)
    return now


def refine_disparities(images: DataFrame, image: str = "image") -> DataFrame:
    """``(image, disparity)`` of rows ``(image, columns, disparity array<int>, foreground array<int>)``, refined; an image is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [refined(np.asarray(d, np.int64).reshape(-1, c), np.asarray(f).reshape(-1, c)).ravel() for c, d, f in zip(pdf["columns"], pdf["disparity"], pdf["foreground"], strict=True)]
            yield pd.DataFrame({image: pdf[image], "disparity": out})

    kind = images.schema[image].dataType.simpleString()
    return images.select(image, "columns", "disparity", "foreground").mapInPandas(run, f"{image} {kind}, disparity array<int>")


