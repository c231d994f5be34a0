"""Seeded augmentation of images: a plan of draws and steps as a table, then the pixels.

The plan holds every random number, drawn by Spark from the seed and the number
of the draw alone, so it is the log of what is done, and the same plan gives the
same bytes whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.geometry import largest_in_rotated
from loomline.functions.imaging import bell, grey, resized, rgb, smoothed, whole
from loomline.functions.pixels import decode, encode
from loomline.operators.ordering import sample_to_target, seeded

STEP = "struct<op: string, values: array<double>>"


@dataclass(frozen=True)
class Settings:
    """Chances and ranges of the steps (fixed values of the source's defaults)."""

    crop: float = 0.95
    scale: tuple[float, float] = (0.78, 1.0)
    shift: float = 0.06
    rotate: float = 0.40
    degrees: float = 4.0
    flip: float = 0.50
    colour: float = 0.55
    brightness: float = 0.12
    contrast: float = 0.12
    saturation: float = 0.10
    stretch: float = 0.0
    gamma: float = 0.0
    gamma_range: float = 0.08
    blur: float = 0.12
    radius: float = 0.9
    sharpen: float = 0.18
    percent: int = 140
    noise: float = 0.12
    deviation: float = 0.02


def plan(images: DataFrame, needed: int, settings: Settings = Settings(), seed: int = 0) -> DataFrame:
    """draw, path, item_seed, out and steps of ``needed`` draws with replacement from the images (path, width, height).

    steps is the chain in its order, an array of (op, values). Of images that
    share a path each is drawn on its own. No images give no draws.
    """
    draws = sample_to_target(images.select("path", "width", "height"), [F.col("path"), F.col("width"), F.col("height")], needed, seed)
    u = lambda name: seeded(F.col("item_seed"), F.lit(name), seed=seed)
    within = lambda name, low, high: u(name) * (high - low) + low
    around = lambda name, spread: within(name, 1.0 - spread, 1.0 + spread)

    def step(op: str, chance: float, *values: Column) -> Column:
        made = F.struct(F.lit(op).alias("op"), F.array(*[v.cast("double") for v in values]).cast("array<double>").alias("values"))
        return F.when(u(f"{op}?") < chance, made)

    angle = within("degrees", -settings.degrees, settings.degrees)
    inner = largest_in_rotated(F.col("width"), F.col("height"), angle)
    chain = [
        step("crop", settings.crop, within("scale", *settings.scale), within("dx", -settings.shift, settings.shift), within("dy", -settings.shift, settings.shift)),
        step("rotate", settings.rotate if settings.degrees else 0.0, angle, inner["width"] / F.col("width"), inner["height"] / F.col("height")),
        step("flip", settings.flip),
        step("colour", settings.colour, around("brightness", settings.brightness), around("contrast", settings.contrast), around("saturation", settings.saturation)),
        step("stretch", settings.stretch),
        step("gamma", settings.gamma, F.greatest(around("gamma", settings.gamma_range), F.lit(0.05))),
        step("blur", settings.blur, within("radius", 0.1, settings.radius)),
        step("sharpen", settings.sharpen, F.round(within("percent", 10.0, float(settings.percent)))),
        step("noise", settings.noise, within("deviation", 0.0, settings.deviation) * 255.0, F.floor(u("noise seed") * (1 << 32))),
    ]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    out = F.format_string("%s__aug_%08d_%s.png", stem, F.col("draw") + 1, F.substring(F.lpad(F.lower(F.hex("item_seed")), 16, "0"), -8, 8))
    return draws.select("draw", "path", "item_seed", out.alias("out"), F.filter(F.array(*chain), lambda s: s.isNotNull()).alias("steps"))


def _crop(p: np.ndarray, scale: float, dx: float, dy: float) -> np.ndarray:
    """A window of the scale, moved by shares of the shorter side and kept inside, brought back to full size."""
    h, w = p.shape[:2]
    ch, cw = (min(n, max(2, round(n * scale))) for n in (h, w))
    top, left = (min(max(round((n - c) / 2 + d * min(h, w)), 0), n - c) for n, c, d in ((h, ch, dy), (w, cw, dx)))
    return resized(p[top : top + ch, left : left + cw], w, h)


def _rotate(p: np.ndarray, degrees: float, wide: float, high: float) -> np.ndarray:
    """The largest upright rectangle of the turned image (its sides as shares of the image's), brought back to full size; straight between pixels."""
    h, w = p.shape[:2]
    y = ((np.arange(h) + 0.5) / h - 0.5)[:, None] * h * high
    x = ((np.arange(w) + 0.5) / w - 0.5)[None, :] * w * wide
    s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
    ty, tx = np.clip(s * x + c * y + h / 2 - 0.5, 0, h - 1), np.clip(c * x - s * y + w / 2 - 0.5, 0, w - 1)
    iy, ix = np.minimum(ty.astype(int), max(h - 2, 0)), np.minimum(tx.astype(int), max(w - 2, 0))
    fy, fx = (ty - iy)[:, :, None], (tx - ix)[:, :, None]
    jy, jx = np.minimum(iy + 1, h - 1), np.minimum(ix + 1, w - 1)
    return (p[iy, ix] * (1 - fx) + p[iy, jx] * fx) * (1 - fy) + (p[jy, ix] * (1 - fx) + p[jy, jx] * fx) * fy


def _colour(p: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    p = np.clip(p * brightness, 0, 255)
    p = np.clip((p - (m := np.floor(grey(p).mean() + 0.5))) * contrast + m, 0, 255)
    g = grey(p)[:, :, None]
    return g + (p - g) * saturation


def _stretch(p: np.ndarray) -> np.ndarray:
    low, high = p.min((0, 1)), p.max((0, 1))
    return np.where(high > low, (p - low) * 255 / np.where(high > low, high - low, 1), p)


def _blurred(p: np.ndarray, radius: float) -> np.ndarray:
    return smoothed(p, bell(max(1, round(4 * radius)), radius))


def _sharpen(p: np.ndarray, percent: float) -> np.ndarray:
    gap = p - _blurred(p, 1.0)
    return np.where(abs(gap) >= 3, p + gap * percent / 100, p)


#: One step of the chain: a float image and its values in, an image out.
STEPS: dict[str, Callable[..., np.ndarray]] = {
    "crop": _crop,
    "rotate": _rotate,
    "flip": lambda p: p[:, ::-1],
    "colour": _colour,
    "stretch": _stretch,
    "gamma": lambda p, gamma: (p / 255) ** (1 / gamma) * 255,
    "blur": _blurred,
    "sharpen": _sharpen,
    "noise": lambda p, deviation, own: p + np.random.default_rng(int(own)).normal(0, deviation, p.shape),
}


def through(pixels: np.ndarray, steps: list[tuple[str, list[float]]]) -> np.ndarray:
    """An image through a chain of steps; after each, values are whole."""
    for op, values in steps:
        pixels = whole(STEPS[op](pixels.astype(float), *values))
    return pixels


def augmented(planned: DataFrame, contents: DataFrame) -> DataFrame:
    """draw, path, out, width, height, steps and content (PNG) of every planned draw; ``contents`` has path and content, a row a path.

    Draws of images that cannot be read have null sides and content, so that the
    log says so. Contents meet their draws in a join on the path; draws of one
    image need not meet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for draw, path, out, steps, content in batch[["draw", "path", "out", "steps", "content"]].itertuples(index=False):
                p = decode(content)
                if p is None:
                    found.append((draw, path, out, None, None, steps, None))
                    continue
                made = through(rgb(p), [(s["op"], list(s["values"])) for s in steps])
                found.append((draw, path, out, made.shape[1], made.shape[0], steps, encode(np.ascontiguousarray(made))))
            frame = pd.DataFrame(found, columns=["draw", "path", "out", "width", "height", "steps", "content"])
            yield frame.astype({"width": "Int32", "height": "Int32"})

    rows = planned.join(contents.select("path", "content"), "path", "left").select("draw", "path", "out", "steps", "content")
    return rows.mapInPandas(run, f"draw long, path string, out string, width int, height int, steps array<{STEP}>, content binary")
