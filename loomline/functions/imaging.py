"""Whole-image measures and changes of PNGs: sharpness, palettes, recolouring, upright turns and resizing.

As in ``pixels``, an image that cannot be read gives null.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.pixels import decode, each, encode

#: Shares of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)
#: Window of the similarity index, and its two constants as shares of the value range.
WINDOW, K1, K2 = 7, 0.01, 0.03


def grey(p: np.ndarray) -> np.ndarray:
    """Grey values as whole numbers; of a grey image its own."""
    return np.floor(p[:, :, :3].astype(float) @ GREY + 0.5) if p.shape[2] >= 3 else p[:, :, 0].astype(float)


def rgb(p: np.ndarray) -> np.ndarray:
    """Three channels; transparency is left out."""
    return p[:, :, :3] if p.shape[2] >= 3 else np.repeat(p[:, :, :1], 3, axis=2)


def smoothed(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A plane through the same odd number of weights along both axes, mirrored at the edges."""
    r = len(weights) // 2
    for axis in (0, 1):
        pad = [(r, r) if k == axis else (0, 0) for k in range(p.ndim)]
        wide = np.pad(p, pad, mode="reflect" if p.shape[axis] > r else "symmetric")
        p = sum(w * np.take(wide, range(i, i + p.shape[axis]), axis) for i, w in enumerate(weights))
    return p


def bell(radius: int, sigma: float) -> np.ndarray:
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def centre(p: np.ndarray) -> np.ndarray:
    """The square around the middle circle of about 0.24 of the shorter side, black outside the circle."""
    h, w = p.shape[:2]
    y, x, r = h // 2, w // 2, int(min(h, w) / 3 * 0.71)
    inside = (np.arange(h)[:, None] - y) ** 2 + (np.arange(w)[None, :] - x) ** 2 <= r * r
    return (p * inside)[y - r : y + r, x - r : x + r]


def edge_variance(p: np.ndarray) -> float | None:
    """Variance of the four-neighbour Laplacian of a grey plane, shrunk to 1024 a side first."""
    if not p.size:
        return None
    if max(p.shape) > 1024:
        scale = 1024 / max(p.shape)
        p = np.floor(resized(p[:, :, None], max(1, round(p.shape[1] * scale)), max(1, round(p.shape[0] * scale)))[:, :, 0] + 0.5)
    w = np.pad(p, 1, mode="reflect" if min(p.shape) > 1 else "symmetric")
    return float((w[:-2, 1:-1] + w[2:, 1:-1] + w[1:-1, :-2] + w[1:-1, 2:] - 4 * p).var())


def self_similarity(p: np.ndarray) -> float | None:
    """Structural similarity of a grey plane and its own blur: near 1 where there is little to blur away; null under 7 pixels a side."""
    if min(p.shape) < WINDOW:
        return None
    q = np.floor(smoothed(p, bell(12, 4.1)) + 0.5)
    span = p.max() - p.min()
    if not span:
        return 1.0
    mean = lambda x: np.lib.stride_tricks.sliding_window_view(x, (WINDOW, WINDOW)).mean((2, 3))
    n = WINDOW * WINDOW
    a, b = mean(p), mean(q)
    va, vb, ab = (n / (n - 1) * (mean(x * y) - mx * my) for x, y, mx, my in ((p, p, a, a), (q, q, b, b), (p, q, a, b)))
    c1, c2 = (K1 * span) ** 2, (K2 * span) ** 2
    return float(((2 * a * b + c1) * (2 * ab + c2) / ((a * a + b * b + c1) * (va + vb + c2))).mean())


def sharpness(content: Column, middle: bool = False) -> Column:
    """volume (edge variance) and ssim (similarity to the own blur) of every image, of its middle if asked: what ``filters.blurry`` takes."""

    @F.pandas_udf("volume double, ssim double")
    def run(values: pd.Series) -> pd.DataFrame:
        found = []
        for x in values:
            p = decode(x)
            g = None if p is None else centre(grey(p)) if middle else grey(p)
            found.append((None, None) if g is None else (edge_variance(g), self_similarity(g)))
        return pd.DataFrame(found, columns=["volume", "ssim"], dtype=float)

    return run(content)


def median_cut(colours: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """(mean colour, pixels) of at most ``k`` boxes of the (n, 3) colours, fullest first.

    The box with the most pixels that has more than one colour is cut next:
    across its longest side (red before green before blue), after the colour at
    which half of its pixels are reached. Boxes with equally many go by age.
    """
    kinds, counts = np.unique(colours, axis=0, return_counts=True)
    todo = [(-int(counts.sum()), 0, kinds, counts)]
    done, age = [], 1
    while todo and len(todo) + len(done) < k:
        _, own_age, box, n = heapq.heappop(todo)
        if len(box) == 1:
            done.append((-int(n.sum()), own_age, box, n))
            continue
        axis = int(np.argmax(np.ptp(box.astype(int), axis=0)))
        order = np.argsort(box[:, axis], kind="stable")
        box, n = box[order], n[order]
        values, firsts = np.unique(box[:, axis], return_index=True)
        reached = np.add.reduceat(n, firsts).cumsum()
        cut = min(int(np.searchsorted(2 * reached, reached[-1])) + 1, len(values) - 1)
        at = firsts[cut]
        for part in (slice(None, at), slice(at, None)):
            heapq.heappush(todo, (-int(n[part].sum()), age, box[part], n[part]))
            age += 1
    boxes = sorted([*todo, *done], key=lambda b: b[:2])
    return [(np.average(box.astype(float), axis=0, weights=n), -total) for total, _, box, n in boxes]


def palette(p: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """At most ``k`` whole colours of an image, commonest first."""
    return [tuple(np.floor(mean + 0.5).astype(int).tolist()) for mean, _ in median_cut(rgb(p).reshape(-1, 3), k)]


def dominant(content: Column, k: int) -> Column:
    """At most ``k`` colours of every image as hex text by median cut, commonest first."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if (p := decode(x)) is None else ["#%02x%02x%02x" % c for c in palette(p, k)])

    return run(content)


def cheapest(cost: np.ndarray) -> list[int]:
    """The column of each row, all different, that make the least sum; of equal ones the first in order. At most as many rows as columns.

    Rows are placed one by one; of all placements of the first rows on one set of
    columns only the best goes on, 2**columns sets at most.
    """
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost.tolist():
        more: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for j, c in enumerate(row):
                if not used >> j & 1:
                    found = (total + c, (*chosen, j))
                    key = used | 1 << j
                    if key not in more or found < more[key]:
                        more[key] = found
        best = more
    return list(min(best.values())[1])


def colour_map(source: list[tuple[int, int, int]], target: list[tuple[int, int, int]], l2: float = 1e-2) -> tuple[list[int], np.ndarray]:
    """The target of each of the first source colours, at the least total distance, and the ridge-regularised affine map (4 by 3) between them."""
    a, b = np.array(source[: len(target)], float), np.array(target, float)
    chosen = cheapest(np.linalg.norm(a[:, None] - b[None], axis=2))
    x = np.hstack([a, np.ones((len(a), 1))])
    return chosen, np.linalg.solve(x.T @ x + l2 * np.eye(4), x.T @ b[chosen])


def hex_colours(names: list[str]) -> list[tuple[int, int, int]]:
    return [tuple(bytes.fromhex(n.strip().removeprefix("#"))) for n in names]


def recolour(content: Column, colours: list[str], k: int = 8, strength: float = 0.8, l2: float = 1e-2, keep_neutral: bool = True) -> Column:
    """Images towards a palette of hex colours (at most 16) by one affine map of their colours.

    The ``k`` commonest colours are assigned to different colours of the palette
    at the least total distance. With ``keep_neutral`` dark pixels keep more of
    their own colour. Transparency stays.
    """
    wanted = hex_colours(colours)
    if not 1 <= len(wanted) <= 16:
        raise ValueError("a palette has 1 to 16 colours")

    def change(p: np.ndarray) -> np.ndarray:
        flat = rgb(p).astype(float)
        _, m = colour_map(palette(p, k), wanted, l2)
        share = strength * np.clip((flat @ [0.2126, 0.7152, 0.0722] / 255 - 0.05) / 0.9, 0, 1)[:, :, None] if keep_neutral else strength
        out = np.clip(flat * (1 - share) + (flat @ m[:3] + m[3]) * share, 0, 255).astype(np.uint8)
        return np.concatenate([out, p[:, :, 3:]], axis=2) if p.shape[2] == 4 else out

    return each(content, change)


def recolour_pairs(content: Column, colours: list[str], k: int = 8) -> Column:
    """source and target of every colour that ``recolour`` assigns, as hex text."""
    wanted = hex_colours(colours)

    @F.pandas_udf("array<struct<source: string, target: string>>")
    def run(values: pd.Series) -> pd.Series:
        def one(x: bytes | None):
            if (p := decode(x)) is None:
                return None
            own = palette(p, k)
            return [{"source": "#%02x%02x%02x" % a, "target": "#%02x%02x%02x" % wanted[j]} for a, j in zip(own, colour_map(own, wanted)[0], strict=False)]

        return values.map(one)

    return run(content)


#: What makes an image upright, by its orientation; others are upright.
TURNS = {
    2: lambda p: p[:, ::-1],
    3: lambda p: p[::-1, ::-1],
    4: lambda p: p[::-1],
    5: lambda p: p.swapaxes(0, 1),
    6: lambda p: p[::-1].swapaxes(0, 1),
    7: lambda p: p[::-1, ::-1].swapaxes(0, 1),
    8: lambda p: p[:, ::-1].swapaxes(0, 1),
}


def upright(content: Column, orientation: Column) -> Column:
    """The image turned as its EXIF orientation says, without that tag; the content itself where there is nothing to turn."""

    @F.pandas_udf("binary")
    def run(values: pd.Series, turns: pd.Series) -> pd.Series:
        def one(x: bytes | None, turn: float | None) -> bytes | None:
            if x is None or pd.isna(turn) or int(turn) not in TURNS:
                return x
            p = decode(x)
            return None if p is None else encode(np.ascontiguousarray(TURNS[int(turn)](p)))

        return pd.Series([one(x, t) for x, t in zip(values, turns, strict=True)], dtype=object)

    return run(content, orientation)


def _axis(old: int, new: int) -> np.ndarray:
    """new by old weights of one axis: the mean of the covered stretch when shrinking, straight between the two nearest when growing."""
    out = np.zeros((new, old))
    if new <= old:
        edges = np.arange(new + 1) * old / new
        at = np.arange(old)
        out = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return out / out.sum(1, keepdims=True)
    place = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
    low = np.minimum(place.astype(int), max(old - 2, 0))
    out[np.arange(new), low] = 1 - (place - low)
    out[np.arange(new), np.minimum(low + 1, old - 1)] += place - low
    return out


def resized(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Float values of an image of another size."""
    return np.einsum("yh,hwc,xw->yxc", _axis(p.shape[0], height), p.astype(float), _axis(p.shape[1], width), optimize=True)


def whole(p: np.ndarray) -> np.ndarray:
    """Values as bytes; halves go up."""
    return np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8)


def downsized(content: Column, most: int, least: int) -> Column:
    """action, width, height and content: images of over ``most`` squared pixels shrunk into a square of that side, as RGB.

    ``small`` keeps an image as it is that is under ``least`` on both sides;
    ``resized`` and ``converted`` are the others. An image that cannot be read has
    action ``error`` and no content. Turn images upright first.
    """

    @F.pandas_udf("action string, width int, height int, content binary")
    def run(values: pd.Series) -> pd.DataFrame:
        found = []
        for x in values:
            p = decode(x)
            if p is None:
                found.append(("error", None, None, None))
                continue
            h, w = p.shape[:2]
            if w < least and h < least:
                found.append(("small", w, h, x))
            elif w * h > most * most:
                ratio = min(most / w, most / h)
                w, h = max(1, int(w * ratio)), max(1, int(h * ratio))
                found.append(("resized", w, h, encode(whole(resized(rgb(p), w, h)))))
            else:
                found.append(("converted", w, h, encode(np.ascontiguousarray(rgb(p)))))
        frame = pd.DataFrame(found, columns=["action", "width", "height", "content"])
        return frame.astype({"width": "Int32", "height": "Int32"})

    return run(content)


def composite(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """An image over another of its size by its transparency, as RGB, or RGBA where the lower one has transparency."""
    alpha = lambda p: p[:, :, -1:].astype(float) / 255 if p.shape[2] in (2, 4) else np.ones((*p.shape[:2], 1))
    a, b = alpha(above), alpha(below)
    total = a + b * (1 - a)
    colour = np.divide(rgb(above) * a + rgb(below) * b * (1 - a), total, out=np.zeros((*below.shape[:2], 3)), where=total > 0)
    return whole(np.concatenate([colour, total * 255], axis=2) if below.shape[2] in (2, 4) else colour)


def _pairs(first: Column, second: Column, x: Column, y: Column, make: Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]) -> Column:
    """``make`` of the pixels of two images and two numbers; null where an image cannot be read."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(left: bytes | None, right: bytes | None, dx: float, dy: float) -> bytes | None:
            p, q = decode(left), decode(right)
            return None if p is None or q is None else encode(np.ascontiguousarray(make(p, q, dx, dy)))

        return pd.Series([one(*v) for v in zip(a, b, x, y, strict=True)], dtype=object)

    return run(first, second, x.cast("double"), y.cast("double"))


def covered(content: Column, overlay: Column) -> Column:
    """Images with an overlay brought to their size and laid over them."""
    return _pairs(content, overlay, F.lit(0.0), F.lit(0.0), lambda p, q, *_: composite(p, whole(resized(q, p.shape[1], p.shape[0]))))


def on_background(subject: Column, background: Column, x: Column, y: Column) -> Column:
    """Subjects over backgrounds that are scaled to cover them, as RGB.

    The background's window is moved right and down by shares of the subject's
    sides, from 0 and as far as the background reaches.
    """

    def make(p: np.ndarray, q: np.ndarray, dx: float, dy: float) -> np.ndarray:
        h, w = p.shape[:2]
        scale = max(w / q.shape[1], h / q.shape[0])
        wide, high = max(w, int(q.shape[1] * scale)), max(h, int(q.shape[0] * scale))
        left, top = min(max(int(dx * w), 0), wide - w), min(max(int(dy * h), 0), high - h)
        return composite(rgb(whole(resized(q, wide, high)))[top : top + h, left : left + w], p)

    return _pairs(subject, background, x, y, make)


# ---- tints: values from 0 to 1, a the image, b a colour ----


def _multiply(a, b):
    return a * b


def _screen(a, b):
    return 1 - (1 - a) * (1 - b)


def _overlay(a, b):
    return np.where(a < 0.5, 2 * a * b, 1 - 2 * (1 - a) * (1 - b))


def _soft(a, b):
    return (1 - a) * a * b + a * _screen(a, b)


def _plain(a):
    return np.repeat((a @ GREY)[:, :, None], 3, axis=2)


#: From linear light to XYZ by the standard primaries, each row over the white point.
_XYZ = np.array([(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]) / np.array([[0.95047], [1.0], [1.08883]])


def to_lab(p: np.ndarray) -> np.ndarray:
    """CIE lightness and the two colour axes of values from 0 to 1."""
    light = np.where(p <= 0.04045, p / 12.92, ((p + 0.055) / 1.055) ** 2.4) @ _XYZ.T
    f = np.where(light > (6 / 29) ** 3, np.cbrt(light), light / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], axis=-1)
    light = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) @ np.linalg.inv(_XYZ).T
    light = np.clip(light, 0, 1)
    return np.where(light <= 0.0031308, light * 12.92, 1.055 * light ** (1 / 2.4) - 0.055)


def _lightness(a, b):
    """The lightness of the image with the colour's hue and chroma."""
    lab, own = to_lab(a), to_lab(b)
    return from_lab(np.stack([lab[..., 0], *(np.broadcast_to(own[..., k], a.shape[:2]) for k in (1, 2))], axis=-1))


def _hue(a, b):
    """The image's saturation and value with the colour's hue; a grey colour has the hue of red."""
    top, low = a.max(2, keepdims=True), a.min(2, keepdims=True)
    span = float(np.ptp(b))
    pure = (b - b.min()) / span if span else np.array([1.0, 0.0, 0.0])
    return low + (top - low) * pure


#: The names of the modes and what each makes of a picture and up to three colours.
TINTS: dict[str, Callable[..., np.ndarray]] = {
    "multiply": lambda a, b, *_: (a + b) / 2,
    "color_burn": lambda a, b, *_: _multiply(a, b),
    "overlay": lambda a, b, *_: _overlay(a, b),
    "color": lambda a, b, *_: (_plain(a) + b) / 2,
    "hue": lambda a, b, *_: _hue(a, b),
    "screen": lambda a, b, *_: _screen(a, b),
    "soft_light": lambda a, b, *_: _soft(a, b),
    "hard_light": lambda a, b, *_: np.where(a <= 0.5, 2 * a * b, 1 - 2 * (1 - a) * (1 - b)),
    "luminosity": lambda a, b, *_: _lightness(a, b),
    "difference": lambda a, b, *_: abs(a - b),
    "light_multiply_screen": lambda a, b, *_: (_screen(_multiply(a, b), b) + a) / 2,
    "light_soft_overlay": lambda a, b, *_: _overlay(_soft(a, b), b),
    "light_color_screen": lambda a, b, *_: _screen((_plain(a) + b) / 2, b),
    "light_lab_soft": lambda a, b, *_: _soft(_lightness(a, b), b),
    "dual_tone": lambda a, b, c, *_: (c + _plain(a)) / 2,
    "gradient_light": lambda a, b, c, *_: _multiply(a, b + (c - b) * (np.arange(len(a)) / len(a))[:, None, None]),
    "tri_color": lambda a, b, c, d: _screen(_overlay(_multiply(b, _plain(a)), c), d),
    "grayscale": lambda a, b, *_: _plain(a),
}
_COLOURS_OF = {"dual_tone": 2, "gradient_light": 2, "tri_color": 3}


def tinted(content: Column, mode: str, *colours: str) -> Column:
    """Images through one of TINTS with hex colours, as RGB: a second colour for dual_tone and gradient_light, a third for tri_color.

    gradient_light goes from the first colour at the top to the second. The mode
    ``multiply`` is the mean of both and ``color_burn`` the product.
    """
    own = [np.array(c, float) / 255 for c in hex_colours(list(colours))]
    if len(own) < _COLOURS_OF.get(mode, 1):
        raise ValueError(f"{mode} takes {_COLOURS_OF[mode]} colours")
    return each(content, lambda p: whole(np.round(TINTS[mode](rgb(p).astype(float) / 255, *own) * 255, 6)))  # a half stays one


def face_crop(content: Column, box: Column, least: int) -> Column:
    """A square around a found face (x, y, w, h) of at least ``least`` pixels a side where the image has them, moved inside the image."""

    @F.pandas_udf("binary")
    def run(values: pd.Series, boxes: pd.DataFrame) -> pd.Series:
        def one(x: bytes | None, face: tuple) -> bytes | None:
            p = decode(x)
            if p is None or any(pd.isna(v) for v in face):
                return None
            h, w = p.shape[:2]
            side = min(max(int(max(face[2], face[3])), least), h, w)
            left = min(max(int(face[0] + face[2] / 2 - side / 2), 0), w - side)
            top = min(max(int(face[1] + face[3] / 2 - side / 2), 0), h - side)
            return encode(np.ascontiguousarray(p[top : top + side, left : left + side]))

        return pd.Series([one(x, f) for x, f in zip(values, boxes[["x", "y", "w", "h"]].itertuples(index=False), strict=True)], dtype=object)

    return run(content, F.struct(*[box[k].alias(k) for k in ("x", "y", "w", "h")]))


def from_values(values: Column, width: int, channels: int = 1) -> Column:
    """A PNG of whole numbers from 0 to 255, ``width`` pixels a row, 1 to 4 channels a pixel; no values, or a last row that is not full, give null."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: encode(np.asarray(v, np.uint8).reshape(-1, width, channels)) if v is not None and len(v) and len(v) % (width * channels) == 0 else None)

    return run(values)


def to_values(content: Column) -> Column:
    """All values of an image, row by row, channel by channel."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if (p := decode(x)) is None else p.ravel().astype(np.int32))

    return run(content)
