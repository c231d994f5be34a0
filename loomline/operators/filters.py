"""Predicates and classifiers: Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import UUID


def is_image(path: Column, mime: Column, extensions: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(extensions) & mime.startswith("image/")


def size_error(width: Column, height: Column, least: int, most: int) -> Column:
    """The first failing check of an image's area, or null."""
    area = width.cast("long") * height.cast("long")
    return F.when(width.isNull() | height.isNull(), "unreadable").when(area < least * least, "below minimum").when(area > most * most, "above maximum")


def small_or(width: Column, height: Column, least: int) -> Column:
    return (width < least) | (height < least)


def small_and(width: Column, height: Column, least: int) -> Column:
    return (width.cast("long") * height.cast("long") < least * least) & (width < least) & (height < least)


def purge(seed: Column, width: Column, height: Column, multiplier: Column, first: int | None, last: int | None, most_w: int | None, most_h: int | None) -> Column:
    """Seed in an inclusive range, or both sides within bounds and no multiplier. A bound of 0 is a bound."""
    by_seed = seed.between(first, last) if first is not None and last is not None else F.lit(False)
    by_size = (width <= most_w) & (height <= most_h) & multiplier.isNull() if most_w is not None and most_h is not None else F.lit(False)
    return F.coalesce(by_seed, F.lit(False)) | F.coalesce(by_size, F.lit(False))


def blurry(volume: Column, ssim: Column, brisque: Column, t1: float | None = None, t2: float | None = None, t3: float | None = None) -> Column:
    """Any enabled test: volume / 100 under t1, (ssim + 1) / 2 over t2, brisque over t3."""
    tests = [volume / 100 < t1 if t1 is not None else None, (ssim + 1) / 2 > t2 if t2 is not None else None, brisque > t3 if t3 is not None else None]
    out = F.lit(False)
    for t in tests:
        out = out if t is None else out | t
    return out


def large_text(words: Column, image_height: Column, conf: float, length: int, ratio: float) -> Column:
    """Whether OCR words (text, conf, h) make large text.

    A word counts with enough confidence, length, height and two letters; two
    words with seven characters do, or one sure word of seven.
    """
    good = F.filter(words, lambda w: (w["conf"] >= conf) & (F.length(w["text"]) >= length) & (w["h"] / image_height >= ratio) & (F.length(F.regexp_replace(w["text"], "[^A-Za-z]", "")) >= 2))
    chars = F.aggregate(good, F.lit(0), lambda s, w: s + F.length(w["text"]))
    return ((F.size(good) >= 2) & (chars >= 7)) | F.exists(good, lambda w: (F.length(w["text"]) >= 7) & (w["conf"] >= 90))


def text_position(boxes: Column, width: Column, height: Column) -> Column:
    """Where the largest text box (x, y, w, h, conf) of at most a fifth of the height lies."""
    fit = F.filter(boxes, lambda b: (b["conf"] > 0) & (b["h"] <= 0.2 * height))
    top = F.array_max(F.transform(fit, lambda b: F.struct((b["w"] * b["h"]).alias("area"), b.alias("b"))))["b"]
    left, right, middle = top["x"] / width, (width - top["x"] - top["w"]) / width, (top["y"] + top["h"] / 2) / height
    side = F.when((left < 0.1) & (right < 0.1), "CENTER").when(F.abs(left - right) < 0.1, "CENTER").when(left > right, "RIGHT").otherwise("LEFT")
    level = F.when(middle > 0.66, "BOTTOM").when(middle < 0.33, "TOP").otherwise("MIDDLE")
    return F.when(top.isNotNull(), F.concat_ws(" ", level, side))


def training_file(path: Column) -> Column:
    """Model files of training folders ``tr_NN`` and ``tr_NNN``."""
    return path.rlike(r"(^|/)[^/]*tr_\d{2,3}/[^/]*\.safetensors$")


def model_sale(amount: Column, external_id: Column, description: Column, prefix: str, pattern: str) -> Column:
    return F.coalesce(amount > 0, F.lit(False)) & (F.coalesce(external_id.startswith(prefix), F.lit(False)) | F.coalesce(description.rlike("(?i)" + pattern), F.lit(False)))


def limited(available: Column, remaining: Column, needed: Column) -> Column:
    """Whether a quota says that nothing is left. A missing remainder is neither limited nor zero."""
    return F.when(remaining.isNotNull(), remaining < needed).when(available.isNotNull(), ~available).otherwise(F.lit(False))


def usable_now(available: Column, remaining: Column, needed: Column) -> Column:
    """Whether a quota says that something is left: enough remains, or it is available with no remainder stated."""
    return F.when(remaining.isNotNull(), remaining >= needed).otherwise(F.coalesce(available, F.lit(False)))


def media_url(url: Column, hosts: list[str]) -> Column:
    """Not inline data or an avatar, and either of a listed host or a UUID with a media extension."""
    bad = url.rlike("^(data|blob):") | url.rlike("(?i)avatar")
    host = F.regexp_extract(url, "^https?://([^/?#]+)", 1)
    return ~bad & (host.isin(hosts) | url.rlike(rf"(?i){UUID}.*\.(jpe?g|png|webp|gif|mp4|webm)([?#]|$)"))


def not_hidden(path: Column) -> Column:
    return ~path.rlike(r"(^|/)\.[^/]*$")


def looks_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 4096)) > 0


def moderated(body: Column) -> Column:
    """Whether a JSON body says ``moderated: true`` anywhere inside; a text that is no JSON object or array does not.

    Inside a JSON string a quote has a backslash before it, so a key's quote has none.
    """
    return F.coalesce(body.rlike(r'^\s*[{\[]') & F.try_parse_json(body).isNotNull() & body.rlike(r'(?<!\\)"moderated"\s*:\s*true(?![\w])'), F.lit(False))


def regex_search(text: Column, pattern: str) -> Column:
    """Whether the pattern is found; an empty or invalid one finds nothing."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = ""
    return F.coalesce(text.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def cooldown_class(text: Column) -> Column:
    """policy, cooldown or none of a reply's text; a policy refusal comes first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    policy = low.rlike(r"content policy|didn.?t comply|wasn.?t able to generate.*policy|cannot generate.*policy")
    return F.when(policy, "policy").when(low.rlike("temporary rate limit|cooldown|used too quickly|slow down|wait a short while|try again later"), "cooldown").otherwise("none")


#: What a body must hold to ask for an edited or a high-quality image.
EDIT_MARKS = ["imageedit", "image-edit", "image_edit", "imagereferences"]
QUALITY_MARKS = ["imagepro", "quality", "imagine-image-gen-pro"]
IMAGE_CONFIGS = ["responseMetadata.modelConfigOverride.modelMap.imageGenModelConfig", "responseMetadata.modelConfigOverride.modelMap.imageEditModelConfig", "toolOverrides.imageGen", "toolOverrides.imageEdit"]
IMAGE_COUNTS = ["numImages", "numberOfImages", "imageCount", "n"]


def generation_request(url: Column, method: Column, body: Column, url_part: str, image_like: Column) -> Column:
    """service, amount and detail of a request that starts a generation, else null.

    Only POST requests of a URL with ``url_part`` and a JSON object count. Video
    comes first (by its configuration or the model's name), in a class of its
    own at 720 lines; then, where ``image_like`` holds, edits, high quality and
    plain images. The amount is the stated number of images, of the first filled
    configuration or the body, else 4 for high quality and 1 for others.
    """
    got = lambda path: F.get_json_object(body, "$." + path)
    model, low = F.lower(F.coalesce(got("modelName"), F.lit(""))), F.lower(body)
    video = F.coalesce(got("responseMetadata.modelConfigOverride.modelMap.videoGenModelConfig"), got("toolOverrides.videoGen"))
    resolution = F.lower(F.coalesce(F.get_json_object(video, "$.resolutionName"), F.get_json_object(video, "$.resolution"), F.lit("")))
    any_of = lambda text, marks: F.coalesce(text.rlike("|".join(marks)), F.lit(False))
    config = F.coalesce(*[got(c) for c in IMAGE_CONFIGS])
    counts = [F.get_json_object(config, "$." + c) for c in IMAGE_COUNTS] + [got(c) for c in ("responseMetadata.imageCount", "imageGenerationCount", "imageCount")]
    stated = F.coalesce(*[F.nullif(c.try_cast("int"), F.lit(0)) for c in counts])
    attached = F.coalesce(F.json_array_length(got("fileAttachments")) > 0, F.lit(False))
    edit = any_of(model, ["image-edit", "image_edit"]) | any_of(low, EDIT_MARKS) | (attached & low.contains("edit"))
    high = any_of(model, ["pro", "quality"]) | any_of(low, QUALITY_MARKS)
    made = lambda service, amount, detail: F.struct(service.alias("service"), F.greatest(F.lit(1), amount).alias("amount"), F.when(model != "", model).otherwise(detail).alias("detail"))
    of = lambda name, amount, detail: made(F.lit(name), F.coalesce(stated, F.lit(amount)), detail)
    starts = url.contains(url_part) & (F.upper(F.coalesce(method, F.lit("GET"))) == "POST") & body.rlike(r"(?s)^\s*\{") & F.try_parse_json(body).isNotNull()
    is_video = video.isNotNull() | model.contains("video")
    found = F.when(is_video, made(F.when(resolution.contains("720"), "video720p").otherwise("video"), F.lit(1), F.lit("video")))
    found = found.when(image_like & edit, of("imageEdit", 1, "image edit")).when(image_like & high, of("imagePro", 4, "quality image")).when(image_like, of("image", 1, "speed image"))
    return F.when(starts, found)


def outcome(status: Column, message: Column) -> Column:
    """limit, moderated, failed or ok of a response, by its status and text; the first rule that holds."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when((status == 429) | text.rlike("rate limit|limit reached|too many requests|quota"), "limit")
        .when(text.rlike("moderat|policy|violat|not allowed"), "moderated")
        .when((status >= 400) | text.rlike("error|failed|timed out"), "failed")
        .otherwise("ok")
    )


def effective_limit(default: Column, live: Column, reached: Column, reported: Column, floor: Column, exact: Column, history: Column) -> Column:
    """The limit that counts: a live one, else the one reached today, else one that was reported.

    Else it is the default, raised to a stated floor, and, unless it is set
    ``exact``, to the most in the history. What is reported or worked out is
    rounded, halves up, and not below 0; a missing default is 0.
    """
    rounded = lambda x: F.when(x.isNotNull(), F.greatest(F.floor(x + 0.5), F.lit(0)).cast("double"))
    raised = F.greatest(F.coalesce(default, F.lit(0)).cast("double"), floor.cast("double"))
    own = F.when(F.coalesce(exact, F.lit(False)), raised).otherwise(F.greatest(raised, history.cast("double")))
    return F.coalesce(live.cast("double"), reached.cast("double"), rounded(reported), rounded(own))
