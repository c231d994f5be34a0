"""Text functions: Column to Column, native unless said otherwise."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.tags import strip

_SHIFT_FROM = string.ascii_lowercase + string.ascii_uppercase + string.digits
_SHIFT_TO = "".join(x[1:] + x[:1] for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def shift_chars(text: Column) -> Column:
    """Every ASCII letter and digit to its successor, z to a, Z to A, 9 to 0."""
    return F.translate(text, _SHIFT_FROM, _SHIFT_TO)


def printable(text: Column) -> Column:
    """Printable ASCII and white space alone."""
    return F.regexp_replace(text, r"[^\x20-\x7e\t\n\r\x0b\x0c]", "")


def replace_count(text: Column, pattern: str, replacement: str, multiline: bool = False, dotall: bool = False) -> tuple[Column, Column]:
    """The text after replacement, and the number of matches."""
    flags = "(?m)" * multiline + "(?s)" * dotall
    return F.regexp_replace(text, flags + pattern, replacement), F.regexp_count(text, F.lit(flags + pattern))


def replace_pairs(text: Column, pairs: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Literal replacements one after another."""
    if ignore_case:
        return reduce(lambda x, p: F.regexp_replace(x, "(?i)\\Q" + p[0] + "\\E", p[1].replace("\\", "\\\\").replace("$", "\\$")), pairs, text)
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, text)


def replace_in_map(metadata: Column, pairs: list[tuple[str, str]]) -> Column:
    """Case-insensitive replacements in every value of a map."""
    return F.transform_values(metadata, lambda _, v: replace_pairs(v, pairs, ignore_case=True))


def obfuscate_name(name: Column) -> Column:
    """Spaces become ``( :0)``; a name without one gets ``(:0)`` before its last character."""
    return F.when(name.contains(" "), F.replace(name, F.lit(" "), F.lit("( :0)"))).otherwise(F.regexp_replace(name, "(?s)^(.*)(.)$", "$1(:0)$2"))


def _last(text: Column, marker: str) -> tuple[Column, Column]:
    """The parts before and after the last marker."""
    after = F.substring_index(text, marker, -1)
    return F.substr(text, F.lit(1), F.length(text) - F.length(after) - len(marker)), after


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it; inside lambdas Spark works a repeated expression out each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def last_of_keys(pairs: Column) -> Column:
    """Of structs with a ``key`` the last of each key, in order."""
    return bound(pairs, lambda held: F.filter(held, lambda p, i: ~F.exists(F.slice(held, i + 2, F.size(held)), lambda q: q["key"] == p["key"])))


def parse_parameters(text: Column) -> Column:
    """prompt, negative_prompt and params of a generation text; null unless both markers are there.

    The last ``Steps:`` and, before it, the last ``Negative prompt:`` divide the
    text. Parameters split at commas, and at their first colon; of repeated names
    the last counts.
    """
    head, tail = _last(text, "Steps:")
    prompt, negative = _last(head, "Negative prompt:")
    items = F.filter(F.split(F.concat(F.lit("Steps:"), tail), ","), lambda x: x.contains(":"))
    pairs = F.transform(items, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substr(x, F.position(F.lit(":"), x) + 1)).alias("value")))
    found = F.struct(strip(prompt).alias("prompt"), strip(negative).alias("negative_prompt"), F.map_from_entries(last_of_keys(pairs)).alias("params"))
    return F.when(text.contains("Steps:") & head.contains("Negative prompt:"), found)


def parse_parameters_first(text: Column) -> Column:
    """The variant that divides at the first markers; the negative part may be missing.

    prompt, negative_prompt, steps, sampler, cfg (``CFG scale``, else ``Guidance scale``), seed.
    """
    head = F.split_part(text, F.lit("Steps:"), F.lit(1))
    tail = F.regexp_replace(F.substr(text, F.length(head) + 1), r"^\s*,+", "")
    value = lambda name: F.nullif(F.trim(F.regexp_extract(tail, name + r":\s*([^,]*)", 1)), F.lit(""))
    clean = lambda x: F.nullif(F.regexp_replace(strip(x), r"^,+\s*|,+$", ""), F.lit(""))
    negative = F.when(head.contains("Negative prompt:"), F.substr(head, F.position(F.lit("Negative prompt:"), head) + len("Negative prompt:")))
    return F.struct(
        clean(F.split_part(head, F.lit("Negative prompt:"), F.lit(1))).alias("prompt"),
        clean(negative).alias("negative_prompt"),
        value("Steps").alias("steps"),
        value("Sampler").alias("sampler"),
        F.coalesce(value("CFG scale"), value("Guidance scale")).alias("cfg"),
        value("Seed").alias("seed"),
    )


#: The rewrites that simplify a prompt, in order, each with texts that a match holds. Escaped brackets wait as private-use
#: characters meanwhile. Repeats that cannot give anything back are possessive: the same matches, and no second search where there is none.
SIMPLIFY = [
    (r"\(:0\)", "", "(:0)"),
    (r"\( :0\)", " ", "( :0)"),
    (r"\\\(", "\ue000", "\\("),
    (r"\\\)", "\ue001", "\\)"),
    (r"(?<=\))([^,\s\]])", ",$1", ")"),
    (r"(?<=\])([^,\s\]])", ",$1", "]"),
    (r"<[^>]++>", "", "<", ">"),
    (r"\(([^:]++):([^:]++):\d+(\.\d+)?\)", "$1, $2", "(", ":", ")"),
    (r"\(([^:]++):\d+(\.\d+)?\)", "$1", "(", ":", ")"),
    (r"((?:\[(?=[^\]]++\])|(?!^)\G)[^\[\]|]*+)\|", "$1, ", "[", "|"),
    (r"\[([^\]]++)\]", "$1", "[", "]"),
    (r"\(([^()]++)\)", "$1", "(", ")"),
    (r"([^:]):\s*\d+(\.\d+)?", "$1", ":"),
    (r",[ ]++,", ", ", ", "),
    (r"[|()\[\]]", ""),
    (r":(?![ \d])", "", ":"),
    (r"BREAK", "", "BREAK"),
    (r"\s*,\s*", ", ", ","),
    (r"\ue000", "(", "\ue000"),
    (r"\ue001", ")", "\ue001"),
    (r",\s*:\d+(\.\d+)?,", ", ", ",", ":"),
    (r",\s*\d+(\.\d+)?,", ", ", ","),
    (r"^,|,$", "", ","),
    (r"^ *, *", "", ","),
    (r" *, *$", "", ","),
    (r"[\n\r]", " "),
    (r", ,", ", ", ", ,"),
    (r"\d+\.\d+", "", "."),
    (r" +", " ", "  "),
    (r",[ ]++,", ",", ", "),
]


def _rewritten(text: Column, pattern: str, replacement: str, *held: str) -> Column:
    """The text after replacement; the pattern is tried on texts alone that have all of ``held``."""
    if not held:
        return F.regexp_replace(text, pattern, replacement)
    return bound(text, lambda x: F.when(reduce(lambda a, b: a & b, [x.contains(h) for h in held]), F.regexp_replace(x, pattern, replacement)).otherwise(x))


def simplify_prompt(text: Column, excluded: tuple[str, ...] = ()) -> Column:
    """A prompt without weights, brackets, network tags and empty parts; patterns of ``excluded`` go first.

    Look-around keeps text that a consuming rewrite would change; RE2 engines
    cannot express it, so it is tested by example.
    """
    return strip(reduce(lambda x, p: _rewritten(x, *p), [*((e, "") for e in excluded), *SIMPLIFY], text))


def extract_prompt(text: Column, mode: str = "original", excluded: tuple[str, ...] = ()) -> Column:
    """all: the text; original: its prompt; simplified: the simplified prompt. A text without markers stays as it is."""
    if mode == "all":
        return text
    prompt = F.coalesce(parse_parameters(text)["prompt"], text)
    return simplify_prompt(prompt, excluded) if mode == "simplified" else prompt


def seed_size_multiplier(text: Column) -> Column:
    """seed, width, height and multiplier of a generation text, each null where missing or out of range."""
    got = lambda pattern, kind: F.regexp_extract(text, pattern, 1).try_cast(kind)
    return F.struct(
        got(r"Seed: (\d+)(?:,|$)", "bigint").alias("seed"),
        got(r"Size: (\d+)x\d+(?:,|$)", "int").alias("width"),
        got(r"Size: \d+x(\d+)(?:,|$)", "int").alias("height"),
        got(r"Hires upscale: ([\d.]+)(?:,|$)", "double").alias("multiplier"),
    )


def clean_basename(name: Column) -> Column:
    """A file name without extension and without what follows its last `` (copy``."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(stem.contains(" (copy"), F.regexp_extract(stem, r"^(.*) \(copy", 1)).otherwise(stem)


#: File types whose names are cleaned.
POSTFIX_TYPES = ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "ico"]


def without_postfix(name: Column, pattern: str) -> Column:
    """An image's file name without what the pattern matches; names of other types stay."""
    return F.when(F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)).isin(POSTFIX_TYPES), F.regexp_replace(name, pattern, "")).otherwise(name)


def without_number(name: Column) -> Column:
    """A file's stem without a space and number at its end."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r" [0-9]+$", "")


def with_repeats(folder: Column, repeats: Column) -> Column:
    """A folder name with its number of repeats in front, in place of one that it has."""
    return F.concat_ws("_", repeats.cast("string"), F.regexp_replace(folder, r"^[0-9]+_", ""))


def extension(name: Column, mode: str = "last") -> Column:
    """Lower-cased extension: ``.tar.*`` pairs count as one, dot files have none; mode ``full`` keeps all suffixes."""
    base = F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1))
    tar = F.regexp_extract(base, r"(\.tar\.(?:gz|bz2|xz|zst|lz|lzma|lz4))$", 1)
    found = F.regexp_extract(base, r"^\.*[^.]+((?:\.[^.]+)+)$" if mode == "full" else r"^.*[^.].*(\.[^.]+)$", 1)
    return F.when(tar != "", tar).otherwise(found)


def human_bytes(size: Column) -> Column:
    """Whole kilobytes or megabytes (``10kb``, ``5mb``) or plain bytes as a number; else null."""
    number = F.regexp_extract(F.lower(F.trim(size)), r"^(\d+)\s*(?:kb|mb)?$", 1).try_cast("bigint")
    return number * F.when(F.lower(size).endswith("kb"), 1024).when(F.lower(size).endswith("mb"), 1024 * 1024).otherwise(1)


def compact_number(value: Column) -> Column:
    """1500 as 1.5k, 2000000 as 2M."""
    short = lambda x: F.regexp_replace(F.format_string("%.1f", x.cast("double")), r"\.0$", "")
    return F.when(value >= 1_000_000, F.concat(short(value / 1_000_000), F.lit("M"))).when(value >= 1000, F.concat(short(value / 1000), F.lit("k"))).otherwise(value.cast("string"))


def price(text: Column) -> Column:
    """1.5k, 2M or 1,200 as a number; null without digits."""
    number = F.replace(F.regexp_extract(text, r"([\d.,]+)\s*[kKmM]?", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"[\d.,]+\s*([kKmM])", 1))
    return number * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)


def url_without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def url_without_param(url: Column, name: str) -> Column:
    """The URL without one query parameter and without its fragment."""
    out = F.regexp_replace(url, "#.*$", "")
    out = F.regexp_replace(out, rf"([?&]){name}=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"&{2,}", "&"), r"\?&", "?"), r"[?&]$", "")


def url_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def uuids(text: Column) -> Column:
    """Lower-cased UUIDs in order of appearance, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({UUID})"), F.lit(1)), F.lower))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def sanitise_path(path: Column, rewrites: list[tuple[str, str]]) -> Column:
    """Every component rewritten by the regexes in turn; one that ends up empty or as dots becomes ``_``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    clean = F.transform(parts, lambda x: reduce(lambda y, r: F.regexp_replace(y, *r), rewrites, x))
    named = F.transform(clean, lambda x: F.when(x.isin("", ".", ".."), "_").otherwise(x))
    return F.when(F.size(named) == 0, "_").otherwise(F.array_join(named, "/"))


def strip_components(path: Column, n: int) -> Column:
    """The path without its first n components; the last one always stays."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    skip = F.least(F.lit(max(n, 0)), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(parts, skip + 1, F.size(parts)), "/")


def flat_prefix(path: Column) -> Column:
    """A relative folder as one name; the root is ``root``."""
    flat = F.btrim(F.regexp_replace(F.regexp_replace(path, r"[\\/]", "_"), "_{2,}", "_"), F.lit("_"))
    return F.when(path.isin("", ".") | (flat == ""), "root").otherwise(flat)


def name_template(template: str, **values: Column) -> Column:
    """A template with ``{name}`` fields."""
    return reduce(lambda x, kv: F.replace(x, F.lit("{" + kv[0] + "}"), kv[1].cast("string")), values.items(), F.lit(template))


def band(value: Column, low: float, high: float) -> Column:
    """low up to ``low``, high from ``high``, else middle."""
    return F.when(value <= low, "low").when(value >= high, "high").otherwise("middle")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 64-bit numbers need at most 92."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def aspect_folder(width: Column, height: Column) -> Column:
    """The reduced aspect ratio as ``%05dx%05d``; zeros where both sides are 0."""
    part = lambda side: F.coalesce(F.try_divide(side, gcd(width, height)), F.lit(0)).cast("int")
    return F.format_string("%05dx%05d", part(width), part(height))


def cooldown_ms(text: Column) -> Column:
    """Half of a stated wait such as ``1 hour and 30 minutes``, in whole milliseconds; null without one."""
    part = lambda unit, ms: F.coalesce(F.regexp_extract(F.lower(text), rf"(\d+)\s*{unit}", 1).try_cast("bigint"), F.lit(0)) * ms
    total = part("hour", 3_600_000) + part("minute", 60_000) + part("second", 1000)
    return F.when(total > 0, F.floor(total / 2))


def sidecar_caption(record: Column) -> Column:
    """A JSON record's caption: author, name, description, tags, watermark, camera, lens, place and date, in this order.

    A date that cannot be read is left out. ``record`` is a struct as ``SIDECAR`` declares.
    """
    taken = F.try_to_timestamp(record["taken_at"], F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))
    author = F.nullif(strip(F.coalesce(record["user"]["fullname"], record["user"]["displayName"])), F.lit(""))
    filled = lambda x: F.nullif(strip(x), F.lit(""))
    return F.concat_ws(
        ", ",
        F.when(author.isNotNull(), F.concat(F.lit("photography by "), author)),
        filled(record["name"]),
        filled(record["description"]),
        F.array_join(record["tags"], ", "),
        F.when(record["watermark"], "watermark"),
        *[F.concat(F.lit(f"{name} "), filled(record[name])) for name in ("camera", "lens", "location")],
        F.when(taken.isNotNull(), F.concat(F.lit("photograph taken on "), F.date_format(taken, "yyyy.MM.dd"))),
    )


#: The schema of a JSON sidecar record.
SIDECAR = "name STRING, description STRING, tags ARRAY<STRING>, watermark BOOLEAN, user STRUCT<fullname: STRING, displayName: STRING>, camera STRING, lens STRING, location STRING, taken_at STRING"


def sidecar_from_json(text: Column) -> Column:
    """A sidecar struct from JSON text; malformed text gives nulls."""
    return F.from_json(text, SIDECAR)


def image_line(line: Column, start: str = "https://media.") -> Column:
    """image, url and alt of a line; null without `` Alt: ``. The image is the first word that begins with ``start``."""
    words = F.split(line, " ")
    image = F.coalesce(F.get(F.filter(words, lambda w: w.startswith(start)), F.lit(0)), F.lit(""))
    rest = F.when(image == "", F.trim(line)).otherwise(F.array_join(F.filter(words, lambda w: w != image), " "))
    at = F.position(F.lit(" Alt: "), rest)
    return F.when(at > 0, F.struct(image.alias("image"), F.substr(rest, F.lit(1), at - 1).alias("url"), F.substr(rest, at + 6).alias("alt")))


def name_with_digest(path: Column) -> Column:
    """A stem with the first eight hex digits of the path's MD5, then the extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("_"), F.substring(F.md5(path), 1, 8), F.regexp_extract(base, r"(\.[^.]*)$", 1))


def entry_caption(names: Column, tags: Column, channels: Column, additional: str = "") -> Column:
    """A scraped entry's caption: names, tags, additional tags and ``watermark "channel"``, lower-cased, empty parts closed up."""
    low = lambda x: F.transform(x, F.lower)
    more = [t.strip().lower().replace("_", " ") for t in additional.split(",")]
    marks = F.transform(low(channels), lambda c: F.concat(F.lit('watermark "'), c, F.lit('"')))
    parts = F.flatten(F.array(low(names), low(tags), F.array(*[F.lit(t) for t in more]), marks))
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")


def episode_number(name: Column) -> Column:
    """The first number of a name, 0 without one: a key to sort episodes by."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0))
