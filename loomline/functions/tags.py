"""Captions as ordered tag lists: Column to Column, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that str.strip removes in ASCII text.
BLANKS = " \t\n\r\u000b\u000c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse(caption: Column) -> Column:
    """Lower-cased tags in order, blanks around them gone, empty ones dropped, repeats kept."""
    return F.filter(F.transform(F.split(F.lower(caption), ","), strip), lambda x: x != "")


def parse_keep_case(caption: Column) -> Column:
    """Tags with their case, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.split(caption, ","), strip), lambda x: x != ""))


def join(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def is_valid(tag: Column) -> Column:
    """Not empty, no ``-`` or ``_`` at either end, and neither twice in a row inside."""
    return ~tag.rlike("^$|^[-_]|[-_]$|--|__")


def contains(tags: Column, tag: str) -> Column:
    """Exact membership; the argument is not case-folded."""
    return F.array_contains(tags, tag)


def add_at(tags: Column, tag: str, start: int = 0, stop: int = 0, seed: Column | None = None) -> Column:
    """The distinct tags with ``tag`` at a place in [min(start, stop'), stop'], stop' = min(stop, length); unchanged if present.

    The place is drawn by a hash of ``seed``; without one it is stop'.
    """
    own = F.array_distinct(tags)
    top = F.least(F.lit(stop), F.size(own))
    low = F.least(F.lit(start), top)
    place = top if seed is None else low + F.pmod(F.xxhash64(seed, F.lit(tag)), (top - low + 1).cast("long")).cast("int")
    put = F.concat(F.slice(own, F.lit(1), place), F.array(F.lit(tag)), F.slice(own, place + 1, F.greatest(F.size(own) - place, F.lit(0))))
    return F.when(F.array_contains(own, tag), own).otherwise(put)


def add_missing(tags: Column, new: list[str], place: int) -> Column:
    """The listed tags that are missing, in their order, at a comma position."""
    at = F.least(F.lit(place), F.size(tags))
    more = F.array_except(F.array(*[F.lit(t) for t in new]), tags)
    return F.concat(F.slice(tags, F.lit(1), at), more, F.slice(tags, at + 1, F.greatest(F.size(tags) - at, F.lit(0))))


def replace(tags: Column, old: str, new: str) -> Column:
    """Exact matches replaced, then each tag once."""
    return F.array_distinct(F.transform(tags, lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def remove(tags: Column, gone: list[str], underscores: bool = True) -> Column:
    """Tags without those listed; with ``underscores`` both sides take ``_`` for a space. Invalid entries are ignored, repeats stay."""
    fold = (lambda x: x.replace("_", " ")) if underscores else (lambda x: x)
    valid = [fold(t) for t in gone if t and t[0] not in "-_" and t[-1] not in "-_" and "--" not in t and "__" not in t]
    own = F.transform(tags, lambda x: F.replace(x, F.lit("_"), F.lit(" "))) if underscores else tags
    if not valid:
        return own
    return F.filter(own, lambda x: ~x.isin(valid))


def keep_only(tags: Column, kept: list[str]) -> Column:
    """Listed tags alone, in caption order, each once."""
    return F.array_intersect(tags, F.array(*[F.lit(t) for t in kept]))


def normalise_newlines(caption: Column) -> Column:
    """Line ends as commas, empty tags dropped; the caption itself where neither a line end nor an empty tag was found."""
    raw = F.split(F.translate(caption, "\n", ","), ",")
    clean = F.filter(F.transform(raw, strip), lambda x: x != "")
    changed = (F.size(clean) != F.size(raw)) | caption.contains("\n")
    return F.when(changed, join(clean)).otherwise(caption)


def search_replace(caption: Column, pattern: str, replacement: str, regex: bool, per_tag: bool) -> Column:
    """Search and replace over the whole text or per tag, by regex or literally.

    Per tag, a result equal to one already in the list is dropped; a literal
    replacement may hold several tags, all of which are added.
    """
    swap = (lambda x: F.regexp_replace(x, pattern, replacement)) if regex else (lambda x: F.replace(x, F.lit(pattern), F.lit(replacement)))
    if not per_tag:
        return swap(caption)
    tags = F.filter(F.transform(F.split(caption, ","), strip), lambda x: x != "")
    out = F.transform(tags, swap)
    if not regex:
        out = F.flatten(F.transform(out, lambda x: F.transform(F.split(x, ","), strip)))
    return join(F.array_distinct(F.filter(out, lambda x: x != "")))


def sync_labels(tags: Column, enabled: list[str], disabled: list[str]) -> Column:
    """Missing enabled labels in front, disabled ones gone."""
    kept = F.filter(tags, lambda x: ~x.isin(disabled)) if disabled else tags
    return F.concat(F.array_except(F.array(*[F.lit(t) for t in enabled]).cast("array<string>"), kept), kept)


def sync_changes(tags: Column, before: Column, now: Column) -> Column:
    """Only what changed of the enabled labels since a remembered state: newly enabled ones that are missing in front, newly disabled ones gone."""
    kept = F.array_except(tags, F.array_except(before, now))
    return F.concat(F.array_except(F.array_except(now, before), kept), kept)


def from_file_name(caption: Column, stem: Column) -> Column:
    """The stem, with underscores as spaces, after the caption."""
    return F.concat_ws(", ", F.nullif(caption, F.lit("")), F.replace(stem, F.lit("_"), F.lit(" ")))


def from_folder(caption: Column, folder: Column) -> Column:
    """The folder's name, with underscores as spaces, before the caption; the root adds nothing."""
    return F.concat_ws(", ", F.nullif(F.replace(F.coalesce(folder, F.lit("")), F.lit("_"), F.lit(" ")), F.lit("")), F.nullif(caption, F.lit("")))
