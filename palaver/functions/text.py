"""Text functions of transcripts, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u0085   -     　]"
STAMP = "^[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]{2}-[0-9]{2}-[0-9]{2}$"


def ltrim(text: Column) -> Column:
    """Without white space of any script at the start."""
    return F.regexp_replace(text, f"^{SPACE}+", "")


def trim(text: Column) -> Column:
    return F.regexp_replace(ltrim(text), f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return trim(F.coalesce(text, F.lit(""))) == ""


def stamp(seconds: Column) -> Column:
    """[MM:SS], from one hour on [HH:MM:SS]; below zero counts as zero."""
    total = F.floor(F.greatest(F.coalesce(F.nanvl(seconds, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    clock = F.concat(two(m), F.lit(":"), two(s), F.lit("]"))
    return F.when(h > 0, F.concat(F.lit("["), two(h), F.lit(":"), clock)).otherwise(F.concat(F.lit("["), clock))


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits, others as single dashes; dashes at the ends go before the cut
    at 40, so a cut may leave one."""
    dashed = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-"))
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 40)


def _parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder with its slash, stem and extension (null without one)."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"\.([^.]*)$", 1))
    stem = F.when(ext.isNotNull(), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)
    return folder, stem, ext


def path_for_source(path: Column, source: Column) -> Column:
    """stem-slug.ext in the same folder; txt without an extension, transcript without a name."""
    folder, stem, ext = _parts(path)
    return F.concat(folder, F.when(stem == "", "transcript").otherwise(stem), F.lit("-"), slug(source), F.lit("."), F.coalesce(ext, F.lit("txt")))


def is_stamp(stem: Column) -> Column:
    return stem.rlike(STAMP)


def restamped(path: Column, now: Column) -> Column:
    """A file named by a stamp of another day gets the new stamp; any other name stays."""
    folder, stem, ext = _parts(path)
    moved = F.concat(folder, now, F.coalesce(F.concat(F.lit("."), ext), F.lit("")))
    return F.when(is_stamp(stem) & (F.substring(stem, 1, 10) != F.substring(now, 1, 10)), moved).otherwise(path)


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")


def truncate(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where some are cut."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(max(most - 1, 0))), F.lit("…"))).otherwise(text)


def speaker_prefix(speaker: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Speaker "), speaker.cast("string"), F.lit(": ")), F.lit(""))


def retract(text: Column, n: Column, more: Column) -> Column:
    """Takes n characters from the end, at most all, and appends."""
    return F.concat(F.left(text, F.greatest(F.char_length(text) - n, F.lit(0)).cast("int")), more)


def delta(text: Column, delivered: Column) -> Column:
    """What follows the characters already delivered."""
    return F.substring(text, (delivered + 1).cast("int"), F.char_length(text))


def path_key(path: Column) -> Column:
    """FNV-1a with 64 bits over the UTF-8 of a path, in hexadecimal.

    The product by 2**40 + 435 is split into a shift and products that stay in 64 bits.
    """
    raw = F.hex(path.cast("binary"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(path) - 1), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))

    def step(h: Column, octet: Column) -> Column:
        x = h.bitwiseXOR(octet)
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
        a = low * 435
        upper = (F.shiftrightunsigned(a, 32) + high * 435 + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(upper, 32).bitwiseOR(a.bitwiseAND(F.lit(0xFFFFFFFF)))

    start = F.lit(-3750763034362895579)
    done = F.when(F.octet_length(path) > 0, F.aggregate(octets, start, step)).otherwise(start)
    return F.lpad(F.lower(F.hex(done)), 16, "0")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return _parts(path)[1]


def meeting_of(path: Column) -> Column:
    """The recording's name: what stands before the first dot of the file's name."""
    return F.substring_index(basename(path), ".", 1)


def resolved(name: Column, folder: str) -> Column:
    """A bare name below a folder; one with a slash as it is."""
    return F.when(name.contains("/"), name).otherwise(F.concat(F.lit(f"{folder}/"), name))


def cache_path(wav: Column, model: Column, window_s: float, hop_s: float, folder: str, version: int) -> Column:
    """Where embeddings of a recording are kept: they depend on the model and the windows, not on thresholds."""
    return F.concat(F.lit(f"{folder}/cache/"), stem(wav), F.lit("-"), path_key(wav), F.lit("."), stem(model), F.lit(f".w{window_s * 1000:.0f}h{hop_s * 1000:.0f}.v{version}.emb"))


BLOCKS = " ▁▂▃▄▅▆▇█"


def bars(bands: Column) -> Column:
    """A block character per band between 0 and 1."""
    return F.array_join(F.transform(bands, lambda v: F.substring(F.lit(BLOCKS), (F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 8 + 0.5) + 1).cast("int"), F.lit(1))), "")


def xml_attr(line: Column, name: str) -> Column:
    """A numeric attribute of a line of XML, null where it isn't one."""
    return F.regexp_extract(line, rf'\b{name}="([^"]*)"', 1).try_cast("double")
