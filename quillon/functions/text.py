"""Keys and predicates of catalog text: normalization, metadata and file name keys, variants, fuzzy equality.

All are column expressions but NFC, which Spark lacks: an Arrow UDF that texts of ASCII bypass. A UDF in a plan still gets every row; ``ascii_apart``
keeps rows of ASCII from it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings that count as audio files, of titles and of scans.
TITLE_EXTENSIONS = ("mp3", "flac", "m4a", "ogg", "opus", "wav", "wma", "aac", "ape", "wv")
SCAN_EXTENSIONS = ("mp3", "flac", "m4a", "aac", "ogg", "opus", "wav", "wma", "aiff", "aif", "ape", "wv", "mpc", "mp4", "alac", "dsf")

#: Whether all texts at hand are known to be ASCII.
ASCII = ContextVar("ASCII", default=False)

SPACE = r"[\s ]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def is_ascii(s: Column | str) -> Column:
    """As many bytes as characters; null counts as ASCII."""
    return F.coalesce(F.octet_length(_c(s)) == F.length(_c(s)), F.lit(True))


def nfc(s: Column | str) -> Column:
    """Canonical composition. Only texts with characters beyond ASCII leave the JVM."""
    s = _c(s)
    if ASCII.get():
        return s
    plain = is_ascii(s)
    return F.when(s.isNull() | plain, s).otherwise(F.pandas_udf(composed, "string")(F.when(~plain, s)))


def ascii_apart(rows: DataFrame, texts: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f(rows)``, for an ``f`` that builds columns of single rows. Rows whose ``texts``, all that ``f`` composes, are ASCII come without the UDF, as
    ASCII is its own composition."""
    plain = reduce(lambda x, y: x & y, map(is_ascii, texts))
    known = ASCII.set(True)
    try:
        ascii_rows = f(rows.where(plain))
    finally:
        ASCII.reset(known)
    return ascii_rows.unionByName(f(rows.where(~plain)))


def strip(s: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def normalize_field(s: Column | str) -> Column:
    """Lower case, stripped, composed, ``|`` as ``/``; null as empty."""
    return nfc(F.translate(strip(F.lower(F.coalesce(_c(s), F.lit("")))), "|", "/"))


def normalize_artist(s: Column | str) -> Column:
    """As a field; the unknown artist as empty."""
    x = normalize_field(s)
    return F.when(x == "unknown artist", F.lit("")).otherwise(x)


def normalize_album(s: Column | str) -> Column:
    x = normalize_field(s)
    return F.when(x == "unknown album", F.lit("")).otherwise(x)


def strip_audio_extension(s: Column | str) -> Column:
    """Without a known audio ending after the last dot, unless nothing stands before the dot."""
    return F.regexp_replace(_c(s), rf"(?i)(?<=.)\.({'|'.join(TITLE_EXTENSIONS)})$", "")


def normalize_title(s: Column | str) -> Column:
    return strip_audio_extension(normalize_field(s))


def normalize_path(s: Column | str) -> Column:
    """Composed; null if blank."""
    s = _c(s)
    return nfc(F.when(strip(s) != "", s))


def rounded_duration(ms: Column | str) -> Column:
    """Milliseconds, cut to hundreds."""
    return F.floor(_c(ms) / 100).cast("long") * 100


def metadata_key(artist, album, title, duration_ms) -> Column:
    """artist|album|title|duration, normalized."""
    return F.concat_ws("|", normalize_field(artist), normalize_field(album), normalize_field(title), rounded_duration(duration_ms).cast("string"))


def metadata_prefix(key: Column | str) -> Column:
    """The key through its last ``|``."""
    return F.regexp_extract(_c(key), r"^(.*\|)", 1)


def title_from_key(key: Column | str) -> Column:
    """The third field of a key that has three bars at least."""
    key = _c(key)
    return F.when(F.length(F.regexp_replace(key, r"[^|]", "")) >= 3, F.split_part(key, F.lit("|"), F.lit(3)))


def file_stem(path: Column | str) -> Column:
    """The last part of a path without its ending; a leading dot is no ending."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def squeezed(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"\s+", " "))


def strip_track_number(s: Column | str) -> Column:
    """Without digits and the dots, dashes or spaces that follow them at the start."""
    return F.regexp_replace(_c(s), r"^\d+[.\-\s]+", "")


def filename_key(stem: Column | str) -> Column:
    """A stem in lower case without bracketed parts and track number, spaces squeezed."""
    bare = F.regexp_replace(F.lower(_c(stem)), r"\s*[(\[].*?[)\]]", "")
    return nfc(squeezed(strip_track_number(bare)))


def filename_keys(existing: Column | str, artist: Column | str, title: Column | str) -> Column:
    """Distinct non-blank keys: the existing one, of the title, of "artist - title"."""
    both = F.when((strip(F.coalesce(_c(artist), F.lit(""))) != ""), filename_key(F.concat(_c(artist), F.lit(" - "), F.coalesce(_c(title), F.lit("")))))
    keys = F.array(F.coalesce(_c(existing), F.lit("")), filename_key(F.coalesce(_c(title), F.lit(""))), F.coalesce(both, F.lit("")))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def loose_title(s: Column | str) -> Column:
    """A title for loose equality: `` & `` as "and", straight quotes, ASCII letters, digits, brackets and apostrophes alone."""
    x = F.regexp_replace(F.lower(_c(s)), " & ", " and ")
    x = F.translate(x, "‘’‛`", "''''")
    return squeezed(F.regexp_replace(x, r"[^a-z0-9 ()']", ""))


def cache_key(path: Column | str, root: str) -> Column:
    """A path below ``root`` as one flat name."""
    p = F.translate(_c(path), "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.replace(F.when(p.startswith(base), F.substring(p, len(base) + 1, 100_000)).otherwise(p), F.lit("/"), F.lit("__"))


def format_track(artist, title, album) -> Column:
    """``artist - title (album)``; unknown parts are named so, a missing album is left out."""
    known = lambda x, other: F.when(F.coalesce(_c(x), F.lit("")) != "", _c(x)).otherwise(F.lit(other))
    tail = F.when(F.coalesce(_c(album), F.lit("")) != "", F.concat(F.lit(" ("), _c(album), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(known(artist, "Unknown Artist"), F.lit(" - "), known(title, "Unknown Title"), tail)


def query_tokens(q: str) -> list[str]:
    """Words of a search, in lower case."""
    return q.lower().split()


def state_key(text: Column | str, weight: Column | str, negative: Column | str, seeds: Column | str) -> Column:
    """All fields of a search in one string: its text, weight and sign, then ``|id:weight:sign`` of each of ``seeds`` (an array of structs of id, weight,
    negative). Two searches of one key are the same search."""
    said = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    head = F.concat_ws("|", F.coalesce(_c(text), F.lit("")), said(_c(weight)), said(_c(negative)))
    each = F.transform(_c(seeds), lambda s: F.concat_ws(":", said(s["id"]), said(s["weight"]), said(s["negative"])))
    return F.concat_ws("|", head, each)


def text_lines(s: Column | str, separator: str = "</s>") -> Column:
    """Distinct non-empty lines of a text in order, joined by a separator."""
    return F.array_join(F.array_distinct(F.filter(F.split(_c(s), "\n"), lambda x: x != "")), separator)


def duration_compatible(a: Column | str, b: Column | str, tolerance: int = 5000) -> Column:
    """Unknown (0 or less) on either side, or within the tolerance."""
    a, b = _c(a), _c(b)
    return (a <= 0) | (b <= 0) | (F.abs(a - b) <= tolerance)


def artist_overlaps(a: Column | str, b: Column | str) -> Column:
    """Both blank, or one within the other with neither blank."""
    a, b = _c(a), _c(b)
    blank_a, blank_b = strip(a) == "", strip(b) == ""
    return F.when(blank_a | blank_b, blank_a & blank_b).otherwise(a.contains(b) | b.contains(a))


def artist_variants(a: Column | str) -> Column:
    """Spellings under which an artist may stand elsewhere, itself first: parts between ``;`` or `` / ``, what stands before the first comma,
    without dots, ``&`` and "and" exchanged, the unknown artist for none and the other way round."""
    a = strip(_c(a))
    parts = F.flatten(F.array(F.split(a, ";"), F.split(a, " / "), F.slice(F.split(a, ","), 1, 1)))
    names = F.filter(F.transform(F.concat(F.array(a), parts), strip), lambda x: (x != "") | (a == ""))
    swapped = F.transform(names, lambda x: F.when(x.contains("&"), F.regexp_replace(x, r"\s*&\s*", " and ")).otherwise(F.regexp_replace(x, " and ", " & ")))
    undotted = F.transform(names, lambda x: F.translate(x, ".", ""))
    unknown = F.when(a == "", F.array(F.lit("unknown artist"))).when(a == "unknown artist", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(names, swapped, undotted, unknown))


def artist_spellings(a: Column | str) -> Column:
    """Names under which another catalog may have an artist, itself first: parts between ``;`` or `` / ``, what stands before the first comma, without
    the dots at its end and without any (a short name without dots: with one at its end), `` & `` and " and " exchanged, the unknown artist for none."""
    a = _c(a)
    none = F.array().cast("array<string>")
    parts = lambda sep: F.when(F.contains(a, F.lit(sep)), F.transform(F.split(a, sep, -1), strip)).otherwise(none)
    comma = F.when(F.contains(a, F.lit(",")), F.array(strip(F.split_part(a, F.lit(","), F.lit(1))))).otherwise(none)
    dots = F.when(F.contains(a, F.lit(".")) & (F.length(a) > 1), F.array(F.regexp_replace(a, r"\.+$", ""), F.translate(a, ".", ""))).when(F.length(a).between(1, 5), F.array(F.concat(a, F.lit(".")))).otherwise(none)
    swap = lambda x, y: F.array(F.replace(a, F.lit(x), F.lit(y)))
    swapped = F.when(F.contains(a, F.lit(" & ")), swap(" & ", " and ")).when(F.contains(a, F.lit(" and ")), swap(" and ", " & ")).otherwise(none)
    unknown = F.when(a == "", F.array(F.lit("unknown artist"))).otherwise(none)
    return F.array_distinct(F.concat(F.array(a), parts(";"), comma, parts(" / "), dots, swapped, unknown))


def _tagged(tag: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(tag), x))


def _starts(s: Column, longest: Column, low: int = 25, high: int = 30) -> Column:
    """The starts of a text that are ``low`` to ``high`` and at most ``longest`` characters long."""
    sizes = F.filter(F.array(*[F.lit(k) for k in range(low, high + 1)]), lambda k: k <= longest)
    return F.transform(sizes, lambda k: F.substr(s, F.lit(1), k))


def _within(s: Column, low: int = 25, high: int = 30) -> Column:
    return F.when(F.length(s).between(low, high), F.array(s)).otherwise(F.array().cast("array<string>"))


def artist_keys(a: Column | str, entry: bool) -> Column:
    """Keys by which artists of entries and of tracks meet: an entry's spellings and a track's name, or one the start, 25 to 30 characters long, of
    the other. Equal keys on both sides are what makes a candidate."""
    a = _c(a)
    starts = _starts(a, F.length(a))
    if entry:
        return F.concat(_tagged("a", artist_spellings(a)), _tagged("b", _within(a)), _tagged("c", starts))
    return F.concat(_tagged("a", F.array(a)), _tagged("b", starts), _tagged("c", _within(a)))


def title_keys(s: Column | str, entry: bool) -> Column:
    """Keys by which fuzzily equal titles of entries and tracks meet: two titles have one in common exactly if ``fuzzy_title`` holds."""
    s = _c(s)
    none = F.array().cast("array<string>")
    bare, loose = strip_audio_extension(s), loose_title(s)
    shorter = _starts(s, F.length(s) - 1)
    ended = F.when(bare != s, F.array(bare)).otherwise(none)
    own, other = ("e", "x") if entry else ("x", "e")
    cut, whole = ("q", "p") if entry else ("p", "q")
    numbered = _tagged("s", F.array(s, strip_track_number(s)))
    return F.array_distinct(F.concat(numbered, _tagged(own, ended), _tagged(other, F.array(s)), _tagged("l", F.when(loose != "", F.array(loose)).otherwise(none)), _tagged(cut, shorter), _tagged(whole, _within(s))))


def fuzzy_keys(artist: Column | str, title: Column | str, entry: bool) -> Column:
    """Keys of artist and title together: an entry and a track that have one in common are fuzzy candidates."""
    titles = title_keys(title, entry)
    return F.flatten(F.transform(artist_keys(artist, entry), lambda a: F.transform(titles, lambda x: F.concat(a, F.lit("\x00"), x))))


def truncated_match(a: Column, b: Column, low: int = 25, high: int = 30) -> Column:
    """One is the start of the other and 25 to 30 characters long: what fixed-width tags leave of a longer text."""
    cut = lambda x, y: F.length(x).between(low, high) & y.startswith(x)
    return cut(a, b) | cut(b, a)


def fuzzy_title(a: Column | str, b: Column | str) -> Column:
    """Equal, or equal without track numbers, audio endings or decoration, or truncated."""
    a, b = _c(a), _c(b)
    same = (a == b) | (strip_track_number(a) == b) | (a == strip_track_number(b)) | (strip_track_number(a) == strip_track_number(b)) | (strip_audio_extension(a) == b) | (a == strip_audio_extension(b))
    x, y = loose_title(a), loose_title(b)
    return same | truncated_match(a, b) | ((x == y) & (x != ""))
