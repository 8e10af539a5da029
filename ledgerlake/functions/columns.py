"""Scalar expressions over catalogue columns; all but the weak hash are built-in Spark functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..shipping import ship

DAY_NS = 86_400_000_000_000

# Bucket bounds and labels of the reports.
SIZE_BOUNDS = tuple(k * 1024 for k in (4, 64, 128, 256, 512, 1024, 2048, 16384, 65536, 131072, 524288))
SIZE_LABELS = ("<4KB", "4KB~64KB", "64KB~128KB", "128KB~256KB", "256KB~512KB", "512KB~1MB", "1MB~2MB", "2MB~16MB", "16MB~64MB", "64MB~128MB", "128MB~512MB", ">512MB")
AGE_DAYS = (1, 7, 30, 180, 365)
AGE_LABELS = ("<1d", "1d~7d", "7d~30d", "30d~180d", "180d~365d", ">=365d")
AGE_DAYS_UI = (7, 30, 180, 365)
# Words that mark a secret, and the bounds of diagnostic texts and labels in bytes.
SECRET_WORDS = ("password", "passwd", "secret", "token", "credential", "authorization", "access_key", "secret_key")
MAX_TEXT_BYTES, MAX_LABEL_BYTES = 2048, 128


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_eq(a: Column | str, b: Column | str) -> Column:
    """Equality in which two nulls are equal and null differs from 0."""
    return c(a).eqNullSafe(c(b))


def depth(path: Column | str) -> Column:
    return F.size(F.split(c(path), "/"))


def name(path: Column | str) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """The directory of a path, '' at the root."""
    p = c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def ext(path: Column | str) -> Column:
    """Extension of the last segment without lower-casing; null without one or for a leading dot only."""
    n = name(path)
    return F.when(n.rlike(r"^.+\.[^.]*$"), F.regexp_extract(n, r"\.([^.]*)$", 1))


def ancestors(path: Column | str) -> Column:
    """All ancestor directories, nearest the root first; the root itself is not listed."""
    parts = F.split(c(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value < bounds[k], F.lit(k)).otherwise(out)
    return out


def size_bucket(size: Column | str) -> Column:
    return _bucket(c(size), SIZE_BOUNDS)


def age_bucket(mtime_ns: Column | str, as_of_ns: int, days: tuple[int, ...] = AGE_DAYS) -> Column:
    """Age bucket at a fixed clock; times in its future are youngest."""
    return _bucket(F.greatest(F.lit(as_of_ns) - c(mtime_ns), F.lit(0)), tuple(d * DAY_NS for d in days))


def age_bucket_ui(mtime_ns: Column | str, as_of_ns: int) -> Column:
    """The five ages of the tree map; 5 is unknown."""
    return F.when(c(mtime_ns).isNull(), F.lit(5)).otherwise(age_bucket(mtime_ns, as_of_ns, AGE_DAYS_UI))


def label(bucket: Column | str, labels: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), c(bucket) + 1)


def format_bytes(value: Column | str, decimals: int = 2) -> Column:
    """Steps of 1024 up to TiB."""
    v = c(value).cast("double")
    out = F.concat(F.format_string(f"%.{decimals}f", F.bround(v / 1024.0**4, decimals)), F.lit(" TiB"))
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB"), (0, "B")):
        out = F.when(v < 1024.0 ** (k + 1), F.concat(F.format_string(f"%.{decimals}f", F.bround(v / 1024.0**k, decimals)), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_elapsed(seconds: Column | str) -> Column:
    s = F.floor(c(seconds)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("long").cast("string") for y in x])
    return F.when(h > 0, text(h, "h", m, "m", r, "s")).when(m > 0, text(m, "m", r, "s")).otherwise(text(r, "s"))


def parse_size(text: Column | str) -> Column:
    """Size text to bytes; null for what is no size."""
    t = F.lower(F.replace(c(text), F.lit(" "), F.lit("")))
    number = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([kmg])i?b$", 1)
    unit = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([kmg])i?b$", 2)
    factor = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3)
    return F.when(t.rlike("^[0-9]{1,18}$"), t.try_cast("long")).when(unit != "", F.round(number.try_cast("double") * factor).cast("long"))


def change_kind(old: str = "o", new: str = "n") -> Column:
    """From two rows' size and mtime (data) and mode, uid, gid (metadata)."""
    data = ~(null_eq(f"{old}.size", f"{new}.size") & null_eq(f"{old}.mtime_ns", f"{new}.mtime_ns"))
    meta = ~(null_eq(f"{old}.mode", f"{new}.mode") & null_eq(f"{old}.uid", f"{new}.uid") & null_eq(f"{old}.gid", f"{new}.gid"))
    return F.when(data & meta, "both_changed").when(data, "data_changed").when(meta, "metadata_changed")


def digest_of(*columns: Column | str) -> Column:
    """A content id of columns: field boundaries and nulls stay apart."""
    named = [c(x).alias(f"f{i}") for i, x in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def entry_hash(columns: tuple[str, ...]) -> Column:
    """Hash of all comparison fields; null and '' differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def metadata_digest(pairs: Column, state: Column | str = "state") -> Column:
    """Order-independent digest of a tag map, null values apart from empty ones; other states are written as themselves."""
    ordered = F.array_sort(F.map_entries(pairs))
    listed = F.array_join(F.transform(ordered, lambda e: F.concat(F.octet_length(e["key"]).cast("string"), F.lit(":"), e["key"], F.coalesce(F.octet_length(e["value"]).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(e["value"], F.lit("")))), "")
    return F.when(c(state) == "ok", F.sha2(F.concat(F.lit("tags:"), listed), 256)).otherwise(c(state))


def tags_from_json(text: Column | str) -> Column:
    """Tags from either JSON shape, a list of {key,value} or an object."""
    t = c(text)
    pairs = F.from_json(t, "array<struct<key:string,value:string>>")
    return F.when(F.ltrim(t).startswith("["), F.map_from_entries(pairs)).otherwise(F.from_json(t, "map<string,string>"))


def tags_to_json(tags: Column) -> Column:
    """The sorted list shape."""
    ordered = F.array_sort(F.map_entries(tags))
    return F.to_json(F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def utf8_prefix(text: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, cut at a character's boundary."""
    chars = F.split(text, "")
    ends = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, x: F.when((a["n"] < 0) | (a["n"] + F.octet_length(x) > limit), F.struct(F.lit(-1).alias("n"), a["k"].alias("k"))).otherwise(F.struct((a["n"] + F.octet_length(x)).alias("n"), (a["k"] + F.length(x)).alias("k"))))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), ends["k"]))


def redact(text: Column | str, limit: int = MAX_TEXT_BYTES) -> Column:
    """Tokens with ``://`` go; the first token with a secret word goes with all after it; control
    characters become U+FFFD; bounded in bytes."""
    tokens = F.filter(F.split(utf8_prefix(c(text), MAX_TEXT_BYTES), r"\s+"), lambda x: x != "")
    secret = lambda x: F.lower(x).rlike("|".join(SECRET_WORDS))
    first = F.array_position(F.transform(tokens, lambda x: secret(x)), F.lit(True))
    shown = F.when(first > 0, F.slice(tokens, F.lit(1), first.cast("int"))).otherwise(tokens)
    safe = F.transform(shown, lambda x: F.when(x.contains("://") | secret(x), F.lit("[redacted]")).otherwise(F.regexp_replace(x, r"[\x00-\x1F\x7F-\x{9F}]", "�")))
    return utf8_prefix(F.array_join(safe, " "), limit)


def block_size(size: Column | str) -> Column:
    return F.greatest(F.lit(700), F.least(F.lit(131072), F.floor(F.sqrt(c(size))).cast("long")))


@F.pandas_udf(LongType())
def _weak(blocks: pd.Series) -> pd.Series:
    def of(block: bytes | None) -> int | None:
        if block is None:
            return None
        x = np.frombuffer(block, np.uint8).astype(np.int64)
        return int(x @ np.arange(len(x), 0, -1) % 65521) << 16 | int(x.sum() % 65521)

    return blocks.map(of).astype("Int64")


def weak_hash(block: Column | str) -> Column:
    """The rolling checksum of a text's UTF-8 bytes, whole blocks at a time (131,072 bytes and more)."""
    ship(SparkSession.getActiveSession())
    return _weak(F.encode(c(block), "UTF-8"))


def valid_notification(id_: str = "id", sequence: str = "sequence", kind: str = "kind", revision: str = "delivery_revision", payload: str = "payload_json") -> Column:
    size = F.octet_length(c(id_))
    ok = size.between(1, 256) & ~c(id_).contains("\u0000") & (c(sequence) > 0) & c(kind).isin(1, 2) & c(revision).between(0, 1)
    return F.coalesce(ok & (F.octet_length(c(payload)) <= 1 << 20) & F.expr(f"try_parse_json({payload}) is not null"), F.lit(False))


def glob_to_regex(pattern: str, whole_path: bool = False) -> str:
    """A glob as a Java regular expression; invalid globs raise before a job starts.

    ``?`` and ``*`` stay inside a segment, ``[...]`` with ranges and ``!`` is a class, and in
    whole-path globs ``**`` as a whole segment spans any number of segments.
    """

    def segment(text: str) -> str:
        if "**" in text:
            raise ValueError(f"** must be a whole segment: {pattern}")
        out, i = "", 0
        while i < len(text):
            ch = text[i]
            if ch == "*":
                out += "[^/]*"
            elif ch == "?":
                out += "[^/]"
            elif ch == "[":
                negated = text[i + 1 : i + 2] == "!"
                begin = i + 1 + negated
                end = text.find("]", begin + 1)
                if end < 0:
                    raise ValueError(f"unclosed [ in {pattern}")
                body = "".join("\\" + x if x in "\\[]^&" else x for x in text[begin:end])
                out += ("(?!/)[^" if negated else "[") + body + "]"
                i = end
            else:
                out += "\\" + ch if ch in r"\.^$|+(){}" else ch
            i += 1
        return out

    if not whole_path:
        return f"^(?:{segment(pattern)})$"
    parts = pattern.split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += segment(part) + ("" if last else "/")
    return f"^(?:{out})$"
