"""String helpers over Columns: prompts, paths, keys, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import col


def prompt(template: str, **values) -> Column:
    """template with its {names} replaced by columns or values; doubles with one decimal."""
    out = F.lit(template)
    for name, v in values.items():
        v = F.format_string("%.1f", v.cast("double")) if isinstance(v, Column) else F.lit(f"{v:.1f}" if isinstance(v, float) else str(v))
        out = F.replace(out, F.lit("{" + name + "}"), v)
    return out


def stem(path) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_extract(col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def container_path(path, prefix: str) -> Column:
    """A path without a leading out/, under the prefix; none gives the path as it is in the tree."""
    plain = F.regexp_replace(col(path), r"^out/", "")
    return F.concat(F.lit(prefix.rstrip("/") + "/"), plain) if prefix else plain


def window_key(video, index) -> Column:
    return F.concat(col(video), F.lit("_w"), F.lpad(col(index).cast("string"), 4, "0"))


def script_safe(json: Column) -> Column:
    """JSON that may stand inside an HTML script element."""
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def error_kind(message) -> Column:
    """What a message of a failed call is about; blank ones are `none`."""
    m = F.lower(F.coalesce(col(message), F.lit("")))
    # fixed values: the two patterns
    return F.when(m.rlike("429|too many requests"), "rate limit").when(m.rlike("timeout|timed out"), "timeout").when(F.trim(m) == "", "none").otherwise("other")


def sibling(path, kind: str = "windows") -> Column:
    """The path of a run's file of another kind: a.events.jsonl gives a.windows.jsonl; NULL for other names."""
    p = col(path)
    return F.when(p.endswith(".events.jsonl"), F.regexp_replace(p, r"\.events\.jsonl$", f".{kind}.jsonl"))


def byte_range(header) -> tuple[Column, Column]:
    """First and last byte of `bytes=a-b`, NULL where left out."""
    part = lambda k: F.regexp_extract(col(header), r"bytes=(\d*)-(\d*)", k)
    return tuple(F.when(part(k) != "", part(k).cast("long")) for k in (1, 2))


def setting(line) -> Column:
    """(key, value) of a key=value line, quotes stripped; NULL for blank lines and comments."""
    line = F.trim(col(line))
    kv = F.split(line, "=", 2)
    value = F.regexp_replace(F.trim(F.get(kv, F.lit(1))), "^[\"']|[\"']$", "")
    return F.when((line != "") & ~line.startswith("#") & line.contains("="), F.struct(F.trim(F.get(kv, F.lit(0))).alias("key"), value.alias("value")))


def on_scale(t, duration) -> Column:
    """A time as a share of the duration, cut to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(t) / F.greatest(col(duration), F.lit(1e-9))))


def ticks(duration) -> Column:
    """Marks of a ruler: every 5, 10, 30 or 60 by the duration; the limits are fixed values."""
    d = col(duration)
    step = F.when(d <= 20, 5).when(d <= 60, 10).when(d <= 300, 30).otherwise(60)
    return F.sequence(F.lit(0), F.floor(d).cast("int"), step)
