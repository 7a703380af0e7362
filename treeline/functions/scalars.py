"""Column functions with the domain's semantics; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Palettes, labels and styles that results show.
USER_COLORS = ("#3b82f6", "#ef4444", "#10b981", "#f59e0b", "#8b5cf6", "#ec4899")
BRANCH_COLORS = (*USER_COLORS, "#14b8a6", "#f97316")
TYPE_LABELS = {"manual": "Manual Save", "auto": "Auto Save", "restore": "Restored", "delete-backup": "Backup"}
ROLE_STYLES = {"owner": "bg-yellow-100 text-yellow-800", "editor": "bg-blue-100 text-blue-800", "viewer": "bg-gray-100 text-gray-600"}

#: White space at either end, of every kind that the source language trims.
_ENDS = "^[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+|[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def or_else(value: Column, default) -> Column:
    """The default for null, "" and 0 alike."""
    default = default if isinstance(default, Column) else F.lit(default)
    empty = value.cast("string").isin("", "0", "0.0", "false")
    return F.when(value.isNull() | empty, default).otherwise(value)


def normal_email(text: Column) -> Column:
    return trimmed(F.lower(text))


def looks_like_email(text: Column) -> Column:
    return text.rlike(r"\S+@\S+\.\S+")


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def initial(name: Column, email: Column) -> Column:
    return F.upper(F.substring(or_else(name, or_else(email, "?")), 1, 1))


def code_sum(text: Column) -> Column:
    """The sum of the text's UTF-16 code units; a character beyond the first plane is two."""
    # cut into units once: what a lambda names besides its argument is evaluated for every element
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("...."), F.lit(0))
    return F.coalesce(F.aggregate(units, F.lit(0).cast("long"), lambda a, x: a + F.conv(x, 16, 10).cast("long")), F.lit(0).cast("long"))


def palette(text: Column, colors: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, colors)), (F.pmod(code_sum(text), F.lit(len(colors))) + 1).cast("int"))


def without_fences(text: Column) -> Column:
    """The text without Markdown code fences."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, "```json\\n?", ""), "```\\n?", ""))


def joined(items: Column, separator: str, default: str) -> Column:
    """Items joined, nulls as empty strings; the default where nothing is left."""
    return or_else(F.array_join(F.transform(items, lambda x: F.coalesce(x, F.lit(""))), separator), default)


def handles(side: Column) -> tuple[Column, Column]:
    """(source handle, target handle) of an edge to a child on that side."""
    left = side == "left"
    return F.when(left, "source-left").otherwise("source-right"), F.when(left, "target-right").otherwise("target-left")


def type_label(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))[kind], kind)


def human_size(size: Column) -> Column:
    """N/A for null and 0, else bytes, KB or MB with one decimal."""
    kilo = lambda x: F.format_string("%.1f", x)
    return (
        F.when(size.isNull() | (size == 0), "N/A")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.concat(kilo(size / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(kilo(size / 1048576.0), F.lit(" MB")))
    )


def age_text(then: Column, now: Column) -> Column:
    """How long ago, in words; the date from seven days on."""
    millis = F.floor(F.timestamp_diff("MICROSECOND", then, now) / 1000)
    minutes, hours, days = (F.floor(millis / x) for x in (60_000, 3_600_000, 86_400_000))
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    date = F.concat_ws("/", F.month(then), F.dayofmonth(then), F.year(then))
    return F.when(minutes < 1, "Just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).when(days < 7, ago(days, "d")).otherwise(date)


def base64_of(data: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(data), "[\\r\\n]", "")


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_of(data))


def payload_size(encoded: Column) -> Column:
    return F.octet_length(F.unbase64(encoded)).cast("long")


def envelope(state: Column, created_by: Column, reason: Column, created_at: Column) -> Column:
    """The snapshot envelope, schema version 1."""
    meta = F.struct(or_else(created_by, "system").alias("createdBy"), or_else(reason, "auto").alias("reason"), F.lit(0).alias("clientCount"))
    return F.struct(F.lit(1).alias("schemaVersion"), state.alias("encodedState"), meta.alias("meta"), created_at.alias("createdAt"))


def valid_envelope(snapshot: Column) -> Column:
    return F.coalesce((snapshot["schemaVersion"] == 1) & snapshot["encodedState"].isNotNull() & (snapshot["encodedState"] != ""), F.lit(False))


def control_point(x1: Column, y1: Column, x2: Column, y2: Column, offset: float) -> tuple[Column, Column]:
    """The midpoint of a line moved at a right angle to it."""
    angle = F.atan2(y2 - y1, x2 - x1)
    return (x1 + x2) / 2 - offset * F.sin(angle), (y1 + y2) / 2 + offset * F.cos(angle)


def checked_envelope(snapshot: Column) -> Column:
    """The envelope's state; a wrong version or a missing state ends the query with an error."""
    return (
        F.when(snapshot["schemaVersion"].isNull() | (snapshot["schemaVersion"] != 1), F.raise_error(F.lit("Unsupported schema version")))
        .when(snapshot["encodedState"].isNull() | (snapshot["encodedState"] == ""), F.raise_error(F.lit("Missing encoded state")))
        .otherwise(snapshot["encodedState"])
    )


def side_of(x: Column, root_x: Column) -> Column:
    return F.when(x < root_x, "left").otherwise("right")


def suggestions(text: Column) -> Column:
    """The texts of a JSON answer's suggestions, fences allowed; null where there is no list."""
    return F.from_json(without_fences(text), "suggestions array<struct<text:string>>")["suggestions"]["text"]


def path_id(path: Column) -> Column:
    """A stable id for a place in a tree."""
    return F.substring(F.sha2(path, 256), 1, 16)


def with_prefix(text: Column, old: str, new: str) -> Column:
    """The text with one literal prefix in the place of another, where it has it."""
    return F.when(F.startswith(text, F.lit(old)), F.concat(F.lit(new), F.substring(text, len(old) + 1, 1 << 30))).otherwise(text)


def stored_state(stored: Column) -> Column:
    """The encoded state of a stored snapshot: an envelope's, or bare bytes in base64; null for an envelope without one."""
    text = F.try_validate_utf8(stored.cast("string"))
    envelope = F.when(F.startswith(text, F.lit("{")), F.try_parse_json(text))
    state = F.get_json_object(text, "$.encodedState")
    return F.when(envelope.isNotNull(), F.when(state != "", state)).otherwise(base64_of(stored))
