"""Clocks, addresses and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Parts of names whose values are secret, ends of names that hold paths.
SENSITIVE = ("api_key", "apikey", "authorization", "credential", "password", "passwd", "secret", "token")
PATHS = ("_dir", "_directory", "_path", "_root")
HIDDEN, NO_NAME, NO_URL = "<redacted>", "<path>", "<redacted-url>"


def clock(ms: Column, point: str = ".") -> Column:
    """hh:mm:ss.mmm; hours are not bounded."""
    ms = ms.cast("long")
    part = lambda divisor, modulus: F.floor(ms / divisor) % modulus
    return F.format_string(f"%02d:%02d:%02d{point}%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), ms % 1000)


def clock_ms(text: Column) -> Column:
    """hh:mm:ss in milliseconds."""
    p = F.split(text, ":")
    return (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")) * 1000


def without_overlap_suffix(name: Column) -> Column:
    return F.regexp_replace(name, "(?:_overlap)+$", "")


def is_absolute(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^(?:[A-Za-z]:[\\/]|/|\\\\)"), F.lit(False))


def basename(path: Column) -> Column:
    """The last part of a path, a folder's as well; NO_NAME for a root."""
    name = F.regexp_extract(F.regexp_replace(path, r"[\\/]+(?:\.[\\/]+)*\.?$", ""), r"([^\\/]*)$", 1)
    return F.when(name.isin("", "."), NO_NAME).otherwise(name)


def _encoded(text: Column) -> Column:
    """As a query's part: only letters, digits and _.-~ stand for themselves, a space is +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def is_sensitive(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(SENSITIVE)), F.lit(False))


def public_url(url: Column) -> Column:
    """An http or https URL without user information, its host in small letters, its query encoded anew with the values of
    secret names hidden; NO_URL where the host or port can't be read."""
    url = F.regexp_replace(url, r"[\t\r\n]", "")
    part = lambda k: F.regexp_extract(url, r"(?s)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    place = F.regexp_extract(part(2), r"([^@]*)$", 1)
    host, port = (F.regexp_extract(place, r"^(\[[^\[\]]*\]|[^:\[\]]*)(?::([0-9]*))?$", k) for k in (1, 2))
    legal = place.rlike(r"^(\[[^\[\]]*\]|[^:\[\]]*)(:[0-9]*)?$") & ((port == "") | (F.coalesce(port.try_cast("int"), F.lit(65536)) <= 65535))
    name = lambda kv: _decoded(F.regexp_extract(kv, "(?s)^([^=]*)", 1))
    value = lambda kv: _decoded(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1))
    shown = lambda kv: F.concat(_encoded(name(kv)), F.lit("="), F.when(is_sensitive(name(kv)), _encoded(F.lit(HIDDEN))).otherwise(_encoded(value(kv))))
    query = F.array_join(F.transform(F.filter(F.split(part(4), "&"), lambda kv: kv != ""), shown), "&")
    path = F.when((part(3) != "") & ~part(3).startswith("/"), F.concat(F.lit("/"), part(3))).otherwise(part(3))
    plain_port = F.when(port != "", F.concat(F.lit(":"), port.try_cast("int").cast("string"))).otherwise("")
    whole = F.concat(part(1), F.lit("://"), F.lower(host), plain_port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""))
    return F.when(legal, whole).otherwise(NO_URL)


def public_text(name: Column, value: Column) -> Column:
    """A text's public form, by its name and what it holds."""
    path = F.coalesce(F.lower(name).rlike("(?:" + "|".join(PATHS) + ")$"), F.lit(False)) | is_absolute(value)
    return F.when(path, basename(value)).when(value.rlike("^https?://"), public_url(value)).otherwise(value)


def redacted(name: str | Column, value: Column, kind: DataType) -> Column:
    """A value of any type without credentials and host paths: structs field by field, arrays element by element under their
    own name, maps by their keys. What is secret becomes HIDDEN, of whatever type it was; in a map of other types than
    text it becomes null."""
    key = F.lit(name) if isinstance(name, str) else name
    if isinstance(name, str) and any(s in name.lower() for s in SENSITIVE):
        return F.when(value.isNotNull(), F.lit(HIDDEN))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[redacted(f.name, value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: redacted(name, x, kind.elementType))
    if isinstance(kind, MapType):
        hidden = F.lit(HIDDEN) if isinstance(kind.valueType, StringType) else F.lit(None)
        return F.transform_values(value, lambda k, x: F.when(is_sensitive(k), F.when(x.isNotNull(), hidden)).otherwise(redacted(k, x, kind.valueType)))
    return public_text(key, value) if isinstance(kind, StringType) else value


def redacted_frame(df: DataFrame) -> DataFrame:
    """All columns of df in their public form."""
    return df.select(*[redacted(f.name, df[f"`{f.name}`"], f.dataType).alias(f.name) for f in df.schema.fields])


def strict_object(text: Column) -> tuple[Column, Column]:
    """(the JSON object as a variant, what is wrong): null and a code where the text is no JSON, or JSON but no object."""
    v = F.try_parse_json(text)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object, v), F.when(v.isNull(), "JSON_INVALID").when(~is_object, "JSON_NOT_OBJECT")


#: The most bytes of an upload, by what it is, and the code of one that has more.
UPLOADS = {"audio": (1 << 30, "AUDIO_TOO_LARGE"), "segments": (16 << 20, "SEGMENTS_TOO_LARGE")}


def upload(content: Column, kind: str = "audio", most: int | None = None) -> tuple[Column, Column, Column]:
    """(digest, bytes, error) of an upload; one of more than `most` bytes isn't digested."""
    limit, code = UPLOADS[kind]
    size = F.octet_length(content).cast("long")
    fits = size <= (limit if most is None else most)
    return F.when(fits, F.sha2(content.cast("binary"), 256)), size, F.when(~fits, code)


def input_digest(content: Column, mode: Column, material: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.sha2(content, 256), mode, material), 256)


def is_task_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{32}$"), F.lit(False))
