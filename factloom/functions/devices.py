"""Validation of device description values and headers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params

_ZONE = r"(Z|[+-]\d{2}:?\d{2})"
_DATE = r"\d{4}-\d{2}-\d{2}"
_TIME = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?"


def reasons(value: Column, datatype: Column, allowed: Column | None = None) -> Column:
    """array<string>: why a text is no value of its data type, empty if it is one."""
    number = value.try_cast("decimal(20,0)")
    real = value.try_cast("double")
    size = F.abs(real)
    checks: list[tuple[Column, Column, str]] = []
    for kind, (low, high) in params.DEVICE_INTEGERS.items():
        ok = value.rlike(r"^\s*[+-]?\d+\s*$") & F.coalesce(number.between(low, high), F.lit(False))
        checks.append((datatype == kind, ok, f"{kind} out of range"))
    for kinds, key in ((("r4",), "r4"), (("r8", "number", "float", "fixed.14.4"), "r8")):
        low, high = params.DEVICE_REALS[key]
        ok = F.coalesce((size == 0) | size.between(low, high), F.lit(False))
        checks.append((datatype.isin(*kinds), ok, "real out of range"))
    checks += [
        (datatype == "char", F.length(value) == 1, "not one character"),
        (datatype == "date", value.rlike(f"^{_DATE}$") & value.try_cast("date").isNotNull(), "not a date without time"),
        (
            datatype.isin("dateTime", "dateTime.tz"),
            value.rlike(f"^{_DATE}([T ]{_TIME}{_ZONE}?)?$") & F.substring(value, 1, 10).try_cast("date").isNotNull(),
            "not a date and time",
        ),
        (datatype == "dateTime", ~value.rlike(f"{_TIME}{_ZONE}$"), "has a time zone"),
        (datatype.isin("time", "time.tz"), value.rlike(f"^{_TIME}{_ZONE}?$"), "not a time without date"),
        (datatype == "time", ~value.rlike(f"{_TIME}{_ZONE}$"), "has a time zone"),
        (datatype == "boolean", F.lower(value).isin(*params.BOOLEANS), "not a boolean"),
        (datatype == "bin.base64", value.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), "not base64"),
        (datatype == "bin.hex", value.rlike(r"^([0-9A-Fa-f]{2})*$"), "not hex"),
        (datatype == "uuid", value.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "not a UUID"),
    ]
    if allowed is not None:
        listed = (F.size(allowed) <= 0) | allowed.isNull() | F.array_contains(allowed, value)
        checks.append((datatype == "string", listed, "not an allowed value"))
    known = datatype.isin(
        *params.DEVICE_INTEGERS, "r4", "r8", "number", "float", "fixed.14.4", "char", "string", "date", "dateTime",
        "dateTime.tz", "time", "time.tz", "boolean", "bin.base64", "bin.hex", "uri", "uuid",
    )
    found = [F.when(applies & ~F.coalesce(ok, F.lit(False)), F.lit(why)) for applies, ok, why in checks]
    found.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown data type")))
    return F.array_compact(F.array(*found))


def valid(value: Column, datatype: Column, allowed: Column | None = None) -> Column:
    return F.size(reasons(value, datatype, allowed)) == 0


#: Spark types that hold the device data types.
SPARK_TYPES = {
    "ui1": "smallint", "ui2": "int", "ui4": "bigint", "i1": "tinyint", "i2": "smallint", "i4": "int", "r4": "float", "r8": "double",
    "number": "double", "float": "double", "fixed.14.4": "decimal(18,4)", "char": "string", "string": "string", "date": "date",
    "dateTime": "timestamp_ntz", "dateTime.tz": "timestamp", "time": "string", "time.tz": "string", "boolean": "boolean",
    "bin.base64": "binary", "bin.hex": "binary", "uri": "string", "uuid": "string",
}


def service_name(service_id: Column) -> Column:
    return F.substring_index(service_id, ":", -1)


def headers(text: Column) -> Column:
    """map<lower-cased name, value> of header lines; the last of equal names holds."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    )
    last = F.filter(
        pairs, lambda p, i: (p["col1"] != "") & ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["col1"] == p["col1"])
    )
    return F.map_from_entries(last)


def subscription_seconds(timeout: Column) -> Column:
    """Seconds of ``Second-N``; null for ``infinite`` and anything else."""
    return F.regexp_extract(F.lower(timeout), r"^second-(\d+)$", 1).try_cast("bigint")
