"""Column functions over names, paths and strings; all run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params


def char_class(chars: str) -> str:
    """A regular-expression class of the given characters."""
    return "[" + "".join(f"\\{c}" if ord(c) < 128 and not c.isalnum() else c for c in chars) + "]"


def any_of(words: tuple[str, ...]) -> str:
    return "(" + "|".join(re.sub(r"([^\w])", r"\\\1", w) for w in words) + ")"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """What follows the last dot of the base name, the base name itself without one; case is kept."""
    return F.substring_index(basename(path), ".", -1)


def file_kind(path: Column, content: Column | None = None) -> Column:
    """html, js or xml by lower-cased suffix, otherwise elf by the content's magic, otherwise null."""
    end = F.lower(suffix(path))
    kind = F.when(end.isin("html", "htm", "shtml"), "html").when(end == "js", "js").when(end == "xml", "xml")
    return kind if content is None else kind.when(is_elf(content), "elf")


def is_elf(content: Column) -> Column:
    return F.substring(F.hex(F.substring(content, 1, 4)), 3, 6) == "454C46"


def is_private_key(content: Column) -> Column:
    return F.contains(content, F.lit("PRIVATE KEY").cast("binary"))


def base_name_ok(name: Column) -> Column:
    """Longer than three characters and no leading digit."""
    return (F.length(name) > 3) & ~name.rlike("^[0-9]")


def keyword_ok(name: Column, strict: bool = True) -> Column:
    """The keyword rule; ``strict`` adds length 5 to 24, no leading underscore and no special characters."""
    if not strict:
        return base_name_ok(name)
    length = F.length(name)
    plain = ~name.rlike(char_class(params.KEYWORD_CHARS)) & ~name.startswith("_")
    return base_name_ok(name) & (length > 4) & (length < 25) & plain


def api_name(value: Column) -> Column:
    """The API name in a value, without one final question mark; null if it is none."""
    name = F.regexp_replace(value, r"^\s+|\s+$", "")
    good = (F.length(name) >= 5) & F.contains(name, F.lit("/")) & ~name.rlike(char_class(params.API_CHARS))
    return F.when(good, F.regexp_replace(name, r"\?$", ""))


def keyword_or_api(value: Column, strict: bool = True) -> Column:
    """struct<kind, name>: a keyword, else an API name, else null."""
    api = api_name(value)
    found = F.when(keyword_ok(value, strict), F.struct(F.lit("keyword").alias("kind"), value.alias("name")))
    return found.when(api.isNotNull(), F.struct(F.lit("api").alias("kind"), api.alias("name")))


def path_string_ok(s: Column) -> Column:
    """A string of a binary that is taken over as a path: a slash and no special character."""
    return F.contains(s, F.lit("/")) & ~F.trim(s).rlike(char_class(params.PATH_CHARS))


def not_command(path: Column) -> Column:
    """Paths that do not end with a command's name (so ``.../utils`` ends with ``ls``)."""
    return ~path.rlike(any_of(params.COMMANDS) + "$")


def not_library(path: Column) -> Column:
    """Paths without a library mark after their first character."""
    ok = F.lit(True)
    for mark in params.LIBRARY_MARKS:
        ok = ok & (F.instr(path, mark) <= 1)
    return ok


def query_cut(value: Column) -> Column:
    """A reference up to its question mark, unless it starts with one."""
    return F.regexp_replace(value, r"^([^?]+)\?.*$", "$1")


def similar(s: Column, key: str | Column) -> Column:
    """Contains the key, and what remains is alphanumeric or has a single kind of ``_`` or ``-``."""
    key = F.lit(key) if isinstance(key, str) else key
    rest = F.replace(s, key, F.lit(""))
    return F.contains(s, key) & (rest.rlike(r"^[\p{L}\p{N}]*$") | rest.rlike(r"^[\p{L}\p{N}_]*$") | rest.rlike(r"^[\p{L}\p{N}-]*$"))


def _role_name(name: Column, words: tuple[str, ...]) -> Column:
    """Whether the first occurrence of a word stands at a boundary: an end, ``_``, ``-`` or camel case."""
    found: Column = F.lit(False)
    for word in words:
        at = F.instr(F.lower(name), word)  # from 1
        after = F.substr(name, at + len(word), F.lit(1))
        before = F.substr(name, at - 1, F.lit(1))
        first = F.substr(name, at, F.lit(1))
        right = (after == "") | after.rlike("[_A-Z-]")
        left = (at == 1) | before.rlike("[_-]") | (first.rlike("[A-Z]") & before.rlike("[a-z]"))
        found = found | ((at > 0) & (right | left))
    return found


def is_setter(name: Column) -> Column:
    return _role_name(name, params.SET_WORDS)


def is_getter(name: Column) -> Column:
    """Like a setter's rule, with the getters' words."""
    return _role_name(name, params.GET_WORDS)


def is_network_word(s: Column) -> Column:
    """Holds a word of request handling and does not start with a hyphen."""
    low = F.lower(s)
    hit = low.rlike(any_of(tuple(dict.fromkeys(w.lower() for w in params.NETWORK_WORDS))))
    return ~s.startswith("-") & (hit | s.rlike(any_of(params.NETWORK_METHODS)))


def getter_of(name: Column) -> Column:
    """The getter's name that belongs to a setter's: ``set`` becomes ``get``, case by case."""
    out = name
    for old, new in (("set", "get"), ("SET", "GET"), ("Set", "Get")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def data_key(value: Column) -> Column:
    return F.substring_index(value, ":%", 1)


def key_prefix(key: Column) -> Column:
    """A key up to and with its first separator, null without one."""
    return F.nullif(F.regexp_extract(key, r"^([^_-]*[_-])", 1), F.lit(""))


def memory_string(s: Column, extended: bool = True, least: int = params.STRING_LEAST) -> Column:
    """Longest prefix in the allowed alphabet within the window; null below the least length."""
    allowed = params.STRING_CHARS_EXTENDED if extended else params.STRING_CHARS
    found = F.regexp_extract(F.substring(s, 1, params.STRING_WINDOW), f"^([{allowed}]*)", 1)
    return F.when(F.length(found) >= least, found)


def longest(*candidates: Column) -> Column:
    """The longest of several decoded strings, the first of equally long ones."""
    sized = [F.struct(F.coalesce(F.length(c), F.lit(-1)).alias("n"), F.lit(-k).alias("k"), c.alias("s")) for k, c in enumerate(candidates)]
    return F.array_max(F.array(*sized))["s"]


def format_specifiers(fmt: Column) -> Column:
    """The directives of a format string in order (``%%`` is skipped)."""
    return F.filter(F.regexp_extract_all(fmt, F.lit(r"(%%|%[^%])"), F.lit(1)), lambda x: x != "%%")


def guard_hash(addresses: Column) -> Column:
    """One text for a set of guard addresses, whatever their order and repetition."""
    return F.array_join(F.array_sort(F.array_distinct(addresses)), ",")


def variable_name(name: Column) -> Column:
    """A symbolic variable's name without its unique number and width."""
    return F.regexp_replace(name, r"_\d+_\d+$", "")


def hex_address(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def address(text: Column) -> Column:
    """``0x…`` text as a number."""
    return F.conv(F.substring(text, 3, 16), 16, 10).cast("bigint")


def rebased(n: Column, loaded: int = 0x10000, base: int = 0x400000) -> Column:
    """Address of position-independent code as the analysis loads it."""
    return n - loaded + base


def swapped(hex_text: Column) -> Column:
    """The bytes of hex text in the other order."""
    pairs = F.regexp_extract_all(hex_text, F.lit(r"([0-9A-Fa-f]{2})"), F.lit(1))
    return F.array_join(F.reverse(pairs), "")


def byte_order(content: Column) -> Column:
    """little or big, from an ELF header's sixth byte; null for anything else."""
    mark = F.hex(F.substring(content, 6, 1))
    return F.when(is_elf(content) & (mark == "01"), "little").when(is_elf(content) & (mark == "02"), "big")
