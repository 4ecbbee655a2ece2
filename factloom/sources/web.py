"""Front-end files: attributes, script references, inline scripts, script literals, XML tags."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def attribute_values(html: Column, attribute: str) -> Column:
    """All values of a double-quoted attribute, in order."""
    return F.regexp_extract_all(html, F.lit(f'{attribute}="([^\\n]*?)"'), F.lit(1))


def attributes(pages: DataFrame, names: tuple[str, ...] = ("name", "id"), *, key: str = "path", html: str = "html") -> DataFrame:
    """(key, value): distinct values of several attributes of each page."""
    found = F.concat(*(attribute_values(F.col(html), n) for n in names))
    return pages.select(F.col(key), F.explode(F.array_distinct(found)).alias("value"))


def actions(pages: DataFrame, *, key: str = "path", html: str = "html", attribute: str = "action") -> DataFrame:
    """(key, name): form actions, taken as they are."""
    return attributes(pages, (attribute,), key=key, html=html).withColumnRenamed("value", "name")


def script_references(pages: DataFrame, *, key: str = "path", html: str = "html") -> DataFrame:
    """js_citations(script, html_path): base names of external scripts, without their query."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'<script src="([^\n]*?)"></script>'), F.lit(1))
    rows = pages.select(F.col(key).alias("html_path"), F.explode(found).alias("src"))
    return rows.select(text.basename(text.query_cut(F.col("src"))).alias("script"), "html_path").distinct()


def inline_scripts(html: Column) -> Column:
    """Bodies of script elements without attributes, then of those of type text/javascript."""
    plain = F.regexp_extract_all(html, F.lit(r"<script>([\s\S]+?)</script>"), F.lit(1))
    typed = F.regexp_extract_all(html, F.lit(r'<script type="text/javascript">([\s\S]+?)</script>'), F.lit(1))
    return F.concat(plain, typed)


def soap_actions(script: Column) -> Column:
    """First arguments of sendSOAPAction calls, by pattern."""
    return F.regexp_extract_all(script, F.lit(r'sendSOAPAction\("([\s\S]+?)",.*\)'), F.lit(1))


_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|$))
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<template>`(?:\\.|[^`\\])*`)
    |(?P<number>0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?n?)
    |(?P<word>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)
    |(?P<mark>[(){}\[\];,.<>=+\-*%&|^!~?:/\\@\#])
    |(?P<other>.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
#: A slash after one of these starts a regular expression.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1]
        if code[0] in "xu" and len(code) > 1:
            return chr(int(code[1:].strip("{}"), 16))
        return _ESCAPES.get(code, code)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,5}\}|.)", one, body, flags=re.S)


def tokens(script: str) -> list[tuple[str, str]]:
    """(kind, value) of a script's tokens; kinds: string, number, regex, word, mark."""
    out: list[tuple[str, str]] = []
    at, last = 0, "("
    while at < len(script):
        if script[at] == "/" and script[at : at + 2] not in ("//", "/*") and last in _BEFORE_REGEX:
            m = _REGEX.match(script, at)
            if m:
                out.append(("regex", m[0]))
                at, last = m.end(), "/x/"
                continue
        m = _TOKEN.match(script, at)
        at, kind = m.end(), m.lastgroup
        if kind in ("skip", "other"):
            continue
        value = m[0]
        last = value
        if kind == "string":
            value = _unescape(value[1:-1])
        elif kind == "template":
            kind, value = "template", value[1:-1]
        out.append((kind, value))
    return out


def literals(script: str | None) -> list[tuple[str, str]]:
    """(kind, value), distinct: literals of a script, and first arguments of three-argument
    ``sendSOAPAction`` calls as kind ``soap``."""
    if not script:
        return []
    found: dict[tuple[str, str], None] = {}
    words = tokens(script)
    for n, (kind, value) in enumerate(words):
        if kind in ("string", "number", "regex"):
            found[("literal", value)] = None
        elif kind == "word" and value in ("true", "false", "null"):
            found[("literal", {"true": "True", "false": "False", "null": "None"}[value])] = None
        elif kind == "word" and value == "sendSOAPAction" and words[n - 1 : n] == [("mark", ".")] and words[n + 1 : n + 2] == [("mark", "(")]:
            depth, commas, end = 0, 0, n + 1
            for end in range(n + 1, len(words)):
                k, v = words[end]
                depth += (k == "mark" and v in "([{") - (k == "mark" and v in ")]}")
                commas += k == "mark" and v == "," and depth == 1
                if depth == 0:
                    break
            if commas == 2 and n + 3 <= end and words[n + 2][0] in ("string", "number") and words[n + 3] == ("mark", ","):
                found[("soap", words[n + 2][1])] = None
    return list(found)


def script_literals(scripts: DataFrame, *, key: str = "path", source: str = "content") -> DataFrame:
    """(key, kind, value) of the literals of each script, tokenised where the script is."""
    kind = scripts.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            rows = [(k, a, b) for k, s in zip(batch[key], batch[source], strict=True) for a, b in literals(s)]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"])

    return scripts.select(key, source).mapInPandas(scan, f"`{key}` {kind}, kind string, value string")


def tag_depths(xml: str | bytes | None) -> list[tuple[int, str]]:
    """(depth, tag without namespace) of the elements of a document, the root at depth 1; empty if it
    is not well-formed or declares entities."""
    found: list[tuple[int, str]] = []
    depth = 0

    def start(name, attrs):
        nonlocal depth
        depth += 1
        found.append((depth, name.rpartition("}")[2]))

    def end(name):
        nonlocal depth
        depth -= 1

    def refuse(*_):
        raise ValueError("entities are not expanded")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, refuse
    try:
        parser.Parse(xml or b"", True)
    except (expat.ExpatError, ValueError):
        return []
    return found


def protocol_tags(documents: DataFrame, *, key: str = "path", source: str = "content", api_depth: int = 3) -> DataFrame:
    """(key, kind, value): tags at ``api_depth`` are API names, deeper ones keywords."""
    kind = documents.schema[key].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            rows = [
                (k, "api" if d == api_depth else "keyword", t)
                for k, s in zip(batch[key], batch[source], strict=True)
                for d, t in dict.fromkeys(tag_depths(s)) if d >= api_depth
            ]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"]).drop_duplicates()

    return documents.select(key, source).mapInPandas(scan, f"`{key}` {kind}, kind string, value string")
