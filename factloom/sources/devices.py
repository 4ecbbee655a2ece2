"""Device and service descriptions."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import schema

_SERVICE = r"<service>([\s\S]*?)</service>"


def services(documents: DataFrame, *, key: str = "path", source: str = "content") -> DataFrame:
    """(key, service_type, service_id, control_url, event_url, scpd_url) of the service lists, by pattern."""
    lists = F.regexp_extract_all(F.col(source), F.lit(r"<serviceList>([\s\S]*?)</serviceList>"), F.lit(1))
    each = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(_SERVICE), F.lit(1))))
    rows = documents.select(F.col(key), F.explode(each).alias("service"))
    fields = {"service_type": "serviceType", "service_id": "serviceId", "control_url": "controlURL", "event_url": "eventSubURL", "scpd_url": "SCPDURL"}
    return rows.select(key, *(F.trim(F.regexp_extract("service", rf"<{tag}>([\s\S]*?)</{tag}>", 1)).alias(n) for n, tag in fields.items()))


def described(services: DataFrame, documents: DataFrame, *, key: str = "path") -> DataFrame:
    """Services with the path of the document whose path holds their description's address.

    Base names meet in an equi-join; the containment is verified on the pairs.
    """
    paths = documents.select(F.col(key).alias("scpd_path"), F.substring_index(key, "/", -1).alias("scpd_name"))
    named = services.withColumn("scpd_name", F.substring_index("scpd_url", "/", -1))
    return named.join(paths, "scpd_name").filter(F.contains("scpd_path", "scpd_url")).drop("scpd_name")


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _child(node: ElementTree.Element, name: str) -> str | None:
    for child in node:
        if _local(child) == name:
            return (child.text or "").strip()
    return None


def parse_service(xml: str | bytes | None) -> tuple[list[dict], list[dict]] | None:
    """(state variables, actions) of one service description, null if it cannot be read."""
    if xml is None or "<!ENTITY" in (xml if isinstance(xml, str) else xml.decode("latin-1")):
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    variables, actions = [], []
    for node in root.iter():
        if _local(node) == "stateVariable":
            allowed = [(v.text or "").strip() for v in node.iter() if _local(v) == "allowedValue"]
            variables.append(
                {"name": _child(node, "name"), "datatype": _child(node, "dataType"), "allowed_values": allowed, "send_events": node.get("sendEvents", "yes").strip().lower() in ("yes", "1", "true")}
            )
        elif _local(node) == "action":
            args = [
                {"name": _child(a, "name"), "direction": _child(a, "direction"), "statevar": _child(a, "relatedStateVariable")}
                for a in node.iter() if _local(a) == "argument"
            ]
            actions.append({"name": _child(node, "name"), "args": args})
    return variables, actions


def service_descriptions(documents: DataFrame, *, key: str = "path", source: str = "content") -> DataFrame:
    """(key, statevars, actions) of readable service descriptions."""
    kind = documents.schema[key].dataType.simpleString()
    full = schema("device_service")
    nested = ", ".join(f"{n} {full[n].dataType.simpleString()}" for n in ("statevars", "actions"))

    def scan(batches):
        for batch in batches:
            rows = [(k, *p) for k, s in zip(batch[key], batch[source], strict=True) if (p := parse_service(s)) is not None]
            yield pd.DataFrame(rows, columns=[key, "statevars", "actions"])

    return documents.select(key, source).mapInPandas(scan, f"`{key}` {kind}, {nested}")


def device_keywords(services: DataFrame, descriptions: DataFrame, *, key: str = "path") -> DataFrame:
    """(name, path), distinct: service types, ids and names, actions, their in-arguments, variables."""
    listed = services.select(F.col(key).alias("path"), F.explode(F.array("service_type", "service_id", F.substring_index("service_id", ":", -1))).alias("name"))
    ins = F.flatten(F.transform("actions", lambda a: F.transform(F.filter(a["args"], lambda x: x["direction"] == "in"), lambda x: x["name"])))
    names = F.concat(F.transform("actions", lambda a: a["name"]), ins, F.transform("statevars", lambda v: v["name"]))
    inner = descriptions.select(F.col(key).alias("path"), F.explode(names).alias("name"))
    return listed.union(inner).filter("name IS NOT NULL AND name <> ''").select("name", "path").distinct()


def find_action(descriptions: DataFrame, name: str, *, key: str = "path") -> DataFrame:
    """The first action of a name over all descriptions, in order of their keys."""
    rows = descriptions.select(F.col(key), F.posexplode("actions").alias("n", "action")).filter(F.col("action.name") == name)
    return rows.orderBy(key, "n").limit(1).select(key, "action")


def missing_arguments(descriptions: DataFrame, given: DataFrame, *, key: str = "path") -> DataFrame:
    """(key, action, argument) of required in-arguments that ``given(action, argument)`` lacks."""
    needed = descriptions.select(F.col(key), F.explode("actions").alias("a")).select(key, F.col("a.name").alias("action"), F.explode("a.args").alias("x"))
    needed = needed.filter("x.direction = 'in'").select(key, "action", F.col("x.name").alias("argument"))
    return needed.join(given.select("action", "argument"), ["action", "argument"], "left_anti")
