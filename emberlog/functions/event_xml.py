"""What an event's XML holds, by a walk over its elements.

Names count without their prefix. Data of the event part are properties by their attribute Name, or Data0,
Data1 and so on where they have none; other elements by their own name, and below an element with
children also by the path from there. Text is what an element holds in all, character data sections and
references resolved; text of white space alone between markup is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa

FIELDS = ("channel", "provider", "event_id", "qualifiers", "record_id", "time", "level", "computer", "user_id")
#: Control characters that XML forbids, as such or by reference; logs hold them all the same.
_FORBIDDEN = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]|&#(?:0*(?:[0-8]|1[124-9]|2\d|3[01])|x0*(?:[0-8BCEFbcef]|1[0-9A-Fa-f]));")


class _Builder(ElementTree.TreeBuilder):
    """A tree of a document without a document type, which could define entities."""

    def doctype(self, name, public, system):
        raise ElementTree.ParseError("document type")


def _tree(xml: str) -> ElementTree.Element:
    # A builder of its own is called for each element, so only texts that may have a document type get one.
    parser = ElementTree.XMLParser(target=_Builder()) if "<!DOCTYPE" in xml else ElementTree.XMLParser()
    parser.feed(xml)
    return parser.close()


@lru_cache(4096)
def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _local(element: ElementTree.Element) -> str:
    return _name(element.tag)


def _children(element: ElementTree.Element | None) -> dict[str, ElementTree.Element]:
    """The first child of each name."""
    return {} if element is None else {_name(c.tag): c for c in reversed(element)}


def _text(element: ElementTree.Element | None) -> str | None:
    if element is None:
        return None
    if not len(element):
        text = element.text
        return text if text and text.strip(" \t\r\n") else ""
    return "".join(t for t in element.itertext() if t.strip(" \t\r\n"))


def _attribute(element: ElementTree.Element | None, name: str) -> str | None:
    return None if element is None else element.get(name)


def _add_leaves(element: ElementTree.Element, found: dict[str, str]) -> None:
    """Leaves below an element by their path, where there is nothing of that name yet."""
    stack = [(child, _local(child)) for child in reversed(element)]
    while stack:
        node, name = stack.pop()
        if len(node):
            stack.extend((child, f"{name}.{_local(child)}") for child in reversed(node))
        elif text := _text(node):
            found.setdefault(name.lower(), text)


def properties(part: ElementTree.Element | None) -> dict[str, str]:
    """Properties of the event or user part, by lower-case name; of equal names the last wins."""
    found: dict[str, str] = {}
    unnamed = 0
    for element in part.iter() if part is not None else ():
        name = _local(element)
        if element is part or name in ("EventData", "UserData", "Binary"):
            continue
        if name != "Data" and len(element):
            _add_leaves(element, found)
            continue
        key = element.get("Name")
        if not key or key.isspace():
            key = name
            if name == "Data":
                key, unnamed = f"Data{unnamed}", unnamed + 1
        if text := _text(element):
            found[key.lower()] = text
    return found


def _parts(xml: str | None) -> tuple | None:
    if xml is None or not xml.strip():
        return None
    try:
        root = _tree(xml)
    except ElementTree.ParseError:
        mended = _FORBIDDEN.sub("\N{REPLACEMENT CHARACTER}", xml)
        if mended == xml:
            return None
        try:
            root = _tree(mended)
        except ElementTree.ParseError:
            return None
    parts = _children(root)
    system = _children(parts.get("System"))
    event_id = system.get("EventID")
    found = properties(parts.get("EventData"))
    for name, text in properties(parts.get("UserData")).items():
        found.setdefault(name, text)
    values = (
        _text(system.get("Channel")), _attribute(system.get("Provider"), "Name"), _text(event_id), _attribute(event_id, "Qualifiers"), _text(system.get("EventRecordID")),
        _attribute(system.get("TimeCreated"), "SystemTime"), _text(system.get("Level")), _text(system.get("Computer")), _attribute(system.get("Security"), "UserID"),
    )
    return *values, list(found.items())


def event_parts(xml: str | None) -> dict | None:
    """The raw fields of the system part and the properties, or None for what is no document."""
    parts = _parts(xml)
    return None if parts is None else dict(zip(("raw_xml", *FIELDS, "main"), (xml, *parts)))


SCHEMA = pa.schema([("raw_xml", pa.string()), *((f, pa.string()) for f in FIELDS), ("main", pa.map_(pa.string(), pa.string()))])
DDL = ", ".join(["raw_xml string", *(f"{f} string" for f in FIELDS), "main map<string,string>"])


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of batches with one column of XML; broken documents give none."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            raw = batch.column(0).slice(at, 1000)
            parts = [_parts(x) for x in raw.to_pylist()]
            rows = [p for p in parts if p is not None]
            if rows:
                whole = raw.filter(pa.array([p is not None for p in parts])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([whole, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(SCHEMA)[1:]))], schema=SCHEMA)
