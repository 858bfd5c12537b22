"""XMP packets: parsing, building and merging."""

from __future__ import annotations

import xml.etree.ElementTree as ET

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: The namespaces that can be written, by their usual prefix.
NAMESPACES = {
    "dc": "http://purl.org/dc/elements/1.1/",
    "xmp": "http://ns.adobe.com/xap/1.0/",
    "xmpRights": "http://ns.adobe.com/xap/1.0/rights/",
    "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "tiff": "http://ns.adobe.com/tiff/1.0/",
    "exif": "http://ns.adobe.com/exif/1.0/",
    "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
    "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
}
_CONTAINER = {"dc:title": "Alt", "dc:description": "Alt", "dc:rights": "Alt", "dc:creator": "Seq", "dc:subject": "Bag"}
_PREFIX = {uri: name for name, uri in NAMESPACES.items()}


def _root(packet: str) -> ET.Element | None:
    start, end = packet.find("<x:xmpmeta"), packet.rfind("</x:xmpmeta>")
    body = packet[start : end + 12] if 0 <= start < end else packet
    if "<!DOCTYPE" in body or "<!ENTITY" in body:
        return None
    try:
        return ET.fromstring(body)
    except ET.ParseError:
        return None


def _name(tag: str, other: dict[str, str]) -> str:
    uri, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return f"{_PREFIX.get(uri) or other.get(uri) or 'ns'}:{local}"


def _values(node: ET.Element) -> list[str]:
    items = [(li.text or "").strip() for li in node.iter(f"{{{RDF}}}li")]
    return items or [(node.text or "").strip()]


def _declared(packet: str) -> dict[str, str]:
    import re

    return {uri: prefix for prefix, uri in re.findall(r'xmlns:([\w.-]+)\s*=\s*["\']([^"\']+)["\']', packet)}


def properties(packet: str) -> dict[str, list[str]]:
    """``prefix:name`` to values, of every description; empty where the XML is broken."""
    root, out = _root(packet), {}
    if root is None:
        return {}
    other = _declared(packet)
    for about in root.iter(f"{{{RDF}}}Description"):
        for key, value in about.attrib.items():
            if not key.startswith(f"{{{RDF}}}"):
                out[_name(key, other)] = [value]
        for node in about:
            out[_name(node.tag, other)] = _values(node)
    return out


def build(values: dict[str, list[str]]) -> str:
    """A packet of ``prefix:name`` to values; ValueError for an unknown prefix."""
    for prefix, uri in NAMESPACES.items():
        ET.register_namespace(prefix, uri)
    ET.register_namespace("x", "adobe:ns:meta/")
    ET.register_namespace("rdf", RDF)
    root = ET.Element("{adobe:ns:meta/}xmpmeta")
    about = ET.SubElement(ET.SubElement(root, f"{{{RDF}}}RDF"), f"{{{RDF}}}Description", {f"{{{RDF}}}about": ""})
    for name, items in values.items():
        _put(about, name, items)
    return _packet(root)


def _packet(root: ET.Element) -> str:
    return '<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>\n' + ET.tostring(root, encoding="unicode") + '\n<?xpacket end="w"?>'


def _put(about: ET.Element, name: str, items: list[str]) -> None:
    prefix, _, local = name.partition(":")
    if prefix not in NAMESPACES:
        raise ValueError(f"unknown XMP prefix {prefix}")
    node = ET.SubElement(about, f"{{{NAMESPACES[prefix]}}}{local}")
    kind = _CONTAINER.get(name) or ("Bag" if len(items) > 1 else None)
    if kind is None:
        node.text = items[0]
        return
    holder = ET.SubElement(node, f"{{{RDF}}}{kind}")
    for item in items:
        li = ET.SubElement(holder, f"{{{RDF}}}li", {"{http://www.w3.org/XML/1998/namespace}lang": "x-default"} if kind == "Alt" else {})
        li.text = item


def merge(packet: str | None, patch: dict[str, list[str]]) -> str:
    """The packet with ``patch``: absent names stay, an empty list removes, others replace.

    Everything else, other vendors' properties too, is kept.
    """
    root = _root(packet) if packet else None
    if root is None:
        return build({k: v for k, v in patch.items() if v})
    for uri, prefix in _declared(packet).items():
        try:
            ET.register_namespace(prefix, uri)
        except ValueError:
            continue
    abouts = list(root.iter(f"{{{RDF}}}Description"))
    if not abouts:
        return build({k: v for k, v in patch.items() if v})
    for name, items in patch.items():
        prefix, _, local = name.partition(":")
        if prefix not in NAMESPACES:
            raise ValueError(f"unknown XMP prefix {prefix}")
        key = f"{{{NAMESPACES[prefix]}}}{local}"
        for about in abouts:
            about.attrib.pop(key, None)
            for node in about.findall(key):
                about.remove(node)
        if items:
            _put(abouts[0], name, items)
    return _packet(root)
