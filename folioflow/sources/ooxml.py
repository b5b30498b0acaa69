"""Parts and relationships of office packages."""

from __future__ import annotations

import io
import posixpath
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree

#: No part larger than this is read.
MAX_PART = 40 << 20


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node, name: str, default: str | None = None) -> str | None:
    """An attribute by local name, whatever its namespace."""
    for k, v in node.attrib.items():
        if local(k) == name:
            return v
    return default


def children(node, name: str) -> list:
    return [] if node is None else [c for c in node if local(c.tag) == name]


def child(node, name: str):
    return next(iter(children(node, name)), None)


def flag(node) -> bool:
    """An on/off property: there and not switched off."""
    return node is not None and (attribute(node, "val") or "1").lower() not in ("0", "false", "off")


class Package:
    """A zip of parts; names are found whatever their case."""

    def __init__(self, content: bytes, max_part: int = MAX_PART) -> None:
        self.zip, self.max_part = zipfile.ZipFile(io.BytesIO(content)), max_part
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def read(self, path: str) -> bytes | None:
        name = self.names.get(path.lstrip("/").lower())
        if name is None or self.zip.getinfo(name).file_size > self.max_part:
            return None
        return self.zip.read(name)

    def xml(self, path: str):
        """A part's root element; a part with a document type is refused, as entities are."""
        data = self.read(path)
        if data is None or b"<!DOCTYPE" in data[:4096].upper().replace(b" ", b""):
            return None
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError:
            return None

    def relations(self, path: str) -> dict[str, Relation]:
        folder, name = posixpath.split(path.lstrip("/"))
        root = self.xml(posixpath.join(folder, "_rels", f"{name}.rels"))
        out = {}
        for r in children(root, "Relationship"):
            external = (attribute(r, "TargetMode") or "").lower() == "external"
            target = attribute(r, "Target") or ""
            out[attribute(r, "Id") or ""] = Relation(attribute(r, "Id") or "", (attribute(r, "Type") or "").rpartition("/")[2], target if external else resolve(path, target), external)
        return out

    def main(self) -> str | None:
        return next((r.target for r in self.relations("").values() if r.kind == "officeDocument"), None)


@dataclass(frozen=True)
class Relation:
    id: str
    kind: str
    target: str
    external: bool


def resolve(source: str, target: str) -> str:
    """A relationship's target as a part name."""
    target = target.replace("\\", "/")
    if target.startswith("/"):
        return posixpath.normpath(target).lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(source.lstrip("/")), target)).lstrip("/")
