"""Port types: parsing, assignability, labels, and the Spark type of each kind."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

OPEN = ("any", "unknown")


@dataclass(frozen=True)
class PortType:
    """A kind with what it is made of: item (list, option), key and value (map), fields (record)."""

    kind: str = "any"
    item: PortType | None = None
    key: PortType | None = None
    value: PortType | None = None
    fields: tuple[tuple[str, PortType], ...] | None = None
    nullable: bool = False
    metadata: tuple[tuple[str, Any], ...] = field(default=())

    @classmethod
    def of(cls, raw: Any) -> PortType:
        """From None, a kind's name, a dict, or a PortType; whatever else is any."""
        if isinstance(raw, cls):
            return raw
        if isinstance(raw, str):
            return cls("float" if raw == "number" else raw)
        if not isinstance(raw, dict):
            return cls()
        part = lambda *names: next((cls.of(raw[n]) for n in names if raw.get(n) is not None), None)
        kind = {"number": "float"}.get(raw.get("kind", "any"), raw.get("kind", "any"))
        item, value = part("elementType", "element_type", "item"), part("value")
        if kind == "map" and value is None:
            item, value = None, item
        fields = tuple((k, cls.of(v)) for k, v in raw["fields"].items()) if isinstance(raw.get("fields"), dict) else None
        return cls(kind, item, part("key"), value, fields, bool(raw.get("nullable")), _frozen(raw.get("metadata")))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"kind": self.kind, "nullable": self.nullable}
        for name, part in (("element_type", self.item), ("key", self.key), ("value", self.value)):
            if part:
                out[name] = part.to_dict()
        if self.fields is not None:
            out["fields"] = {k: v.to_dict() for k, v in self.fields}
        if self.metadata:
            out["metadata"] = {k: list(v) if isinstance(v, tuple) else v for k, v in self.metadata}
        return out

    def accepts(self, source: Any) -> bool:
        """Whether a port of this type may be fed by one of source's.

        Anything goes with an open kind; an int feeds a float; what may be null feeds only what may be;
        otherwise kinds agree, and so do their parts where both sides name them. A record may have more
        fields than asked for; a tensor's dtype and shape agree where both give them.
        """
        source = PortType.of(source)
        if self.kind in OPEN or source.kind in OPEN or (source.kind, self.kind) == ("int", "float"):
            return True
        if (source.nullable and not self.nullable) or source.kind != self.kind:
            return False
        if self.kind in ("list", "option"):
            return not (self.item and source.item) or self.item.accepts(source.item)
        if self.kind == "map":
            return not (self.value and source.value) or self.value.accepts(source.value)
        if self.kind == "record" and self.fields and source.fields:
            have = dict(source.fields)
            return all(k in have and v.accepts(have[k]) for k, v in self.fields)
        if self.kind == "tensor":
            mine, theirs = dict(self.metadata), dict(source.metadata)
            return all(not (mine.get(k) and theirs.get(k)) or mine[k] == theirs[k] for k in ("dtype", "shape"))
        return True

    @property
    def label(self) -> str:
        if self.kind == "list" and self.item:
            return f"list<{self.item.label}>"
        if self.kind == "map":
            return f"map<{self.value.label}>" if self.value else "map"
        if self.kind == "option" and self.item:
            return f"{self.item.label}?"
        if self.kind == "record" and self.fields:
            return "{" + ", ".join(f"{k}: {v.label}" for k, v in self.fields) + "}"
        if self.kind == "tensor" and (dtype := dict(self.metadata).get("dtype")):
            return f"tensor<{dtype}>"
        return f"{self.kind}?" if self.nullable and self.kind not in OPEN else self.kind

    def spark(self) -> T.DataType:
        """The column type of a value of this kind; open kinds are variants."""
        part = lambda p: p.spark() if p else T.VariantType()
        if self.kind in ("list",):
            return T.ArrayType(part(self.item))
        if self.kind == "map":
            return T.MapType(self.key.spark() if self.key and self.key.kind not in OPEN else T.StringType(), part(self.value))
        if self.kind == "option":
            return part(self.item)
        if self.kind in ("record", "tuple"):
            return T.StructType([T.StructField(k, v.spark()) for k, v in self.fields or ()])
        if self.kind == "tensor":
            return T.ArrayType(T.FloatType() if dict(self.metadata).get("dtype") == "float32" else T.DoubleType())
        if self.kind == "point":
            return T.StructType().add("x", "double").add("y", "double").add("label", "int")
        if self.kind == "box":
            return T.StructType().add("x1", "double").add("y1", "double").add("x2", "double").add("y2", "double").add("label", "int")
        flat = {"int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "null": T.NullType(), "mask": T.StringType(), "session": T.StringType(), "image": T.StringType(), "url": T.StringType()}
        return flat.get(self.kind, T.VariantType())


def _frozen(metadata: Any) -> tuple[tuple[str, Any], ...]:
    if not isinstance(metadata, dict):
        return ()
    return tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in metadata.items()))


def compatible(source: Any, target: Any) -> bool:
    return PortType.of(target).accepts(source)


def type_label(raw: Any) -> str:
    return PortType.of(raw).label
