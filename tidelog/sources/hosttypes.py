"""Schemas from dataclasses, and their values as Avro datums and back."""

from __future__ import annotations

import dataclasses
import enum
import json
import types
import typing

from tidelog.sources import avro

#: Types of single values; Int32 and Float32 mark the narrow ones.
PLAIN = {str: "string", int: "long", float: "double", bool: "boolean", bytes: "bytes"}


class Int32(int):
    pass


class Float32(float):
    pass


class NonNull:
    """Annotation: typing.Annotated[T, NonNull] is a field that can't be null."""


def schema_of(cls, renames: dict[str, str] | None = None, deletions: tuple[str, ...] = (), hints: str = "evolution") -> dict:
    """The record schema of a dataclass. Fields may be null (default null) unless they are NonNull; renames maps old names to fields."""
    names = {f.name for f in dataclasses.fields(cls)}
    renames = renames or {}
    if set(renames.values()) - names:
        raise avro.SchemaError("a rename leads to no field")
    if set(deletions) & names or set(deletions) & set(renames):
        raise avro.SchemaError("a deletion names a field, or the old name of a rename")
    hinted = typing.get_type_hints(cls, include_extras=True)
    fields = []
    for f in dataclasses.fields(cls):
        kind, strict = hinted[f.name], False
        if typing.get_origin(kind) is typing.Annotated:
            kind, *marks = typing.get_args(kind)
            strict = NonNull in marks
        kind, _ = _optional(kind)
        plain = _type(kind)
        old = [o for o, n in renames.items() if n == f.name]
        fields.append({"name": f.name, "type": plain if strict else ["null", plain]} | ({} if strict else {"default": None}) | ({"aliases": old} if old else {}))
    return {"type": "record", "name": cls.__name__, "fields": fields} | ({f"{hints}.renames": renames} if renames else {}) | ({f"{hints}.deletions": list(deletions)} if deletions else {})


def _optional(kind) -> tuple:
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        rest = [x for x in typing.get_args(kind) if x is not type(None)]
        if len(rest) != 1:
            raise avro.SchemaError("a union may have None and one other type")
        return rest[0], True
    return kind, False


def _type(kind):
    if kind in (Int32, Float32):
        return "int" if kind is Int32 else "float"
    if kind in PLAIN:
        return PLAIN[kind]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin is list:
        return {"type": "array", "items": _type(_optional(args[0])[0])}
    if origin is dict:
        if args[0] is not str:
            raise avro.SchemaError("the keys of a map must be text")
        return {"type": "map", "values": _type(_optional(args[1])[0])}
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return {"type": "enum", "name": kind.__name__, "symbols": [x.value for x in kind]}
    if dataclasses.is_dataclass(kind):
        return schema_of(kind)
    raise avro.SchemaError(f"no Avro type for {kind}")


def to_bytes(value) -> bytes:
    """The datum of a dataclass instance; an enum member stands for its value."""
    out = bytearray()
    avro.encode(avro.parse(json.dumps(schema_of(type(value)))), _plain(value), out)
    return bytes(out)


def _plain(v):
    if isinstance(v, enum.Enum):
        return v.value
    if dataclasses.is_dataclass(v):
        return {f.name: _plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def from_bytes(cls, data: bytes):
    """The instance of a datum written with the schema of cls."""
    return _built(cls, avro.reader(avro.parse(json.dumps(schema_of(cls))))(data, 0)[0])


def _built(kind, v):
    kind = typing.get_args(kind)[0] if typing.get_origin(kind) is typing.Annotated else kind
    kind, _ = _optional(kind)
    if v is None:
        return None
    if dataclasses.is_dataclass(kind):
        hinted = typing.get_type_hints(kind, include_extras=True)
        return kind(**{f.name: _built(hinted[f.name], v[f.name]) for f in dataclasses.fields(kind) if f.name in v})
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return kind(v)
    if typing.get_origin(kind) is dict:
        return {k: _built(typing.get_args(kind)[1], x) for k, x in (v.items() if isinstance(v, dict) else v)}
    if typing.get_origin(kind) is list:
        return [_built(typing.get_args(kind)[0], x) for x in v]
    return v
