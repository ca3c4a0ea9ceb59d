"""Protobuf bodies: a registry of descriptors, and columns that decode bodies. Scalars that are not set have their zero value and repeated fields are empty; messages that are not set are missing; 64-bit integers are strings, enums names, bytes base64, and NaN or infinity null."""

from __future__ import annotations

import base64
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import SelectorError


def doctype(message: str) -> str:
    """snake_case of a message name."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", message.rpartition(".")[2]).lower()


class Registry:
    """Message types of serialized FileDescriptorSets; it travels to executors as bytes."""

    def __init__(self, *descriptor_sets: bytes, names: dict[str, str] | None = None):
        self.sets, self.names = descriptor_sets, dict(names or {})
        self._pool = None

    def __getstate__(self):
        return {"sets": self.sets, "names": self.names, "_pool": None}

    def message(self, type_name: str):
        from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

        if self._pool is None:
            self._pool = descriptor_pool.DescriptorPool()
            for blob in self.sets:
                for f in descriptor_pb2.FileDescriptorSet.FromString(blob).file:
                    self._pool.Add(f)
        try:
            return message_factory.GetMessageClass(self._pool.FindMessageTypeByName(type_name))
        except KeyError as e:
            raise SelectorError(f"unknown message type: {type_name}") from e

    def type_of(self, doc_type: str, types: list[str]) -> str | None:
        """The message type of a document type: a name given for it, or else one whose snake_case it is."""
        return self.names.get(doc_type) or next((t for t in types if doctype(t) == doc_type), None)


def _plain(field, v, defaults: bool):
    if field.type in (field.TYPE_MESSAGE, field.TYPE_GROUP):
        return as_json(v, defaults)
    if field.type == field.TYPE_ENUM:
        known = field.enum_type.values_by_number.get(v)
        return known.name if known else v
    if field.type == field.TYPE_BYTES:
        return base64.b64encode(v).decode()
    if field.cpp_type in (field.CPPTYPE_INT64, field.CPPTYPE_UINT64):
        return str(v)
    return None if isinstance(v, float) and not math.isfinite(v) else v


def _repeated(field) -> bool:
    return field.is_repeated if hasattr(field, "is_repeated") else field.label == field.LABEL_REPEATED


def as_json(message, defaults: bool = True) -> dict:
    """A message as JSON values, under JSON names. defaults: with fields that aren't set."""
    out = {}
    for f in message.DESCRIPTOR.fields:
        v = getattr(message, f.name)
        if f.message_type is not None and f.message_type.GetOptions().map_entry:
            if v or defaults:
                out[f.json_name] = {str(k): _plain(f.message_type.fields_by_name["value"], v[k], defaults) for k in v}
        elif _repeated(f):
            if len(v) or defaults:
                out[f.json_name] = [_plain(f, x, defaults) for x in v]
        elif f.message_type is not None:
            if message.HasField(f.name):
                out[f.json_name] = _plain(f, v, defaults)
        elif f.has_presence and not message.HasField(f.name):
            continue
        elif defaults or v != f.default_value:
            out[f.json_name] = _plain(f, v, defaults)
    return out


def decode(registry: Registry, type_name: Column, body: Column, defaults: bool = True) -> Column:
    """Bodies as JSON text. An unknown type or a corrupt body fails the query."""

    @F.pandas_udf("string")
    def decoded(types: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(types, bodies):
            out.append(None if b is None else json.dumps(as_json(registry.message(t).FromString(bytes(b)), defaults), ensure_ascii=False))
        return pd.Series(out, dtype=object)

    return decoded(type_name, body)


def document(registry: Registry, type_name: Column, body: Column, head: Column | None = None, defaults: bool = True) -> Column:
    """Bodies as VARIANT documents to match. head: JSON text of further keys, which win over those of the body."""
    text = decode(registry, type_name, body, defaults)
    if head is None:
        return F.parse_json(text)
    merged = F.map_concat(F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: ~F.map_contains_key(F.coalesce(F.from_json(head, "map<string,variant>"), F.create_map().cast("map<string,variant>")), k)), F.coalesce(F.from_json(head, "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.parse_json(F.to_json(merged))


def checked(registry: Registry, type_name: Column, body: Column) -> Column:
    """Why a body can't be stored, or null."""

    @F.pandas_udf("string")
    def reason(types: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for t, b in zip(types, bodies):
            try:
                registry.message(t).FromString(bytes(b))
                out.append(None)
            except Exception as e:  # the library raises several kinds
                out.append(f"bad_request: {type(e).__name__}: {e}")
        return pd.Series(out, dtype=object)

    return reason(type_name, body)
