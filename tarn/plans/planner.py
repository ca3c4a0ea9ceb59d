"""Which index suits a query. Without a materialized one Spark scans; the choice then serves explain and use_index."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from ..functions.collate import sort_key
from ..functions.paths import SelectorError, parse_field
from .selector import Every, Group, Test


#: After each string that a prefix starts, in practice.
LAST = "\U0010ffff\U0010ffff"


@dataclass(frozen=True)
class IndexDef:
    """An index on fields in order, over the documents that meet partial. kind "spatial": fields are west, south, east and north."""

    fields: tuple[str, ...]
    name: str = ""
    ddoc: str = ""
    partial: str = "{}"
    kind: str = "json"
    materialized: str | None = None

    def __post_init__(self):
        digest = hashlib.md5(json.dumps([self.kind, self.fields, self.partial]).encode()).hexdigest()
        object.__setattr__(self, "name", self.name or f"idx-{digest[:12]}")
        object.__setattr__(self, "ddoc", self.ddoc or f"_design/{digest}")

    def same(self, other: IndexDef) -> bool:
        return (self.fields, self.partial, self.kind) == (other.fields, other.partial, other.kind)

    def as_dict(self) -> dict:
        d: dict = {"fields": [{f: "asc"} for f in self.fields]}
        if self.partial != "{}":
            d["partial_filter_selector"] = json.loads(self.partial)
        return {"ddoc": self.ddoc, "name": self.name, "type": self.kind, "def": d}


def index_def(spec: dict, name: str = "", ddoc: str = "", kind: str = "json") -> IndexDef:
    """An index from {"fields": [...], "partial_filter_selector": {...}}; descending fields are refused."""
    fields = []
    for f in spec.get("fields") or []:
        if isinstance(f, dict):
            if len(f) != 1 or next(iter(f.values())) != "asc":
                raise SelectorError("index fields must be ascending")
            f = next(iter(f))
        if not isinstance(f, str):
            raise SelectorError("index fields must be names")
        parse_field(f)
        fields.append(f)
    if not fields or kind == "spatial" and len(fields) != 4:
        raise SelectorError("an index needs fields (a spatial one west, south, east and north)")
    return IndexDef(tuple(fields), name, ddoc, json.dumps(spec.get("partial_filter_selector") or {}, sort_keys=True), kind)


def design_doc(index: IndexDef) -> dict:
    return {"_id": index.ddoc, "language": "query", "views": {index.name: {"map": {"fields": {f: "asc" for f in index.fields}, "partial_filter_selector": json.loads(index.partial)}, "options": {"def": index.as_dict()["def"], "type": index.kind}}}}


def from_design_doc(doc: dict) -> list[IndexDef]:
    return [index_def(v["options"]["def"], name, doc["_id"], v["options"].get("type", "json")) for name, v in (doc.get("views") or {}).items() if isinstance(v, dict) and "def" in v.get("options", {})]


def parse_sort(sort: object) -> tuple[list[str], bool]:
    """(fields, descending) of ["a", {"b": "asc"}]; directions can't be mixed."""
    if sort in (None, []):
        return [], False
    if not isinstance(sort, list):
        raise SelectorError("sort must be an array")
    fields, ways = [], set()
    for s in sort:
        if isinstance(s, str):
            s = {s: "asc"}
        if not isinstance(s, dict) or len(s) != 1 or next(iter(s.values())) not in ("asc", "desc"):
            raise SelectorError("sort fields must be names or {name: asc|desc}")
        ((f, way),) = s.items()
        parse_field(f)
        fields.append(f)
        ways.add(way)
    if len(ways) > 1:
        raise SelectorError("sort directions can't be mixed")
    return fields, ways == {"desc"}


@dataclass
class Range:
    """Bounds of a field in collation order, and whether they are included."""

    low: tuple[object, bool] | None = None
    high: tuple[object, bool] | None = None

    def narrow(self, op: str, v: object) -> None:
        k = sort_key(v)
        if op in ("eq", "gt", "gte") and (self.low is None or (k, op == "gt") > (sort_key(self.low[0]), not self.low[1])):
            self.low = (v, op != "gt")
        if op in ("eq", "lt", "lte") and (self.high is None or (k, op != "lt") < (sort_key(self.high[0]), self.high[1])):
            self.high = (v, op != "lt")

    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        a, b = sort_key(self.low[0]), sort_key(self.high[0])
        return a > b or a == b and not (self.low[1] and self.high[1])

    def single(self) -> bool:
        return self.low is not None and self.high is not None and sort_key(self.low[0]) == sort_key(self.high[0])


def required(node) -> set[tuple[str, ...]]:
    """Paths that exist in every document a tree matches."""
    if isinstance(node, Test):
        return set() if node.op == "exists" and not node.arg else {node.path[: i + 1] for i in range(len(node.path))}
    if isinstance(node, Group) and node.parts:
        sets = [required(p) for p in node.parts]
        return set.union(*sets) if node.op == "and" else set.intersection(*sets) if node.op == "or" else set()
    return set()


def ranges(node) -> dict[tuple[str, ...], Range]:
    """Bounds that hold for every match; only conditions joined by "and" narrow them."""
    out: dict[tuple[str, ...], Range] = {}
    todo = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, Group) and n.op == "and":
            todo += n.parts
        elif isinstance(n, Test) and not n.negated and n.op in ("eq", "lt", "lte", "gt", "gte"):
            out.setdefault(n.path, Range()).narrow(n.op, n.arg)
        elif isinstance(n, Test) and not n.negated and n.op == "beginsWith":
            r = out.setdefault(n.path, Range())
            r.narrow("gte", n.arg)
            r.narrow("lt", n.arg + LAST)
    return out


def _clauses(selector: dict) -> set[str]:
    parts = selector.get("$and", []) + [{k: v} for k, v in selector.items() if k != "$and"] if isinstance(selector.get("$and", []), list) else [selector]
    return {json.dumps(p, sort_keys=True) for p in parts}


def choose(node, selector: dict, indexes: tuple[IndexDef, ...], sort: list[str], use: str | None = None) -> tuple[IndexDef | None, dict[str, str]]:
    """The best usable index, and why others are not usable."""
    if isinstance(node, Every):
        node = Group("and", ())
    bounds, must, rejected, best = ranges(node), required(node), {}, None
    for i in indexes:
        if use and use not in (i.name, i.ddoc, i.ddoc.removeprefix("_design/")):
            continue
        paths = [parse_field(f) for f in i.fields]
        fixed = [p in bounds and bounds[p].single() for p in paths]
        prefix = next((k for k, f in enumerate(fixed) if not f), len(fixed))
        starts = range(prefix + 1)
        if i.partial != "{}" and not _clauses(json.loads(i.partial)) <= _clauses(selector):
            rejected[i.name] = "partial filter isn't implied"
        elif i.kind == "spatial" and (sort or not any(p in bounds for p in paths)):
            rejected[i.name] = "no bounds on the box" if not sort else "a box gives no order"
        elif i.kind != "spatial" and not all(p in must or f in sort or f in ("_id", "_rev") for p, f in zip(paths, i.fields)):
            rejected[i.name] = "a field of the index isn't required"
        elif sort and i.kind != "spatial" and not any(list(i.fields[k : k + len(sort)]) == sort for k in starts):
            rejected[i.name] = "it doesn't give the order"
        elif any(p in bounds and bounds[p].empty() for p in paths):
            rejected[i.name] = "a range is empty"
        else:
            narrowed = next((k for k, p in enumerate(paths) if p not in bounds), len(paths))
            score = (i.kind == "spatial", prefix, narrowed, -len(paths), i.materialized is not None)
            if best is None or score > best[0]:
                best = (score, i)
    return (best[1] if best else None), rejected
