"""Policies: who sees which column masked how, and which rows."""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations
from typing import NamedTuple

import yaml

from wardstone.errors import Code, GovernanceError
from wardstone.functions.masks import MASKS


class ColumnKey(NamedTuple):
    """Lower-case parts; tuple order breaks ties."""

    catalog: str
    schema: str
    table: str
    column: str


@dataclass(frozen=True)
class Subject:
    user: str
    groups: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Selector:
    """Users and groups that an item is for; "*" among the groups is everyone."""

    users: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()

    def specificity(self, subject: Subject) -> int:
        """3 for the user, 2 for a group, 1 for everyone, 0 for no match."""
        if subject.user in self.users:
            return 3
        if set(self.groups) & subject.groups - {"*"}:
            return 2
        return int("*" in self.groups or "*" in self.users)


@dataclass(frozen=True)
class Resource:
    catalog: str = "*"
    schema: str = "*"
    table: str = "*"
    column: str | None = None
    inherit_on_copy: bool = False

    def covers(self, *parts: str) -> bool:
        own = (self.catalog, self.schema, self.table, *([self.column or "*"] if len(parts) == 4 else []))
        return all(glob_match(p, v) for p, v in zip(own, parts, strict=True))


@dataclass(frozen=True)
class Item:
    """A mask (udf and arguments) or a row filter (condition) for a selector."""

    selector: Selector
    udf: str | None = None
    arguments: tuple[object, ...] = ()
    condition: str | None = None


@dataclass(frozen=True)
class Policy:
    name: str
    resources: tuple[Resource, ...]
    items: tuple[Item, ...]
    kind: str = "mask"
    enabled: bool = True
    priority: int = 0

    def best(self, subject: Subject) -> Item | None:
        """The most specific item; of equals the first."""
        ranked = [(i.selector.specificity(subject), -k, i) for k, i in enumerate(self.items)]
        top = max(ranked, key=lambda r: r[:2], default=(0, 0, None))
        return top[2] if top[0] else None


def glob_match(pattern: str, value: str) -> bool:
    """Only * is special; both sides in lower case."""
    return re.fullmatch(".*".join(map(re.escape, pattern.lower().split("*"))), value.lower(), re.S) is not None


@dataclass
class PolicyIndex:
    """Decisions over enabled policies by priority, highest first, then in the order given."""

    policies: list[Policy]
    ordered: list[Policy] = field(init=False)

    def __post_init__(self):
        self.ordered = sorted((p for p in self.policies if p.enabled), key=lambda p: -p.priority)

    def mask(self, subject: Subject, key: ColumnKey) -> tuple[Policy, Item] | None:
        """The first policy whose resource matches and that has an item for the subject."""
        for policy in self.ordered:
            if policy.kind == "mask" and any(r.covers(*key) for r in policy.resources) and (item := policy.best(subject)):
                return policy, item
        return None

    def filters(self, subject: Subject, table: tuple[str, str, str]) -> list[str]:
        """Conditions of all matching policies; they hold together."""
        found = [p.best(subject) for p in self.ordered if p.kind == "filter" and any(r.covers(*table) for r in p.resources)]
        return [i.condition for i in found if i]

    def covering(self, key: ColumnKey) -> list[Policy]:
        """All masks of a column, whoever they are for."""
        return [p for p in self.ordered if p.kind == "mask" and any(r.covers(*key) for r in p.resources)]

    def inherits(self, key: ColumnKey) -> bool:
        return any(r.inherit_on_copy and r.covers(*key) for p in self.ordered for r in p.resources)

    def effective(self, subject: Subject, columns: Iterable[ColumnKey]) -> tuple[dict[ColumnKey, Item], dict[tuple, str]]:
        """Masks by column and combined filters by table for one subject; of equal priority the first name decides."""
        columns = list(columns)
        named = PolicyIndex(sorted(self.policies, key=lambda p: p.name))
        masks = {c: d[1] for c in columns if (d := named.mask(subject, c))}
        tables = dict.fromkeys(c[:3] for c in columns)
        return masks, {t: " AND ".join(f"({c})" for c in conditions) for t in tables if (conditions := named.filters(subject, t))}


class _Unique(yaml.SafeLoader):
    """Rejects repeated keys."""


def _mapping(loader: _Unique, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for k, v in node.value:
        key = loader.construct_object(k, deep=True)
        if key in out:
            raise GovernanceError(Code.CONFIG_ERROR, f"line {k.start_mark.line + 1}: key {key!r} occurs twice")
        out[key] = loader.construct_object(v, deep=True)
    return out


_Unique.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def parse_yaml(text: str) -> dict:
    try:
        return yaml.load(text, _Unique) or {}
    except yaml.YAMLError as e:
        raise GovernanceError(Code.CONFIG_ERROR, str(e)) from e


def _need(ok: bool, path: str, what: str) -> None:
    if not ok:
        raise GovernanceError(Code.CONFIG_ERROR, f"{path}: {what}")


def _item(raw: dict, path: str, mask: bool) -> Item:
    _need(isinstance(raw, dict), path, "a mapping is needed")
    selector = Selector(tuple(raw.get("users") or ()), tuple(raw.get("groups") or ()))
    _need(bool(selector.users or selector.groups), path, "users or groups are needed")
    if not mask:
        _need(isinstance(raw.get("condition"), str) and raw["condition"].strip() != "", f"{path}.condition", "text is needed")
        return Item(selector, condition=raw["condition"])
    _need(isinstance(raw.get("udf"), str), f"{path}.udf", "a name is needed")
    arguments = tuple(raw.get("arguments") or ())
    _need(all(isinstance(a, (str, int, float, bool)) for a in arguments), f"{path}.arguments", "only text, numbers and booleans")
    return Item(selector, raw["udf"], arguments)


def load_policies(text: str) -> list[Policy]:
    """Policies from YAML; a column may be one name, a list of names or *."""
    whole = parse_yaml(text)
    _need(not set(whole) & {"columns", "rowFilters"}, "policies", "a list of policies stands alone, without columns and rowFilters")
    root = whole.get("policies") or []
    _need(isinstance(root, list), "policies", "a list is needed")
    out, names = [], set()
    for i, raw in enumerate(root):
        path = f"policies[{i}]"
        _need(isinstance(raw, dict) and isinstance(raw.get("name"), str), f"{path}.name", "text is needed")
        _need(raw["name"] not in names, f"{path}.name", f"{raw['name']!r} occurs twice")
        names.add(raw["name"])
        _need(isinstance(raw.get("enabled", True), bool), f"{path}.enabled", "a boolean is needed")
        _need(isinstance(raw.get("priority", 0), int), f"{path}.priority", "an integer is needed")
        mask = "dataMaskItems" in raw
        _need(mask != ("rowFilterItems" in raw), path, "exactly one of dataMaskItems and rowFilterItems")
        resources = []
        for j, r in enumerate(raw.get("resources") or []):
            columns = r.get("column")
            _need(mask == (columns is not None), f"{path}.resources[{j}].column", "masks have columns, row filters none")
            for c in columns if isinstance(columns, list) else [columns]:
                parts = [str(r.get(k, "*")).lower() for k in ("catalog", "schema", "table")]
                resources.append(Resource(*parts, c.lower() if c else None, bool(r.get("inheritOnCopy", False))))
        _need(bool(resources), f"{path}.resources", "at least one is needed")
        kind = "dataMaskItems" if mask else "rowFilterItems"
        items = tuple(_item(x, f"{path}.{kind}[{k}]", mask) for k, x in enumerate(raw[kind] or []))
        out.append(Policy(raw["name"], tuple(resources), items, "mask" if mask else "filter", raw.get("enabled", True), raw.get("priority", 0)))
    return out


def dump_policies(policies: list[Policy]) -> str:
    """The inverse of ``load_policies``."""
    out = []
    for p in policies:
        items = [
            {k: v for k, v in {"users": [*i.selector.users], "groups": [*i.selector.groups], "udf": i.udf, "arguments": [*i.arguments], "condition": i.condition}.items() if v}
            for i in p.items
        ]
        resources = [
            {"catalog": r.catalog, "schema": r.schema, "table": r.table} | ({"column": r.column} if r.column else {}) | ({"inheritOnCopy": True} if r.inherit_on_copy else {})
            for r in p.resources
        ]
        out.append({"name": p.name, "enabled": p.enabled, "priority": p.priority, "resources": resources, "dataMaskItems" if p.kind == "mask" else "rowFilterItems": items})
    return yaml.safe_dump({"policies": out}, sort_keys=False, allow_unicode=True)


def merge_policies(stored: list[Policy], given: list[Policy]) -> tuple[list[Policy], dict[str, list[str]]]:
    """Import as update-or-create by name: what is stored then, and which names were created, updated or alike."""
    old = {p.name: p for p in stored}
    report: dict[str, list[str]] = {"created": [], "updated": [], "unchanged": []}
    for p in given:
        report["created" if p.name not in old else "unchanged" if old[p.name] == p else "updated"].append(p.name)
        old[p.name] = p
    return list(old.values()), report


def load_legacy(text: str) -> list[Policy]:
    """Masks under ``policies``, bound under ``columns``, and ``rowFilters``: policies of priority 0 for everyone."""
    root = parse_yaml(text)
    _need(isinstance(root.get("policies") or {}, dict), "policies", "a list of policies is not read with columns and rowFilters")
    everyone, out = Selector(groups=("*",)), []
    for column, name in (root.get("columns") or {}).items():
        parts = column.lower().split(".")
        _need(len(parts) == 4, f"columns.{column}", "four parts are needed")
        mask = (root.get("policies") or {}).get(name)
        _need(mask is not None, f"columns.{column}", f"no policy {name!r}")
        out.append(Policy(f"{name}@{column}", (Resource(*parts),), (Item(everyone, mask["udf"], tuple(mask.get("arguments") or ())),)))
    for table, condition in (root.get("rowFilters") or {}).items():
        parts = table.lower().split(".")
        _need(len(parts) == 3, f"rowFilters.{table}", "three parts are needed")
        out.append(Policy(f"filter@{table}", (Resource(*parts),), (Item(everyone, condition=condition),), "filter"))
    return out


def _check_arguments(name: str, item: Item) -> None:
    """The number and the types of a mask's arguments, after its function's own parameters."""
    want = list(inspect.signature(MASKS[item.udf]).parameters.values())[1:]
    _need(len(item.arguments) <= len(want), name, f"{item.udf} takes {len(want)} arguments at the most, not {len(item.arguments)}")
    for value, p in zip(item.arguments, want, strict=False):
        _need(type(value) is type(p.default), name, f"{item.udf}: {p.name} is {type(p.default).__name__}, not {value!r}")
        _need(not isinstance(value, int) or value >= 0, name, f"{item.udf}: {p.name} is negative")
    _need(item.udf != "mask_hash" or all(a in ("sha256", "md5") for a in item.arguments), name, "mask_hash knows sha256 and md5")


def validate(policies: list[Policy], columns: Iterable[ColumnKey], masks: Iterable[str] = MASKS) -> None:
    """Every resource meets a declared table or column, every mask is known, and no two masks of equal
    priority for one column name the same subject."""
    columns, masks = set(columns), set(masks)
    for p in policies:
        for r in p.resources:
            hit = any(r.covers(*(c if p.kind == "mask" else c[:3])) for c in columns)
            _need(hit, p.name, f"no declared {'column' if p.kind == 'mask' else 'table'} matches {r.catalog}.{r.schema}.{r.table}.{r.column or '*'}")
        for i in p.items:
            _need(p.kind == "filter" or i.udf in masks, p.name, f"no masking function {i.udf!r}")
            if i.udf in MASKS:
                _check_arguments(p.name, i)
    live = [p for p in policies if p.enabled and p.kind == "mask"]
    for a, b in combinations(live, 2):
        if a.priority == b.priority and any(any(r.covers(*c) for r in a.resources) and any(r.covers(*c) for r in b.resources) for c in columns):
            both = [{*(("u", u) for i in p.items for u in i.selector.users), *(("g", g) for i in p.items for g in i.selector.groups)} for p in (a, b)]
            _need(not both[0] & both[1], a.name, f"same priority, column and subject as {b.name}")
