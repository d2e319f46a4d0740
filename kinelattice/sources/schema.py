"""Typed configurations: dataclasses as schemas, chosen by name, with all errors reported at once.

A schema is a frozen dataclass. Its annotations are checked (text, whole and real numbers, truth values, paths, lists,
tuples and mappings of these, other schemas, None); a field's metadata may name what is allowed (``one_of``, ``between``,
``subset_of``). A registry picks the schema of a section by the value of a key in it or by the section's name, as the
detectors' and frameworks' sections differ by algorithm; a default schema takes what has none of its own.
"""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from kinelattice.sources.config import inherit


class ConfigErrors(ValueError):
    """Everything that is wrong with a configuration; ``errors`` has a line each, with the place."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def _name(kind) -> str:
    return getattr(kind, "__name__", str(kind))


def _value(kind, raw, at: str, errors: list[str]):
    """``raw`` as ``kind``; what doesn't fit is noted."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any:
        return raw
    if origin in (typing.Union, types.UnionType):
        tries = []
        for one in inner:
            own: list[str] = []
            got = _value(one, raw, at, own)
            if not own:
                return got
            tries += own
        errors.append(tries[0] if len(inner) == 2 and type(None) in inner and raw is not None else f"{at}: {raw!r} fits none of {[_name(k) for k in inner]}")
        return None
    if kind is type(None):
        return None if raw is None else errors.append(f"{at}: {raw!r} is not empty")
    if dataclasses.is_dataclass(kind):
        return _fill(kind, raw, at, errors)
    if origin in (list, tuple):
        if not isinstance(raw, (list, tuple)):
            return errors.append(f"{at}: {raw!r} is no list")
        kinds = [inner[0]] * len(raw) if origin is list or inner[-1] is Ellipsis else list(inner)
        if len(kinds) != len(raw):
            return errors.append(f"{at}: {len(raw)} values instead of {len(kinds)}")
        return origin(_value(k, x, f"{at}[{i}]", errors) for i, (k, x) in enumerate(zip(kinds, raw)))
    if origin in (dict, Mapping) or kind is dict:
        if not isinstance(raw, Mapping):
            return errors.append(f"{at}: {raw!r} is no table")
        return {k: _value(inner[1] if inner else Any, x, f"{at}.{k}", errors) for k, x in raw.items()}
    if kind is Path and isinstance(raw, (str, Path)):
        return Path(raw)
    if kind is float and isinstance(raw, int) and not isinstance(raw, bool):
        return float(raw)
    if not isinstance(raw, kind) or (isinstance(raw, bool) and kind is not bool):
        return errors.append(f"{at}: {raw!r} is no {_name(kind)}")
    return raw


def _allowed(rules: Mapping, value, at: str, errors: list[str]) -> None:
    if "one_of" in rules and value not in rules["one_of"]:
        errors.append(f"{at}: {value!r} is none of {sorted(map(str, rules['one_of']))}")
    if "between" in rules and not rules["between"][0] <= value <= rules["between"][1]:
        errors.append(f"{at}: {value!r} is not between {rules['between'][0]} and {rules['between'][1]}")
    if "subset_of" in rules and (wrong := set(value) - set(rules["subset_of"])):
        errors.append(f"{at}: {sorted(map(str, wrong))} are none of {sorted(map(str, rules['subset_of']))}")


def _fill(schema, raw, at: str, errors: list[str]):
    if not isinstance(raw, Mapping):
        return errors.append(f"{at}: {raw!r} is no table")
    hints, values, before = typing.get_type_hints(schema), {}, len(errors)
    fields = {f.name: f for f in dataclasses.fields(schema)}
    place = f"{at}." if at else ""
    if not getattr(schema, "extra", False):
        errors += [f"{place}{k}: unknown" for k in raw if k not in fields]
    for name, f in fields.items():
        if name not in raw:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                errors.append(f"{place}{name}: missing")
            continue
        n = len(errors)
        values[name] = _value(hints[name], raw[name], place + name, errors)
        if len(errors) == n and values[name] is not None:
            _allowed(f.metadata, values[name], place + name, errors)
    return schema(**values) if len(errors) == before else None


def validate(schema: type, raw: Mapping, at: str = ""):
    """An instance of ``schema`` from a table; ConfigErrors with all that is wrong. Unknown keys are errors unless the schema has ``extra = True``."""
    errors: list[str] = []
    got = _fill(schema, raw, at, errors)
    if errors:
        raise ConfigErrors(errors)
    return got


class Registry:
    """Schemas by name. A section's schema is that of its value under ``key`` where it has one, else that of its name."""

    def __init__(self, key: str | None = None, default: type | None = None):
        self.key, self.default, self.schemas = key, default, {}

    def register(self, name: str) -> Callable[[type], type]:
        def add(schema: type) -> type:
            self.schemas[name] = schema
            return schema

        return add

    def schema_of(self, name: str, raw: Mapping) -> type | None:
        chosen = raw.get(self.key, name) if self.key and isinstance(raw, Mapping) else name
        return self.schemas.get(chosen, self.default)

    def parse_into(self, sections: Mapping[str, Mapping], at: str, errors: list[str]) -> dict[str, object]:
        out = {}
        for name, raw in sections.items():
            schema = self.schema_of(name, raw)
            if schema is None:
                errors.append(f"{at}.{name}: no schema; there are {sorted(self.schemas)}")
            else:
                known = {f.name for f in dataclasses.fields(schema)}
                body = {k: v for k, v in raw.items() if k != self.key or k in known} if isinstance(raw, Mapping) else raw
                out[name] = _fill(schema, body, f"{at}.{name}", errors)
        return out


def parse_detectors(config: Mapping, algorithms: Registry, frameworks: Registry) -> tuple[dict[str, object], dict[str, object]]:
    """(algorithms, frameworks) of a detector configuration, each under its own schema; errors of all sections are raised together.

    An algorithm that names a framework has the framework's keys on top of its own.
    """
    errors: list[str] = []
    frames = config.get("frameworks", {})
    own = config.get("algorithms", {})
    named = {n: a for n, a in own.items() if isinstance(a, Mapping) and "framework" in a}
    errors += [f"algorithms.{n}.framework: {a['framework']!r} is none of {sorted(frames)}" for n, a in named.items() if a["framework"] not in frames]
    held = frameworks.parse_into(frames, "frameworks", errors)
    known = {n: inherit(a, {k: dict(v) for k, v in frames.items() if isinstance(v, Mapping)}) if n in named else a for n, a in own.items()}
    made = algorithms.parse_into(known, "algorithms", errors)
    if errors:
        raise ConfigErrors(errors)
    return made, held
