"""Configuration files: TOML with placeholders, contexts, calibration and segment lists. All of it is driver-side."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Mapping
from contextlib import contextmanager
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"<([A-Za-z_][A-Za-z0-9_]*)>")
PASSES = 5


def load_toml(path: str | Path) -> dict:
    path = Path(path)
    if path.suffix != ".toml":
        raise ValueError(f"{path} is no .toml file")
    with path.open("rb") as f:
        return tomllib.load(f)


def load_json(path: str | Path) -> dict:
    path = Path(path)
    if path.suffix != ".json":
        raise ValueError(f"{path} is no .json file")
    return json.loads(path.read_text())


def latest_config(folder: str | Path) -> Path:
    """The last ``config_*.toml`` by name."""
    found = sorted(Path(folder).glob("config_*.toml"))
    if not found:
        raise FileNotFoundError(f"no config_*.toml in {folder}")
    return found[-1]


def placeholders(value) -> set[str]:
    """Names of all placeholders in a value: a string, or nested dicts and lists of strings."""
    if isinstance(value, str):
        return set(_NAME.findall(value))
    if isinstance(value, Mapping):
        return set().union(*map(placeholders, value.values()), *map(placeholders, value))
    if isinstance(value, (list, tuple)):
        return set().union(*map(placeholders, value))
    return set()


def substitute(value, names: Mapping[str, object]):
    """A copy of ``value`` with the known placeholders filled in; the others stay."""
    if isinstance(value, str):
        return _NAME.sub(lambda m: str(names[m[1]]) if m[1] in names else m[0], value)
    if isinstance(value, Mapping):
        return {substitute(k, names): substitute(v, names) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(substitute(v, names) for v in value)
    return value


def merge(*contexts: Mapping[str, object]) -> dict:
    """One context of several; a name with two values is a KeyError."""
    out: dict = {}
    for c in contexts:
        for k, v in c.items():
            if k in out and out[k] != v:
                raise KeyError(f"{k} has the values {out[k]!r} and {v!r}")
            out[k] = v
    return out


def resolve(config: Mapping, context: Mapping[str, object] | None = None, runtime: frozenset[str] = frozenset()) -> dict:
    """Fill placeholders from the config's own top-level scalars and ``context``, chained over at most five passes.

    Names in ``runtime`` may stay open. Another open name, or one that still changes after the last pass (a cycle), is a
    ValueError. The input is not changed.
    """
    own = {k: v for k, v in config.items() if isinstance(v, (str, int, float, bool))}
    for k, v in own.items():
        if isinstance(v, str) and k in _NAME.findall(v):
            raise ValueError(f"{k} refers to itself")
    out = dict(config)
    for _ in range(PASSES):
        names = merge(context or {}, {k: v for k, v in out.items() if k in own})
        filled = substitute(out, names)
        if filled == out:
            break
        out = filled
    else:
        if substitute(out, merge(context or {}, {k: v for k, v in out.items() if k in own})) != out:
            raise ValueError("placeholders refer to each other in a circle")
    if left := placeholders(out) - runtime:
        raise ValueError(f"placeholders without a value: {sorted(left)}")
    return out


class ConfigLoader:
    """Contexts in three layers: automatic and global names are fixed early, runtime names may stay open until used."""

    def __init__(self, auto: Mapping[str, object], runtime: set[str]):
        self.context = dict(auto)
        self.runtime = frozenset(runtime)

    def extend_global_ctx(self, names: Mapping[str, object]) -> None:
        self.context = merge(self.context, names)

    def load_config(self, path: str | Path, schema: Callable[..., object] | None = None, ignore_auto_and_global: bool = False):
        raw = load_toml(path)
        filled = raw if ignore_auto_and_global else resolve(raw, self.context, self.runtime)
        return schema(**filled) if schema else filled

    def resolve(self, config: Mapping, runtime_ctx: Mapping[str, object] | None = None) -> dict:
        return resolve(config, merge(self.context, runtime_ctx or {}), frozenset() if runtime_ctx is not None else self.runtime)


def inherit(algorithm: Mapping, frameworks: Mapping[str, Mapping]) -> dict:
    """An algorithm's settings with those of its framework on top."""
    return {**algorithm, **frameworks.get(algorithm.get("framework", ""), {})}


def upstream(name: str, inputs: Mapping[str, list[str]]) -> list[str]:
    """All that ``name`` depends on, each before what needs it; a cycle is a ValueError."""
    done: list[str] = []
    path: list[str] = []

    def visit(x: str) -> None:
        if x in path:
            raise ValueError(f"circular dependency: {' -> '.join([*path, x])}")
        if x not in done:
            path.append(x)
            for y in inputs.get(x, []):
                visit(y)
            path.pop()
            done.append(x)

    visit(name)
    return done[:-1]


class Scope(Enum):
    """What a failure stops: everything, the video, or the detector."""

    STRICT = "strict"
    VIDEO = "video"
    DETECTOR = "detector"


@contextmanager
def error_scope(scope: Scope, failures: list[str], what: str):
    """Failures inside are raised (STRICT) or noted. Plans are lazy: run the action inside the scope."""
    try:
        yield
    except Exception as e:
        if scope is Scope.STRICT:
            raise
        failures.append(f"{scope.value} {what}: {type(e).__name__}: {e}")


def snapshot(config: Mapping, path: str | Path) -> Path:
    """Save the configuration in force as JSON."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(config, indent=2, sort_keys=True, default=str))
    return path


def one_of(value, options, name: str = "value"):
    if value not in options:
        raise ValueError(f"{name} is {value!r}; allowed are {sorted(map(str, options))}")
    return value


def between(value: float, low: float, high: float, name: str = "value") -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; allowed are {low} to {high}")
    return value


def segments(spark: SparkSession, path: str) -> DataFrame:
    """A CSV segment list: file, start, end."""
    return spark.read.schema("file string, start double, end double").option("header", True).csv(path)
