"""Settings from a small YAML or JSON file at any path that Spark reads, checked against a dataclass."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from typing import Any, TypeVar, get_args, get_origin, get_type_hints

from pyspark.sql import SparkSession

T = TypeVar("T")


def parse(text: str) -> dict:
    """The mapping that a JSON or YAML text holds; an empty text holds none."""
    try:
        found = json.loads(text) if text.strip() else {}
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError:
            raise ValueError("the settings aren't JSON, and YAML can't be read here") from None
        found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError("settings are a mapping of names to values")
    return found


def build(kind: type[T], values: dict, at: str = "") -> T:
    """``kind`` (a dataclass) from a mapping. Sections are dataclasses; what is left out keeps its default.

    Unknown names, missing ones without a default and values of another type are errors that name their place.
    """
    if not isinstance(values, dict):
        raise ValueError(f"{at or 'settings'}: a mapping is expected, not {values!r}")
    kinds = get_type_hints(kind)
    if unknown := sorted(map(str, set(values) - set(kinds))):
        raise ValueError(f"{at or 'settings'}: unknown {', '.join(unknown)}; known are {', '.join(kinds)}")
    given = {name: _value(kinds[name], v, f"{at}.{name}" if at else name) for name, v in values.items()}
    try:
        return kind(**given)
    except TypeError:
        required = [f.name for f in fields(kind) if f.name not in given and f.default is f.default_factory]
        raise ValueError(f"{at or 'settings'}: missing {', '.join(required)}") from None


def _value(kind: Any, value: Any, at: str) -> Any:
    if is_dataclass(kind):
        return build(kind, value, at)
    if get_origin(kind) is tuple:
        if not isinstance(value, list | tuple):
            raise ValueError(f"{at}: a list is expected, not {value!r}")
        return tuple(_value(get_args(kind)[0], v, f"{at}[{i}]") for i, v in enumerate(value))
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise ValueError(f"{at}: {kind.__name__} is expected, not {value!r}")
    return value


def read_config(spark: SparkSession, path: str, kind: type[T], given: dict[str, Any] | None = None) -> T:
    """``kind`` from the file at ``path``; ``given`` values that aren't None win over the file's."""
    row = spark.read.text(path, wholetext=True).first()
    return build(kind, parse(row[0] if row else "") | {k: v for k, v in (given or {}).items() if v is not None})
