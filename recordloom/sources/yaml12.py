"""YAML 1.2 text to JSON text, for use inside a task."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

try:
    import yaml
except ImportError:  # pragma: no cover - YAML files then fail with a message
    yaml = None


@lru_cache(maxsize=1)
def _loader():
    """PyYAML reads YAML 1.1; this loader has the 1.2 core scalars (``no``,
    ``on``, ``12:30`` and dates are strings, ``010`` is ten) and refuses a key
    that occurs twice."""

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {}
    # The YAML 1.2 core schema.
    for tag, pattern, first in (
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
        ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", list("-+0123456789")),
        (
            "float",
            r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?"
            r"|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)",
            list("-+.0123456789"),
        ),
        ("merge", r"<<", ["<"]),
    ):
        Loader.add_implicit_resolver(
            f"tag:yaml.org,2002:{tag}", re.compile(f"^(?:{pattern})$"), first
        )

    def whole(loader, node):
        text = node.value
        return int(text, 0) if text[:2] in ("0o", "0x") else int(text, 10)

    def mapping(loader, node):
        seen = set()
        for key_node, _ in node.value:
            key = loader.construct_object(key_node, deep=True)
            if key in seen:
                raise yaml.constructor.ConstructorError(
                    None, None, f"found duplicate key {key!r}", key_node.start_mark
                )
            seen.add(key)
        yield from yaml.SafeLoader.construct_yaml_map(loader, node)

    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


def load(text: str):
    """The value of one YAML 1.2 document."""
    if yaml is None:
        raise ValueError("PyYAML is not installed")
    return yaml.load(text, Loader=_loader())


def to_json(text: str) -> tuple[str | None, str | None]:
    """``(json, problem)`` of one YAML document with a mapping at its root."""
    try:
        value = load(unicodedata.normalize("NFC", text))
        if value is None:
            return "{}", None
        if not isinstance(value, dict):
            return None, f"expected a mapping at the root, got {type(value).__name__}"
        return json.dumps(_plain(value), ensure_ascii=False, allow_nan=False), None
    except Exception as error:  # noqa: BLE001 - any bad file becomes a diagnostic
        return None, getattr(error, "problem", None) or str(error)


def _plain(value):
    """Keys as text; nulls are absent, as everywhere in the data model."""
    if isinstance(value, dict):
        return {_key(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _key(key) -> str:
    return key if isinstance(key, str) else str(key)
