"""Settings: nested dictionaries, overrides by dotted keys, names put in from a mapping, and named choices."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from copy import deepcopy


def merged(base: dict, over: Mapping) -> dict:
    """`base` with the members of `over` put in at every depth; neither is changed."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def overridden(base: dict, arguments: list[str]) -> dict:
    """`base` with `a.b.c=value` arguments put in; a value that reads as a literal is one, else text."""
    out = deepcopy(base)
    for a in arguments:
        path, _, raw = a.partition("=")
        try:
            value = ast.literal_eval(raw)
        except (SyntaxError, ValueError):
            value = raw
        at = out
        *heads, last = path.lstrip("-").split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = value
    return out


def expanded(value, names: Mapping[str, str]):
    """`value` with ${NAME} replaced at every depth; an unknown name is an error."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: names[m[1]], value)
    if isinstance(value, Mapping):
        return {k: expanded(v, names) for k, v in value.items()}
    return [expanded(v, names) for v in value] if isinstance(value, list) else value


class Named(dict):
    """Choices by name: losses, evaluators, models; asking for one that is not there names those that are."""

    def add(self, name: str) -> Callable:
        def put(f: Callable) -> Callable:
            self[name] = f
            return f

        return put

    def __missing__(self, name: str):
        raise KeyError(f"{name!r} is none of {sorted(self)}")
