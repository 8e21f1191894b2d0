"""JSON in text columns: values in prose, facts, bounded copies, schema checks, cleaning. Each works on one text at a time, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import HOME_PATH, MASK, OPEN_NAMES, SECRET_NAMES, SECRET_PARTS, SECRET_VALUES

_DECODER = json.JSONDecoder()
_FENCED = re.compile(r"```(?:json)?(.*?)```", re.S | re.I)
_OPENING = re.compile(r"[\[{]")


def _as_text(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True)


def over_texts(name: str, one: Callable[[str], Any], kind: T.DataType) -> Callable[..., Column]:
    """A column function from one of a single text; a null text gives null."""

    @F.pandas_udf(kind)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else one(t)).astype(object)

    run.__name__ = name
    return run


def _values(text: str) -> Iterator[Any]:
    """What a text is as JSON, and then what can be read from each of its brackets."""
    try:
        yield json.loads(text)
    except (ValueError, RecursionError):
        for m in _OPENING.finditer(text):
            try:
                yield _DECODER.raw_decode(text, m.start())[0]
            except (ValueError, RecursionError):
                continue


def value_in(text: str) -> str | None:
    """The first JSON value: of the first fenced block, else of the whole text. Each counts as a value if it is one whole, a bare scalar too, else from its first bracket that can be read."""
    fence = _FENCED.search(text)
    for part in ([fence[1]] if fence else []) + [text]:
        for found in _values(part.strip()):
            return _as_text(found)
    return None


def facts_in(text: str) -> list[str]:
    """The facts of a JSON list: texts, and the fact, content or text of objects; all else is left out. No list, no facts."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return []
    out = []
    for x in found if isinstance(found, list) else []:
        if isinstance(x, dict):
            x = next((x[k] for k in ("fact", "content", "text") if x.get(k)), None)
        if isinstance(x, str) and x.strip():
            out.append(x.strip())
    return out


def problems_of(arguments: str, schema: dict) -> list[str]:
    """What is wrong with a call's arguments by their schema, by path: missing ones, and values of another type."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
    out: list[tuple[str, str]] = []

    def look(value: Any, rule: dict, path: str) -> None:
        wanted = rule.get("type")
        if wanted:
            names = wanted if isinstance(wanted, list) else [wanted]
            fine = any(isinstance(value, kinds.get(n, object)) and not (isinstance(value, bool) and n in ("integer", "number")) for n in names)
            if not fine:
                out.append((path, f"{path or '.'}: not {' or '.join(names)}"))
                return
        if isinstance(value, dict):
            out.extend((f"{path}.{k}".lstrip("."), f"{path}.{k}: missing".lstrip(".")) for k in rule.get("required", []) if k not in value)
            for k, r in rule.get("properties", {}).items():
                if k in value:
                    look(value[k], r, f"{path}.{k}".lstrip("."))
        elif isinstance(value, list) and isinstance(rule.get("items"), dict):
            for k, v in enumerate(value):
                look(v, rule["items"], f"{path}[{k}]")

    try:
        look(json.loads(arguments), schema, "")
    except (ValueError, RecursionError):
        return [".: no JSON"]
    return [message for _, message in sorted(out)]


def schema_problems(arguments: Column, schema: dict) -> Column:
    return over_texts("schema_problems", lambda t: problems_of(t, schema), T.ArrayType(T.StringType()))(arguments)


def bounded(text: str, most_bytes: int = 65536, most_depth: int = 32, most_nodes: int = 4096) -> str:
    """A JSON text without keys that begin with an underscore; {"truncated": true} where it is over a limit, or is no JSON. The value itself is at depth 0."""
    left = most_nodes

    def copied(x: Any, depth: int) -> Any:
        nonlocal left
        left -= 1
        if left < 0 or depth > most_depth:
            raise OverflowError
        if isinstance(x, dict):
            return {k: copied(v, depth + 1) for k, v in x.items() if not k.startswith("_")}
        return [copied(v, depth + 1) for v in x] if isinstance(x, list) else x

    try:
        out = _as_text(copied(json.loads(text), 0))
    except (ValueError, RecursionError, OverflowError):
        return '{"truncated": true}'
    return out if len(out.encode()) <= most_bytes else '{"truncated": true}'


def bounded_copy(text: Column, most_bytes: int = 65536, most_depth: int = 32, most_nodes: int = 4096) -> Column:
    return over_texts("bounded_copy", lambda t: bounded(t, most_bytes, most_depth, most_nodes), T.StringType())(text)


_VALUES, _HOME = [re.compile(p) for p in SECRET_VALUES], re.compile(HOME_PATH)


def _masked(text: str) -> str:
    for p in _VALUES:
        text = p.sub(MASK, text)
    return _HOME.sub(rf"\1{MASK}", text)


def cleaned(text: str, most: int = 4000) -> str:
    """A JSON text with the values of secret keys hidden at every level and all other texts masked and clipped; a text that is no JSON is masked and clipped itself."""

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            out = {}
            for k, v in x.items():
                low = k.lower()
                secret = low in SECRET_NAMES or any(p in low for p in SECRET_PARTS)
                out[k if k in OPEN_NAMES else _masked(k)] = v if k in OPEN_NAMES else MASK if secret else clean(v)
            return out
        if isinstance(x, list):
            return [clean(v) for v in x]
        if not isinstance(x, str):
            return x
        x = _masked(x)
        return x if len(x) <= most else f"{x[:most]}…(+{len(x) - most})"

    try:
        return _as_text(clean(json.loads(text)))
    except (ValueError, RecursionError):
        return clean(text)


first_json = over_texts("first_json", value_in, T.StringType())
fact_list = over_texts("fact_list", facts_in, T.ArrayType(T.StringType()))
clean_json = over_texts("clean_json", cleaned, T.StringType())


def clamped_step(step: Column, n_steps: Column) -> Column:
    """A step that a diagnosis names, or null if the run has no such step."""
    return F.when(step.between(0, n_steps - 1), step)
