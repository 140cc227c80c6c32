"""Typed literals: a value's Python type and one canonical spelling, so that True is not 1 and [1] is not (1,)."""

from __future__ import annotations

import ast
import json
import math
import re
from json.encoder import encode_basestring
from typing import Any

MAX_CHARS, MAX_NODES, MAX_DEPTH = 4096, 128, 8
WHOLE_NUMBER = re.compile(r"0|[1-9][0-9]{0,17}")
BARE_TOKEN = re.compile(r"(?![+-])[\w./:@+-]+", re.ASCII)
PARSE_FAULTS = (ValueError, TypeError, SyntaxError, RecursionError, MemoryError)

Literal = dict[str, str]


def _tagged(value: Any, room: int) -> list:
    if room < 0:
        raise ValueError("nested too deeply")
    kind = type(value)
    if value is None or kind in (bool, int, str) or (kind is float and math.isfinite(value)):
        return [kind.__name__, value]
    text = lambda x: json.dumps(x, ensure_ascii=False)
    if kind in (list, tuple):
        return [kind.__name__, [_tagged(v, room - 1) for v in value]]
    if kind is set:
        return ["set", sorted((_tagged(v, room - 1) for v in value), key=text)]
    if kind is dict:
        pairs = [[_tagged(k, room - 1), _tagged(v, room - 1)] for k, v in value.items()]
        return ["dict", sorted(pairs, key=lambda p: text(p[0]))]
    raise ValueError(f"no literal: {kind.__name__}")


def encode_literal(value: Any) -> Literal | None:
    """{type, canonical} of a literal value; None for what has no such form (bytes, complex, infinities, ...)."""
    try:
        if type(value) is int:
            return {"type": "int", "canonical": f'["int",{value}]'}
        if type(value) is str:
            return {"type": "str", "canonical": f'["str",{encode_basestring(value)}]'}
        return {"type": type(value).__name__, "canonical": json.dumps(_tagged(value, MAX_DEPTH), ensure_ascii=False, separators=(",", ":"))}
    except PARSE_FAULTS:
        return None


def parse_literal(source: str) -> Literal | None:
    """The literal that an expression spells; None if it isn't one or is too long."""
    if len(source) > MAX_CHARS:
        return None
    try:
        tree = ast.parse(source, mode="eval")
        small = len(list(ast.walk(tree))) <= MAX_NODES
        return encode_literal(ast.literal_eval(tree)) if small else None
    except PARSE_FAULTS:
        return None


def documented_literal(raw: str) -> Literal | None:
    """As parse_literal; besides, a bare word such as utf-8 or ./cache is a string, the way documents write them."""
    if WHOLE_NUMBER.fullmatch(raw):
        return encode_literal(int(raw))
    found = parse_literal(raw)
    if found is None and BARE_TOKEN.fullmatch(raw) and "+" not in raw:
        return encode_literal(raw)
    return found
