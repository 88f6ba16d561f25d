"""A JSON contract compiled into one walk over a document.

A contract is built from small checks: ``text``, ``choice``, ``whole``, ``amount``, ``each`` and
``record``. Every check is a function of (value, path, errors) that appends ``path: kind`` for what
it finds. Numbers are kept as their own text, so an amount is judged by the digits that were sent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

Check = Callable[[object, str, list], None]

#: Errors of one document that are reported.
REPORTED = 10

_WHOLE = re.compile(r"[ \t\n\v\f\r]*[+-]?[0-9]+(\.0*)?[ \t\n\v\f\r]*")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,9})?")
_BLANK = "".join(map(chr, range(33)))
#: Amounts are decimals of 28 digits before the point and 10 after it.
_LEAST, _BEYOND = Decimal("5e-11"), Decimal("1e28")
_WHOLE_BEYOND = Decimal("1e26")


class Number(str):
    """A JSON number as it was written."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _distinct(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key is given twice")
    return found


_DECODER = json.JSONDecoder(
    parse_int=Number, parse_float=Number, parse_constant=_no_constant, object_pairs_hook=_distinct
)


def is_text(value: object) -> bool:
    return type(value) is str


def text(nullable: bool = False, non_empty: bool = False) -> Check:
    def check(value, path, errors):
        if value is None and nullable:
            return
        if not is_text(value):
            errors.append(f"{path}: not_text")
        elif non_empty and not value:
            errors.append(f"{path}: empty")

    return check


def choice(options) -> Check:
    listed = frozenset(options)

    def check(value, path, errors):
        if not (is_text(value) and value in listed):
            errors.append(f"{path}: not_in_vocabulary")

    return check


def _decimal(value: object) -> Decimal | None:
    """The value of a number, or of a text that spells one."""
    if not isinstance(value, str):
        return None
    spelled = value.strip(_BLANK)
    try:
        return Decimal(spelled) if _NUMBER.fullmatch(spelled) else None
    except InvalidOperation:
        return None


def _whole(value: object) -> Decimal | None:
    if isinstance(value, bool):
        return Decimal(value)
    if is_text(value) and not _WHOLE.fullmatch(value):
        return None
    number = _decimal(value)
    if number is None or abs(number) >= _WHOLE_BEYOND or number.adjusted() < -400:
        return None
    return number if number == number.to_integral_value() else None


def whole(kind: str, least: int | None = None, nullable: bool = False) -> Check:
    """An integer, also as a number with an empty fraction, a numeric text or a boolean."""

    def check(value, path, errors):
        if value is None and nullable:
            return
        number = _whole(value)
        if number is None or (least is not None and number < least):
            errors.append(f"{path}: {kind}")

    return check


def amount() -> Check:
    def check(value, path, errors):
        number = _decimal(value)
        if number is None or not _LEAST <= number < _BEYOND:
            errors.append(f"{path}: not_a_positive_number")

    return check


def not_empty_list(value, path, errors) -> None:
    if isinstance(value, list) and not value:
        errors.append(f"{path}: empty")


def each(item: Check) -> Check:
    """A list whose items pass ``item``; the walk ends once enough errors are known."""

    def check(value, path, errors):
        if not isinstance(value, list):
            errors.append(f"{path}: not_a_list")
            return
        for at, one in enumerate(value):
            if len(errors) >= REPORTED:
                return
            item(one, f"{path}.{at}", errors)

    return check


def optional(check: Check) -> Check:
    def given(value, path, errors):
        if value is not None:
            check(value, path, errors)

    return given


def record(allowed, required, *checks: tuple[str, Check]) -> Check:
    """An object of the ``allowed`` keys; ``checks`` are run in order on the keys that are there."""
    known, needed = frozenset(allowed), tuple(required)

    def check(value, path, errors):
        if not isinstance(value, dict):
            errors.append(f"{path}: not_an_object")
            return
        if not value.keys() <= known:
            errors.append(f"{path}: unknown_key")
        for key in needed:
            if key not in value:
                errors.append(f"{path}.{key}: missing")
        for key, inner in checks:
            if key in value:
                inner(value[key], f"{path}.{key}", errors)

    return check


def document(key: str, item: Check) -> Callable[[str | None], list[str]]:
    """The errors of a text that must be an object of one non-empty list under ``key``.

    No text, text that is no JSON, a key given twice and nesting beyond the decoder's depth are
    ``malformed``.
    """
    items = each(item)

    def errors_of(raw: str | None) -> list[str]:
        if raw is None:
            return ["$: malformed"]
        try:
            value = _DECODER.decode(raw)
        except (ValueError, RecursionError):
            return ["$: malformed"]
        if not isinstance(value, dict):
            return ["$: not_an_object"]
        errors: list[str] = []
        if not value.keys() <= {key}:
            errors.append("$: unknown_key")
        if key not in value:
            errors.append(f"{key}: missing")
        else:
            not_empty_list(value[key], key, errors)
            items(value[key], key, errors)
        return errors[:REPORTED]

    return errors_of
