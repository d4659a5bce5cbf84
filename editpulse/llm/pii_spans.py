"""Spans of personal data in one text: base patterns, loose candidates and their features.

Python workers import this module and no model code, which keeps each of them small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
#: Digits with up to two separators between them, and what may stand before a phone number.
_NUMBER = re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ()./\[\]-]{0,2}[0-9]){5,}")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3,}")
_AT = re.compile(r"[\[({] ?at ?[\])}]| at |@")
_SPOKEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]| dot ) ?[A-Za-z0-9-]+)+")
_PLAIN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_CUES = {
    "email": re.compile(r"mail|contact|write|@"),
    "ip": re.compile(r"\bip\b|host|server|addr|port"),
    "card": re.compile(r"card|visa|master|credit|pay|account"),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax"),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """From each @ outwards, which gives the leftmost matches in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        domain = _DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            done = domain.end()
            yield Span("email", first, done)
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns that pass their checks, by start and kind."""
    spans = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m.group().split("."))):
                spans.append(Span("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                spans.append(Span("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def _numbers(text: str, first: int, last: int) -> Iterator[Span]:
    """The number-like run from ``first`` to ``last`` and its parts between group boundaries."""
    groups = [m.span() for m in _GROUP.finditer(text, first, last)]
    for i, (start, _) in enumerate(groups):
        start = first if i == 0 else start - (text[start - 1] == "(")
        n = 0
        for a, end in groups[i : i + 19]:
            n += end - a
            if n > 19:
                break
            if 7 <= n <= 16:
                yield Span("phone", start, end)
            if 13 <= n:
                yield Span("card", start, end)


def proposed_spans(text: str) -> Iterator[Span]:
    """Overlapping candidates in looser formats than the base patterns."""
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            yield from _numbers(text, m.start(), m.end())
        for m in _QUAD.finditer(text):
            yield Span("ip", m.start(), m.end())
    spelled = "dot" in text
    if "@" in text or "at]" in text or "at)" in text or "at}" in text or spelled:
        for m in _AT.finditer(text):
            domain = _SPOKEN_DOMAIN.match(text, m.end()) if spelled else None
            if domain is None and m.group() != " at ":
                domain = _PLAIN_DOMAIN.match(text, m.end())
            first = last = m.start() - (m.group() != " at " and text[m.start() - 1 : m.start()] == " ")
            while first > 0 and text[first - 1] in _LOCAL:  # never past the mark before, so linear in all
                first -= 1
            if domain and first < last:
                yield Span("email", first, domain.end())


def span_features(kind: str, value: str, before: str, after: str) -> list[float]:
    """Format of a span and its context, as numbers."""
    digits = _digits(value)
    groups = re.findall(r"[0-9]+", value)
    near = before.lower()
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(value)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(value.count(".")), float(value.count("-")), float(value.count(" ")), float("(" in value or "[" in value), float(value.startswith("+")),
        float("@" in value), float(" at " in value or "at)" in value or "at]" in value), float("dot" in value),
        float(sum(c.isalpha() for c in value)), float(len(digits) >= 13 and luhn(digits)), float(octets),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "=:\"'"), float(bool(_CUES[kind].search(near))),
        float(any(p.search(near) for k, p in _CUES.items() if k != kind)), float(before[-1:] == "" or before[-1:] == "\n"),
    ]


def _variants(kind: str, value: str) -> Iterator[str]:
    """Looser spellings of a value that is surely personal data, as further positive examples."""
    if kind == "phone":
        digits = _digits(value)
        yield value[1:].strip()
        yield f"00{digits}"
        yield f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}"
        yield ".".join((digits[-10:-7], digits[-7:-4], digits[-4:]))
    elif kind == "card":
        digits = _digits(value)
        yield ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    elif kind == "ip":
        yield value.replace(".", "[.]")
    else:
        local, _, domain = value.partition("@")
        yield f"{local} at {domain.replace('.', ' dot ')}"
        yield f"{local} [at] {domain}"
        yield f"{local}(at){domain.replace('.', '(dot)')}"


CANDIDATE, BASE, VARIANT = 0, 1, 2


def candidates(text: str, base: list[Span]) -> list[dict]:
    """Proposals that overlap no base span, the base spans as examples and variants of these."""
    taken = sorted((s.start, s.end) for s in base)
    out = []

    def add(span: Span, value: str, role: int) -> None:
        context = text[max(0, span.start - CONTEXT) : span.start], text[span.end : span.end + 4]
        out.append({"kind": span.kind, "start": span.start, "end": span.end, "role": role, "f": span_features(span.kind, value, *context)})

    k = 0
    for span in sorted(set(proposed_spans(text)), key=lambda s: s.start):
        while k < len(taken) and taken[k][1] <= span.start:
            k += 1
        if all(a >= span.end or b <= span.start for a, b in taken[k : k + 8]):
            add(span, text[span.start : span.end], CANDIDATE)
    for span in base:
        value = text[span.start : span.end]
        add(span, value, BASE)
        for variant in _variants(span.kind, value):
            add(span, variant, VARIANT)
    return out
