"""Personal identifiers in one text: what the base rules match, and what else has the shape of an identifier.

Every search takes time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import re

EMAIL, IP, CARD, PHONE = range(4)
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The leftmost match within a run of digits begins with the run: from further right the same dot is missing.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_DIGIT = re.compile(r"[0-9]")
_HOST = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9._-]{0,253}[A-Za-z0-9])?")
_AT = re.compile(r" ?[\[({] ?at ?[\])}] ?", re.IGNORECASE)
_SPELT_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}){0,10}", re.IGNORECASE)
_ADDRESS = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|[0-9]{1,5}(?:\.[0-9xX*]{1,5}){3}(?![0-9A-Za-z*]))")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,2}+[0-9])*+")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, past, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        past = domain.end() if domain else at + 1
        at = text.find("@", past)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules' matches in code points, leftmost and non-overlapping for each kind."""
    out = [(EMAIL, *span) for span in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    small = lambda part: len(part) <= 3 and int(part or "0") <= 255
    out += [(IP, *m.span()) for m in _IP.finditer(text) if all(small(part.lstrip("0")) for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:  # 19 digits and 18 separators at most
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _shaped(text: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, kinds) of what looks like an identifier in text[low:high]; kinds has a bit for each kind that it may be."""
    out = []
    at = text.find("@", low, high)
    while at >= 0:
        start = at
        while start > max(low, at - 64) and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1, high)
        if host and start < at:
            out.append((start, host.end(), 1 << EMAIL))
        at = text.find("@", at + 1, high)
    for m in _AT.finditer(text, low, high):
        start = m.start()
        while start > max(low, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        host = _SPELT_HOST.match(text, m.end(), high)
        if host and start < m.start():
            out.append((start, host.end(), 1 << EMAIL))
    out += [(*m.span(), 1 << IP) for m in _ADDRESS.finditer(text, low, high)]
    for m in _NUMBER.finditer(text, low, high):
        if m.end() - m.start() <= 60:
            n = len(_NOT_DIGIT.sub("", m[0]))
            kinds = (7 <= n <= 15) << PHONE | (12 <= n <= 19) << CARD
            if kinds:
                out.append((*m.span(), kinds))
    return out


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds) of non-overlapping strings between the base matches that have the shape of an identifier."""
    if "@" not in text and not _DIGIT.search(text) and not _AT.search(text):
        return []
    found, past = [], 0
    for start, end in sorted((s, e) for _, s, e in base):
        if start > past:
            found += _shaped(text, past, start)
        past = max(past, end)
    found += _shaped(text, past, len(text))
    out, past = [], 0
    for start, end, kinds in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if start >= past:
            out.append((start, end, kinds))
            past = end
    return out


def instance(text: str, kinds: int) -> str:
    """The identifier that a string stands for, whatever its spelling: digits alone, or small letters without spaces."""
    if kinds & (1 << CARD | 1 << PHONE):
        return "#" + _NOT_DIGIT.sub("", text)
    return "".join(text.lower().split())
