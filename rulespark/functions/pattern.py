"""The pattern language: quoted keywords, ~ (in sequence), ! (not), & and |.

Terms: 'kw' (contained), ^'kw' (at the start), 'kw'$ (at the end), ^'kw'$ (all of it) and * (always). ~ binds tightest and takes bare terms
only; ! stands before a term, ( ) or { }, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from .cursor import Cursor, RuleError


@dataclass(frozen=True)
class Term:
    keyword: str
    kind: str  # contain, start, end, exact or always
    positive: bool = True

    def __str__(self) -> str:
        shown = {"contain": "{}", "start": "^{}", "end": "{}$", "exact": "^{}$", "always": "*"}[self.kind].format(self.keyword)
        return shown if self.positive else "!" + shown


@dataclass(frozen=True)
class Group:
    kind: str  # & | ~
    parts: tuple
    positive: bool = True

    def __str__(self) -> str:
        return ("" if self.positive else "!") + "(" + f" {self.kind} ".join(map(str, self.parts)) + ")"


def terms(rule) -> Iterator[Term]:
    if isinstance(rule, Term):
        yield rule
    else:
        for p in rule.parts:
            yield from terms(p)


def parse(text: str) -> Term | Group:
    c = Cursor(text)
    c.blanks()
    rule = _any(c)
    c.need(c.done())
    return rule


def _joined(c: Cursor, sign: str, inner) -> Term | Group:
    parts = [inner(c)]
    while c.word(sign):
        parts.append(inner(c))
    return parts[0] if len(parts) == 1 else Group(sign, tuple(parts))


def _any(c: Cursor):
    return _joined(c, "|", _all)


def _all(c: Cursor):
    return _joined(c, "&", _token)


def _token(c: Cursor):
    if c.take("!"):
        c.blanks()
        inner = _closed(c) or _term(c)
        c.need(inner)
        return replace(inner, positive=not inner.positive)
    if inner := _closed(c):
        return inner
    return _joined(c, "~", _bare)


def _closed(c: Cursor):
    for opening, closing in ("()", "{}"):
        if c.take(opening):
            c.blanks()
            inner = _any(c)
            c.blanks()
            c.need(c.take(closing))
            return inner
    return None


def _bare(c: Cursor) -> Term:
    term = _term(c)
    c.need(term)
    return term


def _term(c: Cursor) -> Term | None:
    if c.take("*"):
        return Term("", "always")
    m = c.match(r"(\^?)'((?:\\'|[^'])+)'(\$?)")
    if not m:
        return None
    kind = {("", ""): "contain", ("^", ""): "start", ("", "$"): "end", ("^", "$"): "exact"}[m[1], m[3]]
    return Term(m[2], kind)


def compile_rules(rules, ignore_invalid: bool = False) -> dict[int, Term | Group]:
    """rules: a mapping or pairs of id and text. Invalid rules raise a RuleError with {id: text}, or are left out."""
    pairs = list(rules.items() if hasattr(rules, "items") else rules)
    out, bad = {}, {}
    for rule_id, text in pairs:
        try:
            rule = parse(text)
        except RuleError:
            bad[rule_id] = text
            continue
        if rule_id in out:
            raise ValueError(f"duplicate rule id {rule_id}")
        out[rule_id] = rule
    if bad and not ignore_invalid:
        raise RuleError(bad)
    return out
