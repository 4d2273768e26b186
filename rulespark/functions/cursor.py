"""A reading position in a rule text, shared by the parsers."""

from __future__ import annotations

import re
from collections.abc import Iterator


class RuleError(ValueError):
    """A rule that can't be compiled. tree: what is wrong, as JSON-like data; kind: json (no JSON), node (a part that no rule may have), syntax (a text that
    can't be parsed), value or object (a value rule or a relation, with all its faults), fields or items (of parts, by name)."""

    def __init__(self, tree, kind: str = "syntax", parts: list[tuple[str, RuleError]] = ()):
        super().__init__(str(tree))
        self.tree, self.kind, self.parts = tree, kind, list(parts)

    def faults(self, path: str = "$") -> Iterator[tuple[str, str, str]]:
        """All faults as (path, kind, detail), in the rule's order."""
        if self.parts:
            for name, e in self.parts:
                yield from e.faults(path + (name if name == "[]" else f".{name}"))
        elif isinstance(self.tree, dict):
            yield from ((path, self.kind, str(x)) for x in self.tree["result"])
        else:
            yield path, self.kind, str(self.tree)


class Cursor:
    def __init__(self, text: str, blanks: str = r"[ \r\n\t]*"):
        self.text, self.at, self._blanks = text, 0, re.compile(blanks)

    def blanks(self) -> None:
        self.at = self._blanks.match(self.text, self.at).end()

    def take(self, token: str) -> bool:
        if self.text.startswith(token, self.at):
            self.at += len(token)
            return True
        return False

    def word(self, token: str) -> bool:
        """Takes a token with blanks around it."""
        was = self.at
        self.blanks()
        if self.take(token):
            self.blanks()
            return True
        self.at = was
        return False

    def match(self, pattern: str) -> re.Match | None:
        m = re.compile(pattern, re.S).match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def need(self, ok) -> None:
        if not ok:
            raise RuleError(f"syntax error :: {self.text}")

    def done(self) -> bool:
        self.blanks()
        return self.at == len(self.text)
