"""One pass over a source file that tells code from strings and comments, and the tree of its matching brackets.

Every token is looked at once, so the time is linear in the file's length whatever it holds.  What the parsers of
``grammars`` read are code tokens; a comment gives none, and a string, a character or a template is one token.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_QUOTED = r"""\"(?:[^"\\\n]|\\.)*+"?"""
_TICKED = r"'(?:[^'\\\n]|\\.)*+'?"
#: Strings and characters of a language; one that does not end at its line's end ends there, others at the file's end.
STRINGS = {
    "java": rf'"""(?:[^\\]|\\.)*?(?:"""|\Z)|{_QUOTED}|{_TICKED}',
    "csharp": rf'\$*(?P<raw>"{{3,}}).*?(?:(?P=raw)|\Z)|(?:@\$|\$@|@)"(?:[^"]|"")*+(?:"|\Z)|\$?{_QUOTED}|{_TICKED}',
    "go": rf"`[^`]*(?:`|\Z)|{_QUOTED}|{_TICKED}",
    "rust": r"""[bc]?r(?P<raw>\#*)".*?(?:"(?P=raw)|\Z)|[bc]?"(?:[^"\\]|\\.)*+(?:"|\Z)|b?'(?:\\(?:u\{[^}\n]{0,8}\}|.)|[^\\'\n])'""",
    "typescript": rf"{_QUOTED}|{_TICKED}",
}
#: More that is no code: directives of C#, lifetimes of Rust.
SKIPPED = {"csharp": r"|\#(?!\[)[^\n]*", "rust": r"|'\w+"}


def _tokens(language: str) -> re.Pattern:
    return re.compile(rf"\s*(?:(?P<skip>\Z|//[^\n]*{SKIPPED.get(language, '')})|(?P<comment>/\*)|(?P<string>{STRINGS[language]})|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"
                      rf"|(?P<number>\d(?:\w|\.(?=\d))*)|(?P<op>=>|->|::|.))", re.DOTALL)


TOKENS = {language: _tokens(language) for language in STRINGS}
TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{|\Z)", re.DOTALL)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*")
#: A slash after one of these begins a regular expression.
BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ < > => return typeof case in of delete void do else".split())
KINDS = {"string": "s", "raw": "s", "word": "w", "number": "n"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, ")]}"


class Lexed:
    """kind: ``w`` word, ``s`` string, ``n`` number, else the sign itself.  mate: the other bracket of a pair, -1 without one."""

    def __init__(self, source: str, language: str):
        self.source, self.kind, self.start, self.end, self.mate = source, [], [], [], []
        self.lines = [m.start() for m in re.finditer("\n", source)]
        nested = language == "rust"
        pattern, script, size = TOKENS[language], language == "typescript", len(source)
        open_, waiting, no_regex = [], dict.fromkeys(")]}", 0), -1
        kinds, starts, ends, mates = self.kind, self.start, self.end, self.mate
        found = pattern.finditer(source)
        while m := next(found, None):
            what = m.lastgroup
            if what == "skip":
                continue
            a, at = m.start(what), m.end()
            if what == "comment":
                found = pattern.finditer(source, self._comment(a, nested))
                continue
            kind = KINDS.get(what) or source[a:at]
            if script and kind == "`":
                at, kind = self._template(at)
                found = pattern.finditer(source, at)
            elif script and kind == "/" and a >= no_regex and (not kinds or self.text(len(kinds) - 1) in BEFORE_REGEX):
                if literal := REGEX.match(source, a):
                    at, kind = literal.end(), "r"
                    found = pattern.finditer(source, at)
                else:  # no slash of this line ends one
                    no_regex = source.find("\n", a) if source.find("\n", a) >= 0 else size
            place = len(kinds)
            kinds.append(kind)
            starts.append(a)
            ends.append(at)
            mates.append(-1)
            if kind in OPEN:
                open_.append(place)
                waiting[OPEN[kind]] += 1
            elif kind in CLOSE and waiting.get(kind):
                while True:  # brackets that are open within the pair have no mate
                    other = open_.pop()
                    waiting[OPEN[kinds[other]]] -= 1
                    if OPEN[kinds[other]] == kind:
                        break
                mates[other], mates[place] = place, other
                if kinds[other] == "${":
                    at, rest = self._template(at)
                    found = pattern.finditer(source, at)
                    if rest == "${":  # the next hole of the same template
                        kinds.append(rest)
                        starts.append(ends[-1])
                        ends.append(at)
                        mates.append(-1)
                        open_.append(place + 1)
                        waiting["}"] += 1

    def _comment(self, at: int, nested: bool) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/" if nested else r"\*/").finditer(self.source, at if nested else at + 2):
            depth += 1 if m[0] == "/*" else -1
            if depth <= 0:
                return m.end()
        return len(self.source)

    def _template(self, at: int) -> tuple[int, str]:
        """The end of a piece of a template, and whether a hole begins there or the template ends."""
        m = TEMPLATE.match(self.source, at)
        return m.end(), "${" if m[1] == "${" else "s"

    def __len__(self) -> int:
        return len(self.kind)

    def text(self, k: int) -> str:
        return self.source[self.start[k] : self.end[k]]

    def is_word(self, k: int, *words: str) -> bool:
        return 0 <= k < len(self.kind) and self.kind[k] == "w" and (not words or self.text(k) in words)

    def string(self, k: int) -> str | None:
        """What a string token holds, as it is written; none for another token."""
        if not (0 <= k < len(self.kind) and self.kind[k] == "s"):
            return None
        t = self.text(k).lstrip("@$brc#")
        n = len(t) - len(t.lstrip(t[:1])) if t[:3] in ('"""', "'''") else 1
        return t.rstrip("#")[n:].removesuffix(t[:1] * n)

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def first_line(self, k: int) -> int:
        return self.line(self.start[k])

    def last_line(self, k: int) -> int:
        return self.line(self.end[min(k, len(self.kind) - 1)] - 1)

    def head(self, k: int) -> str:
        """The rest of the line at a token, trimmed."""
        return self.source[self.start[k] : self.start[k] + 400].split("\n", 1)[0].strip()[:200]

    def after(self, k: int) -> int:
        """The token after a token, or after the pair that it opens."""
        return (self.mate[k] if self.mate[k] > k else k) + 1

    def children(self, a: int, b: int) -> Iterator[int]:
        """Tokens from a to b (exclusive), without what is inside pairs of brackets."""
        while a < b:
            yield a
            a = self.after(a)

    def inside(self, k: int) -> Iterator[int]:
        """Tokens directly inside the pair that token k opens; none if it has no mate."""
        return self.children(k + 1, self.mate[k]) if self.mate[k] > k else iter(())

    def members(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(first, end, block) of the declarations between a and b: each ends with a semicolon or its block (-1 without one)."""
        first, value = a, False
        for k in self.children(a, b):
            kind = self.kind[k]
            if kind == ";" or (kind == "{" and self.mate[k] > k and not value):
                yield first, self.after(k), k if kind == "{" else -1
                first, value = self.after(k), False
            elif kind in ("=", "=>"):
                value = value or not self.is_word(k - 1, "operator")
        if first < b:
            yield first, b, -1
