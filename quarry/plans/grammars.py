"""Routes and functions of TypeScript, Java, C#, Go and Rust files, read from code tokens within their bracket tree.

Nothing is read from comments or strings; every class has its own prefix; all walks are over direct children of a pair
of brackets, so each token is visited a bounded number of times and the time is linear.
"""

from __future__ import annotations

import re

from quarry.plans.lexer import Lexed

METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")


def _row(kind, module, qualname, start, end, **more):
    return {"kind": kind, "module": module, "qualname": qualname, "start_line": start, "end_line": end, "is_async": False, "is_public": not qualname.startswith("_"), **more}


def _join(prefix: str, path: str) -> str:
    return "/" + "/".join(x for x in (prefix.strip("/"), path.strip("/")) if x)


class Found:
    """What a file has, with the lines of its tokens."""

    def __init__(self, lx: Lexed, module: str):
        self.lx, self.module, self.rows, self.seen, self._starts = lx, module, [], set(), None

    def start(self, k: int) -> int:
        """The first token of the chain of names, dots and calls that ends with token k."""
        if self._starts is None:
            self._starts = _chain_starts(self.lx)
        return self._starts[k]

    def route(self, method: str, path: str, first: int, last: int, name: str = "", **more) -> None:
        key = (method, path, self.lx.first_line(first))
        if key not in self.seen:
            self.seen.add(key)
            self.rows.append(_row("endpoint", self.module, name, key[2], self.lx.last_line(last), method=method, path=path, **more))

    def function(self, name: str, first: int, last: int, **more) -> None:
        self.rows.append(_row("function", self.module, name, self.lx.first_line(first), self.lx.last_line(last), signature=self.lx.head(first), **more))


def _strings(lx: Lexed, k: int) -> list[str]:
    """The strings that lead the arguments of a call."""
    out = []
    for at in lx.inside(k):
        if lx.kind[at] == ",":
            continue
        if (s := lx.string(at)) is None or lx.kind[at + 1] not in (",", ")"):
            break
        out.append(s)
    return out


def _chain_starts(lx: Lexed) -> list[int]:
    first, unary = [], ("await", "return", "new", "yield", "go", "defer", "else", "throw")
    for k, kind in enumerate(lx.kind):
        at = k
        if kind == "w" and k and lx.kind[k - 1] in (".", "::"):
            at = first[k - 1]
        elif kind in (".", "::") and k and (lx.kind[k - 1] in ("w", "s", ")", "]") or lx.kind[k - 1] == "?"):
            at = first[k - 1]
        elif kind == "?" and k and lx.kind[k - 1] in ("w", ")", "]"):
            at = first[k - 1]
        elif kind in ("(", "[") and k and (lx.kind[k - 1] in (")", "]") or (lx.kind[k - 1] == "w" and not lx.is_word(k - 1, *unary))):
            at = first[k - 1]
        elif kind in (")", "]") and lx.mate[k] >= 0:
            at = first[lx.mate[k]]
        first.append(at)
    return first


def _block(lx: Lexed, k: int, word: str) -> int:
    """The last token of the declaration that goes on at k: its block's end, its semicolon, or what stands before the next such word with a name."""
    for at in lx.children(k, len(lx)):
        if lx.kind[at] == "{" and lx.mate[at] > at:
            return lx.mate[at]
        if lx.kind[at] in (";", "}"):
            return at
        if lx.is_word(at, word) and (lx.is_word(at + 1) or _receiver(lx, at + 1)):
            return at - 1
    return len(lx) - 1


def _receiver(lx: Lexed, k: int) -> bool:
    """Whether a receiver with a name and brackets after it begins at token k."""
    name = lx.after(k) if k < len(lx) and lx.kind[k] == "(" else -1
    return lx.is_word(name) and name + 1 < len(lx) and lx.kind[name + 1] == "("


# --- TypeScript

VERBS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "del": "DELETE"}


def typescript(source: str, rel_path: str, module: str) -> list[dict]:
    lx = Lexed(source, "typescript")
    found, n = Found(lx, module), len(lx)
    bodies = {}  # the opening brace of a class -> its prefix
    for k, kind in enumerate(lx.kind):
        if kind != "w":
            if kind == "{" and k in bodies:
                _nest_members(found, k, bodies[k])
            continue
        word, dotted = lx.text(k), k > 0 and lx.kind[k - 1] == "."
        if dotted and k + 1 < n and lx.kind[k + 1] == "(":
            _script_call(found, k, word.lower() if word not in ("route", "addRoute") else word)
        elif word == "class" and not dotted and (lx.is_word(k + 1) or (k + 1 < n and lx.kind[k + 1] == "{")):
            for at in lx.children(k + 1, n):
                if lx.kind[at] == "{":
                    bodies[at] = _prefix(lx, k)
                if lx.kind[at] in "{;})" or lx.is_word(at, "class"):
                    break
        elif word == "function" and lx.is_word(k + 1) and not dotted:
            _exported(found, k, rel_path)
    return found.rows


def _prefix(lx: Lexed, k: int) -> str:
    """What the Controller decorator before a class has."""
    while lx.is_word(k - 1, "export", "default", "abstract", "declare"):
        k -= 1
    while k > 1:  # decorators, the last first
        name = k - 1
        call = lx.mate[name] if lx.kind[name] == ")" else -1
        name = call - 1 if call >= 0 else name
        if not (lx.is_word(name) and name and lx.kind[name - 1] == "@"):
            break
        if lx.text(name) == "Controller":
            return next(iter(_strings(lx, call)), "") if call >= 0 else ""
        k = name - 1
    return ""


def _nest_members(found: Found, body: int, prefix: str) -> None:
    """Methods of a class with a verb's decorator."""
    lx, verb, path = found.lx, None, ""
    inside = list(lx.inside(body))
    for n, k in enumerate(inside):
        before = inside[n - 1] if n else -1
        if lx.kind[k] == ";":
            verb = None
        elif lx.is_word(k) and before >= 0 and lx.kind[before] == "@":
            if lx.text(k).upper() in METHODS:
                call = k + 1 if k + 1 < len(lx) and lx.kind[k + 1] == "(" else -1
                verb, path = lx.text(k).upper(), next(iter(_strings(lx, call)), "") if call >= 0 else ""
        elif verb and lx.kind[k] == "(" and lx.is_word(before) and lx.kind[inside[n - 2] if n > 1 else body] not in ("@", "."):
            first = before
            while lx.is_word(first - 1, "public", "private", "protected", "static", "async", "override", "readonly"):
                first -= 1
            at = n + 1  # the body, if there is one
            while at < len(inside) and lx.kind[inside[at]] not in (";", "@", "{"):
                at += 1
            body_at = inside[at] if at < len(inside) and lx.kind[inside[at]] == "{" else k
            last = max(lx.mate[body_at], body_at)
            found.route(verb, _join(prefix, path), first, last, lx.text(before))
            verb = None


def _script_call(found: Found, k: int, word: str) -> None:
    lx, call = found.lx, k + 1
    last = lx.mate[call] if lx.mate[call] > call else call
    lead = lx.string(call + 1) if call + 1 < len(lx) else None
    if word in VERBS or word == "all":
        if lead and lead.startswith("/"):
            found.route(VERBS.get(word, "GET"), lead, found.start(k), last)
    elif word in ("route", "addRoute") and call + 1 < len(lx) and lx.kind[call + 1] == "{":
        fields = {}
        for at in lx.inside(call + 1):  # the fields of the object itself
            if lx.is_word(at) and at + 2 < len(lx) and lx.kind[at + 1] == ":" and (value := lx.string(at + 2)) is not None:
                fields.setdefault(lx.text(at).lower(), value)
        method, path = fields.get("method", fields.get("methods", "")).upper(), fields.get("url", fields.get("path", ""))
        if method in METHODS and path.startswith("/"):
            found.route(method, path, found.start(k), last)
    elif word == "route" and lead and lead.startswith("/") and lx.mate[call] == call + 2:
        at = last + 1  # a chain of verbs
        while at + 2 < len(lx) and lx.kind[at] == "." and lx.is_word(at + 1) and lx.kind[at + 2] == "(" and lx.mate[at + 2] > 0:
            if (verb := lx.text(at + 1).lower()) in VERBS:
                found.route(VERBS[verb], lead, found.start(k), lx.mate[at + 2])
            elif verb != "all":
                break
            at = lx.mate[at + 2] + 1


def _exported(found: Found, k: int, rel_path: str) -> None:
    lx, first = found.lx, k
    while lx.is_word(first - 1, "async", "default"):
        first -= 1
    if not lx.is_word(first - 1, "export"):
        return
    name, last = lx.text(k + 1), _block(lx, k + 2, "function")
    if name in METHODS:
        found.route(name, "/" + re.sub(r"^.*?app/|/route\.[jt]sx?$", "", rel_path), first - 1, last, name)
    else:
        found.function(name, first - 1, last, is_async=lx.is_word(k - 1, "async"))


# --- Java and C#

TYPES = ("class", "interface", "record", "enum", "struct")
MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp internal virtual override async sealed readonly extern partial new unsafe".split())


class Header:
    """The head of a declaration: what is noted before it, its words outside angle brackets, and the call brackets after its name."""

    def __init__(self, lx: Lexed, first: int, end: int):
        self.notes, self.words, self.call, self.first, self.prefix = [], [], -1, first, None
        angle, skip = 0, -1
        for k in lx.children(first, end):
            kind = lx.kind[k]
            if k <= skip:
                continue
            if kind == "@" and lx.is_word(k + 1) and not lx.is_word(k + 1, "interface"):
                name = k + 1
                while name + 2 < end and lx.kind[name + 1] == "." and lx.is_word(name + 2):
                    name += 2
                call = name + 1 if name + 1 < end and lx.kind[name + 1] == "(" else -1
                self.notes.append((lx.text(name), call))
                skip = call if call >= 0 else name
            elif kind == "[" and not self.words:
                self.notes += self._attributes(lx, k)
            elif kind in ("<", ">"):
                angle += 1 if kind == "<" else -1
            elif kind == "w" and angle <= 0:
                self.words.append(k)
            elif kind == "(" and self.words and angle <= 0:
                self.call = k
                break
            elif kind in ("{", "=", "=>", ";"):
                break

    @staticmethod
    def _attributes(lx: Lexed, k: int):
        begins = True
        for at in lx.inside(k):
            if begins and lx.is_word(at):
                name = at
                while lx.kind[name + 1] == "." and lx.is_word(name + 2):
                    name += 2
                yield lx.text(name), name + 1 if lx.kind[name + 1] == "(" else -1
            begins = lx.kind[at] == ","

    def type_name(self, lx: Lexed) -> str | None:
        for a, b in zip(self.words, self.words[1:], strict=False):
            if lx.text(a) in TYPES:
                return lx.text(b)
        return None

    def method(self, lx: Lexed) -> str | None:
        """The name of a method: a word before the brackets with a type before it; a constructor is none."""
        plain = [w for w in self.words if lx.text(w) not in MODIFIERS]
        return lx.text(plain[-1]) if self.call >= 0 and len(plain) > 1 and not any(lx.text(w) in (*TYPES, "delegate", "return", "throw", "operator") for w in plain) else None

    def has(self, lx: Lexed, word: str) -> bool:
        return any(lx.text(w) == word for w in self.words)


def _declared(lx: Lexed):
    """(header, block, end, header of the type around it) of every declaration in the types of a file; types come before what they hold."""
    todo = [(0, len(lx), None)]
    while todo:
        a, b, around = todo.pop()
        inner = []
        for first, end, block in lx.members(a, b):
            h = Header(lx, first, block if block >= 0 else end)
            yield h, end, around
            if block >= 0 and (h.type_name(lx) or (around is None and h.has(lx, "namespace"))):
                inner.append((block + 1, lx.mate[block], h if h.type_name(lx) else None))
        todo.extend(reversed(inner))


def _argument(lx: Lexed, call: int, *names: str) -> str:
    """The first string of an annotation's arguments that has no name or one of these, in braces or not."""
    name = ""
    for k in lx.inside(call) if call >= 0 else ():
        if lx.is_word(k) and k + 1 < len(lx) and lx.kind[k + 1] == "=":
            name = lx.text(k)
        elif lx.kind[k] == ",":
            name = ""
        elif name == "" or name in names:
            for at in lx.inside(k) if lx.kind[k] == "{" else (k,):
                if (s := lx.string(at)) is not None:
                    return s
    return ""


def _named(lx: Lexed, call: int, name: str) -> str:
    """The value of a named argument: a string, or the last of a chain of names; the first of a list in braces."""
    for k in lx.inside(call) if call >= 0 else ():
        if lx.is_word(k, name) and lx.kind[k + 1] == "=":
            at = k + 3 if lx.kind[k + 2] == "{" else k + 2
            while lx.is_word(at) and lx.kind[at + 1] in (".", "::") and lx.is_word(at + 2):
                at += 2
            return lx.text(at) if lx.is_word(at) else lx.string(at) or ""
    return ""


def java(source: str, rel_path: str, module: str) -> list[dict]:
    lx = Lexed(source, "java")
    found = Found(lx, module)
    for h, end, around in _declared(lx):
        name = h.method(lx)
        if around is None or name is None or h.type_name(lx):
            continue
        if around.prefix is None:
            around.prefix = next((_argument(lx, c, "value", "path") for n, c in around.notes if n in ("RequestMapping", "Path")), "")
        prefix = around.prefix
        route = None
        for note, call in h.notes:
            if note.endswith("Mapping") and note.removesuffix("Mapping").upper() in METHODS:
                route = note.removesuffix("Mapping").upper(), _argument(lx, call, "value", "path")
            elif note == "RequestMapping":
                method = _named(lx, call, "method").upper()
                route = method if method in METHODS else "GET", _argument(lx, call, "value", "path")
            elif note.upper() in METHODS:
                route = note.upper(), next((_argument(lx, c, "value") for n, c in h.notes if n == "Path"), "")
            if route:
                break
        if route:
            found.route(route[0], _join(prefix, route[1]), h.first, end - 1, name)
        elif h.has(lx, "public"):
            found.function(name, h.first, end - 1)
    return found.rows


def csharp(source: str, rel_path: str, module: str) -> list[dict]:
    lx = Lexed(source, "csharp")
    found = Found(lx, module)
    for h, end, around in _declared(lx):
        name = h.method(lx)
        if around is None or name is None or h.type_name(lx):
            continue
        if around.prefix is None:
            prefix = next((_argument(lx, c, "template") for n, c in around.notes if n == "Route"), "")
            around.prefix = re.sub(r"(?i)\[controller\]", around.type_name(lx).removesuffix("Controller").lower(), prefix)
        prefix = around.prefix
        verb = next(((n[4:].upper(), c) for n, c in h.notes if n.startswith("Http") and n[4:].upper() in METHODS), None)
        if verb:
            found.route(verb[0], _join(prefix, _argument(lx, verb[1], "template")), h.first, end - 1, name)
        elif h.has(lx, "public"):
            found.function(name, h.first, end - 1, is_async=h.has(lx, "async"))
    for k in range(1, len(lx) - 1):
        if lx.kind[k] == "w" and lx.kind[k - 1] == "." and lx.kind[k + 1] == "(" and lx.text(k).startswith("Map") and lx.text(k)[3:].upper() in METHODS:
            if path := lx.string(k + 2):
                found.route(lx.text(k)[3:].upper(), path, found.start(k), lx.mate[k + 1] if lx.mate[k + 1] > 0 else k + 1)
    return found.rows


# --- Go


def go(source: str, rel_path: str, module: str) -> list[dict]:
    lx = Lexed(source, "go")
    found = Found(lx, module)
    handlers, functions = set(), []
    for k in range(len(lx) - 1):
        if lx.kind[k] != "w":
            continue
        word = lx.text(k)
        if word == "func" and (lx.is_word(k + 1) or lx.kind[k + 1] == "("):
            name = k + 1 if lx.is_word(k + 1) else lx.after(k + 1)  # a receiver may stand before the name
            if lx.is_word(name) and lx.text(name)[0].isupper() and name + 1 < len(lx) and lx.kind[name + 1] in ("(", "["):
                functions.append((lx.text(name), k, _block(lx, name + 1, "func")))
        elif lx.kind[k + 1] == "(" and k and (lx.kind[k - 1] == "." or word == "HandleFunc"):
            if (route := _go_route(lx, k, word)) and route[0] in METHODS:
                last = lx.mate[k + 1] if lx.mate[k + 1] > 0 else k + 1
                found.route(route[0], route[1], found.start(k), last, route[2])
                handlers.add(route[2])
    for name, first, last in functions:
        if name not in handlers:
            found.function(name, first, last)
    return found.rows


def _go_route(lx: Lexed, k: int, word: str):
    """(method, path, handler) of a call whose leading strings are a route."""
    call = k + 1
    lead = _strings(lx, call)
    if not lead:
        return None
    args = [at for at in lx.inside(call)]
    names = [at for at in args[2 * len(lead) :] if lx.kind[at] in ("w", ",", "(")]
    handler = ""
    for at in names:
        if lx.kind[at] != "w":
            break
        handler = lx.text(at)
    if handler == "func":
        handler = ""
    if word.upper() in METHODS and word in (word.upper(), word.capitalize()):
        return (word.upper(), lead[0], handler) if lead[0].startswith("/") else None
    if word in ("Handle", "Add") and len(lead) > 1 and lead[0] in METHODS:
        return (lead[0], lead[1], handler) if lead[1].startswith("/") else None
    if word in ("Handle", "HandleFunc"):
        m = re.fullmatch(r"(?:([A-Z]+)\s+)?([^/\s]*)(/\S*)", lead[0].strip())
        if not m:
            return None
        at, chained = lx.after(call), None
        if at + 2 < len(lx) and lx.kind[at] == "." and lx.is_word(at + 1, "Methods") and lx.kind[at + 2] == "(":
            chained = next(iter(_strings(lx, at + 2)), "").upper()
        return m[1] or (chained if chained in METHODS else "GET"), m[3], handler
    return None


# --- Rust


def rust(source: str, rel_path: str, module: str) -> list[dict]:
    lx = Lexed(source, "rust")
    found, used, functions = Found(lx, module), set(), []
    for k in range(len(lx) - 1):
        if lx.kind[k] != "w":
            continue
        word = lx.text(k)
        if word == "fn" and lx.is_word(k + 1):
            first, notes = _rust_head(lx, k)
            route = next((r for note in notes if (r := _rust_route(lx, note))), None)
            words = [lx.text(at) for at in lx.children(first, k) if lx.kind[at] == "w"]
            name, last = lx.text(k + 1), _block(lx, k + 2, "fn")
            if route:
                used.add(name)
                found.route(*route, first, last, name, is_async="async" in words)
            elif "pub" in words:
                functions.append((name, first, last, "async" in words))
        elif word in ("route", "at") and k and lx.kind[k - 1] == "." and lx.kind[k + 1] == "(":
            path = lx.string(k + 2)
            if path and k + 3 < len(lx) and lx.kind[k + 3] == ",":
                for at in lx.inside(k + 1):
                    if lx.is_word(at) and lx.text(at).upper() in METHODS and lx.text(at).islower() and lx.kind[at + 1] == "(":
                        handler = lx.text(at + 2) if lx.is_word(at + 2) else ""
                        used.add(handler)
                        found.route(lx.text(at).upper(), path, found.start(k), lx.mate[k + 1], handler)
    for name, first, last, later in functions:
        if name not in used:
            found.function(name, first, last, is_async=later)
    return found.rows


def _rust_head(lx: Lexed, k: int) -> tuple[int, list[int]]:
    """The first token of a function, and the opening brackets of its attributes in their order."""
    while k:
        if lx.is_word(k - 1, "pub", "async", "unsafe", "const", "extern", "default") or (lx.kind[k - 1] == "s" and lx.is_word(k - 2, "extern")):
            k -= 1
        elif lx.kind[k - 1] == ")" and lx.mate[k - 1] > 0 and lx.is_word(lx.mate[k - 1] - 1, "pub"):
            k = lx.mate[k - 1] - 1
        else:
            break
    notes, at = [], k
    while at > 1 and lx.kind[at - 1] == "]" and (a := lx.mate[at - 1]) > 0 and lx.kind[a - 1] == "#":
        notes.append(a)
        at = a - 1
    return k, notes[::-1]


def _rust_route(lx: Lexed, note: int):
    """(method, path) of an attribute."""
    words = []
    for at in lx.inside(note):
        if lx.is_word(at):
            words.append(lx.text(at).lower())
        elif lx.kind[at] == "(" and words:
            path = next(iter(_strings(lx, at)), None)
            if path is None:
                return None
            if words[-1] == "route":
                method = _named(lx, at, "method").upper()
            elif words[-1].upper() in (*METHODS, "HEAD", "OPTIONS"):
                method = words[-1].upper()
            else:
                return None
            return method if method in METHODS else "GET", path
    return None


PARSERS = {"typescript": typescript, "java": java, "csharp": csharp, "go": go, "rust": rust}
