"""Script sources: a lexer that blanks what is not code, and the symbols, calls and imports in what is left.

The lexer keeps a stack, as templates hold code that holds templates. What it gives back is as long as the text, so every place in it is a place in the text; braces, branches and calls in strings, comments and patterns are gone.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

from graphlake.config import LIMITS
from graphlake.functions import rules

MARK = re.compile(r"[\"'`/{}]")
STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\[\s\S])*{q}?") for q in "\"'"}
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
PATTERN = re.compile(r"/(?![*/])((?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/[a-z]*")
OPENER = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|await|yield|instanceof))\s*\Z")
NAME = r"[A-Za-z_$][\w$]*"
TYPED = re.compile(rf"(?<![\w$.])(?:(?:export|default|abstract|declare)\s+)*(class|interface)\s+({NAME})")
FUNCTION = re.compile(rf"(?<![\w$.])(?:(?:export|default|declare|async)\s+)*function\s*\*?\s*({NAME})\s*(?:<[^(]*>\s*)?(?=\()")
BOUND = re.compile(rf"(?<![\w$.])(export\s+)?(?:const|let|var)\s+({NAME})\s*(?::[^=;]*)?=\s*(?=[\w$(<])(?!=)")
ARROW = re.compile(rf"(?:async\s+)?(?:<[^(]*>\s*)?(?:{NAME}(?=\s*=>)|(?=\())")
ARROW_OF = re.compile(r"\s*(?::[^;]*?)?=>")
METHOD = re.compile(rf"(?<![\w$.#])(?:(?:public|private|protected|static|async|readonly|override)\s+)*\*?\s*({NAME})\s*(?:<[^()]*>\s*)?(?=\()")
CALL = re.compile(rf"(?<![\w$])({NAME})\s*(?:<[\w\s,.\[\]|]*>\s*)?(?:\?\.\s*)?(?=\()")
IMPORT = re.compile(r"(?<![\w$.])import\s+(?:type\s+(?![,=]))?([^'\"();]*?)\s*\bfrom\s*(['\"])")
BRANCHES = re.compile(r"(?<![\w$.])(?:if|for|while|catch|case)\b(?!\s*:)|&&|\|\||(?<!\?)\?(?![.?]|\s*[:,)=;])")
#: Words before a parenthesis that are neither called nor declared.
WORDS = rules.NO_METHODS | {"import", "async", "constructor", "do", "else", "case", "throw", "delete", "void", "yield", "with", "class", "extends", "instanceof"}
#: What a declared function or class never follows, an expression may.
EXPRESSION = re.compile(r"(?:[(,=:\[!&|?+\-*%~^]|=>|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|await|yield|instanceof))\s*\Z")
QUOTED = re.compile(r"(?<![\w$.])(?:return|case|typeof|in|of|from|import|default|else|await|yield|throw|as|extends)\Z")
LEAD, NEXT = re.compile(r"\s*"), re.compile(r"\s*(\S?)")


class Source:
    """A text and its code; comments (start, end) and pattern literals (start, pattern) by place."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.patterns: list[tuple[int, str]] = []
        self.code = "".join(self._lexed())
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.ends: dict[int, int] = {}
        opened = []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            if m[0] in "([{":
                opened.append(m.start())
            elif opened:
                self.ends[opened.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def _lexed(self) -> Iterator[str]:
        text, at, depth, templates, before = self.text, 0, 0, [], ""
        blank = lambda a, b: re.sub(r"[^\n]", " ", text[a:b])
        while m := MARK.search(text, at):
            start, c = m.start(), m[0]
            plain = text[at:start]
            yield plain
            before = plain[-40:] if plain.strip() else before
            end = start + 1
            if c == "}" and templates and templates[-1] == depth:
                templates.pop()
                yield " "
                end = yield from self._template(end, templates, depth, blank)
            elif c in "{}":
                depth += 1 if c == "{" else -1
                yield c
            elif c == "`":
                yield c
                end = yield from self._template(end, templates, depth, blank)
            elif c in "\"'" and (text[start - 1 : start].isalnum() and not QUOTED.search(text[max(0, start - 12) : start])):
                yield " "  # an apostrophe in text between tags
            elif c in "\"'":
                end = STRING[c].match(text, start).end()
                yield c + blank(start + 1, end - 1) + (text[end - 1] if end - start > 1 else "")
            elif text[start : start + 2] in ("//", "/*"):
                close = text.find("\n" if text[start + 1] == "/" else "*/", start + 2)
                end = len(text) if close < 0 else close + (0 if text[start + 1] == "/" else 2)
                self.comments.append((start, end))
                yield blank(start, end)
                at = end
                continue  # a comment is nothing that a pattern could follow
            elif text[start - 1 : start] != "<" and OPENER.search(before) and (p := PATTERN.match(text, start)):
                end = p.end()
                self.patterns.append((start, p[1]))
                yield "/" + blank(start + 1, end - 1) + "/"
                c = '"'
            else:
                yield c
            before = c
            at = end
        yield text[at:]

    def _template(self, at: int, templates: list[int], depth: int, blank) -> Iterator[str]:  # noqa: ANN001
        """The rest of a template, or of it what stands before code."""
        end = TEMPLATE.match(self.text, at).end()
        yield blank(at, end)
        if self.text[end : end + 2] == "${":
            templates.append(depth)
            yield "  "
            return end + 2
        yield self.text[end : end + 1]
        return end + 1

    def doc(self, at: int) -> str | None:
        """What the last comment says that stands right before a place, on a line after the code before it."""
        k = bisect.bisect_left(self.comments, (at, at)) - 1
        if k < 0 or self.code[self.comments[k][1] : at].strip():
            return None
        start, end = self.comments[k]
        gap = self.code[:start]
        if gap.strip() and "\n" not in gap[len(gap.rstrip()) :]:
            return None
        return re.sub(rules.REMARK_MARKS, "", self.text[start:end].strip(), flags=re.M).strip()[: LIMITS.doc_chars]

    def body(self, at: int) -> tuple[int | None, int]:
        """(where the body opens, where the declaration ends) after a list of parameters."""
        code, wants_type, n = self.code, False, len(self.code)
        while at < n:
            c = code[at]
            if c == "{" and not wants_type:
                return at, self.ends.get(at, n - 1)
            if c in "([{":
                at, wants_type = self.ends.get(at, n - 1), False
            elif c == ";" or (c == "\n" and not wants_type and NEXT.match(code, at)[1] not in tuple("{:|&=")):
                return None, at
            elif not c.isspace():
                wants_type = c in ":|&,<" or code[at - 1 : at + 1] == "=>"  # a type follows, so a brace would not be the body
            at += 1
        return None, n - 1

    def expression_end(self, at: int) -> int:
        code, last = self.code, at
        while at < len(code):
            c = code[at]
            if c in ";,)]}":
                break
            if c == "\n" and code[last] not in "=>+-*/&|?:,.(" and NEXT.match(code, at)[1] not in tuple(".?:&|+-*/=<>"):
                break
            if c in "([{":
                at = self.ends.get(at, len(code) - 1)
            if not code[at].isspace():
                last = at
            at += 1
        return last


def _signature(text: str, at: int) -> str:
    return re.split(r"[\n{]", text[at : at + rules.HEAD_CHARS])[0].strip()


def _complexity(code: str) -> int:
    """1 and one for each branch; a do-loop counts by its while."""
    return 1 + len(BRANCHES.findall(code))


def script(text: str) -> tuple[list[dict], list[dict], list[dict]]:
    """(symbols, imports, calls) of a script: classes, interfaces, declared functions, methods with a body, arrow functions that a variable is bound to."""
    s, found = Source(text), []
    code, react = s.code, "react" in text
    declares = lambda at: not EXPRESSION.search(code[max(0, at - 200) : at])
    spans: list[tuple[int, int, str, str]] = []

    def add(at: int, end: int, name: str, kind: str, exported: bool, doc_at: int) -> None:
        typed = kind in ("class", "interface")
        kind = "component" if kind == "function" and react and "A" <= name[0] <= "Z" else kind
        found.append((at, {"name": name, "kind": kind, "line": s.line(at), "end_line": s.line(end), "signature": _signature(text, at), "doc": s.doc(doc_at), "exported": exported, "container": None, "complexity": None if typed else _complexity(code[at : end + 1])}))

    for m in TYPED.finditer(code):
        opens = code.find("{", m.end())
        if declares(m.start()) and opens >= 0:
            end = s.ends.get(opens, len(code) - 1)
            spans.append((opens, end, m[2], m[1]))
            add(m.start(), end, m[2], m[1], "export" in m[0].split(), m.start())
    taken = set()
    for m in FUNCTION.finditer(code):
        taken.add(m.start(1))
        if declares(m.start()):
            _, end = s.body(s.ends.get(m.end(), m.end()) + 1)
            add(m.start(), end, m[1], "function", "export" in m[0].split(), m.start())
    for m in BOUND.finditer(code):
        at = m.end()
        a = ARROW.match(code, at)
        if a and code[a.end() : a.end() + 1] == "(":
            close = s.ends.get(a.end(), len(code))
            after = ARROW_OF.match(code, close + 1)
        else:
            after = ARROW_OF.match(code, a.end()) if a else None
        if after:
            opens = LEAD.match(code, after.end()).end()
            end = s.ends.get(opens, len(code) - 1) if code[opens : opens + 1] == "{" else s.expression_end(opens)
            add(at, end, m[2], "function", bool(m[1]), at)
    bodies = sorted((opens, end) for opens, end, *_ in spans)
    for m in METHOD.finditer(code):
        if m[1] in WORDS or m.start(1) in taken or re.search(r"(?<![\w$.])(?:get|set|new|function)\s*\*?\s*\Z", code[max(0, m.start() - 20) : m.start()]):
            continue
        close = s.ends.get(m.end())
        if close is None:
            continue
        around = max((a for a, end in bodies if a < m.start() < end), default=None)
        inside = around is not None and code.count("{", around + 1, m.start()) == code.count("}", around + 1, m.start())
        opens = s.body(close + 1)[0] if inside else LEAD.match(code, close + 1).end()
        if opens is not None and code[opens : opens + 1] == "{":
            taken.add(m.start(1))
            add(m.start() + len(m[0]) - len(m[0].lstrip()), s.ends.get(opens, len(code) - 1), m[1], "method", False, m.start())
    found.sort(key=lambda f: f[0])
    for at, symbol in found:
        if symbol["kind"] == "method":
            around = [(a, name) for a, end, name, _ in spans if a < at <= end]
            symbol["container"] = max(around)[1] if around else None
    shapes = [(a, end) for a, end, _, kind in spans if kind == "interface"]
    calls = []
    for m in CALL.finditer(code):
        name, at = m[1], m.start(1)
        if name in WORDS or at in taken or any(a < at < end for a, end in shapes) or re.search(r"(?<![\w$.])(?:new\s+[\w$.]*|(?:get|set)\s+)\Z", code[max(0, at - 60) : at]):
            continue
        calls.append({"name": name, "line": s.line(at)})
    return [f for _, f in found], list(_imports(s)), calls


def _imports(s: Source) -> Iterator[dict]:
    """What each import binds; one that binds nothing is none."""
    for m in IMPORT.finditer(s.code):
        path = s.text[m.end() : s.code.find(m[2], m.end())]
        clause = m[1]
        if named := re.search(r"\{([^}]*)\}", clause):
            clause = clause.replace(named[0], "")
        for part in filter(None, map(str.strip, clause.split(","))):
            star = re.fullmatch(rf"\*\s*as\s+({NAME})", part)
            yield {"local": star[1] if star else part, "imported": "*" if star else "default", "path": path}
        for part in filter(None, map(str.strip, named[1].split(",") if named else [])):
            names = re.split(rules.RENAMED, re.sub(r"^type\s+(?!as\b)", "", part))
            yield {"local": names[-1], "imported": names[0], "path": path}
