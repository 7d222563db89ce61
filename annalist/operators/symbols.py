"""Symbols of source files: declarations, members, line ranges and signatures of twenty languages, and what Go files claim about relations.

Python goes through its own parser.  The other languages are scanned: comments and strings are blanked out (places stay), each line outside
the body of an earlier declaration is tried against the language's rules, and a body ends where its brace or its ``end`` closes.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

SCHEMA = "path string, entity_type string, name string, qualified_name string, receiver string, start_line int, end_line int, signature string, package_path string, language string"
CLAIMS = "path string, package_path string, relationship_type string, from_name string, to_name string, line int"

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|synchronized|native|default|new|unsafe|extern)\b\s*)*"
_TYPED = _MODS + r"(?!(?:public|private|protected|internal|static|return|new|else|throw|await|case)\b)(?:<[^>\n]*>[ \t]*)?[\w.<>\[\],?&: \t]*[\w>\]?][ \t]+(\w+)[ \t]*(?:<[^>\n]*>)?(?=\()"
_NOTES = r"[ \t]*(?:@\w+(?:\([^)\n]*\))?\s+)*"
_WORDS = r"(?:(?:public|private|protected|internal|fileprivate|open|final|override|static|class|mutating|inline|suspend|operator|abstract|implicit|lazy|tailrec|infix|async|external)\s+)*"

#: For each language: (pattern of a declaration at the start of a line, entity, opening of its signature).  Group 1 is the name.
GRAMMAR = {
    "typescript": [(r"[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "struct", "class "), (r"[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)", "interface", "interface "), (r"[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function", "function ")],
    "rust": [(r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct", "struct "), (r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "interface", "trait "), (r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", "function", "fn "), (r"[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{;]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?:[\w]+::)*(\w+)", "impl", "")],
    "java": [(_NOTES + _MODS + r"(?:class|enum|record)\s+(\w+)", "struct", "class "), (_NOTES + _MODS + r"interface\s+(\w+)", "interface", "interface ")],
    "csharp": [(r"[ \t]*" + _MODS + r"(class|struct|record)\s+(?P<name>\w+)", "struct", "{0}_declaration "), (r"[ \t]*" + _MODS + r"interface\s+(\w+)", "interface", "interface ")],
    "ruby": [(r"[ \t]*class\s+([A-Z][\w:]*)", "struct", "class "), (r"[ \t]*module\s+([\w:]+)", "package", "module "), (r"[ \t]*def\s+(?!self\.)([\w?!=]+)", "function", "def ")],
    "kotlin": [(r"[ \t]*(?:(?:public|private|internal|open|abstract|sealed|data|enum|inner|annotation)\s+)*(?:class|object)\s+(\w+)", "struct", "class "), (r"[ \t]*(?:(?:public|private|internal|sealed|fun)\s+)*interface\s+(\w+)", "interface", "interface "), (r"[ \t]*" + _WORDS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(\w+)", "function", "fun ")],
    "swift": [(r"[ \t]*(?:(?:public|private|internal|open|final|indirect)\s+)*(?:class(?!\s+(?:func|var)\b)|struct|enum|actor)\s+(\w+)", "struct", "class "), (r"[ \t]*(?:(?:public|private|internal)\s+)*protocol\s+(\w+)", "interface", "protocol "), (r"[ \t]*" + _WORDS + r"func\s+(\w+)", "function", "func ")],
    "php": [(r"[ \t]*(?:(?:final|abstract|readonly)\s+)*class\s+(\w+)", "struct", "class "), (r"[ \t]*interface\s+(\w+)", "interface", "interface "), (r"[ \t]*function\s+&?(\w+)", "function", "function ")],
    "cpp": [(r"[ \t]*(?:template\s*<[^>]*>\s*)?(class|struct)\s+(?P<name>\w+)(?=[^;(){]*\{)", "struct", "{0} "), (r"[ \t]*(?!(?:if|for|while|switch|return|else|do|catch)\b)(?:[\w:<>&*~, \t]*[:<>&* \t])?([\w~]++)[ \t]*\([^;{}]*\)[^;{}()]*\{", "function", "")],
    "c": [(r"[ \t]*(?:typedef\s+)?struct\s+(\w+)\s*(?=\{)", "struct", "struct "), (r"[ \t]*typedef\s+struct\s*(?=\{)", "typedef", "struct "), (r"[ \t]*(?!(?:if|for|while|switch|return|else|do)\b)(?:[\w* \t]*[* \t])?(\w++)[ \t]*\([^;{}]*\)\s*\{", "function", "")],
    "scala": [(r"[ \t]*(?:(?:private|protected|final|sealed|abstract|case|implicit)\s+)*(class|object)\s+(?P<name>\w+)", "struct", "{0} "), (r"[ \t]*(?:(?:sealed|private)\s+)*trait\s+(\w+)", "interface", "trait "), (r"[ \t]*" + _WORDS + r"def\s+(\w+)", "function", "def ")],
    "lua": [(r"[ \t]*(?:local\s+)?(\w+)\s*=\s*(?=\{)", "struct", "table "), (r"[ \t]*(?:local\s+)?function\s+([\w.:]+)\s*(?=\()", "function", "function ")],
    "bash": [(r"[ \t]*(?:function\s+)?([\w-]+)\s*\(\)", "function", ""), (r"[ \t]*function\s+([\w-]+)\s*(?=\{)", "function", "")],
    "sql": [(r"(?i)[ \t]*create\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", "struct", "table "), (r"(?i)[ \t]*create\s+(?:or\s+replace\s+)?view\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", "type_alias", "view ")],
    "dart": [(r"[ \t]*(?:(?:abstract|base|final|sealed)\s+)*class\s+(\w+)", "struct", "class "), (r"[ \t]*(?!(?:if|for|while|switch|return|else|import|new)\b)[\w<>?,]+[ \t]+(\w+)[ \t]*\([^;{}]*\)\s*(?:async\*?\s*)?(?:\{|=>)", "function", "")],
    "elixir": [(r"[ \t]*defmodule\s+([\w.]+)", "struct", "defmodule "), (r"[ \t]*defp?\s+(\w+[?!]?)", "function", "def ")],
    "zig": [(r"[ \t]*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?struct\b", "struct", "struct "), (r"[ \t]*(?:pub\s+)?(?:export\s+|inline\s+)?fn\s+(\w+)", "function", "fn ")],
}
GRAMMAR["javascript"] = [r for r in GRAMMAR["typescript"] if r[1] != "interface"]
#: Members of a body: (pattern, whether a member must have a body of its own).
MEMBERS = {
    "typescript": (r"[ \t]*(?:(?:public|private|protected|static|async|override|get|set)\s+)*\*?[ \t]*(#?\w+)[ \t]*(?:<[^>\n]*>)?(?=\()", True),
    "rust": (r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", True), "java": (_NOTES + _TYPED, False), "csharp": (r"[ \t]*(?:\[[^\]\n]*\]\s*)*" + _TYPED, False),
    "kotlin": (_NOTES + _WORDS + r"fun\s+(?:<[^>]*>\s*)?(\w+)", False), "swift": (_NOTES + _WORDS + r"func\s+(\w+)", False), "php": (r"[ \t]*" + _WORDS + r"function\s+&?(\w+)", False),
    "cpp": (r"(?:[\w:<>&*~, \t]*[:<>&* \t])?([\w~]++)[ \t]*(?=\()", True), "scala": (_NOTES + _WORDS + r"def\s+(\w+)", False), "dart": (_NOTES + r"(?:(?:static|external)\s+)*[\w<>?,]+[ \t]+(\w+)[ \t]*(?=\()", False), "zig": (r"[ \t]*(?:pub\s+)?(?:inline\s+)?fn\s+(\w+)", False),
}
MEMBERS["javascript"] = MEMBERS["typescript"]
JOINS = {"cpp": "::", "php": "->", "ruby": "#"}  # between receiver and name in a signature; elsewhere a point
NOT_NAMES = frozenset("if for while switch return catch else do new throw super this synchronized using lock foreach sizeof match when with".split())
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"', "typescript": r"""^\s*import\b.*?["']([^"']+)["']""", "javascript": r"""^\s*import\b.*?["']([^"']+)["']""", "rust": r"^\s*use\s+([^;]+);", "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)",
    "csharp": r"^\s*using\s+([\w.]+)\s*;", "ruby": r"""^\s*require(?:_relative)?\s+["']([^"']+)""", "kotlin": r"^\s*import\s+([\w.*]+)", "swift": r"^\s*import\s+(\w+)", "php": r"""^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?["']([^"']+))""",
    "cpp": r'^\s*#include\s*[<"]([^>"]+)', "c": r'^\s*#include\s*[<"]([^>"]+)', "scala": r"^\s*import\s+([\w.{}, ]+)", "lua": r"""require\s*\(?["']([^"']+)""", "bash": r"^\s*(?:source|\.)\s+(\S+)", "dart": r"""^\s*(?:import|export)\s+["']([^"']+)""",
    "elixir": r"^\s*(?:import|alias|require|use)\s+([\w.]+)", "zig": r'@import\("([^"]+)"\)',
}

_CLIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)|"
_TEXT, _CHAR, _QUOTED, _RAW, _LONG = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\[^\n]{1,8}?|[^'\\\n])'", r"'(?:\\.|[^'\\\n])*'", r"`[^`]*`", r'""".*?"""'
BLANKED = {
    **dict.fromkeys(("c", "cpp", "rust", "csharp"), f"{_CLIKE}{_TEXT}|{_CHAR}"), **dict.fromkeys(("java", "kotlin", "scala", "swift"), f"{_CLIKE}{_LONG}|{_TEXT}|{_CHAR}"),
    "go": f"{_CLIKE}{_TEXT}|{_CHAR}|{_RAW}", **dict.fromkeys(("typescript", "javascript"), f"{_CLIKE}{_TEXT}|{_QUOTED}|{_RAW}"), "dart": f"{_CLIKE}{_LONG}|{_TEXT}|{_QUOTED}", "php": rf"{_CLIKE}#(?!\[)[^\n]*|{_TEXT}|{_QUOTED}",
    "zig": rf"//[^\n]*|\\\\[^\n]*|{_TEXT}|{_CHAR}", **dict.fromkeys(("ruby", "elixir"), rf"{_LONG}|(?<!\S)#[^\n]*|{_TEXT}|{_QUOTED}"), "bash": rf"(?<!\S)#[^\n]*|{_TEXT}|'[^']*'", "lua": rf"--\[\[.*?\]\]|--[^\n]*|{_TEXT}|{_QUOTED}", "sql": r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'",
}
_PATTERNS = {name: [(re.compile(p), kind, opening) for p, kind, opening in rules] for name, rules in GRAMMAR.items()}
_MEMBERS = {name: (re.compile(p), whole) for name, (p, whole) in MEMBERS.items()}
_BLANKED = {name: re.compile(p, re.S) for name, p in BLANKED.items()}
_TOKEN, _BRACE = re.compile(r"[{}()\[\];\n]|=>"), re.compile(r"[{}]")
_CONTINUES = re.compile(r"\s*(?:\{|:|=|->|extends\b|implements\b|with\b|where\b|throws\b|permits\b|async\b|const\b|noexcept\b|override\b)")


def blank(language: str, text: str) -> str:
    """text with blanks for all comments and strings; every other character keeps its place."""
    return _BLANKED[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(text: str, at: int) -> int:
    """The place of the brace that closes the one at a place; the end of the text if none does."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def _extent(text: str, at: int) -> tuple[int | None, int]:
    """(start of the body or None, place where the declaration ends)."""
    depth = 0
    for m in _TOKEN.finditer(text, at):
        sign, place = m[0], m.start()
        if sign in "([":
            depth += 1
        elif sign in ")]":
            depth -= 1
        elif depth > 0:
            continue
        elif sign == "{":
            return place, _close(text, place)
        elif sign in ";}":
            return None, place
        elif sign == "\n" and not text[max(at, place - 80) : place].rstrip().endswith((",", "=", "->", ":", "=>")) and not _CONTINUES.match(text, place):
            return None, place
    return None, len(text)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def of(self, place: int) -> int:
        return bisect_right(self.starts, place)


def _line_end(text: str, at: int) -> int:
    stop = text.find("\n", at)
    return len(text) if stop < 0 else stop


@lru_cache(maxsize=1)
def _ends(text: str) -> dict[str, list[int]]:
    """Where lines begin that close a body with ``end``, by their indentation."""
    out: dict[str, list[int]] = {}
    for m in re.finditer(r"(?m)^([ \t]*)end\b", text):
        out.setdefault(m[1], []).append(m.start())
    return out


def _end_word(text: str, at: int) -> int:
    """Where a declaration whose body closes with ``end`` ends: at its own line, or at the next ``end`` of its indentation."""
    stop = _line_end(text, at)
    line = text[at:stop]
    if re.search(r"\bend\s*$|\bdo:|;\s*end\b", line):
        return stop
    indent = re.match(r"[ \t]*", line)[0]
    places = _ends(text).get(indent, ())
    n = bisect_right(places, stop)
    return _line_end(text, places[n]) if n < len(places) else stop


def _ruby_members(text: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    at = _line_end(text, at) + 1
    while at < end:
        if m := re.compile(r"[ \t]*def\s+(self\.)?([\w?!=]+)").match(text, at):
            stop = _end_word(text, at)
            if not m[1]:
                yield m[2], at, stop
        else:
            stop = _end_word(text, at) if re.compile(r"[ \t]*(?:class|module)\b").match(text, at) else _line_end(text, at)
        at = stop + 1


def _members(language: str, text: str, start: int, end: int, receiver: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of the functions directly inside a body; constructors are none in Java, C# and Dart."""
    pattern, whole = _MEMBERS[language]
    at = start + 1
    while at < end:
        m = pattern.match(text, at, end)
        if m and m[1] not in NOT_NAMES:
            body, stop = _extent(text, m.end())
            stop = min(stop, end)
            if (body is not None or not whole) and not (language in ("java", "csharp", "dart") and m[1] == receiver):
                yield m[1], m.start(1), stop
            at = stop + 1
            continue
        stop = min(_line_end(text, at), end)
        opened = text.find("{", at, stop)
        at = (min(_close(text, opened), end) if opened >= 0 else stop) + 1


def _python(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    todo = [*reversed(tree.body)]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.ClassDef):
            yield "struct", node.name, f"{path}.{node.name}", None, node.lineno, node.end_lineno, f"class {node.name}"
            for x in node.body:
                if isinstance(x, kinds):
                    yield "method", x.name, f"{path}.{node.name}.{x.name}", node.name, x.lineno, x.end_lineno, f"{node.name}.{x.name}(...)"
        elif isinstance(node, kinds):
            yield "function", node.name, f"{path}.{node.name}", None, node.lineno, node.end_lineno, f"def {node.name}(...)"
        else:
            todo += reversed([x for part in ("body", "orelse", "finalbody") for x in getattr(node, part, ()) if isinstance(x, ast.stmt)])


def _scanned(language: str, path: str, text: str) -> Iterator[tuple]:
    """Symbols of one file of a scanned language other than Go."""
    clean, lines, at = blank(language, text), _Lines(text), 0
    by_word = language in ("ruby", "elixir", "lua")
    while at < len(clean):
        for pattern, kind, opening in _PATTERNS[language]:
            m = pattern.match(clean, at)
            if not m:
                continue
            name = m["name"] if "name" in pattern.groupindex else m[1] if pattern.groups else ""
            if name in NOT_NAMES:
                continue
            body, end = None, _line_end(clean, at)
            if by_word and not (language == "lua" and kind == "struct"):
                end = _end_word(clean, at)
            elif language == "sql":
                stop = clean.find(";", at)
                end = len(clean.rstrip()) if stop < 0 else stop
            else:
                place = m.end() - 1 if m[0].endswith("{") else m.end()
                body, end = _extent(clean, place)
                if language == "dart" and m[0].endswith("=>"):
                    end = min(x for x in (clean.find(";", place), len(clean)) if x >= 0)
            first, last = lines.of(m.start() + len(m[0]) - len(m[0].lstrip())), lines.of(max(at, min(end, len(clean) - 1)))
            if kind == "typedef":
                named = re.compile(r"\}\s*(\w+)").match(clean, end)
                kind, name = "struct", named[1] if named else ""
            receiver = None
            if language == "lua" and re.search("[.:]", name):
                kind, (receiver, *_, name) = "method", re.split("[.:]", name)
            if name and kind != "impl":
                short = name.rpartition(".")[2] if language == "elixir" else name
                signature = opening.format(m[1] if pattern.groups else "") + name
                if kind == "method":
                    signature = f"{receiver}.{name}(...)"
                elif kind == "function":
                    signature += "()" if language == "bash" else "(...)"
                yield kind, short, f"{path}.{receiver + '.' if receiver else ''}{name}", receiver, first, last, signature
            inside = ()
            if kind in ("struct", "impl") and name:
                if language == "ruby":
                    inside = _ruby_members(clean, at, end)
                elif body is not None and language in _MEMBERS and (kind == "impl") == (language == "rust"):
                    inside = _members(language, clean, body, end, name)
            for member, a, b in inside:
                yield "method", member, f"{path}.{name}.{member}", name, lines.of(a), lines.of(min(b, len(clean) - 1)), f"{name}{JOINS.get(language, '.')}{member}(...)"
            at = _line_end(clean, at) + 1 if language == "elixir" and kind == "struct" else max(_line_end(clean, at), _line_end(clean, end)) + 1
            break
        else:
            at = _line_end(clean, at) + 1


# Go -----------------------------------------------------------------------------------------------------------------

_GO_FUNC = re.compile(r"func\s+(?:\(\s*(?:\w+\s+)?(\*?\s*)(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?(?=\()")
_GO_TYPE = re.compile(r"[ \t]*(\w+)(?:\[[^\]\n]*\s[^\]\n]*\])?[ \t]*(=?)[ \t]*(\S[^\n]*)")
_GO_EMPTY = re.compile(r"\b(?:interface|struct)[ \t]*\{[ \t]*\}")


def go_package(path: str) -> str:
    return path.rpartition("/")[0] or "."


def _go_type(text: str) -> str:
    """A type as a signature shows it: bodies and parameters are left out."""
    x = text.strip()
    if m := re.match(r"\*\s*", x):
        return "*" + _go_type(x[m.end() :])
    if m := re.match(r"\[[^\]]*\]", x):
        return "[]" + _go_type(x[m.end() :])
    if x.startswith("map["):
        depth = 0
        for i, c in enumerate(x):
            depth += (c == "[") - (c == "]")
            if c == "]" and not depth:
                return f"map[{_go_type(x[4:i])}]{_go_type(x[i + 1 :])}"
    if m := re.match(r"(chan\s*<-|<-\s*chan|chan)\s+", x + " "):
        return f"{re.sub(r'\s', '', m[1])} {_go_type(x[m.end() :])}"
    if m := re.match(r"interface\s*\{\s*(\})?", x):
        return "interface{}" if m[1] else "interface{...}"
    if re.match(r"struct\s*\{", x):
        return "struct{...}"
    if m := re.match(r"func\s*\(\s*(\))?", x):
        return "func()" if m[1] else "func(...)"
    return x if re.fullmatch(r"\w+(?:\.\w+)?", x) else "?"


def _go_members(text: str, start: int, end: int) -> Iterator[tuple[list[str], str, int]]:
    """(names, rest, place) of the fields or methods directly inside a body; embedded types have no names."""
    at = start + 1
    while at < end:
        stop = at
        depth = 0
        while stop < end and (depth > 0 or text[stop] not in "\n;"):
            depth += (text[stop] in "({[") - (text[stop] in ")}]")
            stop += 1
        line = text[at:stop].strip()
        if line:
            if m := re.match(r"(\w+(?:\s*,\s*\w+)*)\s+(?=\S)", line):
                yield re.split(r"\s*,\s*", m[1]), line[m.end() :], at + len(text[at:stop]) - len(text[at:stop].lstrip())
            elif m := re.match(r"(\w+)(?=\()", line):
                yield [m[1]], line[m.end() :], at
            else:
                yield [], line, at
        at = stop + 1


def _go_types(text: str) -> Iterator[tuple[str, str, str, int, int | None, int]]:
    """(name, entity, type, place, body, end) of the type declarations, single and in groups."""
    for m in re.finditer(r"(?m)^type\b[ \t]*(\()?", text):
        end = _line_end(text, m.end())
        if m[1]:
            depth = 0
            for x in re.finditer(r"[()]", text[m.end() - 1 :]):
                depth += 1 if x[0] == "(" else -1
                if not depth:
                    end = m.end() - 1 + x.start()
                    break
        at = m.end()
        while at < end:
            found = _GO_TYPE.match(text, at)
            if not found or found.start(3) >= end:
                at = _line_end(text, at) + 1
                continue
            name, rest, stop, body = found[1], found[3], found.end(), None
            kind = "type_alias"
            if opened := re.match(r"(struct|interface)\s*\{", rest):
                kind = opened[1]
                body = found.start(3) + opened.end() - 1
                stop = _close(text, body)
            yield name, kind, rest, found.start(1), body, stop
            at = _line_end(text, stop) + 1 if m[1] else end


def _go(path: str, text: str) -> Iterator[tuple]:
    clean, lines, package = blank("go", text), _Lines(text), go_package(path)
    prefix = "" if package == "." else f"{package}."
    for name, kind, rest, place, body, end in _go_types(clean):
        if body is None:
            signature = f"type {name} {_go_type(rest)}" if re.fullmatch(r"\s*[\w.]+\s*", rest) or clean[place : place + len(name) + 4].find("=") < 0 else f"type {name} = {_go_type(rest)}"
        elif kind == "struct":
            signature = "; ".join(f"{n} {_go_type(x)}" if n else _go_type(x) for names, x, _ in _go_members(clean, body, end) for n in names or [""])
        else:
            signature = "; ".join(n + ("()" if re.match(r"\(\s*\)", x) else "(...)") if n else _go_type(x) for names, x, _ in _go_members(clean, body, end) for n in names or [""])
        yield kind, name, prefix + name, None, lines.of(place), lines.of(min(end, max(0, len(clean) - 1))), signature
    open_bodies = _GO_EMPTY.sub(lambda m: " " * len(m[0]), clean)
    for m in re.finditer(r"(?m)^(?=func\b)", clean):
        f = _GO_FUNC.match(clean, m.start())
        if not f or f[3] == "init":
            continue
        _, end = _extent(open_bodies, f.end())
        place = lines.of(m.start()), lines.of(min(end, max(0, len(clean) - 1)))
        if f[2]:
            yield "method", f[3], f"{prefix}{f[2]}.{f[3]}", f[2], *place, f"func ({f[2]}) {f[3]}(...)"
        else:
            yield "function", f[3], prefix + f[3], None, *place, f"func {f[3]}(...)"
    if '"net/http"' in text:
        for m in re.finditer(r"(?m)^(?=func\b)", clean):
            f = _GO_FUNC.match(clean, m.start())
            if f and (f[3].startswith("Handle") or f[3].endswith("Handler")):
                _, end = _extent(open_bodies, f.end())
                yield "endpoint", f[3], prefix + f[3], None, lines.of(m.start()), lines.of(min(end, max(0, len(clean) - 1))), ""


def claims(path: str, language: str, text: str) -> Iterator[tuple]:
    """(path, package, type, from name, to name, line): what a file says about relations, by name.

    All languages: IMPORTS of the file.  Go also: DEPENDS_ON of a struct's field types, IMPLEMENTS of ``var _ Interface = (*Struct)(nil)``,
    EXPOSES_ENDPOINT of its package's HTTP handlers.
    """
    package = go_package(path)
    seen = set()
    for n, target in imports_at(language, text):
        if target not in seen:
            seen.add(target)
            yield path, package, "IMPORTS", path, target, n
    if language != "go":
        return
    clean, lines = blank("go", text), _Lines(text)
    for name, kind, _, _, body, end in _go_types(clean):
        if kind == "struct":
            for _, rest, place in _go_members(clean, body, end):
                if m := re.fullmatch(r"(?:\*\s*)*(\w+(?:\.\w+)?)", rest.strip()):
                    yield path, package, "DEPENDS_ON", name, m[1], lines.of(place)
    for m in re.finditer(r"(?m)^(?:var)?[ \t]*\w+[ \t]+([\w.]+)[ \t]*=[ \t]*\(\s*\*\s*([\w.]+)\s*\)\s*\(\s*nil\s*\)", clean):
        yield path, package, "IMPLEMENTS", m[2], m[1], lines.of(m.start())
    for kind, name, _, _, line, _, _ in _go(path, text):
        if kind == "endpoint":
            yield path, package, "EXPOSES_ENDPOINT", package, name, line


def symbols(path: str, language: str, text: str) -> Iterator[tuple]:
    """The file and its declarations, in order; nested ones only as members of a type."""
    package = go_package(path)
    yield path, "file", path.rpartition("/")[2], path, None, 1, text.count("\n") + 1, path, package, language
    found = _python(path, text) if language == "python" else _go(path, text) if language == "go" else _scanned(language, path, text)
    for kind, name, qualified, receiver, first, last, signature in found:
        yield path, kind, name, qualified, receiver, first, last, signature, package, language


def imports_at(language: str, text: str) -> Iterator[tuple[int, str]]:
    """(line, target)."""
    pattern = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))" if language == "python" else IMPORTS.get(language)
    grouped = False
    for n, line in enumerate(text.split("\n") if pattern else (), 1):
        if language == "go":
            bare = line.strip()
            grouped = (grouped and not bare.startswith(")")) or bare.startswith("import (")
            if not grouped and not bare.startswith("import "):
                continue
        if m := re.search(pattern, line):
            yield n, next(g for g in m.groups() if g).strip().removeprefix("./")


def imports(language: str, text: str) -> list[str]:
    return list(dict.fromkeys(x for _, x in imports_at(language, text)))
