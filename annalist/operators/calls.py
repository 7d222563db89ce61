"""Calls in the bodies of Go functions: sites are read from a token stream, callees found by joins on names.

A call is a name, or names joined by points, right before an opening bracket.  Blocks form a stack of scopes, so a site knows whether its
name is declared nearer than the package; the file's import aliases say which package a qualifier stands for.  Comments and strings
are blanked first; conversions (``[]byte(x)``), type arguments (``f[int](x)``), methods of interface literals and calls of results
(``f()(x)``, ``f().g(x)``) name no function, and a method value without brackets is no call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .symbols import _GO_EMPTY, _GO_FUNC, _extent, _Lines, blank, go_package

SITES = "path string, package_path string, caller string, caller_type string, form string, qualifier string, import_path string, name string, line int, shadowed boolean"
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
HEADERS = frozenset(("if", "for", "switch", "select", "case"))
_TOKEN = re.compile(r"[^\W\d]\w*|:=|<-|\.\.\.|\d[\w.]*|\n|[^\s\w]")
_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"]+)"')


def aliases(text: str) -> dict[str, str]:
    """The import path of each name that a file's imports give; without a name of its own an import is named by its last part."""
    out, grouped = {}, False
    for line in text.split("\n"):
        bare = line.strip()
        grouped = (grouped and not bare.startswith(")")) or bare.startswith("import (")
        if (grouped or bare.startswith("import ")) and (m := _IMPORT.match(line)):
            out[m[1] or m[2].rpartition("/")[2]] = m[2]
        elif re.match(r"(?:func|type|var|const)\b", bare):
            break
    return out


class _Scopes:
    """Names declared in the open blocks; those of a header (``if x := f(); x {``) belong to the block it opens, and to its else."""

    def __init__(self, names: set[str]):
        self.blocks: list[tuple[set[str], set[str], bool]] = [(names, set(), False)]
        self.header: set[str] | None = None
        self.before: set[str] = set()

    def declare(self, names: list[str]) -> None:
        (self.blocks[-1][0] if self.header is None else self.header).update(names)

    def open(self, names: set[str], interface: bool) -> None:
        own = (self.header or set()) | self.before | names
        self.blocks.append((set(own), set(own), interface))
        self.header, self.before = None, set()

    def close(self) -> set[str]:
        return self.blocks.pop()[1] if len(self.blocks) > 1 else set()

    def __contains__(self, name: str) -> bool:
        return any(name in names for names, _, _ in self.blocks) or name in (self.header or ())


def _group(tokens: list[tuple[str, int]], at: int) -> int:
    """The place behind the bracket that closes the one at a place."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i][0] in "([{") - (tokens[i][0] in ")]}")
        if not depth:
            return i + 1
    return len(tokens)


def _point(tokens: list[tuple[str, int]], at: int) -> int:
    """The place of a point that only line ends part from the word behind a place, else that place."""
    back = at
    while back >= 0 and tokens[back][0] == "\n":
        back -= 1
    return back if back >= 0 and tokens[back][0] == "." else at


def _parameters(tokens: list[tuple[str, int]]) -> set[str]:
    """Names that a bracketed list of parameters declares: the first word of each part that has a type behind it, or before one that has."""
    out, parts, depth = set(), [[]], 0
    for text, _ in tokens[1:-1]:
        depth += (text in "([{") - (text in ")]}")
        if text == "," and not depth:
            parts.append([])
        elif text != "\n":
            parts[-1].append(text)
    typed = any(len(p) > 1 and p[0].isidentifier() and p[0] not in KEYWORDS and p[1] != "." for p in parts)
    for p in parts:
        if typed and p and p[0].isidentifier() and p[0] not in KEYWORDS:
            out.add(p[0])
    return out


def _signature(tokens: list[tuple[str, int]], at: int) -> tuple[set[str], int]:
    """(names of parameters and results, place behind them) of a signature whose first bracket is at a place."""
    end = _group(tokens, at)
    names = _parameters(tokens[at:end])
    if end < len(tokens) and tokens[end][0] == "(":
        last = _group(tokens, end)
        return names | _parameters(tokens[end:last]), last
    return names, end


def body_calls(signature: str, body: str) -> Iterator[tuple[str, str | None, str, int, bool]]:
    """(form, qualifier, name, place, shadowed) of the calls in a function's body, in order.

    form: ``name`` for f(), ``selector`` for x.f(), ``chain`` for x.y.f() with x as qualifier.  shadowed: a block, parameter or header of this
    function declares the name, or the qualifier.
    """
    head = [(m[0], 0) for m in _TOKEN.finditer(signature)]
    names: set[str] = set()
    at = 0
    while at < len(head):  # receiver, parameters and results
        if head[at][0] == "(":
            end = _group(head, at)
            names |= _parameters(head[at:end])
            at = end
        else:
            at = _group(head, at) if head[at][0] == "[" else at + 1
    tokens = [(m[0], m.start()) for m in _TOKEN.finditer(body)]
    scopes, literal, interface = _Scopes(names), [], False
    i = 0
    while i < len(tokens):
        text = tokens[i][0]
        if text == "func" and i + 1 < len(tokens) and tokens[i + 1][0] == "(":
            own, end = _signature(tokens, i + 1)
            # a literal's block follows its result's type; a type alone has none
            j = end
            while j < len(tokens) and tokens[j][0] not in ("{", "\n", ",", ")", "(", "=", ";", "}"):
                j = _group(tokens, j) if tokens[j][0] == "[" else j + 1
            if j < len(tokens) and tokens[j][0] == "{":
                literal.append((j, own))
            i = end
            continue
        if text in HEADERS:
            scopes.header = set()
        elif text == "interface":
            interface = True
        elif text in ("var", "const") or text == ":=":
            found, step, j = [], (-1 if text == ":=" else 1), i
            while 0 <= j + step < len(tokens) and (tokens[j + step][0] == "," or (tokens[j + step][0].isidentifier() and tokens[j + step][0] not in KEYWORDS)):
                j += step
                if tokens[j][0] != ",":
                    found.append(tokens[j][0])
                    if step > 0 and (j + 1 >= len(tokens) or tokens[j + 1][0] != ","):
                        break
            scopes.declare(found)
        elif text == "{":
            own = set()
            value = scopes.header is not None and i > 1 and tokens[i - 2][0] == "]" and tokens[i - 1][0].isidentifier()  # []T{...} in a header
            if value or (literal and literal[-1][0] == i):
                own = set() if value else literal.pop()[1]
                header, scopes.header = scopes.header, None
                scopes.open(own, False)
                scopes.header = header
            else:
                scopes.open(own, interface)
            interface = False
        elif text == "}":
            left = scopes.close()
            scopes.before = left if i + 1 < len(tokens) and tokens[i + 1][0] == "else" else set()
        elif text == "\n":
            scopes.header = None
        elif text == ":" and scopes.header is not None:  # a case: its names live on in the block
            names_here, scopes.header = scopes.header, None
            scopes.declare(sorted(names_here))
        elif text == "(" and i and tokens[i - 1][0].isidentifier() and tokens[i - 1][0] not in KEYWORDS and not scopes.blocks[-1][2]:
            parts, j = [tokens[i - 1][0]], i - 2
            whole = True
            while (j := _point(tokens, j)) >= 0 and tokens[j][0] == ".":
                j -= 1
                if j >= 0 and tokens[j][0].isidentifier() and tokens[j][0] not in KEYWORDS:
                    parts.append(tokens[j][0])
                    j -= 1
                else:
                    whole = False
                    break
            conversion = j >= 0 and tokens[j][0] == "]"
            if whole and not conversion and len(parts) <= 3:
                yield ("name", "selector", "chain")[len(parts) - 1], (parts[-1] if len(parts) > 1 else None), parts[0], tokens[j + 1][1], parts[-1] in scopes
        i += 1


def go_call_sites(path: str, language: str, text: str) -> Iterator[tuple]:
    """Rows of SITES of one Go file; ``init`` functions are no callers."""
    if language != "go":
        return
    clean, lines, package, known = blank("go", text), _Lines(text), go_package(path), aliases(text)
    prefix = "" if package == "." else f"{package}."
    hollow = _GO_EMPTY.sub(lambda m: " " * len(m[0]), clean)
    for m in re.finditer(r"(?m)^(?=func\b)", clean):
        f = _GO_FUNC.match(clean, m.start())
        if not f or f[3] == "init":
            continue
        begin, end = _extent(hollow, f.end())
        if begin is None:
            continue
        caller, kind = (f"{prefix}{f[2]}.{f[3]}", "method") if f[2] else (prefix + f[3], "function")
        receiver = clean[m.start() + 4 : f.start(3)]
        for form, qualifier, name, place, shadowed in body_calls(receiver + clean[f.end() : begin], clean[begin + 1 : end]):
            yield path, package, caller, kind, form, qualifier, known.get(qualifier) if qualifier else None, name, lines.of(begin + 1 + place), shadowed


def call_sites(files: DataFrame) -> DataFrame:
    """files(path, text) to rows of SITES."""
    from .code import _parsed

    return _parsed(files, go_call_sites, SITES)


def resolve_call_sites(sites: DataFrame, entities: DataFrame, module: str, compat: bool = True) -> DataFrame:
    """(from_id, to_id, relationship_type, line): each caller and callee once, at the first line.

    entities: (id, entity_type, name, qualified_name, package_path, receiver).  A name is a function of the package; a qualifier that
    stands for a package of the module leads to a function there; any other to the method of the type that the qualifier's name
    capitalized gives, else to the only method of that name in the package.  A chain leads nowhere but into a package.  A function's calls of
    itself fall out.  With compat a name that the function declares itself is looked up all the same; without, it leads nowhere.
    """
    rows = sites if compat else sites.where("NOT shadowed OR (form = 'selector' AND import_path IS NULL)")
    inside = F.when(F.col("import_path") == module, ".").when(F.col("import_path").startswith(module + "/"), F.col("import_path").substr(F.lit(len(module) + 2), F.length("import_path")))
    rows = rows.withColumn("_target", inside)
    keyed = rows.select(
        "package_path", "caller", "caller_type", "name", "line",
        F.when(F.col("form") == "name", F.col("package_path")).otherwise(F.col("_target")).alias("in_package"),
        F.when((F.col("form") == "selector") & F.col("_target").isNull(), F.concat(F.upper(F.substring("qualifier", 1, 1)), F.expr("substr(qualifier, 2)"))).alias("receiver"),
    )
    function = entities.where("entity_type = 'function'").groupBy(F.col("package_path").alias("in_package"), "name").agg(F.min("id").alias("f"))
    methods = entities.where("entity_type = 'method'")
    typed = methods.groupBy("package_path", "receiver", "name").agg(F.min("id").alias("m"))
    only = methods.groupBy("package_path", "name").agg(F.countDistinct("receiver").alias("n"), F.min("id").alias("u")).where("n = 1").drop("n")
    callers = entities.where("entity_type IN ('function', 'method')").groupBy(F.col("qualified_name").alias("caller"), F.col("entity_type").alias("caller_type")).agg(F.min("id").alias("from_id"))
    # merge: sizes after parsing are guesses from the files', far too low, and no side is small
    large = lambda rows: rows.hint("merge")
    by_name = keyed.where("in_package IS NOT NULL").join(large(function), ["in_package", "name"]).select("caller", "caller_type", F.col("f").alias("to_id"), "line")
    by_method = keyed.where("receiver IS NOT NULL").join(large(typed), ["package_path", "receiver", "name"], "left").join(large(only), ["package_path", "name"], "left").select("caller", "caller_type", F.coalesce("m", "u").alias("to_id"), "line").where("to_id IS NOT NULL")
    found = by_name.unionByName(by_method).join(large(callers), ["caller", "caller_type"]).where("from_id <> to_id")
    return found.groupBy("from_id", "to_id").agg(F.min("line").alias("line")).select("from_id", "to_id", F.lit("CALLS").alias("relationship_type"), "line")
