"""TypeScript, JavaScript, Rust, Go and Java declarations.

Comments and strings are blanked first (line breaks stay), so braces and
keywords that remain are code.  Declarations are recognised at their nesting:
a declaration's body ends at its matching brace.  This finds declarations,
imports and calls, not a full syntax tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

_BLANK = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|r#*\".*?\"#*|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'(?!\w)", re.S
)
#: Attributes and empty type literals; braces; where a statement may stop, and how the next begins; what is blanked within bodies.
_LITERAL = re.compile(
    r"#!?\[[^\]\n]*\]|(type(?<=\btype)[ \t]+\w+[ \t]+)(?:interface|struct)\s*\{\s*\}|(?:interface(?<=\binterface)|struct(?<=\bstruct))\s*\{\s*\}"
)
_EMPTY = re.compile(r"(?:interface|struct)\s*\{\s*\}")
_BRACE, _STOP, _NEXT, _UNSEEN = re.compile("[{}]"), re.compile(r"[;{}\n]"), re.compile(r"\s*[A-Za-z@}]"), re.compile(r"[^\n{]")
_BREAK, _EXPORTED = re.compile("\n"), re.compile(r"\bexport\s*\{([^}]*)\}")
_ATTRIBUTE = re.compile(r"\s*(@\w|#\[)")
_MARKS = {"rust": re.compile(r"\s*//[/!]"), "go": re.compile(r"\s*//"), "java": None, "typescript": re.compile(r"\s*//")}
#: Kinds of rows.
EVERY = frozenset(("symbol", "import", "call"))
TOPS = {"go": "<package>", "java": "<class>"}
_WORD = r"[A-Za-z_$][\w$]*"

# Declarations: kind, pattern and the words without one of which it finds nothing; the name is group "n".
_SCRIPT = (
    ("class", rf"\b(?:abstract\s+)?class\s+(?P<n>{_WORD})", "class"),
    ("interface", rf"\binterface\s+(?P<n>{_WORD})", "interface"),
    ("enum", rf"\benum\s+(?P<n>{_WORD})", "enum"),
    ("type_alias", rf"\btype\s+(?P<n>{_WORD})\s*(?:<[^=]*>)?\s*=", "type"),
    ("function", rf"\bfunction\b\s*\*?\s*(?P<n>{_WORD})", "function"),
    ("function", rf"\b(?:const|let|var)\s+(?P<n>{_WORD})\s*(?::[^=;]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=;]+)?=>|{_WORD}\s*=>)", "const let var"),
    ("constant", rf"\bconst\s+(?P<n>{_WORD})\s*(?::[^=;]+)?=(?!>)", "const"),
    ("variable", rf"\b(?:let|var)\s+(?P<n>{_WORD})\b", "let var"),
)
_SCRIPT_MEMBERS = (
    ("method", rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?(?P<n>#?{_WORD})\s*(?:<[^>()]*>)?\([^;{{}}]*\)\s*(?::[^;{{}}]+)?\{{"),
    ("property", rf"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*(?P<n>#?{_WORD})[?!]?\s*(?::[^;={{}}]+)?(?:=[^;]*)?;"),
)
_RUST = (
    ("function", rf"\bfn\s+(?P<n>{_WORD})", "fn"), ("struct", rf"\bstruct\s+(?P<n>{_WORD})", "struct"), ("enum", rf"\benum\s+(?P<n>{_WORD})", "enum"),
    ("trait", rf"\btrait\s+(?P<n>{_WORD})", "trait"), ("impl", r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?P<n>[A-Za-z_][^{;]*?)\s*(?:where\b[^{]*)?(?=\{)", "impl"),
    ("type_alias", rf"\btype\s+(?P<n>{_WORD})", "type"), ("constant", rf"\bconst\s+(?P<n>{_WORD})\s*:", "const"), ("variable", rf"\bstatic\s+(?:mut\s+)?(?P<n>{_WORD})\s*:", "static"),
    ("module", rf"\bmod\s+(?P<n>{_WORD})", "mod"),
)
_GO = (
    ("method", rf"(?m)^func\s*\([^)]*\)\s*(?P<n>{_WORD})", "func"), ("function", rf"(?m)^func\s+(?P<n>{_WORD})", "func"),
    ("struct", rf"(?m)^type\s+(?P<n>{_WORD})\s+struct\b", "struct"), ("interface", rf"(?m)^type\s+(?P<n>{_WORD})\s+interface\b", "interface"),
    ("type_alias", rf"(?m)^type\s+(?P<n>{_WORD})\s+(?!struct\b|interface\b)", "type"), ("constant", rf"(?m)^const\s+(?P<n>{_WORD})\b", "const"), ("variable", rf"(?m)^var\s+(?P<n>{_WORD})\b", "var"),
)
_MOD = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile)\s+)*"
_JAVA = (
    ("class", rf"\b(?:class|record)\s+(?P<n>{_WORD})", "class record"), ("interface", rf"\b@?interface\s+(?P<n>{_WORD})", "interface"), ("enum", rf"\benum\s+(?P<n>{_WORD})", "enum"),
)
_JAVA_MEMBERS = (
    ("method", rf"(?m)^[ \t]*+(?!\s){_MOD}(?:<[^>]*>\s*)?(?:[\w.$<>,?\[\] ]+?\s+)?(?P<n>{_WORD})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;]"),
    ("field", rf"(?m)^[ \t]*{_MOD}[\w.$<>,?\[\]]+(?:\s*\[\])?\s+(?P<n>{_WORD})\s*(?:=[^;]*)?;"),
)


def _led(pattern: str) -> str:
    """A pattern that begins with a word, with the word before the test of its start: such are searched for as plain text."""
    return re.sub(r"^\\b([a-z]+)(?=\\[sb])", r"\1(?<=\\b\1)", pattern)


_TABLES = {
    language: [(kind, re.compile(_led(pattern)), words.split()) for kind, pattern, words in rows]
    for language, rows in {"typescript": _SCRIPT, "javascript": _SCRIPT, "rust": _RUST, "go": _GO, "java": _JAVA}.items()
}
_CALL = re.compile(rf"(?:(?P<r>[\w$.\])]+)(?:\.|::|\?\.))?(?P<n>{_WORD})\s*(?:::<[^>]*>)?\(")
_SCRIPT_MEMBERS, _JAVA_MEMBERS = ([(kind, re.compile(pattern)) for kind, pattern in rows] for rows in (_SCRIPT_MEMBERS, _JAVA_MEMBERS))
_SELF, _ASYNC, _WORDS = re.compile(r"[^(]*\([^)]*\bself\b"), re.compile(r"\basync\b"), re.compile(r"\w+")
#: Kinds that hold no call and no declaration that does.
_QUIET = frozenset("constant variable module field property enum_variant".split())
_DECLARES = re.compile(r"\b(?:function|fn|func|new)\s*\*?\s*$")
#: Words before a parenthesis that call nothing, in every language and in each.
_CONTROL = frozenset("if for while switch return else in case do".split())
_RESERVED = {
    "typescript": "function catch typeof await yield throw super new import with", "javascript": "function catch typeof await yield throw super new import with",
    "rust": "fn match loop impl where as move pub", "go": "func go defer select range import const var type", "java": "catch try throw super this new synchronized assert",
}


@cache
def keywords(language: str) -> frozenset[str]:
    return _CONTROL | set(_RESERVED[language].split())


def blank(content: str) -> str:
    """The text with comments and strings replaced by spaces of equal length."""
    hide = lambda m: re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0])
    code = _BLANK.sub(hide, content)
    if "#[" not in code and "#![" not in code and not _EMPTY.search(code):
        return code
    # attributes are no calls, and empty type literals no bodies; a named type's is its body
    literal = lambda m: m[0] if m[1] else hide(m)
    return _LITERAL.sub(literal, code)


class _Nesting:
    """How deep each place of a text lies in braces, and where each of them closes; only braces are held.

    A brace lies as deep as what is around it.
    """

    def __init__(self, code: str):
        self.code = code
        self.at = [m.start() for m in _BRACE.finditer(code)]
        self.after: list[int] = []
        self.closing: dict[int, int] = {}
        opened: list[int] = []
        for i in self.at:
            if code[i] == "{":
                opened.append(i)
            elif opened:
                self.closing[opened.pop()] = i
            self.after.append(len(opened))

    def depth(self, i: int) -> int:
        k = bisect_left(self.at, i)
        level = self.after[k - 1] if k else 0
        return max(0, level - 1) if self.code[i] == "}" else level

    def end(self, at: int) -> int:
        """Where a declaration at ``at`` ends: its body's brace, or the end of its statement."""
        code, here = self.code, self.depth(at)
        level, counted, brackets, brace = here, at, 0, code.find("{", at)
        for m in _STOP.finditer(code, at):
            i, c = m.start(), m[0]
            if c == "}":
                level = max(0, level - 1)
            elif c == "{":
                if level == here:
                    return self.closing.get(i, len(code) - 1)
                level += 1
            elif level != here:
                continue
            elif c == ";":
                return i
            else:
                brackets += code.count("(", counted, i) - code.count(")", counted, i)
                counted = i
                if brackets == 0 and not at <= brace < i + 40 and _NEXT.match(code[i + 1 : i + 40]):
                    return i
        return len(code) - 1

    def body(self, start: int, end: int, level: int) -> str:
        """The text from start to end with spaces for what is deeper than ``level``, but for line breaks and opening braces."""
        k = bisect_left(self.at, start)
        parts, depth, begin = [], self.after[k - 1] if k else 0, start
        for k in range(k, bisect_left(self.at, end)):
            i = self.at[k]
            parts.append(self._shown(begin, i, depth == level))
            opens = self.code[i] == "{"
            parts.append("{" if opens else "}" if max(0, depth - 1) == level else " ")
            depth, begin = self.after[k], i + 1
        parts.append(self._shown(begin, end, depth == level))
        return "".join(parts)

    def _shown(self, start: int, end: int, plain: bool) -> str:
        return self.code[start:end] if plain else _UNSEEN.sub(" ", self.code[start:end])


def _doc(lines: list[str], line: int, language: str) -> str | None:
    """The doc comment that ends right above a line (from 1), attributes aside."""
    n = min(line - 1, len(lines))
    while n and _ATTRIBUTE.match(lines[n - 1]):
        n -= 1
    if not n:
        return None
    if lines[n - 1].rstrip().endswith("*/"):
        for i in range(n - 1, -1, -1):
            if "/*" in lines[i]:
                return "\n".join(lines[i:n]).strip() if "/**" in lines[i] else None
        return None
    mark = _MARKS.get(language, _MARKS["typescript"])
    if not mark:
        return None
    taken = []
    while n and mark.match(lines[n - 1]):
        n -= 1
        taken.append(lines[n].strip())
        if language in ("typescript", "javascript"):
            break
    return "\n".join(reversed(taken)) or None


def _visibility(language: str, name: str, head: str, member: bool) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        found = re.search(r"\bpub\b(?:\s*\(([^)]*)\))?", head)
        return "private" if not found else "public" if not found[1] else "crate" if found[1].strip() == "crate" else "internal"
    words = set(_WORDS.findall(head))
    for v in ("private", "protected"):
        if v in words:
            return v
    if language == "java":
        return "public" if "public" in words else "internal"
    if name.startswith("#"):
        return "private"
    return "public" if member or "export" in words else "private"


def extract(content: str, language: str, wanted: frozenset[str] = EVERY) -> list[dict]:
    """Rows of the wanted kinds; without symbols among them, declarations are found but not described."""
    if language not in _TABLES:
        return []
    code = blank(content)
    line_of = _lines(code)
    if wanted == {"import"}:
        return _imports(content, code, language, line_of)
    nesting, lines = _Nesting(code), content.split("\n")
    described = "symbol" in wanted
    reserved = keywords(language)
    script = language in ("typescript", "javascript")
    listed = {n.strip().split(" ")[0] for m in _EXPORTED.findall(code) for n in m.split(",")} if script and "export" in code else set()
    found: list[tuple[int, int, dict]] = []
    taken: set[int] = set()

    def add(kind: str, match: re.Match, parent: str | None, low: int = 0) -> None:
        at = low + match.start("n")
        name = " ".join(match["n"].split())
        if at in taken or (parent and name in reserved):
            return
        taken.add(at)
        lead = match[0][: len(match[0]) - len(match[0].lstrip())]
        start = low + match.start() + len(lead)
        begin = code.rfind("\n", 0, start) + 1
        head = code[begin:at]
        end = at if kind in ("field", "property", "enum_variant") else nesting.end(at)
        if kind == "function" and language == "rust" and parent:
            kind = "method" if _SELF.match(code[at : at + 400]) else "function"
        if not described:
            found.append((at, end, {"name": name, "kind": kind}))
            return
        visible = _visibility(language, name, head, parent is not None)
        stop = min([p for p in (code.find("{", at), code.find(";", at)) if p >= 0] or [len(code)])
        first = line_of(begin)
        found.append((at, end, {
            "what": "symbol", "name": name, "qualified_name": f"{parent}.{name}" if parent else name, "kind": kind, "line_start": first, "line_end": line_of(end),
            "visibility": "public" if name in listed else visible, "exported": visible == "public" or name in listed, "doc": _doc(lines, first, language),
            "signature": " ".join(content[begin : min(stop, begin + 400)].split()) if kind in ("function", "method") else None,
            "async": "async" in code[begin : at + len(name) + 40] and bool(_ASYNC.search(code[begin : at + len(name) + 40].split("{")[0])), "parent": parent,
        }))

    for kind, pattern, words in _TABLES[language]:
        if (kind in _QUIET and not described) or not any(w in code for w in words):
            continue
        for m in pattern.finditer(code):
            if script and kind in ("constant", "variable") and nesting.depth(m.start()) > 0:
                continue
            add(kind, m, None)
    types = [f for f in found if f[2]["kind"] in ("class", "interface", "enum", "struct", "trait", "impl")]
    for at, end, row in types:
        open_at = code.find("{", at)
        if open_at < 0 or open_at > end:
            continue
        inside = nesting.depth(open_at) + 1
        body = nesting.body(open_at + 1, end, inside)
        name = row["name"].split(" for ")[-1].split("<")[0].strip()
        if script or language == "java":
            if row["kind"] == "enum" and language == "java":
                for m in () if not described else re.finditer(rf"(?P<n>{_WORD})\s*(?:\([^)]*\))?\s*(?=[,;]|\s*$)", body.split(";")[0]):
                    add("enum_variant", m, name, open_at + 1)
                continue
            for kind, pattern in _SCRIPT_MEMBERS if script else _JAVA_MEMBERS:
                if (kind in _QUIET and not described) or (kind == "property" and row["kind"] == "interface"):
                    continue
                for m in pattern.finditer(body):
                    add(kind, m, name, open_at + 1)
        elif not described and (language == "rust" or row["kind"] == "struct"):
            pass
        elif language == "rust" and row["kind"] in ("struct", "enum"):
            pattern = rf"(?:pub(?:\([^)]*\))?\s+)?(?P<n>{_WORD})\s*:" if row["kind"] == "struct" else rf"(?m)(?P<n>{_WORD})\s*(?:\([^)]*\)|\{{|=[^,]*)?\s*(?:,|$)"
            for m in re.finditer(pattern, body):
                add("field" if row["kind"] == "struct" else "enum_variant", m, name, open_at + 1)
        elif language == "go":
            pattern = rf"(?m)^[ \t]+(?P<n>{_WORD})\s+[\w\[\]*.]" if row["kind"] == "struct" else rf"(?m)^[ \t]+(?P<n>{_WORD})\s*\("
            for m in re.finditer(pattern, body):
                add("field" if row["kind"] == "struct" else "method", m, name, open_at + 1)
        if language == "rust" and row["kind"] in ("impl", "trait"):
            for f in found:
                if at < f[0] < end and f[2]["kind"] == "function" and nesting.depth(f[0]) == inside:
                    self_arg = _SELF.match(code[f[0] : f[0] + 400])
                    f[2].update(kind="method" if self_arg else "function", parent=name, qualified_name=f"{name}.{f[2]['name']}")
    rows = [r for _, _, r in sorted(found, key=lambda f: f[0])] if described else []
    rows += _imports(content, code, language, line_of) if "import" in wanted else []
    return rows + _calls(code, language, found, line_of) if "call" in wanted else rows


def _lines(code: str):
    breaks = [m.start() for m in _BREAK.finditer(code)]
    return lambda at: bisect_left(breaks, at) + 1


def _imports(content: str, code: str, language: str, line_of) -> list[dict]:
    rows = []

    def add(source: str, names: list[str], at: int) -> None:
        rows.append({"what": "import", "name": source, "names": [n for n in names if n], "line_start": line_of(at)})

    if language in ("typescript", "javascript"):
        for m in re.finditer(r"(?m)^\s*import\s+(?:type\s+)?([^;'\"]*?)\s*(?:from\s*)?['\"]([^'\"]+)['\"]", content):
            add(m[2], [re.split(r"\s+as\s+", n.strip())[-1] for n in re.sub(r"[{}]", ",", m[1]).split(",") if n.strip()], m.start(2))
    elif language == "rust":
        for m in re.finditer(r"\buse\s+([^;]+);", code):
            text = " ".join(m[1].split())
            base, _, tail = text.partition("{")
            if tail:
                for n in tail.rstrip("}").split(","):
                    add(base + n.strip().split(" as ")[0], [n.strip().split(" as ")[-1].split("::")[-1]], m.start())
            else:
                add(text.split(" as ")[0], [text.split(" as ")[-1].split("::")[-1]], m.start())
    elif language == "go":
        for block in re.finditer(r"(?m)^import\s*(\((.*?)\)|[^\n]*)", content, re.S):
            for m in re.finditer(r"([\w.]+\s+)?\"([^\"]+)\"", block[0]):
                add(m[2], [(m[1] or m[2].rsplit("/", 1)[-1]).strip()], block.start() + m.start())
    elif language == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", code):
            add(m[1], ["*" if m[2] else m[1].rsplit(".", 1)[-1]], m.start(1))
    return rows


def _called(code: str):
    """The matches of ``_CALL``, in order: each ends at a parenthesis, and without type arguments it holds no other and lies in the word before."""
    if "::<" in code:
        yield from _CALL.finditer(code)
        return
    begin, at = 0, code.find("(")
    while at >= 0:
        words = code[begin:at].rsplit(None, 1)
        if words:
            found = _CALL.search(code, code.rindex(words[-1], begin, at), at + 1)
            if found:
                yield found
        begin, at = at + 1, code.find("(", at + 1)


def _calls(code: str, language: str, found: list, line_of) -> list[dict]:
    rows = []
    owners = sorted((at, end, r["name"]) for at, end, r in found if r["kind"] in ("function", "method"))
    declared = {at for at, _, _ in owners}
    reserved, top = keywords(language), TOPS.get(language, "<module>")
    # calls come in order: an owner that ended before one holds no later one
    opened, next_owner = [], 0
    for m in _called(code):
        name, at = m["n"], m.start("n")
        if name in reserved or at in declared or _DECLARES.search(code[max(0, at - 12) : at]):
            continue
        while next_owner < len(owners) and owners[next_owner][0] < at:
            opened.append(owners[next_owner])
            next_owner += 1
        while opened and opened[-1][1] < at:
            opened.pop()
        rows.append({"what": "call", "name": name, "qualified_name": m["r"], "parent": opened[-1][2] if opened else top, "line_start": line_of(at)})
    return rows
