"""Python sources, through the language's own parser."""

from __future__ import annotations

import ast

TOP = "<module>"
EVERY = frozenset(("symbol", "import", "call"))


def visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") and not name.startswith("__") else "public"


def extract(content: str, wanted: frozenset[str] = EVERY) -> list[dict]:
    """Rows of the wanted kinds."""
    rows: list[dict] = []
    tree = ast.parse(content)
    _walk(tree, rows, None, TOP, wanted)
    return rows


def _text(node: ast.AST) -> str:
    """The text of a node; names, and names with dots, without the parts that write any expression."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name | ast.Attribute):
        return f"{_text(node.value)}.{node.attr}"
    return ast.unparse(node)


def _arguments(args: ast.arguments) -> str:
    plain = not (args.posonlyargs or args.kwonlyargs or args.vararg or args.kwarg or args.defaults) and all(a.annotation is None for a in args.args)
    return ", ".join(a.arg for a in args.args) if plain else ast.unparse(args)


def _symbol(node, rows: list[dict], parent: str | None, kind: str) -> None:
    shown = visibility(node.name)
    first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
    signature = None
    if kind != "class":
        returns = f" -> {_text(node.returns)}" if node.returns else ""
        signature = f"{node.name}({_arguments(node.args)}){returns}"
    rows.append(
        {
            "what": "symbol", "name": node.name, "qualified_name": f"{parent}.{node.name}" if parent else node.name, "kind": kind,
            "line_start": first, "line_end": node.end_lineno, "visibility": shown, "exported": shown == "public",
            "doc": ast.get_docstring(node), "signature": signature, "async": isinstance(node, ast.AsyncFunctionDef), "parent": parent,
        }
    )


#: Where nodes hold statements, in the order of their fields; no declaration and no import is in an expression.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(node: ast.AST) -> list[ast.AST]:
    """The statements right within a node, handlers and cases too."""
    return [child for name in _BLOCKS if isinstance(held := getattr(node, name, None), list) for child in held]


def _walk(node: ast.AST, rows: list[dict], owner: str | None, caller: str, wanted: frozenset[str]) -> None:
    for child in ast.iter_child_nodes(node) if "call" in wanted else _statements(node):
        if isinstance(child, ast.ClassDef):
            if "symbol" in wanted:
                _symbol(child, rows, owner, "class")
            _walk(child, rows, child.name, caller, wanted)
        elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            if "symbol" in wanted:
                _symbol(child, rows, owner, "method" if owner else "function")
            _walk(child, rows, None, child.name, wanted)
        else:
            if isinstance(child, ast.Import) and "import" in wanted:
                for alias in child.names:
                    rows.append({"what": "import", "name": alias.name, "names": [alias.asname or alias.name], "line_start": child.lineno})
            elif isinstance(child, ast.ImportFrom) and "import" in wanted:
                source = "." * child.level + (child.module or "")
                rows.append({"what": "import", "name": source, "names": [a.asname or a.name for a in child.names], "line_start": child.lineno})
            elif isinstance(child, ast.Call) and "call" in wanted:
                target = child.func
                if isinstance(target, ast.Name):
                    rows.append({"what": "call", "name": target.id, "parent": caller, "line_start": child.lineno})
                elif isinstance(target, ast.Attribute):
                    rows.append({"what": "call", "name": target.attr, "qualified_name": _text(target.value)[:200], "parent": caller, "line_start": child.lineno})
            _walk(child, rows, owner, caller, wanted)
