"""Doc comments of five languages as one structure.

``parse(text, style)`` returns a dict of the fields in ``SCHEMA``; ``column``
is the Arrow-batched form.  A doc comment is a few lines, so each is parsed on
its own.
"""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("jsdoc", "docstring", "rustdoc", "godoc", "javadoc")
SCHEMA = (
    "struct<summary:string,description:string,deprecated:string,see:array<string>,todos:array<string>,"
    "params:array<struct<name:string,type:string,text:string>>,returns:struct<type:string,text:string>,"
    "throws:array<struct<type:string,text:string>>,examples:array<string>,since:string,author:string,"
    "tags:array<struct<name:string,value:string>>,notes:array<string>>"
)


def empty() -> dict:
    return {
        "summary": None, "description": None, "deprecated": None, "see": [], "todos": [], "params": [], "returns": None,
        "throws": [], "examples": [], "since": None, "author": None, "tags": [], "notes": [],
    }


def bare_lines(text: str) -> list[str]:
    """The lines of a comment without its markers."""
    body = re.sub(r"^\s*/\*+!?|\*+/\s*$", "", text.strip())
    return [re.sub(r"^\s*(\*(?!\*) ?|//[/!]? ?)", "", line).rstrip() for line in body.strip("\n").split("\n")]


def _describe(out: dict, lines: list[str], first_sentence: bool = False) -> None:
    told = [x.strip() for x in lines]
    while told and not told[0]:
        told.pop(0)
    while told and not told[-1]:
        told.pop()
    if not told:
        return
    if first_sentence:
        head = " ".join(told[: told.index("") if "" in told else len(told)])
        out["summary"] = re.split(r"(?<=[.!?])\s", head, maxsplit=1)[0]
    else:
        out["summary"] = told[0]
    if len(told) > 1:
        out["description"] = "\n".join(told)


def _tags(lines: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Lines before the first tag, and (tag, text) with continued lines."""
    head, tags = [], []
    for line in lines:
        found = re.match(r"\s*@(\w+)\s*(.*)$", line)
        if found:
            tags.append([found[1], found[2]])
        elif tags:
            tags[-1][1] += "\n" + line
        else:
            head.append(line)
    return head, [(n, v.strip()) for n, v in tags]


def _typed(value: str) -> tuple[str | None, str]:
    found = re.match(r"\{([^}]*)\}\s*(.*)$", value, re.S)
    return (found[1].strip(), found[2]) if found else (None, value)


def _named(value: str) -> tuple[str, str | None]:
    name, _, text = value.partition(" ")
    name = re.sub(r"^\[([^=\]]*).*\]?$", r"\1", name)
    return name.strip(), re.sub(r"^-\s*", "", text.strip()) or None


_INLINE = re.compile(r"\{@(?:link|linkplain|see)\s+([^}|\s]+)[^}]*\}")


def _tagged(lines: list[str], first_sentence: bool) -> dict:
    """JSDoc, TSDoc and Javadoc tags."""
    out = empty()
    head, tags = _tags(lines)
    out["see"] += _INLINE.findall("\n".join(head))
    _describe(out, [_INLINE.sub(r"\1", x) for x in head], first_sentence)
    for name, value in tags:
        kind, rest = _typed(value)
        flat = " ".join(rest.split())
        if name in ("param", "arg", "argument", "typeParam"):
            who, text = _named(flat)
            out["params"].append({"name": who, "type": kind, "text": text})
        elif name in ("returns", "return"):
            out["returns"] = {"type": kind, "text": flat or None}
        elif name in ("throws", "exception", "raise"):
            who, text = (kind, flat or None) if kind else _named(flat)
            out["throws"].append({"type": who, "text": text})
        elif name == "deprecated":
            out["deprecated"] = _INLINE.sub(r"\1", flat) or "Deprecated"
        elif name in ("see", "link"):
            out["see"].append(_INLINE.sub(r"\1", value).strip())
        elif name in ("todo", "fixme"):
            out["todos"].append(flat)
        elif name == "example":
            out["examples"].append(value.strip("\n"))
        elif name in ("since", "version", "author"):
            out["since" if name == "version" and not out["since"] else name if name != "version" else "since"] = flat
        elif name in ("note", "remark", "remarks", "warning"):
            out["notes"].append(flat)
        elif name in ("description", "desc", "summary"):
            out["summary"] = out["summary"] or flat
        else:
            label = {"fileoverview": "module", "group": "category"}.get(name, name)
            out["tags"].append({"name": label, "value": flat})
    return out


def _jsdoc(text: str) -> dict:
    return _tagged(bare_lines(text), False)


def _javadoc(text: str) -> dict:
    body = "\n".join(bare_lines(text))
    examples = [re.sub(r"</?code>", "", e).strip("\n") for e in re.findall(r"<pre>(.*?)</pre>", body, re.S)]
    body = re.sub(r"<pre>.*?</pre>", "", body, flags=re.S)
    body = re.sub(r"\{@code\s+([^}]*)\}", r"`\1`", body)
    body = re.sub(r"\{@inheritDoc\}", "", body)
    body = re.sub(r"</?[A-Za-z][^>]*>", "", body)
    out = _tagged(body.split("\n"), True)
    out["examples"] = examples + out["examples"]
    return out


_SECTIONS = {
    "args": "params", "arguments": "params", "parameters": "params", "params": "params", "other parameters": "params",
    "keyword args": "params", "attributes": "attributes", "returns": "returns", "return": "returns", "yields": "returns",
    "raises": "throws", "throws": "throws", "except": "throws", "example": "examples", "examples": "examples",
    "note": "notes", "notes": "notes", "warning": "notes", "warnings": "notes", "see also": "see", "todo": "todos",
    "references": "see", "deprecated": "deprecated",
}


def docstring_style(text: str) -> str:
    """sphinx, google, numpy or plain: the first line that shows one decides."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if re.match(r"\s*:(param|type|returns?|rtype|raises?)\b", line):
            return "sphinx"
        if re.match(r"\s*(" + "|".join(_SECTIONS) + r"):\s*$", line, re.I):
            return "google"
        if line.strip().lower() in _SECTIONS and i + 1 < len(lines) and re.match(r"\s*-{3,}\s*$", lines[i + 1]):
            return "numpy"
    return "plain"


def _docstring(text: str) -> dict:
    body = re.sub(r'^\s*[rbuRBU]*("""|\'\'\')|("""|\'\'\')\s*$', "", text)
    first, _, rest = body.partition("\n")
    body = first.strip() + ("\n" + textwrap.dedent(rest) if rest else "")
    style = docstring_style(body)
    return _sphinx(body) if style == "sphinx" else _sectioned(body, style == "numpy") if style != "plain" else _plain(body)


def _plain(body: str) -> dict:
    out = empty()
    _describe(out, body.split("\n"))
    return out


def _sphinx(body: str) -> dict:
    out, types, head, fields = empty(), {}, [], []
    for line in body.split("\n"):
        found = re.match(r"\s*:(\w+)(?:\s+([^:]*))?:\s*(.*)$", line)
        if found:
            fields.append([found[1], (found[2] or "").strip(), found[3]])
        elif fields and line.strip():
            fields[-1][2] += " " + line.strip()
        else:
            head.append(line)
    _describe(out, head)
    returned: dict = {}
    for tag, name, value in fields:
        if tag in ("param", "parameter", "arg"):
            kind, _, who = name.rpartition(" ")
            out["params"].append({"name": who, "type": kind or None, "text": value or None})
        elif tag == "type":
            types[name] = value
        elif tag in ("return", "returns"):
            returned["text"] = value
        elif tag == "rtype":
            returned["type"] = value
        elif tag in ("raise", "raises", "except"):
            out["throws"].append({"type": name, "text": value or None})
        elif tag == "deprecated":
            out["deprecated"] = value or name
        elif tag in ("seealso", "see"):
            out["see"].append(value)
        elif tag in ("note", "warning"):
            out["notes"].append(value)
        else:
            out["tags"].append({"name": tag, "value": value})
    for p in out["params"]:
        p["type"] = p["type"] or types.get(p["name"])
    if returned:
        out["returns"] = {"type": returned.get("type"), "text": returned.get("text")}
    return out


def _sectioned(body: str, numpy: bool) -> dict:
    out, head, sections, lines = empty(), [], [], body.split("\n")
    i = 0
    while i < len(lines):
        name = lines[i].strip().rstrip(":").lower()
        ruled = i + 1 < len(lines) and re.match(r"\s*-{3,}\s*$", lines[i + 1])
        if name in _SECTIONS and (ruled if numpy else lines[i].rstrip().endswith(":")):
            sections.append((_SECTIONS[name], []))
            i += 2 if numpy else 1
            continue
        (sections[-1][1] if sections else head).append(lines[i])
        i += 1
    _describe(out, head)
    for kind, rows in sections:
        block = textwrap.dedent("\n".join(rows)).strip("\n")
        items = _items(block, numpy)
        if kind == "params":
            out["params"] += [{"name": n.split(",")[0].strip("* "), "type": t, "text": d} for n, t, d in items]
        elif kind == "throws":
            out["throws"] += [{"type": n, "text": d} for n, _, d in items]
        elif kind == "returns" and block:
            if numpy:
                n, t, d = items[0] if items else (block, None, None)
                out["returns"] = {"type": t or n, "text": d}
            else:
                found = re.match(r"([\w\[\], .|]+):\s+(.*)$", block, re.S)
                out["returns"] = {"type": found[1] if found else None, "text": " ".join((found[2] if found else block).split())}
        elif kind == "examples" and block:
            out["examples"].append(block)
        elif kind in ("notes", "see", "todos") and block:
            out[kind] += [" ".join(x.split()) for x in (block.split("\n") if kind == "see" else [block]) if x.strip()]
        elif kind == "deprecated" and block:
            out["deprecated"] = " ".join(block.split())
    return out


def _items(block: str, numpy: bool) -> list[tuple[str, str | None, str | None]]:
    """(name, type, text) of unindented entries and the indented lines below them."""
    found: list[list] = []
    for line in block.split("\n"):
        if line[:1].strip():
            if numpy:
                name, _, kind = line.partition(" : ")
                found.append([name.strip(), kind.strip() or None, []])
            else:
                entry = re.match(r"(\*{0,2}[\w.]+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$", line)
                found.append([entry[1], entry[2], [entry[3]]] if entry else [line.strip(), None, []])
        elif found and line.strip():
            found[-1][2].append(line.strip())
    return [(n, t, " ".join(x for x in d if x) or None) for n, t, d in found]


def _rustdoc(text: str) -> dict:
    out, sections, fenced = empty(), [("", [])], False
    for line in bare_lines(text):
        if line.strip().startswith("```"):
            fenced = not fenced
        title = None if fenced else re.match(r"#+\s*(\w[\w ]*)$", line.strip())
        if title:
            sections.append((title[1].lower(), []))
        else:
            sections[-1][1].append(line)
    _describe(out, sections[0][1])
    told = "\n".join(sections[0][1])
    out["see"] = [r for r in re.findall(r"\[`?([A-Z]\w*(?:::\w+)*)`?\](?!\()", told) if r.split("::")[0] not in ("Self", "self", "crate", "super")]
    for title, rows in sections[1:]:
        block = "\n".join(rows).strip("\n")
        flat = " ".join(block.split())
        if title.startswith("argument") or title.startswith("parameter"):
            out["params"] += [{"name": n, "type": None, "text": t} for n, t in re.findall(r"(?m)^\s*[*-]\s*`?(\w+)`?\s*[-:]\s*(.*)$", block)]
        elif title.startswith("return"):
            out["returns"] = {"type": None, "text": flat}
        elif title.startswith(("panic", "error", "safety")):
            out["notes"].append(f"{title.capitalize()}: {flat}")
            out["tags"].append({"name": title.rstrip("s") if title != "safety" else title, "value": flat})
            if title.startswith("error"):
                out["throws"].append({"type": "Error", "text": flat})
        elif title.startswith("example"):
            out["examples"] += [e.strip("\n") for e in re.findall(r"```[^\n]*\n(.*?)```", block, re.S)] or [block]
        elif title == "deprecated":
            out["deprecated"] = flat
        elif flat:
            out["notes"].append(flat)
    return out


def _godoc(text: str) -> dict:
    out, head, code = empty(), [], []
    refs = False
    for line in bare_lines(text):
        entry = re.match(r"(Deprecated|BUG|TODO|FIXME|XXX)(?:\((\w+)\))?:?\s+(.*)$", line.strip())
        if re.match(r"See also:?\s*$", line.strip()):
            refs = True
        elif refs and re.match(r"\s*[-*]\s+", line):
            out["see"].append(re.sub(r"^\s*[-*]\s+", "", line).strip())
        elif entry and entry[1] == "Deprecated":
            out["deprecated"] = entry[3]
        elif entry and entry[1] == "BUG":
            out["notes"].append(f"BUG({entry[2] or 'unknown'}): {entry[3]}")
        elif entry:
            out["todos"].append(entry[3])
        elif re.match(r"(\t| {2,})\S", line):
            code.append(line)
            refs = False
        else:
            head.append(line)
            refs = refs and not line.strip()
    _describe(out, head, True)
    out["see"] += [r for r in re.findall(r"\[(\*?[A-Z][\w.]*)\]", "\n".join(head)) if r not in out["see"]]
    if code:
        out["examples"].append(textwrap.dedent("\n".join(code)))
    return out


_PARSERS = {"jsdoc": _jsdoc, "docstring": _docstring, "rustdoc": _rustdoc, "godoc": _godoc, "javadoc": _javadoc}


def parse(text: str | None, style: str | None) -> dict:
    """The fields of one comment; unknown styles and empty texts have none."""
    if not text or style not in _PARSERS:
        return empty()
    return _PARSERS[style](text)


def column(text: Column, style: Column) -> Column:
    """The fields of ``SCHEMA``, parsed in Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def parsed(texts: pd.Series, styles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t, s) for t, s in zip(texts, styles, strict=True)], columns=list(empty()))

    return parsed(text, style)


def style_of(language: Column) -> Column:
    """The comment style of a language."""
    return (
        F.when(language.isin("typescript", "javascript"), "jsdoc")
        .when(language == "python", "docstring")
        .when(language == "rust", "rustdoc")
        .when(language == "go", "godoc")
        .when(language.isin("java", "kotlin"), "javadoc")
    )
