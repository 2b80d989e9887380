"""Scanners that read symbols from source text, one text at a time, and the plans that run them.

They are written for the constructs named in each function; what they do not know they leave out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame



def _line_finder(text: str) -> Callable[[int], int]:
    """Line number of an offset, from 1."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_left(ends, at) + 1


# ---- SQL ----------------------------------------------------------------------------------------

_PART = r'(?:\[(?:[^\]]|\]\])+\]|"(?:[^"]|"")+"|[A-Za-z_@#][\w@#$]*)'
_IDENTIFIER = rf"{_PART}(?:\s*\.\s*{_PART}){{0,3}}(?![\w@#$]|\s*\.)"  # a name that is cut off is none
_CREATE = re.compile(
    rf"\b(?P<verb>CREATE(?:\s+OR\s+ALTER)?|ALTER)\s+(?P<kind>PROC(?:EDURE)?|FUNCTION|VIEW|TABLE|TYPE|(?:UNIQUE\s+)?(?:CLUSTERED\s+|NONCLUSTERED\s+)?INDEX)\s+(?P<name>{_IDENTIFIER})", re.I
)
_SQL_KINDS = {"PROC": "storedProcedure", "PROCEDURE": "storedProcedure", "FUNCTION": "sqlFunction", "VIEW": "view", "TABLE": "table", "TYPE": "userDefinedType", "INDEX": "sqlIndex"}
_ANCHORS = re.compile(rf"\b(?P<word>EXEC(?:UTE)?|FROM|JOIN|INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+(?P<name>{_IDENTIFIER})", re.I)
_COLUMN = re.compile(rf"^\s*(?P<name>\[(?:[^\]]|\]\])+\]|\"[^\"]+\"|[A-Za-z_]\w*)\s+(?P<type>\[?[A-Za-z]\w*\]?)", re.I)
_NO_COLUMN = {"constraint", "primary", "foreign", "unique", "check", "index", "key", "period"}
_BATCH_END = re.compile(r"^[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t\r]*$", re.I | re.M)
_GO = re.compile(r"^\s*GO(?:\s+\d+)?\s*;?\s*$", re.I)


def masked_sql(text: str) -> str:
    """Comments and string literals blanked, every offset and line end kept."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"--[^\n]*|/\*.*?(?:\*/|\Z)|N?'(?:[^']|'')*(?:'|\Z)", blank, text, flags=re.S)


def _parts(identifier: str) -> list[str]:
    return [p.strip('[]"').replace("]]", "]") for p in re.findall(_PART, identifier)]


def sql_symbols(text: str) -> list[tuple]:
    """(kind, name, schema, line, end_line) of procedures, functions, views, tables with columns, types and indexes, batch by batch."""
    out = []
    lines = masked_sql(text).split("\n")
    start = 0
    for stop in [i for i, line in enumerate(lines) if _GO.match(line)] + [len(lines)]:
        batch = "\n".join(lines[start:stop])
        line_of = _line_finder(batch)
        last = stop
        while last > start + 1 and not lines[last - 1].strip():
            last -= 1
        for m in _CREATE.finditer(batch):
            if m["verb"].upper() == "ALTER" and m["kind"].upper() in ("TABLE", "INDEX"):
                continue
            kind = _SQL_KINDS[m["kind"].upper().split()[-1]]
            names = _parts(m["name"])
            schema = names[-2] if len(names) > 1 else None
            line = start + line_of(m.start())
            out.append((kind, names[-1], schema, line, last))
            if kind == "table":
                out.extend(("column", name, names[-1], at, at) for name, at in _columns(batch, m.end(), start, line_of))
        start = stop + 1
    return out


def _columns(batch: str, at: int, offset: int, line_of: Callable[[int], int]) -> Iterator[tuple[str, int]]:
    """Columns between the table's brackets, split at commas of the first level."""
    depth, begin = 0, at
    for i in range(at, len(batch)):
        c = batch[i]
        if c == "(":
            depth += 1
            if depth == 1:
                begin = i + 1
        elif c == ")" or (c == "," and depth == 1):
            if depth == 1:
                m = _COLUMN.match(batch[begin:i])
                if m and m["name"].lower() not in _NO_COLUMN:  # quoted, it is a name like any other
                    yield m["name"].strip('[]"'), offset + line_of(begin + m.start("name"))
                begin = i + 1
            if c == ")":
                depth -= 1
                if not depth:
                    return


def sql_calls(text: str) -> list[tuple]:
    """(kind, schema, name, line), each target once per batch; temporary and system objects are left out."""
    out, masked = [], masked_sql(text)
    line_of = _line_finder(masked)
    ends = [(m.start(), m.end()) for m in _BATCH_END.finditer(masked)] + [(len(masked), len(masked))]
    start = 0
    for stop, after in ends:
        seen = set()
        for m in _ANCHORS.finditer(masked[start:stop]):
            names = _parts(m["name"])
            name, schema = names[-1], names[-2] if len(names) > 1 else None
            if name[0] in "#@" or name.lower() in ("inserted", "deleted", "set", "select") or (schema or "").lower() in ("sys", "information_schema"):
                continue
            kind = "sqlExecute" if m["word"].upper().startswith("EXEC") else "sqlRelation"
            key = (kind, (schema or "").lower(), name.lower())
            if key not in seen:
                seen.add(key)
                out.append((kind, schema, name, line_of(start + m.start())))
        start = after
    return out


# ---- XML and HTML -------------------------------------------------------------------------------

_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/)?(?P<name>[A-Za-z_][\w.:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


#: Levels of an element's ancestry that are spelled out.
SHOWN = 64


def xml_elements(text: str) -> list[tuple]:
    """(element_id, parent_id, name, path, line, end_line, attributes, content, is_leaf) in document order.

    path is the ancestry `a > b > c`, below SHOWN levels with `…` for those in between; content is the element's own text, cut to 197 characters and `...`
    above 200. Ends without a start are passed over, elements without an end run to the end of the text.
    """
    rows: list[list] = []
    stack: list[int] = []
    opened: dict[str, int] = {}
    line, at = 1, 0
    for m in _XML.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        piece = m["text"] if m["text"] is not None else m["cdata"]
        if piece is not None:
            if stack and piece.strip():
                rows[stack[-1]][7] = (rows[stack[-1]][7] + " " + piece.strip()).strip()
        elif m["name"] and m["close"]:
            if not opened.get(m["name"]):
                continue
            for depth in range(len(stack) - 1, -1, -1):
                if rows[stack[depth]][2] == m["name"]:
                    for i in stack[depth:]:
                        rows[i][5] = line
                        opened[rows[i][2]] -= 1
                    del stack[depth:]
                    break
        elif m["name"]:
            parent = stack[-1] if stack else None
            if parent is None:
                path = m["name"]
            elif len(stack) < SHOWN:
                path = f"{rows[parent][3]} > {m['name']}"
            else:
                path = f"{rows[stack[SHOWN - 2]][3]} > … > {m['name']}"
            if parent is not None:
                rows[parent][8] = False
            given = [f"{k}={a or b}" for k, a, b in _ATTRIBUTE.findall(m["rest"])]
            end = line + text.count("\n", m.start(), m.end())
            rows.append([len(rows), parent, m["name"], path, line, end, given, "", True])
            if not m["rest"].rstrip().endswith("/"):
                stack.append(len(rows) - 1)
                opened[m["name"]] = opened.get(m["name"], 0) + 1
    last = text.count("\n") + 1
    for i in stack:
        rows[i][5] = last
    for r in rows:
        r[7] = r[7] if len(r[7]) <= 200 else r[7][:197] + "..."
    return [tuple(r) for r in rows]


_HTML = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<(?P<raw>script|style)\b(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<name>[A-Za-z][A-Za-z0-9-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>",
    re.S | re.I,
)


def custom_elements(html: str) -> list[str]:
    """Distinct names of opening tags with a hyphen, in lower case, sorted; `ng-` names, comments, CDATA, scripts and styles are passed over."""
    found, at = set(), 0
    while m := _HTML.search(html, at):
        at = m.end()
        if m["raw"] and not m["attrs"].rstrip().endswith("/"):
            end = re.compile(rf"</{m['raw']}\b", re.I).search(html, at)
            at = end.start() if end else len(html)
        elif m["name"] and "-" in m["name"] and not m["name"].lower().startswith("ng-"):
            found.add(m["name"].lower())
    return sorted(found)


# ---- C#, TypeScript, Rust -----------------------------------------------------------------------

_COMMENT_OR_STRING = {
    "cs": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\$?@\$?\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'",
    "ts": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rs": r"//[^\n]*|/\*.*?(?:\*/|\Z)|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
}
_MODIFIERS = r"(?P<mods>(?:\b(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|const|extern|unsafe|new|export|default|declare|pub(?:\([^)\n]*\))?)\s+){0,8})"
_TYPE = r"[A-Za-z_][\w.]*(?:<[^;{}()]*>)?(?:\[\])?\??"
_PATTERNS = {
    "cs": [
        (re.compile(rf"{_MODIFIERS}\b(?P<kind>class|interface|struct|enum|record)\s+(?P<name>\w+)(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[^{{;]+))?"), None),
        (re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed|extern|new|partial)\s+){{1,8}})(?P<type>{_TYPE})\s+(?P<name>\w+)(?:<[^>(]*>)?\s*\((?P<params>[^)]*)\)"), "method"),
        (re.compile(r"(?P<mods>(?:\b(?:public|private|protected|internal|static)\s+){1,8})(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), "constructor"),
        (re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|internal|static|virtual|override|readonly)\s+){{1,8}})(?P<type>{_TYPE})\s+(?P<name>\w+)\s*(?=\{{|=>)"), "property"),
        (re.compile(rf"(?P<mods>(?:\b(?:public|private|protected|internal|static|readonly|const|volatile)\s+){{1,8}})(?P<type>{_TYPE})\s+(?P<name>\w+)\s*(?=;|=[^>=])"), "field"),
    ],
    "ts": [
        (re.compile(rf"{_MODIFIERS}\b(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:<[^>{{]*>)?(?P<bases>(?:\s+(?:extends|implements)\s+[^{{]+)?)"), None),
        (re.compile(rf"{_MODIFIERS}\bfunction\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\((?P<params>[^)]*)\)"), "function"),
        (re.compile(rf"{_MODIFIERS}\btype\s+(?P<name>\w+)\s*(?:<[^=]*>)?="), "typeAlias"),
        (re.compile(r"^(?P<mods>[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*)(?P<name>(?!(?:if|for|while|switch|catch|return|function)\b)\w+)\s*(?:<[^>(]*>)?\((?P<params>[^)]*)\)\s*(?::\s*[^{;=]+)?(?=\{)", re.M), "method"),
        (re.compile(r"^(?P<mods>(?:export\s+)?)(?:const|let|var)\s+(?P<name>\w+)", re.M), "variable"),
    ],
    "rs": [
        (re.compile(rf"{_MODIFIERS}\b(?P<kind>struct|enum|trait)\s+(?P<name>\w+)"), None),
        (re.compile(rf"{_MODIFIERS}\b(?:(?:async|const|unsafe)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\((?P<params>[^)]*)\)"), "function"),
        (re.compile(rf"{_MODIFIERS}\btype\s+(?P<name>\w+)[^=;]*="), "typeAlias"),
        (re.compile(rf"{_MODIFIERS}\b(?:const|static)\s+(?P<name>[A-Z_][A-Z0-9_]*)\s*:"), "variable"),
    ],
}
_RUST_KINDS = {"trait": "interface"}
_IMPL = re.compile(r"\bimpl(?:<[^>]*>)?\s+(?:(?P<trait>[\w:<>, ]+?)\s+for\s+)?(?P<name>\w+)[^{;]*(?=\{)")
_CALL = re.compile(r"(?:(?P<receiver>[A-Za-z_]\w*)\s*(?:\.|::|\?\.)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:<[\w, ]+>)?\(")
_NOT_CALLS = set("if for while switch catch return using lock foreach match nameof typeof sizeof when fn function await throw new else in is as loop unsafe where".split())
_BRANCHES = {
    "cs": r"\b(?:if|for|foreach|while|do|switch|catch)\b|\?(?![?.\[:>])(?=[^;\n]*:)",
    "ts": r"\b(?:if|for|while|do|switch|catch)\b|\?(?![?.:)])(?=[^;\n]*:)",
    "rs": r"\b(?:if|for|while|loop|match)\b",
}
_CASES = {"cs": r"\bcase\b|\bdefault\s*:", "ts": r"\bcase\b", "rs": r"=>"}
_RETURNS = {"cs": r"\b(?:return|throw)\b", "ts": r"\b(?:return|throw)\b", "rs": r"\breturn\b|\?(?=[;.)\s])"}
_LAMBDAS = {"cs": r"=>(?!\s*_)|\bdelegate\b\s*[({]", "ts": r"=>|\bfunction\b\s*\(", "rs": r"(?<![|&\w)])\|[^|\n]*\|(?!\|)"}


def masked_code(text: str, language: str) -> str:
    """Comments and literals blanked, every offset and line end kept."""
    return re.sub(_COMMENT_OR_STRING[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _brace_ends(code: str) -> dict[int, int]:
    """Closing brace of every opening one; the end of the text for those that are never closed."""
    ends, open_ = {}, []
    for m in re.finditer("[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.start()
    return ends | dict.fromkeys(open_, len(code))


def _block(code: str, at: int, ends: dict[int, int]) -> tuple[int, int] | None:
    """(start, end) of the braces that follow, unless a statement ends before."""
    m = re.compile("[{;]").search(code, at)
    return (m.start(), ends[m.start()]) if m and m[0] == "{" else None


def complexity(body: str, language: str) -> tuple[int, int, int, int, int]:
    """(cyclomatic, cognitive, deepest nesting, returns, lambdas) of a body without comments and literals.

    Cyclomatic: 1 and one per branch, logical operator and case. Cognitive: 1 and the nesting per branch,
    1 per else that starts no further branch and per run of one logical operator. A brace opened by a
    branch, try or lambda nests.
    """
    token = re.compile(rf"(?P<branch>{_BRANCHES[language]})|(?P<else>\belse\b(?!\s+if\b))|(?P<op>&&|\|\|)|(?P<try>\btry\b)|(?P<lam>{_LAMBDAS[language]})|[{{}};]")
    cyclomatic, cognitive, deepest, lambdas = 1, 0, 0, 0
    stack: list[bool] = []
    nesting = 0  # nesting blocks on the stack
    pending, operator = False, None
    for m in token.finditer(body):
        if m["branch"]:
            cyclomatic += 1
            else_if = body[max(0, m.start() - 16) : m.start()].rstrip().endswith("else")
            cognitive += 1 + (0 if else_if else nesting)
            pending, deepest, operator = True, max(deepest, nesting + 1), None
        elif m["else"]:
            cognitive += 1
            pending = True
        elif m["op"]:
            cyclomatic += 1
            cognitive += operator != m["op"]
            operator = m["op"]
        elif m["try"] or m["lam"]:
            lambdas += bool(m["lam"])
            pending, deepest = True, max(deepest, nesting + 1)
        elif m[0] == "{":
            stack.append(pending)
            nesting += pending
            pending, operator = False, None
        elif m[0] == "}":
            if stack:
                nesting -= stack.pop()
            pending, operator = False, None
        else:
            pending, operator = False, None
    cyclomatic += len(re.findall(_CASES[language], body))
    return cyclomatic, cognitive, deepest, len(re.findall(_RETURNS[language], body)), lambdas


def code_symbols(text: str, language: str) -> list[tuple]:
    """(kind, name, parent, line, end_line, modifiers, bases, params, cyclomatic, cognitive, nesting, returns, lambdas) of a C#, TypeScript or Rust text."""
    code = masked_code(text, language)
    found: list[tuple] = []
    taken: set[int] = set()
    line_of, ends = _line_finder(code), _brace_ends(code)
    for pattern, fixed in _PATTERNS[language]:
        for m in pattern.finditer(code):
            if m.start("name") in taken or m["name"] in _NOT_CALLS:
                continue
            groups = m.groupdict()
            kind = fixed or _RUST_KINDS.get(groups["kind"], groups["kind"])
            taken.add(m.start("name"))
            block = _block(code, m.end(), ends) if kind not in ("field", "variable", "typeAlias") else None
            bases = [b.strip() for b in re.split(r",(?![^<]*>)|\bextends\b|\bimplements\b", groups.get("bases") or "") if b.strip()]
            found.append((m.start("name"), block[1] if block else m.end(), kind, m["name"], (groups.get("mods") or "").split(), bases, groups.get("params"), block))
    owners = [(f[0], f[1], f[3]) for f in found if f[2] in ("class", "interface", "struct", "enum", "record") and f[7]]
    if language == "rs":
        blocks = [(m.start("name"), _block(code, m.end(), ends), m["name"]) for m in _IMPL.finditer(code)]
        owners += [(at, block[1], name) for at, block, name in blocks if block]
    out = []
    waiting, around = sorted(owners, reverse=True), []
    for at, end, kind, name, mods, bases, params, block in sorted(found):
        while waiting and waiting[-1][0] < at:  # owners begun so far, of which the finished ones are let go
            owner = waiting.pop()
            while around and around[-1][1] < owner[0]:
                around.pop()
            around.append(owner)
        while around and around[-1][1] < at:
            around.pop()
        parent = next((o[2] for o in reversed(around) if end <= o[1]), None)
        if language == "rs" and kind == "function" and parent:
            kind = "method"
        n = len([p for p in re.split(r",(?![^<(]*[>)])", params) if p.strip()]) if params is not None else None
        stats = complexity(code[block[0] + 1 : block[1]], language) if block and kind in ("method", "constructor", "function") else (None,) * 5
        out.append((kind, name, parent, line_of(at), line_of(end), mods, bases, n, *stats))
    return out


_TYPED = {
    "cs": re.compile(rf"\b(?P<type>[A-Z]\w*(?:<[^;{{}}()=]*>)?)\??\s+(?P<name>[a-z_]\w*)\s*(?=[;,)=])|\b(?:var|{_TYPE})\s+(?P<local>\w+)\s*=\s*(?:await\s+)?(?:new\s+(?P<made>[A-Z]\w*)|\(\s*(?P<cast>[A-Z]\w*)\s*\)|[^;\n]*?\bas\s+(?P<as>[A-Z]\w*))|\bis\s+(?P<is>[A-Z]\w*)\s+(?P<pattern>[a-z_]\w*)"),
    "ts": re.compile(r"\b(?P<name>\w+)\s*\??:\s*(?P<type>[A-Z]\w*)|\b(?:const|let|var)\s+(?P<local>\w+)\s*=\s*(?:await\s+)?(?:new\s+(?P<made>[A-Z]\w*)|[^;\n]*?\bas\s+(?P<as>[A-Z]\w*))"),
    "rs": re.compile(r"\b(?P<name>[a-z_]\w*)\s*:\s*&?(?:mut\s+)?(?P<type>[A-Z]\w*)|\blet\s+(?:mut\s+)?(?P<local>\w+)\s*=\s*(?P<made>[A-Z]\w*)(?:::|\s*\{)"),
}


def declared_types(code: str, language: str) -> dict[str, str]:
    """Types of names in a stretch of code: fields, parameters, and locals made, cast or matched; the first declaration holds."""
    out: dict[str, str] = {}
    for m in _TYPED[language].finditer(code):
        g = m.groupdict()
        name = g.get("name") or g.get("local") or g.get("pattern")
        kind = g.get("type") or g.get("made") or g.get("cast") or g.get("as") or g.get("is")
        if name and kind:
            out.setdefault(name, kind.split("<")[0])
    return out


def code_calls(text: str, language: str) -> list[tuple]:
    """(caller, caller_class, ordinal, name, receiver, receiver_type, line) of calls inside methods and functions.

    receiver_type is what the method's own declarations say of the receiver, else the file's fields.
    """
    code = masked_code(text, language)
    out = []
    lines = code.split("\n")
    whole = declared_types(code, language)
    for s in code_symbols(text, language):
        if s[0] not in ("method", "function", "constructor"):
            continue
        body = "\n".join(lines[s[3] - 1 : s[4]])
        known = {**whole, **declared_types(body, language)}
        start = body.find("{")
        for ordinal, m in enumerate(m for m in _CALL.finditer(body, max(start, 0)) if m["name"] not in _NOT_CALLS):
            receiver = m["receiver"]
            kind = s[2] if receiver in ("this", "self", "Self") else receiver if receiver and receiver[0].isupper() else known.get(receiver)
            out.append((s[1], s[2], ordinal, m["name"], receiver, kind, s[3] + body.count("\n", 0, m.start("name"))))
    return out


def extension_methods(text: str) -> list[tuple]:
    """(method, class, extended type, line) of C# extension methods: static, with `this` before the first parameter."""
    code = masked_code(text, "cs")
    line_of = _line_finder(code)
    owners = [(m.start(), m["name"]) for m in re.finditer(r"\bstatic\s+(?:partial\s+)?class\s+(?P<name>\w+)", code)]
    out = []
    for m in re.finditer(rf"\bstatic\s+(?:async\s+)?{_TYPE}\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\(\s*this\s+(?P<type>[A-Za-z_]\w*)", code):
        before = [n for at, n in owners if at < m.start()]
        if before:
            out.append((m["name"], before[-1], m["type"], line_of(m.start("name"))))
    return out


# ---- plans --------------------------------------------------------------------------------------

_SCHEMAS = {
    "sql_symbols": "kind string, name string, schema string, line int, end_line int",
    "sql_calls": "kind string, schema string, name string, line int",
    "xml_elements": "element_id int, parent_id int, name string, path string, line int, end_line int, attributes array<string>, content string, is_leaf boolean",
    "code_symbols": "kind string, name string, parent string, line int, end_line int, modifiers array<string>, bases array<string>, params int, cyclomatic int, cognitive int, nesting int, returns int, lambdas int",
    "code_calls": "caller string, caller_class string, ordinal int, name string, receiver string, receiver_type string, line int",
    "extension_methods": "name string, class_name string, extended string, line int",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def parsed(files: DataFrame, what: str, language: str | None = None) -> DataFrame:
    """Rows of one scanner over files (file_id, text), with file_id in front; texts of any length are read whole."""
    scan: Callable = globals()[what]
    fields = [f.rsplit(" ", 1) for f in _SCHEMAS[what].split(", ")]
    schema = pa.schema([("file_id", pa.int64()), *[(n, _ARROW[t]) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(file, *r) for r in (scan(text, language) if language else scan(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.where("text is not null").select("file_id", "text").mapInArrow(run, "file_id long, " + _SCHEMAS[what])
