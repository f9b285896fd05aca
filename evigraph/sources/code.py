"""C++ and C# extraction by a tokeniser, exposed as table functions.

A documented subset: includes, macro uses, namespaces, class, struct and enum heads with bases, fields, functions (declared, inline,
defined), calls and control keywords for C++; classes with bases, fields, methods and ordered operations for C#. Files are independent
rows, so a lost executor repeats only its own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*|[A-Za-z_]\w*|\d[\w.]*|::|->|=>|\+=|[^\s\w]', re.S | re.M)
CONTROL = {"if", "for", "while", "switch", "catch", "foreach", "do", "else", "return", "try", "case"}


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, line) without white space and comments; preprocessor lines are one token."""
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        s = m[0]
        if not s.isspace() and not s.startswith(("//", "/*")):
            out.append((s.strip() if s.lstrip().startswith("#") else s, line + (len(s) - len(s.lstrip("\n")) if s.lstrip().startswith("#") else 0)))
        line += s.count("\n")
    return out


def _until(toks, i, opens, closes):
    depth = 0
    while i < len(toks):
        if toks[i][0] == opens:
            depth += 1
        elif toks[i][0] == closes:
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return len(toks) - 1


def cpp_facts(text: str) -> list[tuple[str, str, str, str, int]]:
    """(kind, name, owner, detail, line): include, macro, type, enum, field, function, call, control."""
    toks, out = tokens(text), []
    scope: list[tuple[str, str, int]] = []  # (what, name, depth at its brace)
    depth, i, start = 0, 0, 0
    where = lambda: "::".join(n for w, n, _ in scope if w in ("namespace", "type") and n)
    body = lambda: next((n for w, n, _ in reversed(scope) if w == "function"), None)
    while i < len(toks):
        s, line = toks[i]
        if s.startswith("#"):
            m = re.match(r'#\s*include\s*([<"][^>"]+[>"])', s)
            if m:
                out.append(("include", m[1].strip('<>"'), "", "system" if m[1][0] == "<" else "local", line))
            elif s.startswith("#"):
                m = re.match(r"#\s*define\s+(\w+)", s)
                if m:
                    out.append(("define", m[1], "", "", line))
            i += 1
            start = i
            continue
        inside = body()
        if inside is None and re.fullmatch(r"U?(?:CLASS|STRUCT|ENUM|FUNCTION|PROPERTY|INTERFACE|META|GENERATED_BODY|[A-Z][A-Z0-9_]{3,})|GENERATED_BODY", s) and i + 1 < len(toks) and toks[i + 1][0] == "(":
            end = _until(toks, i + 1, "(", ")")
            out.append(("macro", s, where(), " ".join(t for t, _ in toks[i + 2 : end]), line))
            i = end + 1
            start = i
            continue
        if inside is None and s == "namespace" and i + 1 < len(toks):
            j, name = i + 1, ""
            while j < len(toks) and toks[j][0] not in ("{", ";"):
                name += toks[j][0]
                j += 1
            if j < len(toks) and toks[j][0] == "{":
                scope.append(("namespace", name, depth))
                depth += 1
            i = start = j + 1
            continue
        if inside is None and s in ("class", "struct", "enum") and (i == start or toks[i - 1][0] in (";", "}", "{", ":", ">")):
            j, head = i + 1, []
            while j < len(toks) and toks[j][0] not in ("{", ";", "(", "="):
                head.append(toks[j][0])
                j += 1
            if j < len(toks) and toks[j][0] == "{":
                names = head[: head.index(":")] if ":" in head else head
                names = [n for n in names if re.fullmatch(r"\w+", n) and n not in ("class", "struct", "final") and not n.endswith("_API")]
                bases = [b for b in re.split(",", "".join(x if x in ("::", "<", ">", ",") else f" {x} " for x in head[head.index(":") + 1 :]))] if ":" in head else []
                bases = [re.sub(r"\s+", "", re.sub(r"\b(public|protected|private|virtual)\b", "", b)) for b in bases]
                name = names[-1] if names else ""
                out.append(("enum" if s == "enum" else "type", name, where(), ",".join(b for b in bases if b), line))
                if s == "enum":
                    i = start = _until(toks, j, "{", "}") + 1
                    continue
                scope.append(("type", name, depth))
                depth += 1
                i = start = j + 1
                continue
        if inside is not None and s in CONTROL:
            out.append(("control", s, inside, "", line))
        elif inside is not None and s == "(" and i and re.fullmatch(r"\w+", toks[i - 1][0]) and toks[i - 1][0] not in CONTROL:
            j, callee = i - 1, toks[i - 1][0]
            while j >= 2 and toks[j - 1][0] in ("::", ".", "->") and re.fullmatch(r"\w+|\)", toks[j - 2][0]):
                callee = toks[j - 2][0] + toks[j - 1][0] + callee
                j -= 2
            end = _until(toks, i, "(", ")")
            out.append(("call", callee, inside, " ".join(t for t, _ in toks[i + 1 : end]), line))
        if s == "{":
            if inside is None:
                head = [t for t, _ in toks[start:i]]
                if "(" in head:
                    k = head.index("(")
                    named = re.search(r"((?:\w+::)*~?\w+)$", " ".join(head[:k]).replace(" :: ", "::"))
                    name = named[1] if named else "".join(head[:k])
                    qualified = "::".join(x for x in (where(), name) if x)
                    out.append(("function", qualified, where(), "inline" if scope and scope[-1][0] == "type" else "definition", toks[start][1]))
                    scope.append(("function", qualified, depth))
                else:
                    scope.append(("block", "", depth))
            depth += 1
            start = i + 1
        elif s == "}":
            depth -= 1
            while scope and scope[-1][2] >= depth:
                scope.pop()
            start = i + 1
        elif s == ";":
            if inside is None:
                head = [t for t, _ in toks[start:i]]
                if "(" in head and head.index("(") > 0 and "=" not in head[: head.index("(")] and head[0] not in ("using", "typedef", "friend"):
                    m = re.search(r"((?:\w+::)*~?\w+)$", " ".join(head[: head.index("(")]).replace(" :: ", "::"))
                    if m and len(head[: head.index("(")]) > 1:
                        out.append(("function", "::".join(x for x in (where(), m[1]) if x), where(), "declaration", toks[start][1]))
                elif scope and scope[-1][0] == "type" and len(head) >= 2 and head[0] not in ("using", "typedef", "friend", "public", "private"):
                    plain = head[: head.index("=")] if "=" in head else head
                    names = [t for t in plain if re.fullmatch(r"\w+", t)]
                    if len(names) >= 2:
                        cut = len(plain) - 1 - plain[::-1].index(names[-1])
                        out.append(("field", names[-1], where(), " ".join(plain[:cut]), toks[start][1]))
            start = i + 1
        elif s == ":" and inside is None and i and toks[i - 1][0] in ("public", "protected", "private"):
            start = i + 1
        i += 1
    return out


def cs_facts(text: str) -> list[tuple[str, str, str, str, int]]:
    """(kind, name, owner, detail, line): class (detail: bases), method, call (detail: arguments), assign (detail: value)."""
    toks, out = tokens(text), []
    scope: list[tuple[str, str, int]] = []
    depth, i, start = 0, 0, 0
    while i < len(toks):
        s, line = toks[i]
        owner = next((n for w, n, _ in reversed(scope) if w in ("class", "method")), "")
        inside = next((n for w, n, _ in reversed(scope) if w == "method"), None)
        if s == "class" and i + 1 < len(toks):
            j = i + 2
            while j < len(toks) and toks[j][0] != "{":
                j += 1
            head = [t for t, _ in toks[i + 2 : j]]
            bases = "".join(head[1:]) if head[:1] == [":"] else ""
            out.append(("class", toks[i + 1][0], owner, bases, line))
            scope.append(("class", toks[i + 1][0], depth))
            depth += 1
            i = start = j + 1
            continue
        if s == "{":
            head = [t for t, _ in toks[start:i]]
            if inside is not None and head.count("(") > head.count(")"):  # an initialiser inside a call
                i = _until(toks, i, "{", "}") + 1
                continue
            if inside is None and "(" in head:
                name = head[head.index("(") - 1]
                out.append(("method", name, owner, "constructor" if name == owner else "", toks[start][1]))
                scope.append(("method", name, depth))
            else:
                scope.append(("block", "", depth))
            depth += 1
            start = i + 1
        elif s == "}":
            depth -= 1
            while scope and scope[-1][2] >= depth:
                scope.pop()
            start = i + 1
        elif s == ";":
            head = [t for t, _ in toks[start:i]]
            if inside is not None and head:
                eq = next((k for k, t in enumerate(head) if t in ("=", "+=")), None)
                par = head.index("(") if "(" in head else None
                if eq is not None and (par is None or eq < par):
                    out.append(("assign", "".join(head[:eq]), inside, " ".join(head[eq + 1 :]), toks[start][1]))
                elif par:
                    out.append(("call", "".join(head[:par]), inside, " ".join(head[par + 1 : -1]), toks[start][1]))
            start = i + 1
        i += 1
    return out


_SCHEMA = "kind: string, name: string, owner: string, detail: string, line: int"


@udtf(returnType=_SCHEMA)
class CppFacts:
    """Facts of one C++ file."""

    def eval(self, text: str):
        yield from cpp_facts(text or "")


@udtf(returnType=_SCHEMA)
class CsFacts:
    """Facts of one C# file."""

    def eval(self, text: str):
        yield from cs_facts(text or "")


def register(spark: SparkSession) -> None:
    spark.udtf.register("cpp_facts", CppFacts)
    spark.udtf.register("cs_facts", CsFacts)


def extract(files: DataFrame, function: str = "cpp_facts", path: str = "path", text: str = "text") -> DataFrame:
    """(path, kind, name, owner, detail, line) of each file, by lateral join with the table function."""
    spark = files.sparkSession
    register(spark)
    return spark.sql(f"SELECT f.{path} AS path, x.* FROM {{files}} f, LATERAL {function}(f.{text}) x", files=files)


def rule_dependencies(facts: DataFrame) -> DataFrame:
    """(path, setting, dependency) of literal Add and AddRange calls in constructors and the helpers that they reach."""
    from pyspark.sql import functions as F

    from ..operators.closure import reach

    calls = facts.filter("kind = 'call'")
    methods = facts.filter("kind = 'method'").select("path", "name", "detail")
    key = lambda c: F.concat_ws("\0", "path", c)
    edges = calls.join(methods.select("path", "name"), ["path", "name"], "left_semi").select(key("owner").alias("src"), key("name").alias("dst"))
    live = reach(edges, methods.filter("detail = 'constructor'").select(key("name").alias("node"))).select("node")
    lit = F.regexp_extract_all("detail", F.lit(r'"([^"]*)"'), F.lit(1))
    adds = calls.filter(F.col("name").rlike(r"\.(Add|AddRange)$")).withColumn("node", key("owner")).join(live, "node", "left_semi")
    return adds.select("path", F.substring_index("name", ".", 1).alias("setting"), F.explode(lit).alias("dependency"), "line")
