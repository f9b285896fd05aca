"""Scalar functions over paths, names, references, macros and declarations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- paths -----------------------------------------------------------------------------------


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def leaf(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(leaf(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(leaf(path), r"\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"/?[^/]*$", "")


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``, or null outside."""
    base = F.concat(F.regexp_replace(slashes(root), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(slashes(path), base), F.substr(slashes(path), F.length(base) + 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, the nearest last, each with its depth: array of (dir, depth)."""
    parts = F.split(slashes(path), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))


#: Directories that source scans do not enter, by exact name; that file graphs do not enter, in any case; that configuration scans do not enter.
SKIPPED = (".git", ".idea", ".vs", "Binaries", "DerivedDataCache", "Intermediate", "Saved")
SKIPPED_FOLDED = (".git", "binaries", "deriveddatacache", "intermediate", "saved")
SKIPPED_CONFIG = ("Binaries", "Intermediate", "Saved")


def in_skipped(path: Column, skipped=SKIPPED, folded: bool = False) -> Column:
    """Whether a directory of the path is one that scans leave out."""
    segments = F.split(slashes(path), "/")
    return F.exists(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: (F.lower(s) if folded else s).isin(*skipped))


#: Extensions of headers and of other sources, and marks of generated file names.
HEADERS, SOURCES = (".h", ".hh", ".hpp", ".hxx", ".inl", ".ipp"), (".cpp", ".cc", ".cxx", ".mm")
GENERATED = (".generated.", ".autogen.")


def is_generated(name: Column) -> Column:
    """Whether a file name says that a tool wrote the file: a mark anywhere in it, or ``.gen`` before a source extension."""
    n = F.lower(name)
    return F.exists(F.array(*[F.lit(m) for m in GENERATED]), lambda m: F.contains(n, m)) | F.exists(F.array(*[F.lit(f".gen{x}") for x in (*HEADERS, *SOURCES)]), lambda x: F.endswith(n, x))


def source_kind(path: Column) -> Column:
    return F.when(suffix(path).isin(*HEADERS), "header").when(suffix(path).isin(*SOURCES), "source").otherwise("other")


def visibility(rel: Column) -> Column:
    """public (below Public or Classes), private or unclassified by the first directory; files at the top are unclassified."""
    parts = F.split(slashes(rel), "/")
    first = F.when(F.size(parts) >= 2, F.lower(F.element_at(parts, 1)))
    return F.when(first.isin("public", "classes"), "public").when(first == "private", "private").otherwise("unclassified")


# --- references ------------------------------------------------------------------------------

#: An object path, perhaps in its class wrapper, and a tag in a struct's text.
OBJECT_PATH = r"(?:([A-Za-z_][\w:]*)')?(/[A-Za-z_]\w*/[^'\s,)\]]+)'?"
TAG = r"(?:TagName|GameplayTag)\s*=\s*\"([^\"]+)"


def object_path(value: Column) -> Column:
    """A reference without quotes and without its class wrapper, with slashes: ``Class'/Path/X.X'`` to ``/Path/X.X``."""
    plain = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    return slashes(F.coalesce(F.nullif(F.regexp_extract(plain, r"^[A-Za-z0-9_.:/]*'([^']+)'?$", 1), F.lit("")), plain))


def references(text: Column) -> Column:
    """Distinct sorted (kind, target) in a string: object paths (class from a script root or in a wrapper that ends in Class, else asset) and tags."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(OBJECT_PATH), F.lit(1)).alias("w"), F.transform(F.regexp_extract_all(text, F.lit(OBJECT_PATH), F.lit(2)), object_path).alias("p"))
    is_class = lambda x: F.startswith(x["p"], F.lit("/Script/")) | F.endswith(x["w"], F.lit("Class"))
    paths = F.transform(both, lambda x: F.struct(F.when(is_class(x), "class").otherwise("asset").alias("kind"), x["p"].alias("target")))
    named = F.filter(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda t: F.trim(t)), lambda t: t != "")
    tags = F.transform(named, lambda t: F.struct(F.lit("gameplay_tag").alias("kind"), t.alias("target")))
    return F.array_sort(F.array_distinct(F.concat(paths, tags)))


#: Words of a type expression that name no type of the project, and words around types.
IGNORED_TYPES = (
    "bool", "char", "double", "float", "int", "long", "short", "void", "auto", "size_t", "FName", "FString", "FText", "FVector", "FRotator", "FTransform", "FGameplayTag", "TArray", "TMap", "TSet",
    "TObjectPtr", "TWeakObjectPtr", "TSoftObjectPtr", "TSoftClassPtr", "TSubclassOf", "TSharedPtr", "TSharedRef", "TWeakPtr", "TOptional", "std",
)
QUALIFIERS = r"\b(?:class|struct|enum|const|volatile|typename)\b"


def type_names(expression: Column) -> Column:
    """Distinct short type names of an expression in order, template arguments included, without ignored ones and those that begin in lower case."""
    names = F.regexp_extract_all(F.regexp_replace(expression, QUALIFIERS, " "), F.lit(r"\b([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)\b"), F.lit(1))
    short = F.transform(names, lambda n: F.substring_index(n, "::", -1))
    return F.array_distinct(F.filter(short, lambda n: ~n.isin(*IGNORED_TYPES) & ~n.rlike("^[a-z]")))


def primary_type(expression: Column) -> Column:
    """The first type name of an expression without qualifiers, references and template arguments."""
    plain = F.regexp_replace(expression, r"\b(const|volatile|class|struct|enum|typename)\b|[&*]", " ")
    return F.nullif(F.regexp_extract(F.trim(plain), r"^([A-Za-z_][A-Za-z0-9_:]*)", 1), F.lit(""))


def clean_type(expression: Column) -> Column:
    """A type without const, pointers and references, in single spaces; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(expression, r"\bconst\b|[&*]", ""), r"\s+", " ")), F.lit(""))


def looks_like_tag(text: Column) -> Column:
    """Two or more dotted names, and nothing else but quotes around them."""
    return F.regexp_replace(F.trim(text), '^"+|"+$', "").rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")


def pointer_escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def like_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def literal_line(text: Column, literal: Column) -> Column:
    """1-based line of the first occurrence of a literal between quotes (each of either kind); 1 without one; null without a text."""
    quotes = [F.lit(q) for q in "\"'"]
    quoted = F.array(*[F.concat(a, literal, b) for a in quotes for b in quotes])
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda s, i: F.struct(i.alias("i"), F.exists(quoted, lambda q: F.contains(s, q)).alias("has")))
    hit = F.filter(lines, lambda x: x["has"])
    return F.when(text.isNotNull(), F.coalesce(F.get(hit, F.lit(0))["i"] + 1, F.lit(1)))


def version(text: Column) -> Column:
    """(major, minor, patch) of a version string; null where none is read."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"(\d+)\.(\d+)(?:\.(\d+))?", k), F.lit("")).cast("int")
    return F.when(text.rlike(r"\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


#: Members of build rules by what they list, and single members that are assigned.
RULE_KINDS = {
    "PublicDependencyModuleNames": "public_dependency", "PrivateDependencyModuleNames": "private_dependency", "DynamicallyLoadedModuleNames": "dynamic_dependency",
    "PublicIncludePathModuleNames": "public_include_module", "PrivateIncludePathModuleNames": "private_include_module", "PublicIncludePaths": "public_include_path",
    "PrivateIncludePaths": "private_include_path", "PublicSystemIncludePaths": "public_system_include_path", "PublicDefinitions": "public_definition", "PrivateDefinitions": "private_definition",
}
ASSIGNED_KINDS = {"PCHUsage": "pch", "PrivatePCHHeaderFile": "pch", "SharedPCHHeaderFile": "pch", "bEnforceIWYU": "iwyu", "IWYUSupport": "iwyu", "bLegacyPublicIncludePaths": "iwyu"}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def rule_annotation(kind: Column, target: Column) -> Column:
    """(kind, member, action) of a rule's operation, or null: calls of Add, AddRange, Remove and RemoveAll on listed members, and assignments to listed ones.

    ``kind`` tells calls from assignments ("call"); ``target`` is the callee or what is assigned to.
    """
    called = r"(?:^|[.>])([A-Za-z_]\w*)\.(AddRange|Add|Remove|RemoveAll)$"
    member = F.when(kind == "call", F.regexp_extract(target, called, 1)).otherwise(F.substring_index(target, ".", -1))
    action = F.when(kind == "call", F.regexp_extract(target, called, 2)).otherwise("assign")
    what = F.coalesce(_looked_up(RULE_KINDS, member), F.when(kind != "call", _looked_up(ASSIGNED_KINDS, member)))
    return F.when(what.isNotNull(), F.struct(what.alias("kind"), member.alias("member"), action.alias("action")))


#: Calls that fire a delegate, and beginnings of calls that listen to one.
PUBLISHING, SUBSCRIBING = ("Broadcast", "Execute", "ExecuteIfBound"), ("Add", "Bind", "Create", "Register", "Subscribe", "Listen")


def delegate_operation(callee: Column, arguments: Column, owner: Column | None = None, types: Column | None = None) -> Column:
    """(operation, event, owner_type, callback) of a call on a delegate, or null.

    ``callee`` is dotted; its last part is the call and the one before it the event. The event's owner is the type of the part before that in
    ``types`` (name to type expression), else the function's ``owner``. The callback is the first ``&Owner::Name`` among the arguments.
    """
    parts = F.filter(F.split(callee, r"\."), lambda x: x != "")
    api = F.element_at(parts, -1)
    operation = F.when(api.isin(*PUBLISHING), "publish").when(api.rlike(f"^(?:{'|'.join(SUBSCRIBING)})"), "subscribe")
    none = F.lit(None).cast("string")
    root = F.when(F.size(parts) >= 3, F.element_at(parts, -3))
    typed = F.substring_index(F.regexp_replace(types[root], r"\s*[*&]+\s*$", ""), "::", -1) if types is not None else none
    whose = F.coalesce(typed, F.nullif(F.substring_index(owner, "::", -1), F.lit("")) if owner is not None else none)
    callback = F.nullif(F.regexp_extract(arguments, r"&([A-Za-z_]\w*::[A-Za-z_]\w*)", 1), F.lit(""))
    told = F.struct(operation.alias("operation"), F.element_at(parts, -2).alias("event"), whose.alias("owner_type"), callback.alias("callback"))
    return F.when(operation.isNotNull() & (F.size(parts) >= 2), told)


def split_arguments(text: str) -> list[str]:
    """The parts of an argument list at its top-level commas; brackets and strings nest."""
    out, level, part, quote = [], 0, "", ""
    k = 0
    while k < len(text):
        c = text[k]
        if quote:
            part += c
            if c == "\\" and k + 1 < len(text):
                k += 1
                part += text[k]
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote, part = c, part + c
        elif c == "," and level == 0:
            out.append(part.strip())
            part = ""
        else:
            level += (c in "([{<") - (c in ")]}>")
            part += c
        k += 1
    if part.strip() or out:
        out.append(part.strip())
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def macro_arguments(texts: pa.Array) -> pa.Array:
    """Arguments of macro calls (their text between the brackets)."""
    return pa.array([None if t is None else split_arguments(t) for t in texts.to_pylist()], pa.list_(pa.string()))
