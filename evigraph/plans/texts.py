"""Text, configuration and file queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import filegraph, fold, graph, resolve, upsert
from ..sources import sinks
from . import adapters as a

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(
    a.sql(
        """, d AS (SELECT *, max(CASE WHEN operator IN ('!', 'set') THEN seq END) OVER (PARTITION BY section, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut FROM decl),
k AS (SELECT * FROM d WHERE cut IS NULL OR seq > cut OR (seq = cut AND operator = 'set')),
m AS (SELECT *, max(CASE WHEN operator = '-' THEN seq END) OVER (PARTITION BY section, key, value) AS gone FROM k),
p AS (SELECT * FROM m WHERE operator <> '-' AND (gone IS NULL OR seq > gone)),
f AS (SELECT *, row_number() OVER (PARTITION BY section, key, value ORDER BY seq) AS r FROM p),
v AS (SELECT section, key, string_agg(value, ',' ORDER BY seq) AS vs FROM f WHERE operator IN ('.', 'set') OR r = 1 GROUP BY 1, 2)
SELECT DISTINCT decl.section, decl.key, coalesce(vs, '') AS folded FROM decl LEFT JOIN v ON v.section = decl.section AND v.key = decl.key""",
        "decl",
    )
)
def config_fold(spark, sf):
    return fold.fold_declarations(a.declarations(spark, sf), ["section", "key"]).select("section", "key", F.array_join("values", ",").alias("folded"))


@query(a.sql("SELECT seq AS declaration_id, lag(seq) OVER (PARTITION BY section, key ORDER BY seq) AS previous FROM decl", "decl"))
def override_chain(spark, sf):
    d = a.declarations(spark, sf).withColumn("declaration_id", F.col("seq"))
    return graph.override_chain(d, ["section", "key"]).select("declaration_id", "previous")


@query(a.sql("SELECT doc_id, line, last_value(CASE WHEN length(text) % 3 = 0 THEN length(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines", "lines"))
def running_section(spark, sf):
    n = F.length("text").cast("long")
    return fold.running_section(a.lines(spark, sf), F.when(n % 3 == 0, n), "doc_id").select("doc_id", "line", "section")


@query("SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (WHERE value > 50), '') AS last_high FROM events GROUP BY 1")
def last_observed(spark, sf):
    e = a.read(spark, sf, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.when(F.col("value") > 50, F.col("event_type")).otherwise("").alias("last_high"))
    return upsert.upsert_nodes(e, first=(), last=("last_high",)).withColumnRenamed("node_id", "user_id")


@query("SELECT lower(o_orderpriority) || '|' || o_custkey AS key, count(*) AS n, arg_min(o_orderkey, o_orderkey) AS first FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, sf):
    o = a.read(spark, sf, "orders").select(F.concat_ws("|", "o_orderpriority", F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("pointer"), F.col("o_orderkey").alias("seq"))
    return fold.duplicate_names(o)


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS s FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY s) AS types FROM f GROUP BY 1")
def ordered_distinct(spark, sf):
    e = a.read(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("seq"))
    return fold.ordered_distinct(e, "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


# an object path: a slash, a name, a slash, and on to a quote, blank, comma or bracket; class by its root
_REFS = r"""x AS (SELECT page_id, list_transform(regexp_extract_all(html, '/[A-Za-z_][A-Za-z0-9_]*/[^''\s,)\]]+'), lambda p: regexp_replace(regexp_replace(p, '"+$', ''), '\\', '/', 'g')) AS ps FROM pages),
r AS (SELECT DISTINCT page_id, CASE WHEN starts_with(p, '/Script/') THEN 'class' ELSE 'asset' END AS kind, p AS target FROM (SELECT page_id, unnest(ps) AS p FROM x))"""


@query(f"WITH {_REFS} SELECT page_id, count(target) AS n, coalesce(string_agg(kind || ' ' || target, chr(10) ORDER BY kind, target), '') AS targets FROM pages LEFT JOIN r USING (page_id) GROUP BY 1")
def refs_extract(spark, sf):
    found = a.read(spark, sf, "pages").select("page_id", t.references(F.col("html")).alias("r"))
    return found.select("page_id", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: F.concat_ws(" ", x["kind"], x["target"])), "\n").alias("targets"))


@query(f"WITH {_REFS} SELECT kind, target, count(*) AS pages FROM r GROUP BY 1, 2")
def refs_unique(spark, sf):
    x = a.read(spark, sf, "pages").select(F.explode(t.references(F.col("html"))).alias("r"))
    return x.groupBy("r.kind", "r.target").agg(F.count("*").alias("pages"))  # distinct within a page already


_TAGGED = "x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '(TagName=\"A.' || event_type || '\")' WHEN 1 THEN 'BlueprintGeneratedClass''/Game/' || event_type || '/U' || user_id || '_C'' GameplayTag = \" T' || user_id || ' \"' WHEN 2 THEN 'Texture2D''/Game/T/' || user_id || '.T:S'', /Script/M.' || event_type ELSE event_type END AS v FROM events)"


@query(f"""WITH {_TAGGED} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'gameplay_tag A.' || event_type WHEN 1 THEN 'class /Game/' || event_type || '/U' || user_id || '_C;gameplay_tag T' || user_id WHEN 2 THEN 'asset /Game/T/' || user_id || '.T:S;class /Script/M.' || event_type ELSE '' END AS refs FROM x JOIN events USING (event_id)""")
def value_references(spark, sf):
    k, user, kind = F.col("event_id") % 4, F.col("user_id").cast("string"), F.col("event_type")
    v = F.when(k == 0, F.concat(F.lit('(TagName="A.'), kind, F.lit('")'))).when(k == 1, F.concat(F.lit("BlueprintGeneratedClass'/Game/"), kind, F.lit("/U"), user, F.lit("_C' GameplayTag = \" T"), user, F.lit(' "'))).when(k == 2, F.concat(F.lit("Texture2D'/Game/T/"), user, F.lit(".T:S', /Script/M."), kind)).otherwise(kind)
    return a.read(spark, sf, "events").select("event_id", F.array_join(F.transform(t.references(v), lambda x: F.concat_ws(" ", x["kind"], x["target"])), ";").alias("refs"))


_IGNORED = "bool char double float int long short void auto size_t FName FString FText FVector FRotator FTransform FGameplayTag TArray TMap TSet TObjectPtr TWeakObjectPtr TSoftObjectPtr TSoftClassPtr TSubclassOf TSharedPtr TSharedRef TWeakPtr TOptional std"


@query(
    f"""WITH x AS (SELECT p_partkey, 'const TArray<N::' || replace(p_name, ' ', '*, ') || '>& ' || CASE p_partkey % 4 WHEN 0 THEN 'TSoftObjectPtr<FVector> UThing' WHEN 1 THEN 'std::Map<A::B, Thing> class Thing' ELSE 'TOptional<Other> _low' END AS e FROM part),
y AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(regexp_replace(e, '\\b(?:class|struct|enum|const|volatile|typename)\\b', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*'), lambda n: string_split(n, '::')[-1]), lambda n: n NOT IN ({', '.join(repr(w) for w in _IGNORED.split())}) AND NOT regexp_matches(n, '^[a-z]')) AS l FROM x)
SELECT p_partkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS names FROM y"""
)
def type_names(spark, sf):
    k = F.col("p_partkey") % 4
    e = F.concat(F.lit("const TArray<N::"), F.replace("p_name", F.lit(" "), F.lit("*, ")), F.lit(">& "), F.when(k == 0, "TSoftObjectPtr<FVector> UThing").when(k == 1, "std::Map<A::B, Thing> class Thing").otherwise("TOptional<Other> _low"))
    return a.read(spark, sf, "part").select("p_partkey", F.array_join(t.type_names(e), ",").alias("names"))


@query(a.sql("SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE trim(text) = '') AS blank, max(line) AS last FROM lines GROUP BY 1", "lines"))
def line_evidence(spark, sf):
    return a.lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("blank"), F.max("line").cast("long").alias("last"))


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'token', '\"token\"') ELSE replace(text, 'token', chr(39) || 'token' || chr(39)) END AS text FROM documents) SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce((SELECT min(i) FROM (SELECT unnest(range(1, len(s) + 1)) AS i, unnest(s) AS l) WHERE regexp_matches(l, '[\"' || chr(39) || ']token[\"' || chr(39) || ']')), 1) END AS line FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS s FROM x)")
def literal_line(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("token"), F.lit('"token"'))).otherwise(F.replace("text", F.lit("token"), F.lit("'token'")))
    return a.read(spark, sf, "documents").select("doc_id", t.literal_line(text, F.lit("token")).cast("long").alias("line"))


@query("SELECT e.event_id, j.fullkey AS field, CAST(j.atom AS VARCHAR) AS value FROM events e, json_tree(e.props) j WHERE j.atom IS NOT NULL")
def json_field_paths(spark, sf):
    from ..functions.values import field_paths

    e = a.read(spark, sf, "events").select("event_id", "props")
    return field_paths(e, "event_id", "props")


_ENTRIES = """e AS (SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'Config' WHEN 1 THEN 'content' WHEN 2 THEN 'Source' WHEN 3 THEN 'Plugins' WHEN 4 THEN 'Binaries' WHEN 5 THEN 'Saved' WHEN 6 THEN 'Game.uproject' ELSE url END AS name, page_id % 5 <> 0 AS is_dir FROM pages),
k AS (SELECT *, CASE lower(name) WHEN 'config' THEN 'configuration' WHEN 'content' THEN 'content' WHEN 'source' THEN 'source' WHEN 'plugins' THEN 'plugins' WHEN 'binaries' THEN 'build' WHEN 'saved' THEN 'cache' ELSE CASE WHEN lower(name) LIKE '%.uproject' THEN 'descriptor' END END AS role FROM e)"""


def _entries(spark, sf):
    k = F.col("page_id") % 12
    name = F.col("url")
    for i, n in reversed(list(enumerate(("Config", "content", "Source", "Plugins", "Binaries", "Saved", "Game.uproject")))):
        name = F.when(k == i, n).otherwise(name)
    return a.read(spark, sf, "pages").select("page_id", name.alias("name"), (F.col("page_id") % 5 != 0).alias("is_dir"))


@query(f"WITH {_ENTRIES} SELECT page_id, role FROM k")
def path_roles(spark, sf):
    return filegraph.classify_paths(_entries(spark, sf))[0].select("page_id", "role")


@query(f"WITH {_ENTRIES} SELECT CASE WHEN bad AND role NOT IN ('build', 'cache') THEN 'error' ELSE 'warning' END AS severity, CASE WHEN bad THEN 'project-path-type-mismatch' ELSE 'unclassified-project-root-directory' END AS code, name AS subject FROM (SELECT *, coalesce((role = 'descriptor') = is_dir, false) AS bad FROM k) WHERE bad OR (role IS NULL AND is_dir)")
def path_problems(spark, sf):
    return filegraph.classify_paths(_entries(spark, sf))[1]


_PATHS = "x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Public/' WHEN 1 THEN 'Private/sub/' WHEN 2 THEN 'other/' WHEN 3 THEN 'CLASSES/' WHEN 4 THEN 'Src/Intermediate/' ELSE '' END || p_name || CASE p_partkey % 11 WHEN 0 THEN '.h' WHEN 1 THEN '.HXX' WHEN 2 THEN '.ipp' WHEN 3 THEN '.mm' WHEN 4 THEN '.c' WHEN 5 THEN '.Generated.h' WHEN 6 THEN '.autogen.cc' WHEN 7 THEN '.gen.cpp' WHEN 8 THEN '.gen.txt' WHEN 9 THEN '.inl' ELSE '.g.cs' END AS path FROM part)"


def _file_paths(spark, sf):
    k, e = F.col("p_partkey") % 6, F.col("p_partkey") % 11
    head, tail = F.lit(""), F.lit(".g.cs")
    for i, h in enumerate(("Public/", "Private/sub/", "other/", "CLASSES/", "Src/Intermediate/")):
        head = F.when(k == i, h).otherwise(head)
    for i, x in enumerate((".h", ".HXX", ".ipp", ".mm", ".c", ".Generated.h", ".autogen.cc", ".gen.cpp", ".gen.txt", ".inl")):
        tail = F.when(e == i, x).otherwise(tail)
    return a.read(spark, sf, "part").select("p_partkey", F.concat(head, F.col("p_name"), tail).alias("path"))


@query(f"WITH {_PATHS} SELECT p_partkey, CASE WHEN lower(path) LIKE 'public/%' OR lower(path) LIKE 'classes/%' THEN 'public' WHEN lower(path) LIKE 'private/%' THEN 'private' ELSE 'unclassified' END AS visibility, CASE WHEN regexp_matches(lower(path), '\\.(h|hh|hpp|hxx|inl|ipp)$') THEN 'header' WHEN regexp_matches(lower(path), '\\.(cpp|cc|cxx|mm)$') THEN 'source' ELSE 'other' END AS kind FROM x")
def visibility(spark, sf):
    return _file_paths(spark, sf).select("p_partkey", t.visibility(F.col("path")).alias("visibility"), t.source_kind(F.col("path")).alias("kind"))


@query(f"WITH {_PATHS} SELECT p_partkey, p_partkey % 11 IN (5, 6, 7) AS generated, p_partkey % 6 = 4 AS skipped FROM x")
def generated_filter(spark, sf):
    return _file_paths(spark, sf).select("p_partkey", t.is_generated(t.leaf(F.col("path"))).alias("generated"), t.in_skipped(F.col("path")).alias("skipped"))


def _contents(spark, sf):
    d = a.read(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel"), F.encode("text", "UTF-8").alias("content"))


@query("SELECT source || '/' || doc_id AS rel, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def fingerprint(spark, sf):
    return sinks.fingerprint(_contents(spark, sf))[0]


@query("SELECT source AS top, count(*) AS file_count, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def dir_rollup(spark, sf):
    return sinks.fingerprint(_contents(spark, sf))[1]


@query(
    a.sql(
        """, x AS (SELECT *, length(text) % 5 = 0 AND length(text) % 7 <> 0 AS m, length(text) % 7 = 0 AS t FROM lines WHERE NOT regexp_full_match(text, '\\s*')),
g AS (SELECT *, (SELECT min(y.line) FROM x y WHERE y.doc_id = x.doc_id AND y.line > x.line AND NOT y.m) AS nx FROM x WHERE m)
SELECT g.doc_id, g.line AS marker_line, g.nx AS target_line FROM g JOIN x ON x.doc_id = g.doc_id AND x.line = g.nx WHERE x.t""",
        "lines",
    )
)
def adjacent_markers(spark, sf):
    n = F.length("text")
    out = resolve.adjacent_markers(a.lines(spark, sf), n % 5 == 0, n % 7 == 0)
    return out.select("doc_id", "marker_line", "target_line")


_OPS = {"purchase": "publish", "view": "subscribe", "click": "subscribe", "login": "publish", "logout": "unsubscribe"}


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items()) + " END AS operation, CASE WHEN event_id % 3 = 0 THEN 'dynamic' WHEN event_id % 3 = 1 THEN 'static' ELSE 'unresolved' END AS channel_status FROM events")
def message_classify(spark, sf):
    from ..operators.messages import channel_status

    e = a.read(spark, sf, "events")
    op = None
    for k, v in _OPS.items():
        op = F.when(F.col("event_type") == k, v) if op is None else op.when(F.col("event_type") == k, v)
    r = F.col("event_id") % 3
    return e.select("event_id", op.alias("operation"), channel_status(F.when(r == 0, 1).otherwise(0), F.when(r <= 1, F.lit("A.B"))).alias("channel_status"))
