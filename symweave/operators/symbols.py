"""Search, neighbours, context and resolution of symbols."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.session import cut

# The group of context each edge kind belongs to, by the direction in which it is seen.
CATEGORIES = {
    "dependencies": ("INJECTS", "SELECTED_BEAN", "BEAN_CANDIDATE"),
    "data_access": ("READS_ENTITY", "WRITES_ENTITY", "READS", "WRITES", "USES_REPOSITORY", "REPOSITORY_FOR"),
    "routes": ("HANDLED_BY", "EXPOSES_ROUTE"), "events": ("PUBLISHES_EVENT", "LISTENS_TO_EVENT"),
    "types": ("REFERENCES_TYPE", "ACCEPTS_TYPE", "RETURNS_TYPE"), "implementations": ("IMPLEMENTS", "IMPLEMENTS_METHOD"),
    "imports": ("IMPORTS",), "field_access": ("READS_FIELD", "WRITES_FIELD"),
}


def framework_roles(nodes: DataFrame) -> DataFrame:
    """(project, stable_id, direct, role): each symbol's own framework role, and, without one, that of its declaring type."""
    own = nodes.select(
        "project", "stable_id", names.framework_role(F.col("kind"), F.col("metadata")).alias("direct"), names.owner_id(F.col("kind"), F.col("stable_id"), F.col("metadata")).alias("owner")
    )
    owners = own.where("direct IS NOT NULL").select("project", F.col("stable_id").alias("owner"), F.col("direct").alias("inherited"))
    return own.join(owners, ["project", "owner"], "left").select("project", "stable_id", "direct", F.coalesce("direct", "inherited").alias("role"))


def candidates(nodes: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """The first symbols of each project that hold the query, or its first word, in a name or the identifier: exact names first, then by identifier.

    Percent signs and underscores of the query don't count. The cut comes before any other filter.
    """
    text = query.replace("%", "").replace("_", "")
    word = next(("".join(g) for ok, g in itertools.groupby(text, str.isalnum) if ok), text)
    holds = lambda c, part: F.coalesce(names.ascii_lower(F.col(c)).contains(names.ascii_lower(F.lit(part))), F.lit(False))
    found = holds("qualified_name", text) | holds("simple_name", text) | holds("stable_id", text) | holds("qualified_name", word) | holds("simple_name", word)
    exact = F.coalesce((F.col("qualified_name") == query) | (F.col("simple_name") == query), F.lit(False))
    w = Window.partitionBy("project").orderBy(F.when(exact, 0).otherwise(1), "stable_id")
    return nodes.where(found).withColumn("prefetch", F.row_number().over(w)).where(F.col("prefetch") <= most).drop("prefetch")


def search(
    nodes: DataFrame, query: str, limit: int = 10, offset: int = 0, kinds: tuple[str, ...] = (), module: str | None = None, package_prefix: str | None = None, namespace_prefix: str | None = None,
    roles: tuple[str, ...] = (), most: int = 1000,
) -> DataFrame:
    """A page of the best symbols of each project for a query: (project, stable_id, kind, role, rank, nth, n_matched).

    Candidates are cut to so many first; kinds and roles are compared without case, a role is the symbol's own or that
    of its declaring type. Ties go by the qualified name in lower case, then by the identifier.
    """
    query = query.strip()
    if not query or len(query.encode()) > 500:
        raise ValueError("a query has 1 to 500 bytes")
    if limit < 1 or offset < 0:
        raise ValueError("a page has a positive limit and no negative offset")
    found = candidates(nodes, query, most)
    if kinds:
        found = found.where(F.lower("kind").isin(*(k.lower() for k in kinds)))
    lexical = names.lexical_rank(F.lit(query), F.col("stable_id"), F.col("qualified_name"), F.col("simple_name"))
    yes = lambda condition: F.coalesce(condition, F.lit(False))
    space = F.coalesce("namespace_path", "package_name")
    terms = [lexical, F.when(F.col("file_path").isNotNull(), 80).otherwise(0), F.when(names.framework_role(F.col("kind"), F.col("metadata")).isNotNull(), 20).otherwise(0)]
    for given, condition, value in (
        (module, F.col("module_name") == module, 40), (package_prefix, space.startswith(package_prefix or ""), 30), (namespace_prefix, F.col("namespace_path").startswith(namespace_prefix or ""), 30)
    ):
        if given is not None:
            found, terms = found.where(yes(condition)), [*terms, F.lit(value)]
    terms.append(
        F.when(F.col("kind") == "ROUTE", 35).when(F.col("kind").isin("REPOSITORY", "ENTITY", "BEAN", "EVENT_TYPE"), 25)
        .when((F.col("kind") == "METHOD") & yes(F.get_json_object("metadata", "$.has_body") == "true"), 10).otherwise(0)
    )
    scored = found.withColumn("lexical", lexical).where("lexical > 0").select("project", "stable_id", "kind", "qualified_name", sum(terms[1:], terms[0]).alias("rank"))
    named = scored.join(framework_roles(nodes).select("project", "stable_id", "role"), ["project", "stable_id"])
    if roles:
        named = named.where(yes(F.lower("role").isin(*(r.lower() for r in roles))))
    project = Window.partitionBy("project")
    placed = named.withColumn("nth", F.row_number().over(project.orderBy(F.desc("rank"), F.lower("qualified_name"), "stable_id"))).withColumn("n_matched", F.count(F.lit(1)).over(project))
    return placed.where((F.col("nth") > offset) & (F.col("nth") <= offset + limit)).select("project", "stable_id", "kind", "role", "rank", "nth", "n_matched")


def neighbours(edges: DataFrame, end: str, limit: int, kinds: list[str], limit_first: bool = True) -> DataFrame:
    """At most limit edges of each node, in order of kind, source and target; then only those of the kinds.

    With limit_first unset the kinds are filtered before the cut, so that a node with many edges loses none of them.
    """
    wanted = F.col("kind").isin(*kinds)
    w = Window.partitionBy("project", end).orderBy("kind", "source", "target")
    kept = (edges if limit_first else edges.where(wanted)).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)
    return kept.where(wanted).select("project", "source", "target", "kind", "nth")


def of_kinds(nodes: DataFrame, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """The symbols of the kinds, whatever their case, among the first of each project by identifier: the cut comes first."""
    first = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("stable_id"))).where(F.col("nth") <= limit)
    return first.where(F.lower("kind").isin(*(k.lower() for k in kinds)))


def context_page(edges: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """(project, stable_id, direction, kind, source, target, nth, n_edges): a page of each symbol's edges in both directions.

    Only the first offset + limit edges of a symbol are put in order in one task, which Spark cuts to before it shuffles;
    the edges are counted apart. Rows with a null project or symbol are left out.
    """
    sides = F.array(F.struct(F.col("target").alias("stable_id"), F.lit("inbound").alias("direction")), F.struct(F.col("source").alias("stable_id"), F.lit("outbound").alias("direction")))
    seen = edges.select("project", "kind", "source", "target", F.explode(sides).alias("s")).select("project", "s.*", "kind", "source", "target").where("project IS NOT NULL AND stable_id IS NOT NULL")
    order = Window.partitionBy("project", "stable_id").orderBy("direction", "kind", "source", "target")
    first = seen.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= offset + limit).where(F.col("nth") > offset)
    counted = seen.groupBy("project", "stable_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return first.join(counted, ["project", "stable_id"])


def context_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, stable_id, direction, category, n_edges, n_ambiguous) of every symbol with edges in a known group.

    A link to itself is seen in both directions. Symbols that aren't current nodes are left out.
    """
    sides = F.array(F.struct(F.col("target").alias("stable_id"), F.lit("inbound").alias("direction")), F.struct(F.col("source").alias("stable_id"), F.lit("outbound").alias("direction")))
    seen = edges.select("project", "kind", "confidence", F.explode(sides).alias("s")).select("project", "kind", "confidence", "s.*")
    category = F.when(F.col("kind") == "CALLS", F.when(F.col("direction") == "inbound", "callers").otherwise("callees"))
    for name, kinds in CATEGORIES.items():
        category = category.when(F.col("kind").isin(*kinds), name)
    grouped = seen.withColumn("category", category).where("category IS NOT NULL").groupBy("project", "stable_id", "direction", "category").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("n_ambiguous")
    )
    return grouped.join(nodes.select("project", "stable_id"), ["project", "stable_id"], "left_semi")


def resolved_names(nodes: DataFrame) -> DataFrame:
    """(project, stable_id, name, n_candidates, resolved) of each unresolved name: the only symbol of that simple name, if it is unique."""
    wanted = nodes.select("project", "stable_id", F.explode("unresolved").alias("name")).distinct()
    known = nodes.where("simple_name IS NOT NULL").groupBy("project", F.col("simple_name").alias("name")).agg(F.count(F.lit(1)).alias("n_candidates"), F.min("stable_id").alias("only"))
    found = wanted.join(known, ["project", "name"], "left").fillna({"n_candidates": 0})
    return found.select("project", "stable_id", "name", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("only")).alias("resolved"))


def owning_packages(nodes: DataFrame) -> DataFrame:
    """(project, stable_id, owner) of each symbol: the deepest package whose name is a dotted prefix of its own.

    The prefixes of a name are joined by equality, so no range of names is compared. Without such a package owner is null.
    """
    packages = nodes.where("kind = 'PACKAGE'").select("project", F.col("qualified_name").alias("prefix")).distinct().withColumn("known", F.lit(True))
    parts = F.split(F.substring_index("qualified_name", "#", 1), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(".", F.slice(parts, F.lit(1), n)))
    symbols = nodes.where("kind <> 'PACKAGE'").select("project", "stable_id", F.explode(prefixes).alias("prefix"))
    found = symbols.join(packages, ["project", "prefix"], "left")
    return found.groupBy("project", "stable_id").agg(F.max_by(F.when(F.col("known"), F.col("prefix")), F.when(F.col("known"), F.length("prefix"))).alias("owner"))


def resolved_annotations(nodes: DataFrame) -> DataFrame:
    """(project_id, generation, stable_id, direct, resolved) of nodes as delivered: the first annotation, or that of the declaring type."""
    first = F.get_json_object("metadata_json", "$.annotations[0]")
    own = nodes.groupBy("project_id", "generation", "stable_id").agg(F.max(first).alias("direct"))
    owner = F.when(F.col("stable_id").contains("#"), F.concat(F.lit("type:"), names.declaring_type(F.col("stable_id"))))
    types = own.where("stable_id LIKE 'type:%' AND direct IS NOT NULL").select("project_id", "generation", F.col("stable_id").alias("owner"), F.col("direct").alias("inherited"))
    return own.withColumn("owner", owner).join(types, ["project_id", "generation", "owner"], "left").select(
        "project_id", "generation", "stable_id", "direct", F.coalesce("direct", "inherited").alias("resolved")
    )


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (project, stable_id) of all its loaded rows.

    Names come from the first row, the location from the first one that has it, unresolved is the union in order, and
    of each metadata member the latest value counts.
    """
    key = ["project", "stable_id"]
    at = F.struct("loaded_at", "qualified_name")
    base = nodes.groupBy(*key).agg(
        F.min_by("qualified_name", at).alias("qualified_name"), F.min_by("simple_name", at).alias("simple_name"),
        F.min_by(F.struct("file_path", "start_line", "end_line"), F.when(F.col("file_path").isNotNull(), at)).alias("l"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("unresolved")))).alias("unresolved"), F.count(F.lit(1)).alias("n_rows"),
    )
    member = nodes.select(*key, "loaded_at", F.explode(F.from_json("metadata", "map<string,string>")).alias("member", "value"))
    latest = member.groupBy(*key, "member").agg(F.max_by("value", "loaded_at").alias("value"))
    members = latest.groupBy(*key).agg(F.array_sort(F.collect_list(F.concat_ws("=", "member", "value"))).alias("metadata"))
    return base.join(members, key, "left").select(*key, "qualified_name", "simple_name", "l.file_path", "l.start_line", "l.end_line", F.array_join("unresolved", ",").alias("unresolved"), F.coalesce(F.array_join("metadata", ","), F.lit("")).alias("metadata"), "n_rows")


def flattened(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, path, value) of each scalar in a column of JSON text; members by name, array elements as [].

    Text that is no JSON, or repeats a member of an object, and empty objects and arrays, give no rows; null is the text
    null, numbers are in Spark's shortest form. One step for each level of nesting, until nothing is nested.
    """
    spark = rows.sparkSession
    live = rows.select(*key, F.lit("").alias("flat_path"), F.try_parse_json(F.col(column)).alias("flat_node")).where("flat_node IS NOT NULL")
    nested, leaves = F.schema_of_variant("flat_node").rlike("^(OBJECT|ARRAY)<"), []
    while True:
        live = cut(live.withColumn("flat_nested", nested))
        leaves.append(live.where("NOT flat_nested").select(*key, F.col("flat_path").alias("path"), F.coalesce(F.col("flat_node").cast("string"), F.lit("null")).alias("value")))
        inner = live.where("flat_nested")
        if not inner.head(1):
            return functools.reduce(DataFrame.unionByName, leaves)
        parts = spark.tvf.variant_explode(F.col("flat_node").outer()).select(F.col("key").alias("flat_key"), F.col("value").alias("flat_value"))
        path = F.when(F.col("flat_key").isNull(), F.concat("flat_path", F.lit("[]"))).when(F.col("flat_path") == "", F.col("flat_key")).otherwise(F.concat_ws(".", "flat_path", "flat_key"))
        live = inner.lateralJoin(parts).select(*key, path.alias("flat_path"), F.col("flat_value").alias("flat_node"))
