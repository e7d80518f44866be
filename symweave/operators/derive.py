"""Facts derived from descriptor rows: routes, injected candidates, repository queries, types and conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names

# Suffixes of derived query conditions.
OPERATORS = ("IsNotNull", "IsNull", "StartsWith", "EndsWith", "Containing", "GreaterThan", "LessThan", "Between", "True", "False", "In", "IgnoreCase")
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")


def composed_routes(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(method_id, verb, path) of every route: each prefix of a type with each suffix and verb of its methods.

    types are (type_id, prefixes), methods (type_id, method_id, suffixes, verbs); empty or missing lists of paths
    count as one empty path. A method without a verb has no route; see routes_without_verb.
    """
    paths = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit("")))
    every = methods.select("type_id", "method_id", F.explode("verbs").alias("verb"), paths("suffixes").alias("suffixes")).join(types.select("type_id", paths("prefixes").alias("prefixes")), "type_id")
    joined = every.select("method_id", "verb", F.explode("prefixes").alias("prefix"), "suffixes").select("method_id", "verb", "prefix", F.explode("suffixes").alias("suffix"))
    return joined.select("method_id", F.upper("verb").alias("verb"), names.normal_route(F.concat_ws("/", "prefix", "suffix")).alias("path")).distinct()


def routes_without_verb(methods: DataFrame) -> DataFrame:
    """(method_id) of the methods that are mapped to paths but to no verb."""
    return methods.where((F.coalesce(F.size("verbs"), F.lit(0)) <= 0) & (F.size("suffixes") > 0)).select("method_id").distinct()


def duplicate_routes(routes: DataFrame) -> DataFrame:
    """(verb, path, n_handlers, first_handler) of each route that several methods handle."""
    return routes.groupBy("verb", "path").agg(F.count_distinct("method_id").alias("n_handlers"), F.min("method_id").alias("first_handler")).where("n_handlers > 1")


def selected_candidates(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(point_id, n_candidates, selected, reason) of each injection point.

    points are (point_id, required, qualifier, name), candidates (bean, assignable, qualifiers, is_primary): a bean fits a
    point whose required type is among its assignable ones. A qualifier decides alone, the first bean by name if several
    have it; else the only candidate, the
    only primary one, or the one named like the parameter. reason is the rule, or why none applies: unresolved
    qualifier, none, several primaries, ambiguous. Candidates are summed up for each required type, and for each type
    with a qualifier or name, so no point is paired with all beans that fit it. Repeated rows count once.
    """
    fits = candidates.where("bean IS NOT NULL").select("bean", "qualifiers", "is_primary", F.explode(F.array_distinct("assignable")).alias("required")).distinct()
    primary, bean = F.coalesce("is_primary", F.lit(False)), F.col("bean")
    stats = fits.groupBy("required").agg(F.count(F.lit(1)).alias("n"), F.count_if(primary).alias("n_primary"), F.max("bean").alias("any"), F.max(F.when(primary, bean)).alias("any_primary"))
    # A bean is found by its own name as by a qualifier.
    called = fits.select("required", F.explode(F.array_union(F.coalesce("qualifiers", F.array().cast("array<string>")), F.array("bean"))).alias("qualifier"), "bean")
    qualified = called.groupBy("required", "qualifier").agg(F.min("bean").alias("qualified"))
    named = fits.groupBy("required", bean.alias("name")).agg(F.count(F.lit(1)).alias("n_named"))
    met = points.select("point_id", "required", "qualifier", "name").distinct().join(stats, "required", "left").join(qualified, ["required", "qualifier"], "left").join(named, ["required", "name"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = lambda count, value: F.when(total(count) == 1, F.max(value))
    per = met.groupBy("point_id").agg(
        F.first("qualifier").alias("qualifier"), total("n").alias("n_candidates"), total("n_primary").alias("n_primary"),
        F.min("qualified").alias("by_qualifier"), one("n", "any").alias("by_type"), one("n_primary", "any_primary").alias("by_primary"), one("n_named", F.when(F.col("n_named") > 0, F.col("name"))).alias("by_name"),
    )
    asked = F.col("qualifier").isNotNull()
    selected = F.when(asked, F.col("by_qualifier")).otherwise(F.coalesce("by_type", "by_primary", F.when(F.col("n_primary") == 0, F.col("by_name"))))
    reason = (
        F.when(asked, F.when(F.col("by_qualifier").isNotNull(), "qualifier").otherwise("unresolved qualifier")).when(F.col("n_candidates") == 0, "none")
        .when(F.col("by_type").isNotNull(), "only candidate").when(F.col("n_primary") > 1, "several primaries").when(F.col("by_primary").isNotNull(), "primary")
        .when(F.col("by_name").isNotNull(), "name").otherwise("ambiguous")
    )
    return per.select("point_id", "n_candidates", selected.alias("selected"), reason.alias("reason"))


def parsed_queries(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """(repository, method, kind, operation, predicates, order_field, direction, unparsed) of the methods of repositories.

    methods are (repository, method, query, modifying), fields (repository, fields) of the repository's domain. A method
    with a query is explicit, and its operation is WRITE if it modifies, else READ. Else a name of an action, By,
    conditions joined by And or Or, and OrderBy is derived, if every condition is a field with a known suffix or none;
    predicates are structs of field and operator, names are compared decapitalised. unparsed tells names that only look
    like that.
    """
    name = F.col("method")
    pattern = r"(?s)^(find|read|get|exists|count|delete)By(.+)$"
    sides = F.split(F.regexp_extract(name, pattern, 2), "OrderBy", 2)
    conditions, order = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    # Nothing counts behind the last And or Or.
    bare = F.regexp_replace(conditions, "(And|Or)+$", "")
    none = F.array().cast("array<string>")
    terms = F.when(conditions == "", F.array(F.lit(""))).when(bare == "", none).otherwise(F.split(bare, "And|Or"))
    suffix = f"({'|'.join(OPERATORS)})$"
    predicate = lambda t: F.struct(
        names.decapitalised(F.regexp_replace(t, suffix, "")).alias("field"), F.coalesce(F.nullif(names.upper_snake(F.regexp_extract(t, suffix, 1)), F.lit("")), F.lit("EQUALS")).alias("operator")
    )
    parsed = methods.join(fields.select("repository", "fields"), "repository", "left").withColumn("predicates", F.transform(terms, predicate))
    explicit = F.col("query").isNotNull()
    derived = ~explicit & name.rlike(pattern) & F.col("fields").isNotNull() & F.coalesce(F.forall("predicates", lambda p: F.array_contains("fields", p["field"])), F.lit(False))
    ordered = derived & order.isNotNull()
    return parsed.select(
        "repository", "method", F.when(explicit, "explicit").when(derived, "derived").alias("kind"),
        F.when(explicit, F.when(F.coalesce("modifying", F.lit(False)), "WRITE").otherwise("READ")).when(derived, F.upper(F.regexp_extract(name, pattern, 1))).alias("operation"),
        F.when(derived, F.col("predicates")).alias("predicates"), F.when(ordered, names.decapitalised(F.regexp_replace(order, "(Asc|Desc)$", ""))).alias("order_field"),
        F.when(ordered, F.when(order.endswith("Desc"), "DESC").otherwise("ASC")).alias("direction"),
        (~explicit & ~F.coalesce(derived, F.lit(False)) & name.rlike("(?is)^(find|read|get|exists|count|delete).*By.*$")).alias("unparsed"),
    )


def first_emissions(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; ties beyond the order go by the whole row."""
    w = Window.partitionBy(*key).orderBy(*order, F.to_json(F.struct(*rows.columns)))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def erased(c: Column) -> Column:
    """A type's text without white space and type arguments of any nesting; varargs as an array."""
    return F.regexp_replace(names.without_arguments(F.regexp_replace(c, r"\s+", "")), r"\.\.\.$", "[]")


def qualified_types(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_path, type_text, qualified): a type by its import, as it is if it is primitive or has dots, else in its package.

    uses are (file_path, package_name, type_text), imports (file_path, simple_name, qualified_name).
    """
    plain = F.regexp_replace(erased(F.col("type_text")), r"(\[\])+$", "")
    dims = F.regexp_extract(erased(F.col("type_text")), r"((\[\])*)$", 1)
    named = uses.select("file_path", "package_name", "type_text", plain.alias("simple_name"), dims.alias("dims")).join(imports, ["file_path", "simple_name"], "left")
    local = F.when(F.col("simple_name").isin(*PRIMITIVES) | F.col("simple_name").contains(".") | F.col("package_name").isNull(), F.col("simple_name")).otherwise(F.concat_ws(".", "package_name", "simple_name"))
    return named.select("file_path", "type_text", F.concat(F.coalesce("qualified_name", local), "dims").alias("qualified"))


def partial_status(analyses: DataFrame) -> DataFrame:
    """(request_id, status, partial, agrees, adds_up): whether any file failed, and whether status and counts agree with that; unknown failures are none."""
    partial = F.coalesce(F.col("files_failed") > 0, F.lit(False))
    return analyses.select(
        "request_id", "status", partial.alias("partial"), ((F.col("status") == "partial") == partial).alias("agrees"), (F.col("files_discovered") == F.col("files_parsed") + F.coalesce("files_failed", F.lit(0))).alias("adds_up")
    )


def joint_condition(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, state) of all conditions on something together: inactive if one is, else unknown if one is, else active."""
    rank = F.when(F.col("state") == "inactive", 2).when(F.col("state") == "active", 0).otherwise(1)
    worst = states.groupBy(*key).agg(F.max(rank).alias("rank"))
    return worst.select(*key, F.element_at(F.array(F.lit("active"), F.lit("unknown"), F.lit("inactive")), F.col("rank") + 1).alias("state"))


def repository_calls(calls: DataFrame, repositories: DataFrame) -> DataFrame:
    """(caller, repository, domain, access, confidence) of each call on a repository: WRITE, READ or null by the method's name.

    calls are (caller, receiver_type, method, modifying, conditional), repositories (type, domain). A modifying query
    writes whatever its name; a conditional call is only inferred.
    """
    met = calls.join(repositories.select(F.col("type").alias("receiver_type"), "domain").distinct(), "receiver_type")
    access = F.when(F.coalesce("modifying", F.lit(False)), "WRITE").otherwise(names.access_class(F.col("method")))
    confidence = F.when(F.coalesce("conditional", F.lit(False)), "STATIC_INFERRED").otherwise("FRAMEWORK_RESOLVED")
    return met.select("caller", F.col("receiver_type").alias("repository"), "domain", access.alias("access"), confidence.alias("confidence")).distinct()


def entity_relations(fields: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, field, relation, target, known) of each field with a relation; known tells an edge from a diagnostic.

    fields are (entity, field, relation, type), entities (entity). Fields of unknown entities are left out.
    """
    known = entities.select("entity").distinct()
    own = fields.where("relation IS NOT NULL").join(known, "entity", "left_semi")
    return own.join(known.select(F.col("entity").alias("type"), F.lit(True).alias("known")), "type", "left").select("entity", "field", "relation", F.col("type").alias("target"), F.coalesce("known", F.lit(False)).alias("known")).distinct()


def event_links(publishers: DataFrame, listeners: DataFrame, types: DataFrame) -> DataFrame:
    """(method, kind, event, external) of each publisher and listener; an event is external if its type is no known one, and unresolved where it is null.

    publishers and listeners are (method, event), types (type).
    """
    both = publishers.select("method", F.lit("PUBLISHES_EVENT").alias("kind"), "event").unionByName(listeners.select("method", F.lit("LISTENS_TO_EVENT").alias("kind"), "event")).distinct()
    known = types.select(F.col("type").alias("event"), F.lit(True).alias("known")).distinct()
    return both.join(known, "event", "left").select("method", "kind", "event", (F.col("event").isNotNull() & F.col("known").isNull()).alias("external"))
