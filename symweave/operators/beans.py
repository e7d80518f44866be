"""Facts of annotated types: stereotypes, scanned and factory beans, injections, bindings, repositories and build targets.

Every operator takes descriptor rows of many projects and is made of joins and aggregations on equal keys. Rows with a
null key take part in nothing; repeated rows count once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.session import cut

# The annotations that make a type a component.
STEREOTYPES = (
    "org.springframework.stereotype.Component", "org.springframework.stereotype.Service", "org.springframework.stereotype.Repository",
    "org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController", "org.springframework.context.annotation.Configuration",
)
# The interfaces whose first two type arguments are a repository's domain and identifier.
REPOSITORY_BASES = (
    "org.springframework.data.repository.Repository", "org.springframework.data.repository.CrudRepository", "org.springframework.data.repository.ListCrudRepository",
    "org.springframework.data.repository.PagingAndSortingRepository", "org.springframework.data.jpa.repository.JpaRepository",
)
# How annotations of a parameter bind it.
BINDINGS = {"RequestBody": "REQUEST_BODY", "PathVariable": "PATH_VARIABLE", "RequestParam": "REQUEST_PARAM", "RequestHeader": "REQUEST_HEADER", "ModelAttribute": "MODEL_ATTRIBUTE"}


def stereotypes(annotations: DataFrame) -> DataFrame:
    """(project, type, stereotype, chain): the first stereotype that each type's annotations lead to, in their order.

    annotations are (project, type, nth, annotation); an annotation with annotations of its own is a type by that name,
    and all that it leads to comes before the type's next annotation. chain are the annotations on the way. Annotations
    that lead back to themselves lead nowhere. One join for each step of the longest chain.
    """
    own = cut(annotations.where("project IS NOT NULL AND type IS NOT NULL AND annotation IS NOT NULL").groupBy("project", "type", "annotation").agg(F.min("nth").alias("nth")))
    hops = own.select("project", F.col("type").alias("node"), F.col("annotation").alias("next"), "nth")
    live = own.select("project", "type", F.col("annotation").alias("node"), F.array("nth").alias("place"), F.array("annotation").alias("chain"))
    done, found = F.col("node").isin(*STEREOTYPES), []
    while True:
        live = cut(live)
        found.append(live.where(done).select("project", "type", "place", "chain"))
        if not live.where(~done).head(1):
            break
        onward = live.where(~done).join(hops, ["project", "node"]).where(~F.array_contains("chain", F.col("next")))
        longer = F.struct(F.concat("place", F.array("nth")).alias("place"), F.concat("chain", F.array("next")).alias("chain"))
        live = onward.groupBy("project", "type", F.col("next").alias("node")).agg(F.min(longer).alias("l")).select("project", "type", "node", "l.place", "l.chain")
    first = functools.reduce(DataFrame.unionByName, found).groupBy("project", "type").agg(F.min(F.struct("place", "chain")).alias("f"))
    return first.select("project", "type", F.substring_index(F.get("f.chain", F.size("f.chain") - 1), ".", -1).alias("stereotype"), F.col("f.chain").alias("chain"))


def scan_roots(types: DataFrame, scans: DataFrame) -> DataFrame:
    """(project, root): the packages below which components are looked for; blank ones are none.

    types are (project, package_name, is_application), scans (project, packages, classes) as a scan names them.
    """
    of_class = F.regexp_extract(F.col("c"), r"(?s)^(.+)\.[^.]*$", 1)
    roots = types.where("is_application").select("project", F.col("package_name").alias("root"))
    roots = roots.unionByName(scans.select("project", F.explode("packages").alias("root"))).unionByName(scans.select("project", F.explode("classes").alias("c")).select("project", of_class.alias("root")))
    return roots.where("trim(root) <> '' AND project IS NOT NULL").distinct()


def scanned_beans(types: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """(project, type, bean, stereotype, confidence, scan_known) of the types with a stereotype that a scan meets.

    types are (project, type, package_name, simple_name, explicit_name, conditional), found are stereotypes(), roots
    scan_roots(). A project without roots takes all its types, inferred only, as are types under conditions. A bean has
    its explicit name, or that of its type with a small letter. A type meets a root by the packages it lies in, which are
    joined one by one, so there is no join on prefixes.
    """
    met = types.select("project", "type", "package_name", "simple_name", "explicit_name", "conditional").distinct().join(found.select("project", "type", "stereotype"), ["project", "type"])
    limited = met.join(roots.select("project").distinct().withColumn("scan_known", F.lit(True)), "project", "left")
    parts = F.split("package_name", r"\.")
    packages = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    inside = limited.where("scan_known AND package_name IS NOT NULL").withColumn("root", F.explode(packages)).join(roots, ["project", "root"], "left_semi").drop("root").distinct()
    name = F.coalesce(F.when(F.trim("explicit_name") != "", F.col("explicit_name")), names.decapitalised(F.col("simple_name")))
    inferred = F.col("scan_known").isNull() | F.coalesce("conditional", F.lit(False))
    return inside.unionByName(limited.where("scan_known IS NULL")).select(
        "project", "type", name.alias("bean"), "stereotype", F.when(inferred, "STATIC_INFERRED").otherwise("FRAMEWORK_RESOLVED").alias("confidence"), F.coalesce("scan_known", F.lit(False)).alias("scan_known")
    )


def unknown_scans(beans: DataFrame) -> DataFrame:
    """(project, n_beans) of the projects whose scanned_beans() come without any root."""
    return beans.where("NOT scan_known").groupBy("project").agg(F.count(F.lit(1)).alias("n_beans"))


def factory_beans(methods: DataFrame, supertypes: DataFrame) -> DataFrame:
    """(project, method, bean, aliases, assignable, confidence) of each factory method.

    methods are (project, method_id, method, names, return_type, conditional), supertypes (project, type, super) of any
    distance. The first name is the bean's, the others are aliases; without any it is the method's. Assignable are the
    returned type and all above it, in order of their names.
    """
    above = supertypes.select("project", F.col("type").alias("return_type"), "super").distinct()
    each = methods.select("project", "method_id", "method", "names", "return_type", "conditional").distinct().join(above, ["project", "return_type"], "left")
    per = each.groupBy("project", "method_id", "method", "names", "return_type", "conditional").agg(F.collect_set("super").alias("supers"))
    first = F.coalesce(F.get("names", F.lit(0)), F.col("method"))
    aliases = F.coalesce(F.when(F.size("names") > 1, F.array_distinct(F.slice("names", 2, F.size("names")))), F.array().cast("array<string>"))
    assignable = F.array_sort(F.array_union(F.array_compact(F.array("return_type")), "supers"))
    return per.select("project", "method_id", first.alias("bean"), aliases.alias("aliases"), assignable.alias("assignable"), F.when(F.coalesce("conditional", F.lit(False)), "STATIC_INFERRED").otherwise("FRAMEWORK_RESOLVED").alias("confidence"))


def injected_constructors(constructors: DataFrame) -> DataFrame:
    """(project, type, constructor) of the constructors that are injected: the marked ones, else the only one of a type."""
    rows = constructors.groupBy("project", "type", "constructor").agg(F.bool_or(F.coalesce("autowired", F.lit(False))).alias("autowired"))
    per = rows.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"), F.bool_or("autowired").alias("marked"))
    return rows.join(per, ["project", "type"]).where("autowired OR NOT marked AND n = 1").select("project", "type", "constructor")


def injections(points: DataFrame, beans: DataFrame, factories: bool = False) -> DataFrame:
    """(project, source, target, kind, confidence, reason): the edges of injected parameters.

    points are (project, consumer, point, parameter, required, qualifier), beans (project, bean, type, assignable,
    qualifiers, is_primary, conditional). Each bean that fits is a BEAN_CANDIDATE of the point, ambiguous if it isn't the
    only one. The SELECTED_BEAN is, with a qualifier, the first by name that has it or is called so; else the only one,
    the only primary one, or, if none is primary, the one with the parameter's name. It is inferred under conditions.
    INJECTS leads from a consumer that is the type of a bean. For factories the consumer is the bean itself, which is no
    candidate of its own; names don't count, all selected ones are resolved, and the edge leads from the bean.
    Beans are summed up for each required type, so only the candidates themselves are pairs of a point and a bean; they
    are joined last, moved nowhere afterwards, and a type with many of them is spread over several tasks.
    """
    key, by_type = ["project", "consumer", "point", "parameter"], ["project", "required"]
    fits = beans.select("project", "bean", "qualifiers", "is_primary", F.coalesce("conditional", F.lit(False)).alias("conditional"), F.explode(F.array_distinct("assignable")).alias("required"))
    asked = points.select(*key, "required", "qualifier").where("project IS NOT NULL AND required IS NOT NULL").distinct()
    if factories:
        asked, fits = asked.where("consumer IS NOT NULL"), fits.where("bean IS NOT NULL")
    asked, fits = cut(asked), cut(fits.withColumn("is_primary", F.coalesce("is_primary", F.lit(False))))
    bean = F.when(F.col("bean").isNotNull(), F.struct("bean", "conditional"))
    primary = F.when(F.col("is_primary"), bean)
    stats = fits.groupBy(*by_type).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("n_primary"), F.min(bean).alias("any"), F.max(bean).alias("any_last"), F.min(primary).alias("primary"), F.max(primary).alias("primary_last"))
    # A bean is found by its own name too; of those with a qualifier the first two by name are enough, as at most one is the consumer.
    called = fits.where("bean IS NOT NULL").select(*by_type, F.explode(F.array_union(F.coalesce("qualifiers", F.array().cast("array<string>")), F.array("bean"))).alias("qualifier"), "bean", "conditional")
    place = F.dense_rank().over(Window.partitionBy(*by_type, "qualifier").orderBy("bean"))
    of_place = lambda i: F.min(F.when(F.col("place") == i, F.struct("bean", "conditional")))
    qualified = called.where("qualifier IS NOT NULL").withColumn("place", place).where("place <= 2").groupBy(*by_type, "qualifier").agg(of_place(1).alias("q1"), of_place(2).alias("q2"))
    own = fits.groupBy(*by_type, F.col("bean").alias("consumer" if factories else "parameter")).agg(F.count(F.lit(1)).alias("n_own"), F.count_if("is_primary").alias("n_own_primary"), F.min(bean).alias("own"))
    each = asked.join(stats, by_type).join(qualified, [*by_type, "qualifier"], "left").join(own, [*by_type, "consumer" if factories else "parameter"], "left")
    # The only bean besides the consumer is the first or the last one.
    other = lambda *found: F.coalesce(*(F.when(F.col(c)["bean"] != F.col("consumer"), F.col(c)) for c in found)) if factories else F.col(found[0])
    less = lambda n, own: F.col(n) - F.coalesce(own, F.lit(0)) if factories else F.col(n)
    per = each.groupBy(*key, "qualifier").agg(
        F.sum(less("n", "n_own")).alias("n"), F.sum(less("n_primary", "n_own_primary")).alias("n_primary"), F.min(other("q1", "q2")).alias("by_qualifier"), F.min(other("any", "any_last")).alias("any"), F.min(other("primary", "primary_last")).alias("by_primary"), F.min("own").alias("by_name")
    ).where("n > 0")
    rules = [("UNIQUE_CANDIDATE", F.col("n") == 1, "any"), ("PRIMARY", F.col("n_primary") == 1, "by_primary")] + ([] if factories else [("INJECTION_POINT_NAME", F.col("n_primary") == 0, "by_name")])
    of = lambda value: functools.reduce(lambda w, r: w.when(r[1] & F.col(r[2]).isNotNull(), value(r)), rules, F.when(F.col("qualifier").isNotNull(), value(("QUALIFIER", None, "by_qualifier"))))
    reason = of(lambda r: F.lit("FACTORY_PARAMETER" if factories and r[0] != "QUALIFIER" else r[0]))
    chosen = cut(per.select(*key, of(lambda r: F.col(r[2])).alias("s"), reason.alias("reason"), "n"))
    selected = chosen.where("s IS NOT NULL")
    sure = F.lit("FRAMEWORK_RESOLVED")
    confidence = sure if factories else F.when(F.col("s.conditional"), "STATIC_INFERRED").otherwise(sure)
    edge = lambda source, target, kind, confidence, reason: (F.col("project"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), confidence.alias("confidence"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    sought = asked.join(chosen.select(*key, "n"), key).select("project", "point", "required", F.col("consumer" if factories else "project").alias("but"), F.when(F.col("n") > 1, "AMBIGUOUS").otherwise(sure).alias("certainty")).distinct()
    pairs = _pairs(sought, fits.select(*by_type, "bean").distinct(), factories)
    candidates = pairs.select(*edge("point", "bean", "BEAN_CANDIDATE", F.col("certainty"), none))
    consumers = selected if factories else selected.join(beans.select("project", F.col("type").alias("consumer")).distinct(), ["project", "consumer"], "left_semi")
    rest = selected.select(*edge("point", "s.bean", "SELECTED_BEAN", confidence, F.col("reason"))).unionByName(consumers.select(*edge("consumer", "s.bean", "INJECTS", confidence, none)))
    return candidates.unionByName(rest.distinct())


#: Pairs that a task makes at once, about.
PAIRS_AT_ONCE = 1 << 24
#: Points that are joined as one row, about.
POINTS_AT_ONCE = 128


def _pairs(sought: DataFrame, fits: DataFrame, excluding: bool) -> DataFrame:
    """(project, point, certainty, bean): distinct rows of sought (project, point, required, but, certainty) with fits (project, required, bean).

    excluding leaves out the bean named but. Both sides of a required type are cut into slices of points, each with all
    its beans, by the number of pairs. Points are joined in blocks and taken apart last, so a bean comes with all points
    of a block in turn: such rows are quickly made and take little space. Only points with several rows can have a pair
    twice.
    """
    key = ["project", "required"]
    sought = cut(sought.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("project", "point", "certainty"))))
    sizes = sought.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(fits.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
    slices = F.least("n", F.ceil(F.col("n") * F.col("m") / PAIRS_AT_ONCE)).cast("int")
    sizes = cut(sizes.select(*key, slices.alias("slices"), F.greatest(slices, F.ceil(F.col("n") / POINTS_AT_ONCE).cast("int")).alias("blocks")))
    session = sought.sparkSession
    wanted = sizes.agg(F.sum("slices")).head()[0] or 1
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), min(wanted, 10_000))
    placed = sought.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("point", "but", "certainty"), F.col("blocks")).cast("int"))
    several = F.col("rows") > 1
    blocks = placed.groupBy(*key, "certainty", several.alias("several"), "block", F.pmod("block", "slices").alias("slice")).agg(F.collect_list(F.struct("point", "but")).alias("points")).drop("block")
    left = blocks.repartition(parts, *key, "slice")
    right = fits.join(sizes, key).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices", "blocks").repartition(parts, *key, "slice")
    met = left.join(right, [*key, "slice"]).select("project", "certainty", "bean", "several", F.explode("points").alias("p"))
    if excluding:
        met = met.where("bean <> p.but")
    wide = met.select("project", F.col("p.point").alias("point"), "certainty", "bean", "several")
    return wide.where("NOT several").drop("several").unionByName(wide.where("several").drop("several").distinct())


def _last(values: Column) -> Column:
    """The last value of an array that isn't null; null without any."""
    held = F.array_compact(values)
    return F.get(held, F.size(held) - 1)


def bindings(parameters: DataFrame, key: list[str]) -> DataFrame:
    """(key, binding_kind, external_name, required) of parameters (key, name, optional, annotations).

    annotations are structs of annotation (a simple name), name, value and required. The last one that binds, that gives a
    name and that says whether it is required counts for each; without any it is a plain parameter by its own name,
    required unless it is optional.
    """
    kinds = F.create_map(*(F.lit(x) for pair in BINDINGS.items() for x in pair))
    filled = lambda c: F.when(F.trim(c) != "", c)
    part = lambda f: F.transform(F.coalesce("annotations", F.expr("from_json('[]', 'array<struct<annotation: string, name: string, value: string, required: boolean>>')")), f)
    return parameters.select(
        *key, F.coalesce(_last(part(lambda a: F.try_element_at(kinds, a["annotation"]))), F.lit("JAVA")).alias("binding_kind"),
        F.coalesce(_last(part(lambda a: F.coalesce(filled(a["name"]), filled(a["value"])))), F.col("name")).alias("external_name"),
        F.coalesce(_last(part(lambda a: a["required"])), ~F.coalesce("optional", F.lit(False))).alias("required"),
    )


def validated_components(parameters: DataFrame, fields: DataFrame) -> DataFrame:
    """(project, type, components): the constrained fields, by name, of each type that a route's parameter has.

    parameters are (project, type), fields (project, type, field, java_type, validation) with the constraints' names.
    """
    own = fields.where("size(validation) > 0").select("project", "type", "field", "java_type", "validation").distinct().join(parameters.select("project", "type").distinct(), ["project", "type"], "left_semi")
    return own.groupBy("project", "type").agg(F.array_sort(F.collect_list(F.struct("field", "java_type", "validation"))).alias("components"))


def repositories(interfaces: DataFrame, entities: DataFrame) -> DataFrame:
    """(project, type, domain, id_type, contract, known) of each type that implements a repository's interface.

    interfaces are (project, type, nth, interface, arguments); the first of REPOSITORY_BASES with two arguments counts.
    known holds if the domain is among entities (project, entity): it tells an edge from a diagnostic.
    """
    fit = interfaces.where(F.col("interface").isin(*REPOSITORY_BASES) & (F.size("arguments") >= 2))
    first = fit.groupBy("project", "type").agg(F.min(F.struct("nth", "interface", "arguments")).alias("f")).select("project", "type", F.get("f.arguments", F.lit(0)).alias("domain"), F.get("f.arguments", F.lit(1)).alias("id_type"), F.col("f.interface").alias("contract"))
    known = entities.select("project", F.col("entity").alias("domain"), F.lit(True).alias("known")).distinct()
    return first.join(known, ["project", "domain"], "left").select("project", "type", "domain", "id_type", "contract", F.coalesce("known", F.lit(False)).alias("known"))


def owning_targets(files: DataFrame, targets: DataFrame, tests: bool = True) -> DataFrame:
    """(project, path, source, kind): the build target of each file; files that none holds are left out.

    files are (project, path), targets (project, nth, source, kind). A target whose root file is the path comes first,
    else the one in the deepest folder above it, libraries before others and later ones before earlier ones. Without
    tests, targets of tests and benches are out. Each file is joined by its folders one by one.
    """
    folders = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.split(c, "/")) - 1), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    given = targets if tests else targets.where("kind NOT IN ('test', 'bench')")
    exact = lambda c, hit: F.struct(c.alias("place"), F.lit(hit).alias("exact"))
    folder = F.when(F.instr("source", "/") > 0, F.regexp_replace("source", "/[^/]*$", "")).otherwise(F.lit(""))
    held = given.where("source IS NOT NULL").select("project", "nth", "source", "kind", F.explode(F.array(exact(F.col("source"), True), exact(folder, False))).alias("k")).select("*", "k.*").drop("k")
    asked = files.where("path IS NOT NULL").select("project", "path").distinct().select("project", "path", F.explode(F.concat(F.array(exact(F.col("path"), True)), F.transform(F.array_distinct(folders(F.col("path"))), lambda f: exact(f, False)))).alias("k")).select("project", "path", "k.*")
    depth = F.when(F.col("exact") | (F.col("place") == ""), 0).otherwise(F.size(F.split("place", "/")))
    library = ~F.col("exact") & F.col("kind").isin("lib", "rlib", "proc-macro")
    rank = F.struct("exact", depth.alias("depth"), library.alias("library"), F.when(F.col("exact"), -F.col("nth")).otherwise(F.col("nth")).alias("nth"), "source", "kind")
    return asked.join(held, ["project", "place", "exact"]).groupBy("project", "path").agg(F.max(rank).alias("r")).select("project", "path", "r.source", "r.kind")


def request_bodies(routes: DataFrame) -> DataFrame:
    """(project, stable_id, java_type): the type of each route's first parameter that is bound to the request's body.

    It is read from metadata.handler_parameters; routes without such a parameter, or with other JSON, are left out.
    """
    parameters = F.from_json(F.get_json_object("metadata", "$.handler_parameters"), "array<struct<binding_kind: string, java_type: string>>")
    body = F.get(F.filter(parameters, lambda p: p["binding_kind"] == "REQUEST_BODY"), F.lit(0))
    return routes.select("project", "stable_id", body.alias("body")).where("body IS NOT NULL").select("project", "stable_id", F.col("body.java_type").alias("java_type"))
