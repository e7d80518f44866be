"""What an endpoint does: its handlers, the calls they lead to, and what is read, written, published, configured and injected on the way.

All endpoints are followed at once, one join for each level of calls. Every handler has its own set of nodes seen, so
the work grows with the handlers and the nodes that each of them reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions import names
from symweave.session import cut

# The kinds of edges that a flow looks at, and the category of what each leads to.
FLOW = ("CALLS", "USES_REPOSITORY", "READS_ENTITY", "WRITES_ENTITY", "READS", "WRITES", "PUBLISHES_EVENT", "LISTENS_TO_EVENT", "CONFIGURED_BY")
CATEGORIES = {"READS_ENTITY": "reads", "READS": "reads", "WRITES_ENTITY": "writes", "WRITES": "writes", "PUBLISHES_EVENT": "events", "LISTENS_TO_EVENT": "events", "CONFIGURED_BY": "configuration"}
#: Between the identifiers of a path, below every character of theirs, so that paths compare like lists.
MARK = "\x01"


def route_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, route, handler): the known handlers of each known route."""
    known = nodes.select("project", "stable_id", "kind")
    routes = known.where("kind = 'ROUTE'").select("project", F.col("stable_id").alias("route"))
    handled = edges.where("kind = 'HANDLED_BY'").select("project", F.col("source").alias("route"), F.col("target").alias("handler")).distinct()
    return handled.join(routes, ["project", "route"], "left_semi").join(known.select("project", F.col("stable_id").alias("handler")), ["project", "handler"], "left_semi").select("project", "route", "handler")


def routes_of_handlers(handlers: DataFrame) -> DataFrame:
    """(project, handler, n_routes, route): the route of each handler, null where it has several, from route_handlers()."""
    found = handlers.groupBy("project", "handler").agg(F.count(F.lit(1)).alias("n_routes"), F.min("route").alias("route"))
    return found.withColumn("route", F.when(F.col("n_routes") == 1, F.col("route")))


def asked_routes(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, method, path, route) of each row (project, method, path): the known route, or null."""
    ids = asked.select("project", "method", "path", F.concat_ws(":", F.lit("route"), F.upper(F.trim("method")), names.asked_route(F.col("path"))).alias("id"))
    known = nodes.where("kind = 'ROUTE'").select("project", F.col("stable_id").alias("id"), F.col("stable_id").alias("route")).distinct()
    return ids.join(known, ["project", "id"], "left").select("project", "method", "path", "route")


def repository_domains(nodes: DataFrame) -> DataFrame:
    """(project, stable_id, domain, access): what the methods of repositories deal with, where it is a known type or entity.

    Of a saving method it is the first parameter, if that is known; else what its owner is the repository of. access is
    WRITE, READ or null by the method's name.
    """
    owner = F.when(F.col("stable_id").contains("#"), names.declaring_type(F.col("stable_id"))).otherwise(F.col("stable_id"))
    parameter = F.get_json_object("metadata", "$.parameter_types[0]")
    asked = nodes.select("project", "stable_id", F.when(F.col("simple_name").startswith("save"), parameter).alias("first"), F.regexp_replace(owner, "Repository$", "").alias("second"), owner.alias("owner"), names.access_class(F.col("simple_name")).alias("access"))
    asked = asked.where(F.col("owner").endswith("Repository"))
    known = nodes.where(F.col("stable_id").rlike("^(type|entity):")).select("project", F.regexp_replace("stable_id", "^(type|entity):", "").alias("name")).distinct()
    has = lambda c: known.select("project", F.col("name").alias(c), F.lit(True).alias(f"has_{c}"))
    both = asked.join(has("first"), ["project", "first"], "left").join(has("second"), ["project", "second"], "left")
    return both.select("project", "stable_id", F.when(F.col("has_first"), F.col("first")).when(F.col("has_second"), F.col("second")).alias("domain"), "access").where("domain IS NOT NULL")


class Flow:
    """The calls that lead on from every handler, up to a depth.

    levels are (project, handler, node, depth, key, path) with the path of qualified names; key orders paths by their
    identifiers. A node counts for a handler where it is met first: at the least depth, then on the first path. The handler
    itself can be met again. Nodes that the policy hides are not followed; policy none hides nothing.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, handlers: DataFrame, depth: int = 3, policy: str = "default") -> None:
        if not 1 <= depth <= 8:
            raise ValueError("depth is 1 to 8")
        self.depth, self.nodes = depth, nodes
        hidden = F.lit(False) if policy == "none" else names.is_suppressed(*(F.col(c) for c in ("kind", "simple_name", "file_path", "stable_id", "metadata")))
        target = nodes.select(
            "project", F.col("stable_id").alias("target"), F.col("qualified_name").alias("target_name"), hidden.alias("hidden"), names.is_application(F.col("file_path"), F.col("stable_id")).alias("own"),
            F.coalesce(F.get_json_object("metadata", "$.declared_type"), F.col("qualified_name")).alias("declared"),
        )
        self.edges = cut(edges.where(F.col("kind").isin(*FLOW, "INJECTS")).select("project", "source", "target", F.col("kind").alias("edge_kind")).join(target, ["project", "target"]))
        self.calls = self.edges.where("edge_kind = 'CALLS' AND NOT hidden AND own").select("project", F.col("source").alias("node"), F.col("target").alias("next"), F.col("target_name").alias("next_name"))
        start = handlers.select("project", "handler").distinct().join(nodes.select("project", F.col("stable_id").alias("handler"), F.col("qualified_name").alias("path")), ["project", "handler"])
        live = cut(start.select("project", "handler", F.col("handler").alias("node"), F.lit(0).alias("depth"), F.col("handler").alias("key"), "path"))
        self.levels, seen = live, None
        for level in range(1, depth + 1):
            further = live.join(self.calls, ["project", "node"]).groupBy("project", "handler", F.col("next").alias("node")).agg(
                F.min(F.struct(F.concat("key", F.lit(MARK), "next").alias("key"), F.concat("path", F.lit(" > "), "next_name").alias("path"))).alias("p")
            )
            if seen is not None:
                further = further.join(seen, ["project", "handler", "node"], "left_anti")
            live = cut(further.select("project", "handler", "node", F.lit(level).alias("depth"), "p.key", "p.path"))
            seen = live.select("project", "handler", "node") if seen is None else seen.unionByName(live.select("project", "handler", "node"))
            self.levels = self.levels.unionByName(live)

    def paths(self) -> DataFrame:
        """(project, handler, path): the paths that end at the depth or where nothing further is called."""
        last = self.levels.where(F.col("depth") < self.depth).join(self.calls, ["project", "node"], "left_anti").unionByName(self.levels.where(F.col("depth") == self.depth))
        return last.select("project", "handler", "path").distinct()

    def facts(self) -> DataFrame:
        """(project, handler, category, item): what the nodes short of the depth read, write, publish, are configured by, inject, and where calls branch.

        Calls of repository methods count as reads and writes of what the repository deals with.
        """
        open_ = self.levels.where(F.col("depth") < self.depth).select("project", "handler", "node").distinct()
        met = open_.join(self.edges.where("NOT hidden").withColumnRenamed("source", "node"), ["project", "node"])
        category = F.lit(None).cast("string")
        for kind, name in CATEGORIES.items():
            category = F.when(F.col("edge_kind") == kind, name).otherwise(category)
        item = F.when(category == "events", F.concat_ws(" ", "edge_kind", "target_name")).otherwise(F.col("target_name"))
        direct = met.select("project", "handler", category.alias("category"), item.alias("item")).where("category IS NOT NULL")
        domains = repository_domains(self.nodes).withColumnRenamed("stable_id", "target")
        through = met.where("edge_kind = 'CALLS'").join(domains, ["project", "target"]).select("project", "handler", F.when(F.col("access") == "WRITE", "writes").when(F.col("access") == "READ", "reads").alias("category"), F.col("domain").alias("item")).where("category IS NOT NULL")
        node_names = self.nodes.select("project", F.col("stable_id").alias("node"), F.col("qualified_name").alias("name"), F.coalesce(F.get_json_object("metadata", "$.declaring_type"), F.concat(F.lit("type:"), names.declaring_type(F.col("stable_id")))).alias("owner"))
        branching = self.calls.groupBy("project", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        named = open_.join(node_names, ["project", "node"])
        branches = named.join(branching, ["project", "node"], "left_semi").select("project", "handler", F.lit("branch points").alias("category"), F.col("name").alias("item"))
        owners = named.select("project", "handler", F.col("owner").alias("source")).distinct()
        owner_names = self.nodes.select("project", F.col("stable_id").alias("source"), F.col("qualified_name").alias("from"))
        injected = owners.join(self.edges.where("edge_kind = 'INJECTS'"), ["project", "source"]).join(owner_names, ["project", "source"]).select("project", "handler", F.lit("injections").alias("category"), F.concat_ws(" > ", "from", "declared").alias("item"))
        return direct.unionByName(through).unionByName(branches).unionByName(injected).distinct()

    def hidden(self) -> DataFrame:
        """(project, handler, n_hidden): the edges to nodes that the policy hides, from nodes short of the depth."""
        open_ = self.levels.where(F.col("depth") < self.depth).select("project", "handler", F.col("node").alias("source"))
        return open_.join(self.edges.where("hidden AND edge_kind <> 'INJECTS'"), ["project", "source"]).groupBy("project", "handler").agg(F.count(F.lit(1)).alias("n_hidden"))


def endpoint_summary(handlers: DataFrame, flow: Flow, nodes: DataFrame) -> DataFrame:
    """Per route: its handlers, paths, facts by category, hidden edges and completeness: ambiguous with several handlers or by its confidence."""
    per_handler = handlers.join(flow.paths().groupBy("project", "handler").agg(F.count(F.lit(1)).alias("paths")), ["project", "handler"], "left").join(flow.hidden(), ["project", "handler"], "left")
    counts = per_handler.groupBy("project", "route").agg(F.count(F.lit(1)).alias("n_handlers"), F.coalesce(F.sum("paths"), F.lit(0)).alias("n_paths"), F.coalesce(F.sum("n_hidden"), F.lit(0)).alias("n_hidden"))
    categories = ("reads", "writes", "events", "injections")
    facts = handlers.join(flow.facts(), ["project", "handler"]).select("project", "route", "category", "item").distinct().groupBy("project", "route").agg(*(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in categories))
    unsure = nodes.where("kind = 'ROUTE'").select("project", F.col("stable_id").alias("route"), (F.col("confidence") == "AMBIGUOUS").cast("int").alias("unsure"))
    whole = counts.join(facts, ["project", "route"], "left").fillna({f"n_{c}": 0 for c in categories}).join(unsure, ["project", "route"])
    state = names.completeness(F.lit(False), F.col("unsure") + F.col("n_handlers") - 1, F.lit(0), F.lit(False))
    return whole.withColumn("completeness", state).drop("unsure")
