"""Column expressions over names, identifiers and paths of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of stable identifiers and the route verbs.
PLAIN_KINDS = ("project", "crate", "module", "package", "type", "trait", "function", "variant", "const", "static", "macro", "associated_type", "bean", "entity", "config")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_ID_BYTES = 1024
PROJECT_NAMESPACE = "2bbd078153ac4e839e4b87ecad76bf89"
# Prefixes of symbols that don't belong to an application, names of utilities, and the kinds that are framework components with their roles.
EXTERNAL = ("java.", "javax.", "jakarta.", "org.springframework.")
UTILITY = ("toString", "hashCode", "equals", "requireNonNull", "debug", "info", "warn", "error", "trace")
ROLES = {"ROUTE": "ROUTE", "REPOSITORY": "REPOSITORY", "ENTITY": "ENTITY", "EVENT_TYPE": "EVENT", "CONFIG_PROPERTY": "CONFIGURATION"}


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def is_valid_id(c: Column) -> Column:
    """Whether a stable identifier follows the grammar of its kind."""
    plain = c.rlike(rf"^({'|'.join(PLAIN_KINDS)}):[^\n\r]*\S")
    method = c.rlike(r"^method:[^#]+#[^(]+\(.*\)$") | c.rlike(r"^constructor:[^#]+#<init>\(.*\)$")
    return (F.octet_length(c) <= MAX_ID_BYTES) & ~c.rlike(r"[\x00\r\n]") & (plain | method | c.rlike(r"^field:[^#]+#.+$") | c.rlike(rf"^route:({'|'.join(VERBS)}):/"))


def signature(c: Column) -> Column:
    """What follows the kind of a stable identifier."""
    return F.regexp_replace(c, "^[^:]*:", "")


def declaring_type(c: Column) -> Column:
    """The owner within a stable identifier: what stands before the first number sign; all of it without one."""
    return F.substring_index(signature(c), "#", 1)


def derived_simple_name(c: Column) -> Column:
    """The last segment after a dot or number sign, then what stands before its bracket."""
    return F.regexp_extract(F.regexp_extract(c, r"([^.#]*)$", 1), r"^([^(]*)", 1)


def normalised_tokens(c: Column) -> Column:
    """Words in lower case between single spaces; camel case is split, anything else separates."""
    split = F.regexp_replace(c, r"(?<=\p{Ll})(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.lower(split), r"[^\p{L}\p{N}]+", " "))


def kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"))


def upper_snake(c: Column) -> Column:
    """Words between underscores, ASCII letters in upper case."""
    return F.translate(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), LOWER, UPPER)


def decapitalised(c: Column) -> Column:
    """The first letter in lower case, unless the name begins with two capitals."""
    return F.when(c.rlike("^[A-Z]{2}"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30)))


def access_class(c: Column) -> Column:
    """WRITE, READ or null by how a method's name begins."""
    name = ascii_lower(c)
    return F.when(name.rlike("^(save|delete|remove)"), "WRITE").when(name.rlike("^(find|read|get|exists|count|list)"), "READ")


def normal_route(c: Column) -> Column:
    """The path of a derived route: one slash in front, none behind and none doubled."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(c), "/+", "/"), "^/|/$", "")
    return F.concat(F.lit("/"), inner)


def asked_route(c: Column) -> Column:
    """The path of a route that is asked for: one slash in front and none behind; slashes within it stay as they are."""
    return F.concat(F.lit("/"), F.trim(F.trim(c), F.lit("/")))


def is_application(file_path: Column, stable_id: Column) -> Column:
    """Whether a symbol has a file and is none of a library."""
    return file_path.isNotNull() & ~stable_id.rlike(rf"^method:({'|'.join(p.replace('.', '[.]') for p in EXTERNAL)})")


def is_suppressed(kind: Column, simple_name: Column, file_path: Column, stable_id: Column, metadata: Column) -> Column:
    """Whether the default policy hides a symbol: of a library, an accessor method, generated, or named like a utility."""
    accessor = (kind == "METHOD") & F.coalesce(simple_name.rlike("^(get|set|is)"), F.lit(False))
    utility = F.coalesce(simple_name.isin(*UTILITY), F.lit(False))
    generated = F.coalesce(F.get_json_object(metadata, "$.generated") == "true", F.lit(False))
    return ~is_application(file_path, stable_id) | accessor | utility | generated


def framework_role(kind: Column, metadata: Column) -> Column:
    """The role of a symbol by its kind, a bean's by its stereotype, any other's by its first telling annotation; null without one."""
    role = F.lit(None).cast("string")
    annotations = F.filter(F.from_json(F.get_json_object(metadata, "$.annotations"), "array<string>"), lambda a: a.endswith("Controller") | a.endswith("Service"))
    first = F.get(annotations, F.lit(0))
    role = F.when(first.endswith("Controller"), "CONTROLLER").when(first.endswith("Service"), "SERVICE")
    chosen = F.when(kind == "BEAN", F.coalesce(F.translate(F.get_json_object(metadata, "$.stereotype"), LOWER, UPPER), F.lit("BEAN")))
    for k, r in ROLES.items():
        chosen = chosen.when(kind == k, r)
    return chosen.otherwise(role)


def owner_id(kind: Column, stable_id: Column, metadata: Column) -> Column:
    """The declaring type: as the metadata say, else of a method or constructor by its identifier, else null."""
    by_id = F.when(kind.isin("METHOD", "CONSTRUCTOR") & signature(stable_id).contains("#"), F.concat(F.lit("type:"), declaring_type(stable_id)))
    return F.coalesce(F.get_json_object(metadata, "$.declaring_type"), by_id)


def is_sensitive(path: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Whether a file may hold secrets by its name, or lies under one of the excluded paths."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = p.rlike(r"(^|/)\.env(\.[^/]*)?$|(credential|secret)[^/]*$|\.(pem|key|p12|pfx)$|/\.ssh/")
    for entry in excluded:
        e = entry.replace("\\", "/").lower()
        found = found | (p == e) | p.startswith(e + "/")
    return found


def is_safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root: no empty, single- or double-dotted part, drive, NUL or lost character."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (path != "") & ~path.rlike(r"[\x00\uFFFD]|^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def bounded(c: Column, most: int) -> Column:
    """No more than so many characters of a text."""
    return F.left(c, F.lit(most))


def placeholder_key(c: Column) -> Column:
    """The key of the first placeholder ${key} or ${key:default} in a text; null without one."""
    return F.nullif(F.regexp_extract(c, r"\$\{([^}:]+)(?::[^}]*)?\}", 1), F.lit(""))


def final_name(c: Column) -> Column:
    """The last segment behind :: of a path, without type arguments; null if it is empty, self or a star."""
    last = F.trim(F.element_at(F.split(without_arguments(c), "::"), -1))
    return F.when(~last.isin("", "self", "*"), last)


def without_arguments(c: Column) -> Column:
    """A text without what stands between angle brackets, however deep they are nested; unmatched closing ones stay."""
    none = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        depth = acc.depth + F.when(x == "<", 1).when((x == ">") & (acc.depth > 0), -1).otherwise(0)
        kept = F.when((acc.depth == 0) & (x != "<"), F.concat(acc.text, x)).otherwise(acc.text)
        return F.struct(depth.cast("int").alias("depth"), kept.alias("text"))

    # Brackets and what stands between them are the elements, so that a text takes as many steps as it has brackets.
    return F.aggregate(F.regexp_extract_all(c, F.lit("[<>]|[^<>]+"), F.lit(0)), none, step, lambda acc: acc.text)


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a place in a text, given by the number of characters before it."""
    before = F.left(text, offset.cast("int"))
    return (1 + F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def completeness(partial: Column, n_ambiguous: Column, n_unresolved: Column, truncated: Column) -> Column:
    """How complete an answer is; only a complete one can be truncated."""
    return F.when(partial, "partial").when(n_ambiguous > 0, "ambiguous").when(n_unresolved > 0, "unresolved").when(truncated, "truncated").otherwise("complete")


def is_bad_location(file_path: Column, start: Column, end: Column) -> Column:
    """Whether a location isn't there or not there as a whole, or its lines are no range from one on."""
    given = [file_path.isNotNull(), start.isNotNull(), end.isNotNull()]
    some, all_ = given[0] | given[1] | given[2], given[0] & given[1] & given[2]
    return some & ~F.coalesce(all_ & (start > 0) & (end >= start), F.lit(False))


def lexical_rank(query: Column, stable_id: Column, qualified: Column, simple: Column) -> Column:
    """How well a symbol fits a query, by the first rule that holds. Only the simple name is compared as words."""
    tokens, low = normalised_tokens(query), ascii_lower(query)
    ql, sl, st = ascii_lower(qualified), ascii_lower(F.coalesce(simple, F.lit(""))), normalised_tokens(F.coalesce(simple, F.lit("")))
    return (
        F.when(stable_id == query, 900).when(ql == low, 700).when(sl == low, 600).when(st == tokens, 500).when(ql.startswith(low) | sl.startswith(low), 400)
        .when(st.startswith(tokens) | F.array_contains(F.split(st, " "), tokens), 350).when(ql.contains(low) | st.contains(tokens), 200).otherwise(0)
    )


def fnv1a64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of UTF-8 bytes in hexadecimal, in two 32-bit halves so that nothing overflows."""
    mask = F.lit(0xFFFFFFFF)
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("bigint"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        # The prime is 2 ** 40 + 0x1B3: the low half times 0x1B3 carries into the high one, which also gets the low half shifted by eight.
        low = acc.lo.bitwiseXOR(byte)
        product = low * 0x1B3
        high = (acc.hi * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    done = F.aggregate(codes, start, step)
    return F.lower(F.concat(F.lpad(F.hex(done.hi), 8, "0"), F.lpad(F.hex(done.lo), 8, "0")))


def project_id(root: Column, prefix: str = "") -> Column:
    """The version 5 UUID of a project's root folder within the projects' namespace, backslashes as slashes, behind a prefix such as "project:"."""
    h = F.sha1(F.concat(F.unhex(F.lit(PROJECT_NAMESPACE)), F.encode(F.replace(root, F.lit("\\"), F.lit("/")), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat(F.lit(prefix), uuid)
