"""Facts from source files, as rows: Java statements, declarations, endpoints, clients, topics, Angular and build files.

Input is files(project, path, text). Java texts are split into statements at `;`, `{` and `}` outside strings; a
running sum over a file's statements gives the nesting depth, from which classes, members and bodies follow. Only a
file's own rows meet in a task. Missing or empty texts give no rows; code that does not balance gives what its
statements still tell. Braces and semicolons in comments other than inline tags are not recognised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Annotations, types and words that results depend on.
BEAN_TYPES = {"RestController": "controller", "Controller": "controller", "Service": "service", "Repository": "repository", "Component": "component", "Configuration": "configuration", "ControllerAdvice": "advice", "RestControllerAdvice": "advice"}
URL_ENDINGS = ["url", "host", "base", "uri", "endpoint", "baseurl"]
DTO_TOKENS = "DTO|Dto|Request|Response|Payload"
VALIDATIONS = ["NotNull", "NotEmpty", "NotBlank", "Size", "Min", "Max", "Email", "Pattern", "Positive", "Valid"]
RELATIONS = "OneToMany|ManyToOne|OneToOne|ManyToMany|DBRef"
QUERY_VERBS = {"findAll": "SELECT ALL", "findFirst": "SELECT FIRST", "findTop": "SELECT TOP", "find": "SELECT", "get": "SELECT", "read": "SELECT", "count": "COUNT", "exists": "EXISTS", "delete": "DELETE", "remove": "DELETE", "stream": "STREAM"}
CRITERIA = r"(?:mongoTemplate|reactiveMongoTemplate)\s*\.\s*(find\w*|updateMulti|updateFirst|remove|count|exists|upsert)\s*\("
QUERY_SUFFIXES = {"GreaterThanEqual": ">= ?", "LessThanEqual": "<= ?", "IsNotNull": "IS NOT NULL", "StartingWith": "LIKE ?%", "EndingWith": "LIKE %?", "GreaterThan": "> ?", "Containing": "LIKE %?%", "LessThan": "< ?", "NotLike": "NOT LIKE ?", "Between": "BETWEEN ? AND ?", "IsNull": "IS NULL", "Before": "< ?", "NotIn": "NOT IN (?)", "After": "> ?", "Like": "LIKE ?", "Not": "<> ?", "In": "IN (?)", "True": "= true", "False": "= false"}

_ARGS = r"(?:\(((?:\"[^\"\n]*\"|\([^()]*\)|[^()\"])*+)\))?"
_END = r"(?<=[;{}])(?=(?:[^\"\n]*+\"[^\"\n]*+\")*+[^\"\n]*+(?:\n|$))"
_MODIFIERS = r"^(?:(?:public|protected|private|static|final|default|abstract|synchronized|transient|volatile)\s+)*"
_DOC = r"/\*\*.*?\*/"
_VERBS = "Get|Post|Put|Delete|Patch|Request"
#: Stands between the groups of a match.
_MARK = "\ue002"


def _get(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, else null; a condition on it would look for it twice."""
    return F.get(F.filter(F.array(F.regexp_extract(c, pattern, group)), lambda x: x != ""), F.lit(0))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _args(c: Column, annotation: str) -> Column:
    """What stands in the parentheses of an annotation; empty without them, null without the annotation."""
    return F.when(F.rlike(c, F.lit(rf"@{annotation}\b")), F.regexp_extract(c, rf"@{annotation}\b{_ARGS}", 1))


def _quoted(args: Column, *names: str) -> Column:
    """The string given by one of the names, else a string given without name."""
    return F.coalesce(_get(args, rf"(?:{'|'.join(names)})\s*=\s*\[?\s*\"([^\"]*)\""), _get(args, r"^\s*\[?\s*\"([^\"]*)\""))


def _of(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.rlike("path", F.lit(pattern)))


def java_statements(files: DataFrame) -> DataFrame:
    """project, path, no, stmt, depth, cls, kind, head (the class's own statement), member (number of the member's first statement)."""
    each = _of(files, r"\.java$").select("project", "path", F.col("text").alias("code"))
    for mark, pattern, by in [("/*", r"(?s)/\*(?!\*).*?\*/", ""), ("//", r"(?m)(?<![:\"\w/])//[^\n]*", ""), ("{@", r"\{@\w+\s+([^}]*)\}", "$1"), ("{", r"([=(,]\s*)\{((?:\"[^\"\n]*\"|[^{};\"])*+)\}", "$1[$2]")]:
        each = each.withColumn("code", F.when(F.contains("code", F.lit(mark)), F.regexp_replace("code", pattern, by)).otherwise(F.col("code")))
    each = each.select("project", "path", F.posexplode(F.split("code", _END)).alias("no", "stmt"))
    each = each.withColumn("stmt", F.trim(F.regexp_replace("stmt", r"\s+", " "))).where("stmt <> ''")
    by_file = Window.partitionBy("project", "path").orderBy("no")
    step = F.when(F.endswith("stmt", F.lit("{")), 1).when(F.endswith("stmt", F.lit("}")), -1).otherwise(0)
    each = each.withColumn("depth", F.coalesce(F.sum(step).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plain = F.regexp_replace(F.regexp_replace("stmt", _DOC, ""), r"\"[^\"]*\"", "")
    name = F.when((F.col("depth") == 0) & F.endswith("stmt", F.lit("{")), _get(plain, r"\b(?:class|interface|enum|record)\s+(\w+)"))
    so_far = by_file.rowsBetween(Window.unboundedPreceding, 0)
    return each.select(
        "project", "path", "no", "stmt", "depth", F.last(name, True).over(so_far).alias("cls"), F.last(F.when(name.isNotNull(), _get(plain, r"\b(class|interface|enum|record)\s+\w+")), True).over(so_far).alias("kind"),
        F.last(F.when(name.isNotNull(), F.col("stmt")), True).over(so_far).alias("head"), F.last(F.when((F.col("depth") == 1) & (F.col("stmt") != "}"), F.col("no")), True).over(so_far).alias("member"),
    )


def java_members(statements: DataFrame) -> DataFrame:
    """Methods, constructors and fields: project, path, cls, kind, head, no, stmt, what, type, name, params, doc.

    Each rule is tried once for a statement: what it finds is one text with its groups between marks, and a statement without
    any gives no row where that is divided (a filter would be pushed below, and try all rules again).
    """
    m = statements.where("depth = 1 and stmt <> '}' and cls is not null")
    has = lambda x: F.contains("stmt", F.lit(x))
    m = m.withColumn("bare", F.when(has("/**"), F.regexp_replace("stmt", _DOC, "")).otherwise(F.col("stmt")))
    m = m.withColumn("bare", F.when(has("@"), F.regexp_replace("bare", rf"@\w+\b{_ARGS}", "")).otherwise(F.col("bare")))
    m = m.withColumn("decl", F.regexp_replace(F.trim("bare"), r"\s+", " "))
    method = _MODIFIERS + r"(?:<[^>]+>\s+)?([\w.<>\[\], ?]+?)\s+(\w+)\s*\(([^)]*)\).*"
    made = _MODIFIERS + r"(\w+)\s*\(([^)]*)\).*"
    field = _MODIFIERS + r"([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=.*)?;$"
    rule = lambda pattern, what, *groups: F.regexp_replace("decl", rf"(?s){pattern}", _MARK.join([_MARK + what, *groups]))
    # a field ends in a semicolon; what begins with the class's name is its constructor, all else that takes something a method
    m = m.withColumn("found", F.when(F.endswith("decl", F.lit(";")), rule(field, "field", "$1", "$2")).otherwise(F.col("decl")))
    known, takes = F.startswith("found", F.lit(_MARK)), F.contains("decl", F.lit("("))
    m = m.withColumn("found", F.when(~known & takes & F.contains("decl", F.col("cls")), rule(made, "constructor", "$1", "$1", "$2")).otherwise(F.col("found")))
    own = ~F.startswith("found", F.lit(f"{_MARK}constructor{_MARK}")) | (F.split_part("found", F.lit(_MARK), F.lit(3)) == F.col("cls"))
    m = m.withColumn("found", F.when((~known | ~own) & takes, rule(method, "method", "$1", "$2", "$3")).when(own, F.col("found")))
    doc = F.trim(F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), _all(F.col("stmt"), r"/\*\*(.*?)\*/")), -1), r"[\s*]+", " "))
    m = m.withColumn("doc", F.when(has("/**"), doc).otherwise(""))
    each = m.select("project", "path", "cls", "kind", "head", "no", "stmt", "doc", F.explode(F.filter(F.array(F.split("found", _MARK, 5)), lambda x: F.startswith("found", F.lit(_MARK)) & ~F.startswith("decl", F.lit(_MARK)))).alias("x"))
    group = lambda n: F.nullif(F.get("x", F.lit(n)), F.lit(""))
    return each.select("project", "path", "cls", "kind", "head", "no", "stmt", F.get("x", F.lit(1)).alias("what"), group(2).alias("type"), group(3).alias("name"), F.get("x", F.lit(4)).alias("params"), F.substring("doc", 1, 200).alias("doc"))


def constants(members: DataFrame) -> DataFrame:
    """project, name (`Class.FIELD` and `FIELD`), value; of equal short names the last by path wins."""
    found = members.where("what = 'field' and type = 'String'").where(F.rlike("stmt", F.lit(r"static\s+final|final\s+static")))
    found = found.select("project", "path", "cls", F.col("name").alias("f"), F.array_join(_all(F.regexp_extract("stmt", r"=(.*);$", 1), r"\"([^\"]*)\""), "").alias("value"))
    named = found.select("project", "path", "value", F.explode(F.array(F.concat_ws(".", "cls", "f"), "f")).alias("name"))
    return named.groupBy("project", "name").agg(F.max_by("value", "path").alias("value"))


def _mapped(methods: DataFrame) -> DataFrame:
    """Methods with a mapping: its verb, and args as `_args` gives them."""
    m = methods.where(F.contains("stmt", F.lit("Mapping"))).withColumn("verb", F.regexp_extract("stmt", rf"@({_VERBS})Mapping\b", 1))
    return m.where("verb <> ''").withColumn("args", _args(F.col("stmt"), rf"(?:{_VERBS})Mapping"))


def endpoints(members: DataFrame) -> DataFrame:
    """One row for each mapped method: path, method, controller, handler, DTOs, roles, auth_required, javadoc, file, no.

    A path that is not quoted is looked up among the constants of its project, and is empty if not found.
    """
    m = _mapped(members.where("what = 'method' and kind = 'class'").withColumnRenamed("path", "file"))
    m = m.withColumn("args", F.coalesce("args", F.lit(""))).withColumn("quoted", _quoted(F.col("args"), "path", "value")).withColumn("const", _get(F.col("args"), r"(?:^|(?:path|value)\s*=)\s*([A-Z]\w*(?:\.\w+)?)\s*(?:,|$)"))
    known = constants(members).select("project", F.col("name").alias("const"), "value")
    m = m.join(known, ["project", "const"], "left")
    base = F.coalesce(_quoted(_args(F.col("head"), "RequestMapping"), "path", "value"), F.lit(""))
    path = F.regexp_replace(F.concat(F.lit("/"), T.join_paths(base, F.coalesce("quoted", "value", F.lit("")))), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    by_name = F.coalesce(_get(F.col("args"), r"RequestMethod\.(\w+)"), F.lit("GET"))
    secured = F.concat_ws(" ", F.col("head"), F.col("stmt"))
    body = _get(F.col("stmt"), r"@RequestBody\s+(?:@\w+\s+)*(?:final\s+)?([\w<>]+)")
    answer = T.unwrap_generic(F.regexp_replace("type", r"\s", ""))
    return m.select(
        "project", path.alias("path"), F.when(F.col("verb") == "Request", by_name).otherwise(F.upper("verb")).alias("method"), F.col("cls").alias("controller"), F.col("name").alias("handler"),
        T.unwrap_generic(body).alias("request_dto"), F.when(~F.lower(answer).isin("void", "?"), answer).alias("response_dto"), T.roles(secured).alias("roles"),
        F.rlike(secured, F.lit(r"@(?:PreAuthorize|Secured|RolesAllowed)\b")).alias("auth_required"), F.col("doc").alias("javadoc"),
        F.col("file").alias("file"), "no",
    )


def beans(members: DataFrame) -> DataFrame:
    """Classes of a known stereotype or repository interfaces: type, dependencies, methods, transactional methods."""
    kind = F.lit(None).cast("string")
    for annotation, name in reversed(BEAN_TYPES.items()):
        kind = F.when(F.rlike("head", F.lit(rf"@{annotation}\b")), name).otherwise(kind)
    kind = F.when((F.col("kind") == "interface") & F.rlike("head", F.lit(r"extends\s+\w*Repository\b")), "repository").otherwise(kind)
    m = members.withColumn("bean_type", kind).where("bean_type is not null")
    wired = (F.col("what") == "field") & F.rlike("stmt", F.lit(r"@(?:Autowired|Inject|Resource)\b|\bprivate final [A-Z]")) & ~F.rlike("stmt", F.lit(r"\bstatic\b"))
    given = F.when(F.col("what") == "constructor", _all(F.coalesce("params", F.lit("")), r"(?:^|,)\s*(?:final\s+)?([A-Z]\w*)"))
    used = F.when(wired, F.array(F.regexp_extract("type", r"^\w+", 0))).otherwise(F.coalesce(given, F.array().cast("array<string>")))
    is_method = F.col("what") == "method"
    marked = F.when(is_method & F.rlike("stmt", F.lit(r"@Transactional\b")), F.col("name"))
    out = m.groupBy("project", "path", F.col("cls").alias("name"), "bean_type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(used)))).alias("dependencies"), F.array_sort(F.collect_set(F.when(is_method, F.col("name")))).alias("methods"), F.array_sort(F.collect_set(marked)).alias("transactional_methods")
    )
    return out.withColumn("dependencies", F.filter("dependencies", lambda x: ~x.isin("String", "Long", "Integer", "Boolean")))


def method_calls(statements: DataFrame, members: DataFrame, most: int = 8) -> DataFrame:
    """project, cls, method, calls: the first `most` distinct `field.call` of a method on the class's own fields, sorted."""
    fields = members.where("what = 'field' and length(name) > 2").select("project", "path", F.col("name").alias("field")).distinct()
    bodies = statements.where("depth > 1 and member is not null").select("project", "path", "member", F.explode(_all(F.col("stmt"), r"\b([a-z]\w*\.\w+)\s*\(")).alias("call"))
    hits = bodies.withColumn("field", F.substring_index("call", ".", 1)).join(fields, ["project", "path", "field"])
    owner = members.where("what = 'method'").select("project", "path", F.col("no").alias("member"), "cls", F.col("name").alias("method"))
    called = hits.join(owner, ["project", "path", "member"]).groupBy("project", "cls", "method")
    return called.agg(F.slice(F.array_sort(F.collect_set("call")), 1, most).alias("calls"))


def method_bodies(statements: DataFrame, members: DataFrame, most: int = 500) -> DataFrame:
    """project, cls, method, body: statements of a method in order, cut to `most` characters; trivial accessors are left out."""
    owner = members.where("what = 'method'").select("project", "path", F.col("no").alias("member"), "cls", F.col("name").alias("method"))
    inner = statements.where("depth > 1 and member is not null").groupBy("project", "path", "member").agg(F.array_sort(F.collect_list(F.struct("no", "stmt"))).alias("x"))
    body = F.regexp_replace(F.array_join(F.transform("x", lambda s: s["stmt"]), " "), r"\s*\}$", "")
    both = inner.select("project", "path", "member", body.alias("body")).join(owner, ["project", "path", "member"])
    trivial = F.rlike("method", F.lit(r"^(?:get|set|is)[A-Z]")) & F.rlike("body", F.lit(r"^(?:return (?:this\.)?\w+;|this\.\w+ = \w+;)$"))
    return both.where(~trivial).select("project", "cls", "method", F.substring("body", 1, most).alias("body"))


def marked_methods(members: DataFrame) -> DataFrame:
    """Scheduled methods and exception handlers: project, cls, method, mark, value."""
    m = members.where("what = 'method'")
    rule = m.select("project", "cls", F.col("name").alias("method"), F.lit("scheduled").alias("mark"), _args(F.col("stmt"), "Scheduled").alias("value"))
    caught = m.select("project", "cls", F.col("name").alias("method"), F.lit("exception").alias("mark"), F.explode(_all(_args(F.col("stmt"), "ExceptionHandler"), r"(\w+)\.class")).alias("value"))
    return rule.where("value is not null").unionByName(caught)


def entities(members: DataFrame) -> DataFrame:
    """JPA entities and documents: project, name, table, fields, relationships such as `OneToMany -> items`."""
    m = members.where(F.rlike("head", F.lit(r"@(?:Entity|Document)\b")))
    table = F.coalesce(_quoted(_args(F.col("head"), "Table"), "name"), _quoted(_args(F.col("head"), "Document"), "collection", "value"), F.lower("cls"))
    relation = _get(F.col("stmt"), rf"@({RELATIONS})\b")
    static = F.rlike("stmt", F.lit(r"\bstatic\b"))
    field = F.when((F.col("what") == "field") & relation.isNull() & ~static, F.struct("no", F.col("name").alias("x")))
    link = F.when((F.col("what") == "field") & relation.isNotNull(), F.struct("no", F.concat(relation, F.lit(" -> "), F.col("name")).alias("x")))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"])
    return m.groupBy("project", F.col("cls").alias("name"), table.alias("table")).agg(listed(field).alias("fields"), listed(link).alias("relationships"))


def dto_fields(members: DataFrame) -> DataFrame:
    """project, dto, name, type, required, json_property, validations of classes named like transfer objects."""
    m = members.where("what = 'field'").where(F.rlike("cls", F.lit(DTO_TOKENS)) & ~F.rlike("stmt", F.lit(r"\bstatic\b")))
    checks = F.array_sort(F.array_distinct(F.array_intersect(_all(F.col("stmt"), r"@(\w+)"), F.array(*map(F.lit, VALIDATIONS)))))
    need = F.arrays_overlap(checks, F.array(*map(F.lit, ["NotNull", "NotEmpty", "NotBlank"])))
    return m.select("project", F.col("cls").alias("dto"), "name", "type", need.alias("required"), _quoted(_args(F.col("stmt"), "JsonProperty"), "value").alias("json_property"), checks.alias("validations"))


def client_calls(members: DataFrame, settings: DataFrame) -> DataFrame:
    """Calls of declarative HTTP clients; `${key}` in url is looked up in settings(project, key, value).

    project, client, target (host of the URL's first label, else what the key says, else the client's name), property_key, method,
    path, request_dto, response_dto, path_params, request_params, oauth_scope (its setting, else as it is written), url.
    """
    m = _mapped(members.where("what = 'method' and kind = 'interface'").where(F.rlike("head", F.lit(r"@FeignClient\b"))))
    given = F.col("given")
    m = m.withColumn("given", _args(F.col("head"), "FeignClient"))
    m = m.withColumn("client", F.coalesce(_quoted(given, "name", "value", "contextId"), F.col("cls"))).withColumn("url", _get(given, r"\burl\s*=\s*\"([^\"]*)\"")).withColumn("property_key", _get(F.col("url"), r"\$\{([^}:]+)"))
    m = m.join(settings.select("project", F.col("key").alias("property_key"), F.col("value").alias("found")), ["project", "property_key"], "left")
    asked = _get(F.coalesce(_args(F.col("head"), "AuthorizationToken"), _args(F.col("stmt"), "AuthorizationToken")), r"\bscope\s*=\s*\"([^\"]+)\"")
    m = m.withColumn("scope", asked).join(settings.select("project", F.col("key").alias("scope"), F.col("value").alias("scoped")), ["project", "scope"], "left")
    host = _get(F.coalesce("found", "url"), r"^https?://([\w-]+)")
    parts = F.split(F.rtrim("property_key", F.lit(".")), r"\.")
    tail = F.lower(F.element_at(parts, -1)).isin(URL_ENDINGS) & (F.size(parts) > 1)
    told = F.when(F.col("found").isNull() & F.col("property_key").isNotNull(), F.array_join(F.when(tail, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts), "-"))
    given_names = lambda mark: _all(F.col("stmt"), rf"@{mark}(?:\([^)]*\))?\s+(?:final\s+)?[\w<>\[\]., ]+?\s+(\w+)\s*[,)]")
    args = F.col("args")
    base = F.coalesce(_get(given, r"\bpath\s*=\s*\"([^\"]*)\""), F.lit(""))
    path = F.regexp_replace(F.concat(F.lit("/"), T.join_paths(base, F.coalesce(_quoted(args, "path", "value"), F.lit("")))), "/{2,}", "/")
    by_name = F.coalesce(_get(args, r"RequestMethod\.(\w+)"), F.lit("GET"))
    answer = T.unwrap_generic(F.regexp_replace("type", r"\s", ""))
    body = _get(F.col("stmt"), r"@RequestBody\s+(?:@\w+\s+)*([\w<>]+)")
    return m.select("project", "client", F.coalesce(host, told, "client").alias("target"), "property_key", F.when(F.col("verb") == "Request", by_name).otherwise(F.upper("verb")).alias("method"), path.alias("path"), body.alias("request_dto"), F.when(answer != "void", answer).alias("response_dto"), given_names("PathVariable").alias("path_params"), given_names("RequestParam").alias("request_params"), F.coalesce("scoped", "scope").alias("oauth_scope"), F.coalesce("found", "url").alias("url"))


def derived_query(name: Column) -> Column:
    """`findByStatusAndAgeGreaterThan` as `SELECT WHERE status = ? AND age > ?`; null for other names.

    `And` and `Or` divide only before a capital and never at the start; longer endings go first.
    """
    verb = F
    for prefix, said in QUERY_VERBS.items():
        verb = verb.when(F.startswith(name, F.lit(prefix)), said)
    rest = _get(name, rf"^(?:{'|'.join(QUERY_VERBS)})\w*?By([A-Z]\w*)$")
    order = _get(rest, r"OrderBy([A-Z]\w*)$")
    where = F.regexp_replace(rest, r"OrderBy[A-Z]\w*$", "")

    def term(x: Column) -> Column:
        out = F
        for ending, said in QUERY_SUFFIXES.items():
            out = out.when(F.endswith(x, F.lit(ending)) & (F.length(x) > len(ending)), F.concat(_field(F.substring(x, F.lit(1), F.length(x) - len(ending))), F.lit(" " + said)))
        return out.otherwise(F.concat(_field(x), F.lit(" = ?")))

    either = F.split(where, r"(?<=[a-z0-9])Or(?=[A-Z])")
    said = F.array_join(F.transform(either, lambda o: F.array_join(F.transform(F.split(o, r"(?<=[a-z0-9])And(?=[A-Z])"), term), " AND ")), " OR ")
    tail = F.when(order.isNotNull(), F.concat(F.lit(" ORDER BY "), _field(F.regexp_replace(order, "(Asc|Desc)$", "")), F.when(F.endswith(order, F.lit("Desc")), " DESC").otherwise(""))).otherwise("")
    return F.when(rest.isNotNull(), F.concat(verb, F.when(said != "", F.concat(F.lit(" WHERE "), said)).otherwise(""), tail))


def _field(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def repository_queries(members: DataFrame, most: int = 300) -> DataFrame:
    """project, repository, method, query: a written query of ten characters or more, else the derived one."""
    m = members.where("what = 'method' and kind = 'interface'").where(F.rlike("head", F.lit(r"extends\s+\w*Repository\b")))
    told = F.array_join(_all(_args(F.col("stmt"), "Query"), r"\"([^\"]*)\""), "")
    written = F.when(F.length(told) >= 10, F.substring(told, 1, most))
    return m.select("project", F.col("cls").alias("repository"), F.col("name").alias("method"), F.coalesce(written, derived_query(F.col("name"))).alias("query")).where("query is not null")


def criteria_queries(statements: DataFrame, members: DataFrame) -> DataFrame:
    """project, repository, method, query of calls that build their conditions: `[mongoTemplate.find] Item WHERE a = ? AND b = ?`."""
    each = statements.where("depth > 1 and member is not null").select("project", "path", "member", "no", "stmt", _get(F.col("stmt"), CRITERIA).alias("op")).where("op is not null")
    named = F.concat(_all(F.col("stmt"), r"Criteria\.where\s*\(\s*\"([^\"]+)\"\s*\)"), _all(F.col("stmt"), r"\.and\s*\(\s*\"([^\"]+)\"\s*\)"))
    where = F.array_join(F.transform(named, lambda c: F.concat(c, F.lit(" = ?"))), " AND ")
    target = F.coalesce(_get(F.col("stmt"), r",\s*([A-Z]\w*)\.class\s*\)"), F.lit("?"))
    said = F.concat(F.lit("[mongoTemplate."), "op", F.lit("] "), target, F.lit(" WHERE "), where)
    owner = members.where("what = 'method'").select("project", "path", F.col("no").alias("member"), F.col("cls").alias("repository"), F.col("name").alias("method"))
    return each.where(F.size(named) > 0).select("project", "path", "member", said.alias("query")).join(owner, ["project", "path", "member"]).select("project", "repository", "method", "query")


def security_facts(files: DataFrame) -> DataFrame:
    """For each project: what its Java texts say about security and the paths they open or close."""
    java = _of(files, r"\.java$")
    has = lambda p: F.bool_or(F.rlike("text", F.lit(p)))
    paths = lambda rule: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform(_all(F.col("text"), rf"Matchers\(([^)]*)\)\s*\.{rule}\("), lambda a: _all(a, r"\"([^\"]*)\"")))))))
    return java.groupBy("project").agg(has("@EnableWebSecurity").alias("web_security"), has("oauth2ResourceServer").alias("resource_server"), has("(?i)jwt").alias("jwt"), paths("permitAll").alias("open_paths"), paths("authenticated").alias("closed_paths"))


def components(files: DataFrame) -> DataFrame:
    """Angular components: inputs, outputs and injected types sorted; template events from the sibling or inline template."""
    c = _of(files, r"\.component\.ts$").withColumn("stem", F.regexp_replace("path", r"\.ts$", ""))
    pages = _of(files, r"\.component\.html$").select("project", F.regexp_replace("path", r"\.html$", "").alias("stem"), F.col("text").alias("page"))
    c = c.join(pages, ["project", "stem"], "left")
    t, names = F.col("text"), lambda p: F.array_sort(F.array_distinct(_all(F.col("text"), p)))
    injected = F.array_distinct(F.concat(_all(F.regexp_extract(t, r"constructor\s*\(([^)]*)\)", 1), r":\s*([A-Z]\w*)"), _all(t, r"\binject\(\s*([A-Z]\w*)")))
    shown = F.coalesce("page", _get(t, r"template\s*:\s*`([^`]*)`"), F.lit(""))
    return c.where(F.rlike(t, F.lit(r"export\s+class\s+\w+"))).select(
        "project", "path", _get(t, r"export\s+class\s+(\w+)").alias("name"), _get(t, r"selector\s*:\s*['\"]([^'\"]+)").alias("selector"), names(r"@Input\([^)]*\)\s*(?:set\s+)?(\w+)").alias("inputs"), names(r"@Output\([^)]*\)\s*(\w+)").alias("outputs"),
        injected.alias("injected"), names(r"@ViewChild(?:ren)?\(\s*['\"]?(\w+)").alias("view_children"), F.array_sort(F.array_distinct(_all(shown, r"\((\w[\w.]*)\)\s*="))).alias("template_events"),
    )


def script_calls(files: DataFrame) -> DataFrame:
    """project, path, method, url, response_shape of the `this.http.verb<T>(url` calls in each file.

    `${…}` becomes `*`; a plain name or `this.name` takes the text of that field where the file has it.
    """
    pattern = r"this\.http\s*\.\s*(?:get|post|put|delete|patch)\s*(?:<[^(]*>)?\(\s*(?:`[^`]*`|'[^']*'|\"[^\"]*\"|[\w.]+)"
    s = files.select("project", "path", "text", F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("call"))
    raw = _get(F.col("call"), r"\(\s*(`[^`]*`|'[^']*'|\"[^\"]*\"|[\w.]+)$")
    names = _all(F.col("text"), r"\b(\w+)\s*(?::\s*string\s*)?=\s*['\"`][^'\"`\n]*['\"`]")
    texts = _all(F.col("text"), r"\b\w+\s*(?::\s*string\s*)?=\s*['\"`]([^'\"`\n]*)['\"`]")
    field = F.regexp_extract(raw, r"^(?:this\.)?(\w+)$", 1)
    known = F.try_element_at(texts, F.nullif(F.array_position(names, field).cast("int"), F.lit(0)))
    said = F.coalesce(_get(raw, r"^[`'\"](.*)[`'\"]$"), known, raw)
    return s.select("project", "path", F.upper(F.regexp_extract("call", r"http\s*\.\s*(\w+)", 1)).alias("method"), F.regexp_replace(said, r"\$\{[^}]*\}", "*").alias("url"), _get(F.col("call"), r"<([^(]*)>\(").alias("response_shape"))


def http_calls(files: DataFrame) -> DataFrame:
    """script_calls of Angular services, with the service's class."""
    services = _of(files, r"\.service\.ts$")
    named = services.select("project", "path", _get(F.col("text"), r"export\s+class\s+(\w+)").alias("service")).distinct()
    return script_calls(services).join(named, ["project", "path"]).select("project", "path", "service", "method", "url", "response_shape")


def routes(files: DataFrame) -> DataFrame:
    """project, route, component, lazy, guards of route objects in Angular texts."""
    r = _of(files, r"rout(?:es|ing)[\w.-]*\.ts$").select("project", F.explode(_all(F.col("text"), r"(\{\s*path\s*:[^{}]*)")).alias("x"))
    x = F.col("x")
    return r.select("project", F.regexp_extract(x, r"path\s*:\s*['\"]([^'\"]*)", 1).alias("route"), _get(x, r"component\s*:\s*(\w+)").alias("component"), _get(x, r"import\(\s*['\"]([^'\"]+)").alias("lazy"), _all(F.regexp_extract(x, r"canActivate\s*:\s*\[([^\]]*)\]", 1), r"(\w+)").alias("guards"))


def store_features(files: DataFrame) -> DataFrame:
    """project, name, actions, effects, selectors of store files, merged by the name before their suffix."""
    s = _of(files, r"\.(?:actions|effects|selectors)\.ts$").withColumn("name", F.regexp_extract("path", r"([\w-]+)\.(?:actions|effects|selectors)\.ts$", 1)).withColumn("part", F.regexp_extract("path", r"\.(\w+)\.ts$", 1))
    found = {"actions": r"export\s+const\s+(\w+)\s*=\s*createAction", "effects": r"(\w+)\$?\s*=\s*createEffect", "selectors": r"export\s+const\s+(\w+)\s*=\s*create(?:Feature)?Selector"}
    each = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("part") == k, _all(F.col("text"), p)))))).alias(k) for k, p in found.items()]
    return s.groupBy("project", "name").agg(*each)


def environments(files: DataFrame) -> DataFrame:
    """project, path, key, value of environment files: strings, numbers and truth values; the last of equal keys."""
    e = _of(files, r"environment[\w.-]*\.ts$").select("project", "path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\w+\s*:\s*(?:'[^'\n]*'|\"[^\"\n]*\"|true|false|\d+))"), F.lit(1))).alias("no", "x"))
    value = F.regexp_replace(F.regexp_extract("x", r"^\w+\s*:\s*(.*)$", 1), r"^['\"]|['\"]$", "")
    return e.groupBy("project", "path", F.regexp_extract("x", r"^\w+", 0).alias("key")).agg(F.max_by(value, "no").alias("value"))


def build_dependencies(files: DataFrame) -> DataFrame:
    """project, dependency (`group:artifact[:version][ [scope]]`) of pom.xml, else of Gradle files."""
    pom = _of(files, r"(?:^|/)pom\.xml$").select("project", F.explode(_all(F.col("text"), r"(?s)<dependency>(.*?)</dependency>")).alias("x"))
    tag = lambda t: _get(F.col("x"), rf"<{t}>\s*([^<\s]+)\s*</{t}>")
    a = pom.select("project", F.concat(F.concat_ws(":", tag("groupId"), tag("artifactId"), tag("version")), F.coalesce(F.concat(F.lit(" ["), tag("scope"), F.lit("]")), F.lit(""))).alias("dependency"))
    gradle = _of(files, r"(?:^|/)build\.gradle(?:\.kts)?$").join(pom.select("project").distinct(), "project", "left_anti")
    b = gradle.select("project", F.explode(_all(F.col("text"), r"(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|annotationProcessor)\s*\(?\s*['\"]([^'\"]+)['\"]")).alias("dependency"))
    return a.unionByName(b).distinct()


#: What changes of a changelog are read, and their columns.
_CHANGE = "array<struct<_tableName:string,column:array<struct<_name:string,_type:string>>>>"
_CHANGELOG = f"changeSet array<struct<createTable:{_CHANGE},addColumn:{_CHANGE}>>"


def migrations(files: DataFrame) -> DataFrame:
    """project, file, tables (in order of appearance), columns (`name:type`, six at most) of versioned SQL files and of
    changelogs in XML; a changelog that names no table gives no row, one that cannot be read no columns."""
    m = _of(files, r"(?:^|/)V[\w.]*\.sql$")
    tables = F.array_distinct(_all(F.col("text"), r"(?i)(?:create|alter|drop)\s+table\s+(?:if\s+(?:not\s+)?exists\s+)?[\"`]?(\w+)"))
    added = F.slice(F.transform(_all(F.col("text"), r"(?i)add\s+column\s+(?:if\s+not\s+exists\s+)?(\w+\s+\w+)"), lambda c: F.regexp_replace(c, r"\s+", ":")), 1, 6)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    sql = m.select("project", name, tables.alias("tables"), added.alias("columns"))
    logs = _of(files, r"(?:^|/)db\.changelog[^/]*\.xml$").withColumn("x", F.from_xml("text", _CHANGELOG, {"mode": "PERMISSIVE"}))
    named = F.array_distinct(_all(F.col("text"), r"\btableName\s*=\s*[\"'](\w+)[\"']"))
    new = F.flatten(F.transform(F.coalesce("x.changeSet", F.array()), lambda s: F.coalesce(s["addColumn"], F.array())))
    columns = F.flatten(F.transform(new, lambda c: F.transform(F.coalesce(c["column"], F.array()), lambda k: F.concat_ws(":", k["_name"], k["_type"]))))
    xml = logs.select("project", name, named.alias("tables"), F.slice(columns, 1, 6).alias("columns")).where("size(tables) > 0")
    return sql.unionByName(xml)
