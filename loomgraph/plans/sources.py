"""Source files written out from the relational tables, in Spark: what the extraction queries read.

Customers become controllers with an endpoint for each order, parts become entities and transfer objects, suppliers
become clients with a call for each line that they supply, users of the event table become listeners and senders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def _slug(c: str):
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"))


#: Digits as words: names of letters only, for keys.
DIGITS = ["Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine"]
NATION_NAME = f"('Nation' || {DIGITS}[(n_nationkey // 10 + 1)::int] || {DIGITS}[(n_nationkey % 10 + 1)::int])"


def nation_name(key: str = "n_nationkey"):
    """`NationOneFour` for 14; NATION_NAME is the same in SQL."""
    word = lambda c: F.element_at(F.array(*map(F.lit, DIGITS)), (c + 1).cast("int"))
    return F.concat(F.lit("Nation"), word(F.expr(f"{key} div 10")), word(F.col(key) % 10))


def _joined(piece, order: str):
    return F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), piece.alias("x")))).getField("x"), "")


def controllers(spark: SparkSession, d: str) -> DataFrame:
    verb = F.when(F.startswith("o_orderpriority", F.lit("1")), "Post").otherwise("Get")
    posts = F.startswith("o_orderpriority", F.lit("1"))
    guard = F.when(posts, "  @PreAuthorize(\"hasRole('DESK') or hasAuthority('CLERK')\")\n").otherwise("")
    body = F.when(posts, F.format_string(", @Valid @RequestBody Order%sRequest body", "o_orderstatus")).otherwise("")
    method = F.format_string('  /** Order %d. */\n%s  @%sMapping("/orders/%d/{id}")\n  public ResponseEntity<Order%sDto> take%d(@PathVariable Long id%s) { return orders.find(check.pass(id)); }\n', "o_orderkey", guard, verb, "o_orderkey", "o_orderstatus", "o_orderkey", body)
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(_joined(method, "o_orderkey").alias("body"))
    c = table(spark, d, "customer").join(o, "c_custkey")
    name = F.format_string("Customer%dController", "c_custkey")
    head = F.format_string('@RestController\n@RequestMapping("/api/%s/%d")\npublic class %s {\n  private final Nation%dService orders;\n  private final CheckService check;\n', _slug("c_mktsegment"), "c_custkey", name, "c_nationkey")
    return c.select(_slug("c_mktsegment").alias("project"), F.concat(F.lit("src/"), name, F.lit(".java")).alias("path"), F.concat(head, "body", F.lit("}\n")).alias("text"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    text = F.format_string('@Entity\n@Table(name = "t_%d")\npublic class Part%dRequest {\n  @NotNull private Long key;\n  private String brand%d;\n  @ManyToOne private Maker maker;\n}\n', "p_size", "p_partkey", "p_size")
    return p.select(_slug("p_brand").alias("project"), F.format_string("src/Part%dRequest.java", "p_partkey").alias("path"), text.alias("text"))


def clients(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    key = F.struct("l_orderkey", "l_linenumber")
    call = F.format_string('  @GetMapping("/orders/%d/{line}")\n  ResponseEntity<LineDto> line%dx%d(@PathVariable("line") Long line);\n', "l_orderkey", "l_orderkey", "l_linenumber")
    body = lines.withColumn("k", key).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(_joined(call, "k").alias("body"))
    s = table(spark, d, "supplier").join(body, "s_suppkey").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    head = F.format_string('@FeignClient(name = "s%d", url = "${region.url}")\npublic interface Supplier%dClient {\n', "s_suppkey", "s_suppkey")
    return s.select(_slug("n_name").alias("project"), F.format_string("src/Supplier%dClient.java", "s_suppkey").alias("path"), F.concat(head, "body", F.lit("}\n")).alias("text"))


def _named_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with the topic that they name, its number and the project of their user."""
    e = table(spark, d, "events").withColumn("k", F.pmod("event_id", F.lit(50)))
    return e.select("*", F.format_string("user-%d", "user_id").alias("project"), F.format_string("%s-%d", "event_type", "k").alias("topic"), F.format_string("topic.%s.%d", "event_type", "k").alias("key"))


def listeners(spark: SparkSession, d: str) -> DataFrame:
    """Topics as literals, references to settings, expressions with a default, and constants."""
    e = _named_events(spark, d)
    way = F.pmod("event_id", F.lit(3))
    name = F.when(way == 1, F.concat(F.lit("${"), "key", F.lit("}"))).when(way == 2, F.format_string("#{'${gone.%d:%s}'}", "k", "topic")).otherwise(F.col("topic"))
    heard = F.format_string('  @KafkaListener(topics = "%s", groupId = "g")\n  public void on%d(String m) { }\n', name, "event_id")
    said = F.when(way == 1, F.format_string("Topics.%s_%d", F.upper("event_type"), "k")).otherwise(F.format_string('"%s"', "topic"))
    sent = F.format_string('  public void do%d() { kafkaTemplate.send(%s, "{}"); }\n', "event_id", said)
    files = e.groupBy("project", "user_id").agg(_joined(F.when(F.col("value") > 50, heard).otherwise(sent), "event_id").alias("body"))
    head = F.format_string("@Service\npublic class User%dService {\n  private KafkaTemplate<String, String> kafkaTemplate;\n", "user_id")
    services = files.select("project", F.format_string("src/User%dService.java", "user_id").alias("path"), F.concat(head, "body", F.lit("}\n")).alias("text"))
    each = e.select("project", "topic", F.format_string('  public static final String %s_%d = "%s";\n', F.upper("event_type"), "k", "topic").alias("line")).distinct()
    constants = each.groupBy("project").agg(_joined(F.col("line"), "topic").alias("body"))
    return services.unionByName(constants.select("project", F.lit("src/Topics.java").alias("path"), F.concat(F.lit("public class Topics {\n"), "body", F.lit("}\n")).alias("text")))


def topic_settings(spark: SparkSession, d: str) -> DataFrame:
    """project, key, value: each topic's name, whose number is itself a setting."""
    e = _named_events(spark, d).select("project", "key", "event_type", "k").distinct()
    named = e.select("project", "key", F.format_string("%s-${number.%d}", "event_type", "k").alias("value"))
    return named.unionByName(e.select("project", F.format_string("number.%d", "k").alias("key"), F.col("k").cast("string").alias("value")).distinct())


def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """A stored class for each part: its collection as a literal, with a suffix that the environment may set, or unnamed."""
    p, way = table(spark, d, "part"), F.pmod("p_partkey", F.lit(4))
    literal, asked = F.format_string('(collection = "parts_%d")', "p_size"), F.format_string("('size.%d') ?: '_any'}\")", "p_size")
    given = F.when(way == 0, literal).when(way == 1, F.concat(F.lit('("p#{@environment.getProperty'), asked)).when(way == 2, F.concat(F.lit('("p#{@environment.getProperty"\n    + "'), asked)).otherwise("")
    text = F.concat(F.lit("@Document"), given, F.format_string("\npublic class Part%dItem {\n  private Long key;\n}\n", "p_partkey"))
    return p.select(_slug("p_brand").alias("project"), F.format_string("src/Part%dItem.java", "p_partkey").alias("path"), text.alias("text"))


def size_settings(spark: SparkSession, d: str) -> DataFrame:
    """project, key, value: suffixes of even sizes, that refer to another setting."""
    p = table(spark, d, "part").where("p_size % 2 = 0").select(_slug("p_brand").alias("project"), "p_size").distinct()
    return p.select("project", F.format_string("size.%d", "p_size").alias("key"), F.format_string("_%d${tail:}", "p_size").alias("value")).unionByName(p.select("project", F.lit("tail").alias("key"), F.lit("x").alias("value")).distinct())


def front_services(spark: SparkSession, d: str) -> DataFrame:
    """A service for each supplier, that calls itself, inherits its nation's calls (or those of that one's parent), overrides an
    address, gives a slug, or inherits from a circle."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    way = F.pmod("s_suppkey", F.lit(6)).cast("int")
    name = F.format_string("export class Supplier%dService extends %s { %s }", "s_suppkey", F.element_at(F.array(F.lit("Object"), F.format_string("Nation%dApi", "n_nationkey"), *[F.lit(x) for x in ("Gone", "Gone", "Gone", "Round1")]), way + 1), F.element_at(F.array(
        F.format_string("load() { return this.http.get<Item[]>('/api/supplier/%d'); }", "s_suppkey"), F.lit(""), F.format_string("override apiItemsUrl() { return 'v2/s/%d'; } save() { super.put({ method: HTTP_LOAD_METHODS.put }); }", "s_suppkey"),
        F.format_string("constructor(h: H) { super(h, API_SLUGS.N%d); }", "n_nationkey"), F.format_string("constructor(h: H) { super(h, 'supplier-%d'); }", "s_suppkey"), F.lit(""),
    ), way + 1))
    services = s.select(F.format_string("src/s%d.service.ts", "s_suppkey").alias("path"), name.alias("text"))
    n = table(spark, d, "nation")
    own = F.when(F.col("n_nationkey") % 2 == 0, F.format_string("save() { this.http.post('/api/nation/%d', x); }", "n_nationkey")).otherwise("")
    nations = n.select(F.format_string("src/nation-%d.ts", "n_nationkey").alias("path"), F.format_string("export class Nation%dApi extends BaseApi<X> { %s }", "n_nationkey", own).alias("text"))
    slugs = n.where("n_nationkey % 3 = 0").select(F.lit("src/slugs.constants.ts").alias("path"), "n_nationkey", F.format_string("  N%d: 'all-%d',\n", "n_nationkey", "n_nationkey").alias("x"))
    slugs = slugs.groupBy("path").agg(_joined(F.col("x"), "n_nationkey").alias("x")).select("path", F.concat(F.lit("export const API_SLUGS = {\n"), "x", F.lit("};")).alias("text"))
    few = [("src/base.ts", "export abstract class BaseApi<T> { load() { return this.http.get<T[]>('/api/base'); } }"), ("src/round.ts", "export class Round1 extends Round2 { }\nexport class Round2 extends Round1 { }")]
    more = table(spark, d, "region").limit(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in few])))
    return services.unionByName(nations).unionByName(slugs).unionByName(more).select(F.lit("web").alias("project"), "path", "text")


def migrations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(_joined(F.format_string("alter table t_%s add column c%d text;\n", F.lower("o_orderstatus"), "o_orderkey"), "o_orderkey").alias("text"))
    return o.select(F.lit("orders").alias("project"), F.format_string("db/V%d__orders.sql", "k").alias("path"), "text")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """project, key, value of the clients' projects."""
    n = table(spark, d, "nation")
    return n.select(_slug("n_name").alias("project"), F.lit("region.url").alias("key"), F.format_string("https://region-%d/", "n_regionkey").alias("value"))


def nation_files(spark: SparkSession, d: str) -> DataFrame:
    """For each nation an exception handler with a task, a build file that its suppliers are dependencies of, and a store."""
    n = table(spark, d, "nation")
    advice = F.format_string(
        '@ControllerAdvice\npublic class Nation%dAdvice {\n  @ExceptionHandler({Worse%d.class, Bad%d.class})\n  public String bad() { return "x"; }\n  @Scheduled(cron = "0 %d * * * *")\n  public void tick%d() { }\n}\n',
        "n_nationkey", "n_nationkey", "n_regionkey", "n_nationkey", "n_nationkey",
    )
    one = F.format_string("<dependency><groupId>s</groupId><artifactId>supplier-%d</artifactId><version>%d</version></dependency>\n", "s_suppkey", "s_nationkey")
    needs = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(_joined(one, "s_suppkey").alias("needs"))
    store = lambda kind, made: F.struct(F.format_string(f"src/cart-%d.{kind}.ts", "n_nationkey").alias("path"), made.alias("text"))
    files = [
        F.struct(F.format_string("src/Nation%dAdvice.java", "n_nationkey").alias("path"), advice.alias("text")),
        F.struct(F.lit("pom.xml").alias("path"), F.concat(F.lit("<project>\n"), F.coalesce("needs", F.lit("")), F.lit("</project>")).alias("text")),
        store("actions", F.format_string("export const add%d = createAction('a');\nexport const drop = createAction('d');", "n_nationkey")),
        store("selectors", F.format_string("export const all%d = createSelector(a, b);", "n_regionkey")),
    ]
    return n.join(needs, "n_nationkey", "left").select(_slug("n_name").alias("project"), F.inline(F.array(*files)))


def page_components(spark: SparkSession, d: str) -> DataFrame:
    """A component for each page, with its template beside it."""
    p = table(spark, d, "pages")
    text = F.format_string("@Component({ selector: 'page-%d' })\nexport class Page%dComponent { @Input() b; @Input() a; @Output() done; constructor(private s: Site%dService, r: Router) {} }", "page_id", "page_id", F.col("page_id") % 7)
    page = F.when(F.col("page_id") % 2 == 0, F.lit('<b (click)="f()" (blur)="g()"></b>'))
    stem = F.format_string("src/page-%d.component", "page_id")
    files = F.array(F.struct(F.concat(stem, F.lit(".ts")).alias("path"), text.alias("text")), F.struct(F.concat(stem, F.lit(".html")).alias("path"), page.alias("text")))
    return p.select(F.lit("web").alias("project"), F.inline(files)).where("text is not null")


def stores(spark: SparkSession, d: str) -> DataFrame:
    """For each nation a service, its repository, and an entity that is related to another one."""
    n = table(spark, d, "nation")
    k = "n_nationkey"
    files = [
        ("Service", F.format_string("@Service\npublic class Nation%dService {\n  private final Nation%dRepository rows;\n  public void all() { rows.findAll(); }\n}\n", k, k)),
        ("Repository", F.format_string("public interface Nation%dRepository extends JpaRepository<Nation%d, Long> {\n  List<Nation%d> findByRegionKey(int k);\n}\n", k, k, k)),
        ("", F.format_string('@Entity\n@Table(name = "nation_%d")\npublic class Nation%d {\n  private Long id;\n  @OneToMany private List<Local> locals;\n}\n', k, k)),
    ]
    made = [F.struct(F.concat(F.format_string("src/Nation%d", k), F.lit(f"{kind}.java")).alias("path"), text.alias("text")) for kind, text in files]
    local = F.struct(F.lit("src/Local.java").alias("path"), F.lit("@Entity\npublic class Local {\n  private Long id;\n}\n").alias("text"))
    return n.select(_slug("n_name").alias("project"), F.inline(F.array(*made, local)))
