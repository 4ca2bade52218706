"""Facts from a small source tree written for these tests."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import extraction as X
from loomgraph.operators import messaging

TREE = {
    "src/ParcelController.java": '''package a; // note: not code;
/* a { block ; comment } */
@RestController
@RequestMapping("/api/parcels/")
@PreAuthorize("hasRole('CLERK')")
public class ParcelController {
    private static final String TAIL = "/by-" + "day";
    private final ParcelService parcels;
    private final AuditLog audit;
    public ParcelController(ParcelService parcels, Clock clock) { this.parcels = parcels; }
    /** Finds {@link Parcel} one
     *  by number. */
    @GetMapping("/{id}")
    public ResponseEntity<ParcelDto> one(@PathVariable Long id) { if (id > 0) { audit.note(id); } return parcels.find(id); }
    @PostMapping
    public void add(@Valid @RequestBody List<ParcelRequest> body) { parcels.save(body); parcels.find(1); }
    @RequestMapping(value = "/old", method = RequestMethod.DELETE)
    @Secured("ROLE_ADMIN")
    public List<String> old() { return null; }
    @GetMapping(TAIL)
    public Optional<ParcelDto> day() { return null; }
    private void helper() { }
}
''',
    "src/ParcelServiceImpl.java": '''@Service
public class ParcelServiceImpl implements ParcelService {
    @Autowired private ParcelRepository store;
    private KafkaTemplate<String, String> kafkaTemplate;
    private String state;
    @Value("${x}") private String other;
    private static final String DONE = "parcel-done";
    @Transactional
    public Parcel find(long id) { for (int i = 0; i < 3; i++) { store.findById(id); } kafkaTemplate.send(DONE, "{;}"); return null; }
    @KafkaListener(topics = {"${in.topic}", "raw"}, groupId = "g1")
    public void hear(String m) { kafkaTemplate.send("raw", m); }
    @Scheduled(cron = "0 0 * * * *")
    public void tick() { }
    @ExceptionHandler({IOException.class, Bad.class})
    public String bad() { return "x"; }
    public String getState() { return state; }
}
''',
    "src/Parcel.java": '''@Entity
@Table(name = "parcels")
public class Parcel { @Id private Long id; private String code; @OneToMany(mappedBy = "p") private List<Item> items; static int n; }
''',
    "src/ParcelRequest.java": '''public class ParcelRequest { @NotBlank @Size(max = 5) @JsonProperty("c") private String code; private Map<String, Long> sizes; }''',
    "src/ParcelRepository.java": '''public interface ParcelRepository extends JpaRepository<Parcel, Long> {
    List<Parcel> findByOrderIdAndSizeGreaterThanOrderByCodeDesc(Long a, int b);
    @Query("select p from Parcel p " + "where p.code = 1") List<Parcel> own();
}''',
    "src/StockClient.java": '''@FeignClient(name = "stock", url = "${stock.url}", path = "/v1")
public interface StockClient { @GetMapping("/items/{id}") ResponseEntity<ItemDto> item(@PathVariable("id") Long id); @PostMapping("/items") void put(@RequestBody ItemRequest r); }''',
    "src/Broken.java": "class Broken { void x( { ; \" }",
    "src/Security.java": '''@EnableWebSecurity class Security { void f() { a.requestMatchers("/open/**", "/h").permitAll().requestMatchers("/in").authenticated(); } }''',
    "web/a.component.ts": "@Component({ selector: 'app-a' })\nexport class AComponent { @Input() x; @Output() done = 1; constructor(private s: AService, r: Router) {} b = inject(BService); @ViewChild('box') v; }",
    "web/a.component.html": '<p (click)="f()" (keyup.enter)="g()"></p><b (click)="h()"></b>',
    "web/a.service.ts": "export class AService { base = '/api/parcels'; f() { return this.http.get<Parcel[]>(`/api/parcels/${id}/x`); } g() { this.http.post(this.base, 1); this.http.put<A>(other); } }",
    "web/app-routing.module.ts": "const routes = [{ path: 'a', component: AComponent, canActivate: [G1, G2] }, { path: 'b', loadChildren: () => import('./b/b.module').then(m => m.B) }];",
    "web/cart.actions.ts": "export const add = createAction('x'); export const drop = createAction('y');",
    "web/cart.selectors.ts": "export const all = createSelector(a, b);",
    "web/environment.prod.ts": "export const environment = { production: true, api: 'http://h', port: 80, api: \"http://k\" };",
    "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency><dependency>\n<groupId>h</groupId> <artifactId>b</artifactId></dependency>",
    "db/V2__more.sql": "CREATE TABLE IF NOT EXISTS parcels (id int); alter table items add column size int; ALTER TABLE items ADD COLUMN w  text;",
}


@pytest.fixture(scope="module")
def tree(spark):
    rows = [("post", p, t) for p, t in TREE.items()] + [("gr", "build.gradle", "dependencies {\n  implementation 'x:y:2'\n  testImplementation(\"z:w\")\n}"), ("post", "src/Empty.java", ""), ("post", "src/Null.java", None)]
    files = spark.createDataFrame(rows, "project string, path string, text string").cache()
    statements = X.java_statements(files).cache()
    return files, statements, X.java_members(statements).cache(), spark.createDataFrame([("post", "in.topic", "arrivals"), ("post", "stock.url", "https://stock-svc:80/")], "project string, key string, value string")


def test_endpoints(tree):
    got = {r.handler: r for r in X.endpoints(tree[2]).collect()}
    assert {(h, r.method, r.path, r.request_dto, r.response_dto) for h, r in got.items()} == {
        ("one", "GET", "/api/parcels/{id}", None, "ParcelDto"), ("add", "POST", "/api/parcels", "ParcelRequest", None), ("old", "DELETE", "/api/parcels/old", None, "String"), ("day", "GET", "/api/parcels/by-day", None, "ParcelDto")}
    assert got["one"].javadoc == "Finds Parcel one by number." and got["one"].roles == ["CLERK"] and got["old"].roles == ["ADMIN", "CLERK"] and got["add"].auth_required


def test_beans_calls_and_bodies(tree):
    _, s, m, _ = tree
    got = {r.name: r for r in X.beans(m).collect()}
    assert {n: r.bean_type for n, r in got.items()} == {"ParcelController": "controller", "ParcelServiceImpl": "service", "ParcelRepository": "repository"}
    assert got["ParcelController"].dependencies == ["AuditLog", "Clock", "ParcelService"] and got["ParcelServiceImpl"].dependencies == ["ParcelRepository"]
    assert got["ParcelServiceImpl"].transactional_methods == ["find"] and "helper" in got["ParcelController"].methods
    calls = {(r.cls, r.method): r.calls for r in X.method_calls(s, m).collect()}
    assert calls[("ParcelController", "one")] == ["audit.note", "parcels.find"] and calls[("ParcelController", "add")] == ["parcels.find", "parcels.save"]
    bodies = {r.method: r.body for r in X.method_bodies(s, m).collect()}
    assert bodies["hear"] == 'kafkaTemplate.send("raw", m);' and "getState" not in bodies and bodies["find"].endswith("return null;")
    assert {(r.method, r.mark, r.value) for r in X.marked_methods(m).collect()} == {("tick", "scheduled", 'cron = "0 0 * * * *"'), ("bad", "exception", "IOException"), ("bad", "exception", "Bad")}


def test_data_types_and_queries(tree):
    _, _, m, _ = tree
    assert [tuple(r)[1:] for r in X.entities(m).collect()] == [("Parcel", "parcels", ["id", "code"], ["OneToMany -> items"])]
    got = {r.name: r for r in X.dto_fields(m).collect()}
    assert got["code"].required and got["code"].json_property == "c" and got["code"].validations == ["NotBlank", "Size"]
    assert got["sizes"].type == "Map<String, Long>" and not got["sizes"].required
    assert {r.method: r.query for r in X.repository_queries(m).collect()} == {"findByOrderIdAndSizeGreaterThanOrderByCodeDesc": "SELECT WHERE order_id = ? AND size > ? ORDER BY code DESC", "own": "select p from Parcel p where p.code = 1"}
    assert {(r.name, r.value) for r in X.constants(m).collect()} >= {("ParcelController.TAIL", "/by-day"), ("DONE", "parcel-done")}


def test_clients_topics_and_security(tree):
    f, s, m, settings = tree
    assert {tuple(r)[1:8] for r in X.client_calls(m, settings).collect()} == {("stock", "stock-svc", "stock.url", "GET", "/v1/items/{id}", None, "ItemDto"), ("stock", "stock-svc", "stock.url", "POST", "/v1/items", "ItemRequest", None)}
    assert {tuple(r)[1:] for r in messaging.topics(s, m, settings).collect()} == {("arrivals", "consumer", "in.topic", "g1", None), ("raw", "both", None, "g1", None), ("parcel-done", "producer", None, None, None)}
    r = X.security_facts(f).where("project = 'post'").first()
    assert r.web_security and not r.jwt and r.open_paths == ["/h", "/open/**"] and r.closed_paths == ["/in"]


def test_web_build_and_migrations(tree):
    f = tree[0]
    c = X.components(f).first()
    assert (c.name, c.selector, c.inputs, c.outputs, c.injected, c.view_children, c.template_events) == ("AComponent", "app-a", ["x"], ["done"], ["AService", "Router", "BService"], ["box"], ["click", "keyup.enter"])
    assert {(r.method, r.url, r.response_shape) for r in X.http_calls(f).collect()} == {("GET", "/api/parcels/*/x", "Parcel[]"), ("POST", "/api/parcels", None), ("PUT", "other", "A")}
    assert {(r.route, r.component, r.lazy, tuple(r.guards)) for r in X.routes(f).collect()} == {("a", "AComponent", None, ("G1", "G2")), ("b", None, "./b/b.module", ())}
    assert [tuple(r)[1:] for r in X.store_features(f).collect()] == [("cart", ["add", "drop"], [], ["all"])]
    assert {(r.key, r.value) for r in X.environments(f).collect()} == {("production", "true"), ("api", "http://k"), ("port", "80")}
    assert {(r.project, r.dependency) for r in X.build_dependencies(f).collect()} == {("post", "g:a:1 [test]"), ("post", "h:b"), ("gr", "x:y:2"), ("gr", "z:w")}
    assert [tuple(r)[1:] for r in X.migrations(f).collect()] == [("V2__more.sql", ["parcels", "items"], ["size:int", "w:text"])]


def test_empty_tree(tree):
    files = tree[0].limit(0)
    s = X.java_statements(files)
    m = X.java_members(s)
    for out in [X.endpoints(m), X.beans(m), X.method_calls(s, m), X.entities(m), messaging.topics(s, m, tree[3]), X.components(files), X.http_calls(files), X.migrations(files)]:
        assert out.where(F.lit(True)).count() == 0


def test_derived_queries_and_criteria(spark):
    want = {
        "findAllByActiveTrue": "SELECT ALL WHERE active = true", "findFirstByName": "SELECT FIRST WHERE name = ?", "findTopByAgeLessThanOrNameIsNull": "SELECT TOP WHERE age < ? OR name IS NULL", "countByIdIn": "COUNT WHERE id IN (?)",
        "existsByOpenFalse": "EXISTS WHERE open = false", "streamByKind": "STREAM WHERE kind = ?", "findById": "SELECT WHERE id = ?", "other": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "n string").select("n", X.derived_query(F.col("n")).alias("q"))
    assert {r["n"]: r["q"] for r in df.collect()} == want
    text = """@Repository
public class Store {
  public List<Item> some(String a) { return mongoTemplate.find(new Query(Criteria.where("kind").is(a).and("size").gt(1)), Item.class); }
  public void none() { mongoTemplate.remove(x); }
  public void drop() { if (a) { reactiveMongoTemplate.updateMulti(query(Criteria.where("id").is(1)), u); } }
}
"""
    s = X.java_statements(spark.createDataFrame([("p", "Store.java", text)], "project string, path string, text string"))
    assert {tuple(r)[1:] for r in X.criteria_queries(s, X.java_members(s)).collect()} == {("Store", "some", "[mongoTemplate.find] Item WHERE kind = ? AND size = ?"), ("Store", "drop", "[mongoTemplate.updateMulti] ? WHERE id = ?")}


def test_handlers_in_their_tiers(spark):
    from loomgraph.operators import codegraph

    ends = [("a", c, "GET", f"/{c}") for c in ("OneController", "TwoController", "ThreeController", "FourController", "Controller")]
    beans = [("a", "OneService"), ("b", "OneService"), ("c", "TwoService"), ("b", "TwoService"), ("z", "ThreeServiceImpl"), ("y", "ThreeRepo"), ("a", "FourController"), ("b", "FourController"), ("a", "ThreeController")]
    got = codegraph.handled_by(spark.createDataFrame(ends, "project string, controller string, method string, path string"), spark.createDataFrame(beans, "project string, name string"))
    assert {(r["src"].split("/")[1], r["dst"]) for r in got.collect()} == {("OneController", "bean::a::OneService"), ("TwoController", "bean::b::TwoService"), ("ThreeController", "bean::y::ThreeRepo"), ("FourController", "bean::a::FourController")}


def test_client_parameters(spark):
    text = """@FeignClient(name = "c", url = "${stock.api.url}")
@AuthorizationToken(scope = "scope.key", clientId = "x")
public interface C {
  @GetMapping("/a/{id}")
  List<Item> a(@PathVariable("id") Long id, @RequestParam(value = "q", required = false) String query, @RequestParam int page);
  @AuthorizationToken(scope = "plain")
  @PutMapping("/b") void b(@RequestBody Body body);
}
"""
    files = spark.createDataFrame([("p", "C.java", text)], "project string, path string, text string")
    settings = spark.createDataFrame([("p", "scope.key", "read:all")], "project string, key string, value string")
    got = {r["path"]: (r["target"], r["path_params"], r["request_params"], r["oauth_scope"], r["url"]) for r in X.client_calls(X.java_members(X.java_statements(files)), settings).collect()}
    assert got == {"/a/{id}": ("stock-api", ["id"], ["query", "page"], "read:all", "${stock.api.url}"), "/b": ("stock-api", [], [], "read:all", "${stock.api.url}")}


def test_component_methods(spark):
    from loomgraph.operators import fact_chunks, frontend

    text = """@Component({ selector: 'x' })
export class AComponent {
  constructor(private s: S) { this.s.init(); }
  ngOnInit() { this.s.start(); }
  save(x: number): void {
    if (x) { this.s.put(x); }
    this.bus.emit(1); this.s.put(2);
  }
  plain() { return 1; }
}
"""
    files = spark.createDataFrame([("p", "a.component.ts", text), ("q", "a.component.ts", text.replace("save", "keep")), ("p", "b.service.ts", text)], "project string, path string, text string")
    methods = frontend.component_methods(files)
    got = {(r["project"], r["path"], r["component"], r["method"]): r["calls"] for r in methods.collect()}
    assert got == {("p", "a.component.ts", "AComponent", "save"): ["bus.emit()", "s.put()"], ("p", "a.component.ts", "AComponent", "plain"): [], ("q", "a.component.ts", "AComponent", "keep"): ["bus.emit()", "s.put()"], ("q", "a.component.ts", "AComponent", "plain"): []}
    told = {r["project"]: r["content"] for r in fact_chunks.component(X.components(files), methods).collect()}
    assert told["p"].endswith("methods=['plain', 'save']\nmethod_call_graph:\n  save() → bus.emit(), s.put()")
