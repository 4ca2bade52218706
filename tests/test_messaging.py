"""References between settings, names of topics and collections, and the front end's cascade."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import extraction as X
from loomgraph.operators import frontend, messaging
from loomgraph.operators.placeholders import plain_expression, resolved, settled

SETTINGS = [
    ("a", "env", "prod"), ("a", "topic.prod", "orders-${region}"), ("a", "region", "eu"), ("a", "loop.x", "${loop.y}!"), ("a", "loop.y", "${loop.x}?"), ("a", "uses.loop", "${loop.x}-${env}"),
    ("a", "host", "h"), ("a", "url", "http://${host}:${port:80}/${host}"), ("a", "empty", None), ("b", "env", "test"), (None, "env", "x"), ("a", None, "x"),
    ("a", "kafka.topic.paid", "paid-events"), ("a", "other.topic", "bare-events"), ("a", "kafka.consumer.group-id", "second"), ("a", "spring.kafka.consumer.group-id", "workers"), ("a", "suffix", "_dev"),
]


@pytest.fixture(scope="module")
def settings(spark):
    return spark.createDataFrame(SETTINGS, "project string, key string, value string")


def test_settings_settle(settings):
    got = {r["key"]: r["value"] for r in settled(settings).where("project = 'a'").collect()}
    assert got["topic.prod"] == "orders-eu" and got["url"] == "http://h:80/h" and got["empty"] == ""
    assert "${loop" in got["loop.x"] and got["uses.loop"] == "${loop.x}-prod"


def test_texts_resolve(spark, settings):
    want = {
        "${topic.${env}}": "orders-eu", "${none:${topic.${env}:x}}": "orders-eu", "${none}": "${none}", "a${none:}b": "ab", "${none:http://x:1}": "http://x:1", "${a.${none}}": "${a.${none}}",
        "plain": "plain", "": "", "${env": "${env", "$${env}": "$prod", "${env}${env}": "prodprod",
    }
    texts = spark.createDataFrame([("a", t) for t in want] + [("b", "${env}"), (None, "${env}"), ("a", None), ("c", "${env:d}")], "project string, text string")
    got = {(r["project"], r["text"]): r["resolved"] for r in resolved(texts, settled(settings)).collect()}
    assert got == {("a", t): r for t, r in want.items()} | {("b", "${env}"): "test", ("c", "${env:d}"): "d"}


def test_expressions(spark):
    want = {
        "#{'${k}'}": "${k}", "#{'x,y'.split(',')}": "x,y", "#{T(org.x.Names).PAID}": "Names.PAID", "base#{@environment.getProperty('k') ?: 'd'}": "base${k:d}",
        "base#{environment.getProperty('k')}": "base${k:}", "#{other.thing}": "#{other.thing}", "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", plain_expression(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] for r in df.collect()} == want


JAVA = {
    "src/Names.java": 'public class Names { public static final String PAID = "paid-events"; public static final String TEMPLATE = "${topic.${env}}"; }',
    "src/Hear.java": '''@Service
public class Hear {
  @Value("${topic.${env}}") private String ordersTopic;
  @KafkaListener(topics = "${topic.${env}}", groupId = "own")
  public void a(String m) { kafkaTemplate.send(ordersTopic, m); }
  @KafkaListener(topics = {"${gone:late}", "#{'one,two'.split(',')}"})
  public void b(String m) { }
  @KafkaListener(topics = "#{T(x.Names).PAID}")
  public void c(String m) { run(() -> streamBridge.send("lambda-out", m)); }
  @KafkaListener(topicPattern = "orders\\\\..*")
  public void d(String m) { sender.send("literal.any", m); sender.send(unknown, m); other.send(null, m); }
  @RabbitListener(queues = Names.TEMPLATE)
  public void e(String m) { rabbitTemplate.convertAndSend("bare-events", m); }
  @KafkaListener(topics = "x")
  public void f(String m) { }
  @KafkaListener(topics = "#{bean.name}")
  public void g(String m) { }
}''',
    "src/Publish.java": '@RestController\n@RequestMapping("/api")\npublic class Publish { @PostMapping("/z") public void z() { kafkaTemplate.send("bare-events", 1); } @PostMapping("/pay") public void pay() { if (ok) { kafkaTemplate.send(Names.PAID, 1); } } }',
    "src/Doc.java": '@Document("base#{@environment.getProperty" + "(\'suffix\') ?: \'\'}")\npublic class Doc { private String id; }',
    "src/Named.java": '@Document(collection = "${env}_items")\npublic class Named { private String id; }',
    "src/Plain.java": "@Document\npublic class Plain { private String id; }",
    "src/Odd.java": '@Document("kept#{other.thing}")\npublic class Odd { private String id; }',
}


@pytest.fixture(scope="module")
def java(spark):
    files = spark.createDataFrame([("a", p, t) for p, t in JAVA.items()], "project string, path string, text string")
    statements = X.java_statements(files).cache()
    return statements, X.java_members(statements).cache()


def test_topics_with_settings(java, settings):
    got = {r["topic"]: tuple(r)[2:] for r in messaging.topics(*java, settings).collect()}
    assert got == {
        "orders-eu": ("both", "topic.prod", "own", None),
        "late": ("consumer", "gone", "workers", None), "one": ("consumer", None, "workers", None), "two": ("consumer", None, "workers", None),
        "paid-events": ("both", "kafka.topic.paid", "workers", "POST /api/pay"), "lambda-out": ("producer", None, "workers", None), "pattern:orders\\\\..*": ("consumer", None, "workers", None),
        "literal.any": ("producer", None, "workers", None), "bare-events": ("producer", "other.topic", "workers", "POST /api/z"),
    }


def test_collections(java, settings):
    assert {r["name"]: r["collection"] for r in messaging.collections(java[1], settings).collect()} == {"Doc": "base_dev", "Named": "prod_items", "Plain": "Plain", "Odd": "kept"}
    assert {r["name"]: r["collection"] for r in messaging.collections(java[1], settings.limit(0)).collect()} == {"Doc": "base", "Named": "${env}_items", "Plain": "Plain", "Odd": "kept"}


WEB = {
    "web/base.api.ts": "export abstract class BaseApi<T> { load() { return this.http.get<T[]>(`/api/base/${x}`); } }",
    "web/mid.ts": "export class Mid extends BaseApi<X> { go() { return 1; } }",
    "web/near.ts": "export class Near extends Mid { save() { this.http.put('/api/near', x); } }",
    "web/a.service.ts": "export class AService { f() { this.http.post<A>('/api/a', 1); this.http.delete('/api/a/1'); } }",
    "web/b.service.ts": "export class BService extends Mid { }",
    "web/c.service.ts": "export class CService extends Near { }",
    "web/d.service.ts": "export class DService extends Gone { override apiItemsUrl(): string { return 'v1/d/items'; } save() { super.saveOne({ a: 1, method: HTTP_LOAD_METHODS.post }); } load() { this.loadMany({ method: 'x' }); } }",
    "web/e.service.ts": "export class EService extends Gone { constructor(h: H) { super(h, API_SLUGS.ORDERS); } }",
    "web/f.service.ts": "export class FService extends Gone { constructor(h: H) { super(h, API_SLUGS.Unknown_Slug); } }",
    "web/g.service.ts": "export class GService extends Gone { constructor(h: H) { super(h, 'plain-slug'); x({ method: M.put }); } }",
    "web/h.service.ts": "export class HService extends Round1 { }",
    "web/round.ts": "export class Round1 extends Round2 { }\nexport class Round2 extends Round1 { }",
    "web/i.service.ts": "export class IService extends by-file { }",
    "web/slugs.constants.ts": "export const API_SLUGS = { ORDERS: 'orders/all', OTHER: \"other\" };",
    "web/z.constants.ts": "export const X = { ORDERS: 'never' };",
    "web/x.module.ts": "export class XModule {}\nexport class Helper {}", "web/x.guard.ts": "export const canGo = () => true; export class XGuard {}",
    "web/t.interceptor.ts": "export class TInterceptor { h = 'Bearer ' + t; refreshToken() {} }", "web/p.interceptor.ts": "export class Plain {}",
    "web/m.dto.ts": "export interface Item { } type Kind = 'a';\nenum E { }", "web/environment.ts": "export const e = { apiUrl: 'http://x', other: 'y' };",
}


@pytest.fixture(scope="module")
def web(spark):
    rows = [("w", p, t) for p, t in WEB.items()] + [("v", "web/j.service.ts", "export class JService extends Near { }"), ("w", "web/n.service.ts", None)]
    return spark.createDataFrame(rows, "project string, path string, text string").cache()


def test_calls_through_three_levels(web):
    got = sorted(tuple(r)[2:] for r in frontend.service_calls(web).collect())
    assert got == sorted([
        ("AService", "POST", "/api/a", "A", "own"), ("AService", "DELETE", "/api/a/1", None, "own"),
        ("BService", "GET", "/api/base/*", "T[]", "parent"), ("CService", "PUT", "/api/near", None, "parent"),
        ("DService", "POST", "v1/d/items", "unknown", "override"), ("EService", "GET", "v1/orders/all", "unknown", "slug"),
        ("FService", "GET", "v1/unknown_slug", "unknown", "slug"), ("GService", "GET", "v1/plain-slug", "unknown", "literal"),
    ])


def test_names_by_kind(web):
    assert {tuple(r)[1:] for r in frontend.angular_names(web).collect()} == {
        ("module", "XModule"), ("guard", "canGo"), ("guard", "XGuard"), ("interceptor", "TInterceptor"), ("interceptor", "JWTHeaderInjectionDetected"), ("interceptor", "TokenRefreshDetected"),
        ("interceptor", "Plain"), ("model", "Item"), ("model", "Kind"), ("model", "E"), ("model", "apiUrl:http://x"),
    }
    assert frontend.service_calls(web.limit(0)).count() == 0
