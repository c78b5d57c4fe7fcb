import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import signatures as G

GOOD = 'signature c2-traffic {\n  ip-proto == tcp\n  dst-port == 80\n  payload /POST.*\\/upload.*evil/i\n  event "seen"\n}'


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, text string")


@pytest.mark.parametrize("text, reason", [
    (GOOD, None), (f"```plaintext\n{GOOD}\n```", None), ("  \n", "empty"),
    ("rule x { }", "other rule language"), ("x condition = 1", "other rule language"), ("hello", "no signature keyword"),
    ("signature a }", "no opening brace"), ("signature a { event", "no closing brace"),
    (GOOD + "\n{", "unbalanced braces"), ("signature {\n event \"a\"\n}", "bad name"), ("signature a {\n b\n}", "no known field"),
])
def test_first_broken_rule(spark, text, reason):
    assert G.validate_signatures(texts(spark, text), "text").first()["reason"] == reason


def test_cleaning(spark):
    fenced = "```sig\n  signature a {\n\n\tevent \"x\"  \n}\n```\n"
    assert texts(spark, fenced).select(G.clean_signature(F.col("text"))).first()[0] == 'signature a {\nevent "x"\n}'
    marked = "\n plaintext \nsignature a {}"
    assert texts(spark, marked).select(G.clean_signature(F.col("text"))).first()[0] == "signature a {}"


def test_parsing_stops_at_the_first_slash(spark):
    parsed = G.parse_signatures(texts(spark, GOOD), "text").first()["parsed"]
    assert parsed["name"] == "c2-traffic"
    assert parsed["fields"] == {"ip-proto": ["tcp"], "dst-port": ["80"], "event": ["seen"]}
    assert [tuple(p) for p in parsed["patterns"]] == [("payload", "POST.*\\", "")]
    assert G.parse_signatures(texts(spark, "signature { }"), "text").first()["parsed"] is None


@pytest.mark.parametrize("text, reason", [
    (GOOD, None), (" ", "empty"), ("x", "no signature keyword"), ("signature a {", "missing braces"),
    ("signature a { {}", "unbalanced braces"), ("signature {x}", "does not parse"),
])
def test_loose_check(spark, text, reason):
    assert texts(spark, text).select(G.text_fault(F.col("text"))).first()[0] == reason


def test_splitting_replies(spark):
    reply = f"Here:\n{GOOD}\n\nsignature broken {{\n\n{GOOD.replace('c2-traffic', 'next')}"
    rows = G.split_replies(texts(spark, reply, "nothing"), "text", "stricter").orderBy("index").collect()
    assert [(r["index"], r["name"], r["strategy"]) for r in rows] == [(1, "c2-traffic", "stricter"), (2, "next", "stricter")]
    assert rows[0]["modifiable_patterns"][0]["type"] == "payload"


def test_training_examples(spark):
    replies = texts(spark, GOOD, "no").withColumns({"instruction": F.lit("do"), "input": F.lit("")})
    rows = G.training_example(G.validate_signatures(replies, "text")).collect()
    assert len(rows) == 1 and rows[0]["output"].startswith("signature c2-traffic {\nip-proto")


def test_matching(spark):
    flows = spark.createDataFrame(
        [(1, "TCP", "10.0.0.5", 1000, "1.2.3.4", 80, "GET /a"), (2, "udp", "10.0.1.5", 1000, "1.2.3.4", 53, "x GET"),
         (3, "tcp", "bad", 1, "1.2.3.4", 443, "GET")],
        "n int, proto string, src_ip string, src_port int, dst_ip string, dst_port int, payload string")
    signatures = texts(
        spark, 'signature net {\n src-ip == 10.0.0.0/24, 172.16.0.0/12\n event "net"\n}',
        'signature start {\n payload /GET/\n dst-port == 80, 53\n event "start"\n}',
        'signature wrong {\n payload /(/\n}', 'signature proto {\n ip-proto == tcp\n}')
    found = G.match_signatures(flows, G.parse_signatures(signatures, "text"))
    assert sorted((r["n"], r["signature"], r["message"]) for r in found.collect()) == [
        (1, "net", "net"), (1, "proto", ""), (1, "start", "start"), (3, "proto", "")]
    assert [(r["signature"], r["matches"]) for r in G.signature_hits(found).collect()][0] == ("proto", 2)


def test_every_condition_counts(spark):
    columns = ("n int, proto string, src_ip string, src_port int, dst_ip string, dst_port int, payload string, "
               "tcp_state array<string>")
    flows = spark.createDataFrame([
        (1, "tcp", "2001:db8::1", 1500, "2001:db8::1", 80, "POST /a/update x malware", ["established", "responder"]),
        (2, "tcp", "2001:DB9:0:0:0:0:0:5", 3000, "1.2.3.4", 443, "x" * 2000, ["originator"]),
        (3, "udp", "1.2.3.4", 1024, None, 53, "", [])], columns)
    bodies = {
        "v6": "src-ip == 2001:db8::/32", "v6one": "src-ip == 2001:db9::5, 9.9.9.9", "range": "src-port == 1024-2048",
        "not80": "dst-port != 80", "notin": "src-ip != 1.2.0.0/16", "big": "payload-size > 1000", "low": "src-port <= 1500",
        "state": "tcp-state established,responder", "same": "same-ip", "slash": r"payload /POST.*\/update.*malware/",
        "many": "ip-proto == tcp\n dst-port == 80, 443\n src-port >= 2000 event \"both\"",
        "needs": "requires-signature other", "header": "header ip[16:4] == 1.2.3.4", "odd": "src-port == web", "bad": "payload /(/",
        "mime": "http-request /x/", "call": "eval check",
    }
    signatures = texts(spark, *[f"signature {n} {{\n {b}\n}}" for n, b in bodies.items()])
    parsed = G.parse_signatures(signatures, "text")
    found = {}
    for r in G.match_signatures(flows, parsed).collect():
        found.setdefault(r["signature"], []).append(r["n"])
    assert {k: sorted(v) for k, v in found.items()} == {
        "v6": [1], "v6one": [2], "range": [1, 3], "not80": [2, 3], "notin": [1, 2], "big": [2], "low": [1, 3], "state": [1],
        "same": [1], "slash": [1], "many": [2]}
    rejects = {r["signature"]: r["reason"] for r in G.signature_rejects(flows, parsed).collect()}
    assert set(rejects) == {"needs", "header", "odd", "bad", "mime", "call"}
    assert rejects["mime"] == "no column for http-request" and rejects["call"].startswith("unsupported line")


def test_dyadic_blocks_cover_ranges_exactly():
    draw = random.Random(3)
    for _ in range(300):
        ranges = G._joined_ranges([tuple(sorted(draw.choices(range(65536), k=2))) for _ in range(draw.randrange(1, 4))])
        keys = G._dyadic_keys("p", ranges)
        blocks = [(int(n) << int(level), ((int(n) + 1) << int(level)) - 1) for _, level, n in (k.split("/") for k in keys)]
        assert G._joined_ranges(blocks) == ranges and len(keys) <= 32 * len(ranges)
        assert sum(b - a + 1 for a, b in blocks) == sum(b - a + 1 for a, b in ranges)
    assert G._dyadic_keys("p", [(-2**62, 2**62)]) == ["p/16/0"]


def test_many_signatures_equal_testing_each(spark):
    """Networks of every prefix length, port ranges, protocols and signatures without any of them, against plain Python."""
    draw = random.Random(11)
    flows, signatures, wanted = [], [], {}
    for n in range(250):
        address = f"10.{draw.randrange(3)}.{draw.randrange(4)}.{draw.randrange(256)}" if n % 5 else f"2001:db8:{draw.randrange(3):x}::{draw.randrange(99):x}"
        flows.append((n, draw.choice(["tcp", "UDP"]), address, draw.randrange(65536), "192.168.0.1", draw.choice([53, 80, 443]), draw.choice(["GET /a", "x", None])))
    for n in range(2000):
        lines = []
        if n % 3 == 0:
            bits = draw.randrange(6, 33)
            lines.append(("ip", [f"10.{draw.randrange(3)}.{draw.randrange(4)}.{draw.randrange(256)}/{bits}", "10.1.0.0/17"][:draw.randrange(1, 3)]))
        if n % 7 == 0:
            lines.append(("ip", [f"2001:db8:{draw.randrange(3):x}::/{draw.randrange(30, 128)}"]))
        if n % 4 == 0:
            low = draw.randrange(65000)
            lines.append(("port", [(low, low + draw.randrange(500)), (53, 53)]))
        if n % 50 == 1:
            lines.append(("proto", ["TCP"]))
        signatures.append(f"signature s{n} {{\n" + "\n".join(
            "src-ip == " + ", ".join(v) if k == "ip" else "src-port == " + ", ".join(f"{a}-{b}" for a, b in v) if k == "port" else "ip-proto == " + v[0]
            for k, v in lines) + ("\nsrc-port > 65000" if not lines else "") + "\n}")
        wanted[f"s{n}"] = lines
    df = spark.createDataFrame(flows, "n int, proto string, src_ip string, src_port int, dst_ip string, dst_port int, payload string")
    found = G.match_signatures(df.withColumn("key", F.lit("x")).withColumn("name", F.lit("y")), G.parse_signatures(texts(spark, *signatures), "text"))
    got = sorted((r["n"], r["signature"]) for r in found.collect())
    want = []
    for n, proto, address, port, *_ in flows:
        for name, lines in wanted.items():
            ok = port > 65000 if not lines else True
            for kind, values in lines:
                ok &= (any(ipaddress.ip_address(address) in ipaddress.ip_network(v, strict=False) for v in values) if kind == "ip" else
                       any(a <= port <= b for a, b in values) if kind == "port" else proto.lower() == values[0].lower())
            if ok:
                want.append((n, name))
    assert got == sorted(want) and len(got) > 1000
