import os
import random
import re
import shutil

import pytest

from alertloom.functions.literals import literals_of
from alertloom.operators import feeds as W
from alertloom.sources.tables import read_feed
from alertloom.streaming.feeds import stream_match, stream_series

# A documented feed, and the two requests of its example, which only the last
# pattern is found in.
DOCUMENTED = [
    (r"http:\/\/.*\.exe", "Suspicious .exe file download"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "IPv4 address"),
    (r"(?s:GET.*POST)", "Matches a GET followed by a POST on a single line"),
    (r"[^/]+\.php\?", "Suspicious PHP file with query parameters"),
    (r"user[:blank:]*[:digit:]+", "User followed by a number with optional space"),
    (r"([a-zA-Z0-9_-]+\.)+[a-zA-Z0-9_-]+", "Generic domain name"),
]
REQUESTS = ["/connecttest.txt?n=1618065954857", "/mobile/status.php"]


def write_feed(path, rows):
    path.write_text("#fields\tregex\tdescription\n" + "".join(f"/{r}/\t{d}\n" for r, d in rows))


def frame(spark, rows):
    return spark.createDataFrame(rows, "regex string, description string")


def test_documented_example(spark, tmp_path):
    write_feed(tmp_path / "feed.tsv", DOCUMENTED)
    feed = read_feed(spark, str(tmp_path / "feed.tsv"))
    assert sorted((r["regex"], r["description"]) for r in feed.collect()) == sorted(DOCUMENTED)
    uris = spark.createDataFrame([(u,) for u in REQUESTS], "uri string")
    found = W.match_feed(uris, feed).collect()
    assert sorted((r["uri"], r["description"]) for r in found) == [(u, "Generic domain name") for u in sorted(REQUESTS)]


def test_invalid_patterns_are_set_aside(spark):
    good, bad = W.checked_patterns(frame(spark, [("a", "1"), ("(", "2")]))
    assert [r["regex"] for r in good] == ["a"] and [r["regex"] for r in bad] == ["("]


@pytest.mark.parametrize("few", [0, 200])
def test_more_patterns_than_one_block(spark, monkeypatch, few):
    monkeypatch.setattr(W, "RULES_PER_SCAN", 3)
    monkeypatch.setattr(W, "FEW_PATTERNS", few)
    uris = spark.range(20).selectExpr("concat('u', id) AS uri")
    feed = frame(spark, [(f"u{i}$", str(i)) for i in range(8)])
    assert sorted(r["uri"] for r in W.match_feed(uris, feed).collect()) == [f"u{i}" for i in range(8)]
    assert W.match_feed(uris, frame(spark, [("nowhere", "")])).count() == 0
    assert W.match_feed(uris, frame(spark, [("(", "")])).count() == 0


def test_fields_line_names_the_columns(spark, tmp_path):
    (tmp_path / "f").write_text("#fields\tdescription\tregex\nfirst\t/a+/\nsecond\t/b/\n")
    assert [(r["regex"], r["description"]) for r in read_feed(spark, str(tmp_path / "f")).collect()] == [("a+", "first"), ("b", "second")]
    (tmp_path / "g").write_text("#fields\tdescription\nfirst\n")
    with pytest.raises(ValueError):
        read_feed(spark, str(tmp_path / "g"))


def test_changes(spark):
    old = frame(spark, [("a", "1"), ("b", "2"), ("c", "3")])
    new = frame(spark, [("a", "1"), ("b", "x"), ("d", "4")])
    rows = {(r["regex"], r["description"], r["change"]) for r in W.feed_changes(old, new).collect()}
    assert rows == {("b", "x", "CHANGED"), ("c", "3", "REMOVED"), ("d", "4", "NEW")}


def test_stream_follows_the_feed(spark, tmp_path):
    requests, out = tmp_path / "requests", tmp_path / "out"
    requests.mkdir()
    versions = [[("a", "1"), ("b", "2")], [("a", "one"), ("b", "2")], [("a", "one"), ("c", "3")]]
    uris = spark.readStream.schema("uri string").option("maxFilesPerTrigger", 10).json(str(requests))
    for n, version in enumerate(versions):
        write_feed(tmp_path / "feed.tsv", version)
        (requests / f"{n}.json").write_text('{"uri": "/a"}\n{"uri": "/b"}\n{"uri": "/c"}\n')
        query = stream_match(uris, lambda: read_feed(spark, str(tmp_path / "feed.tsv")), str(out),
                             str(tmp_path / "state"), available_now=True)
        assert query.awaitTermination(120)
    matches = spark.read.parquet(str(out / "matches")).collect()
    assert sorted((r["batch"], r["uri"], r["description"]) for r in matches) == [
        (0, "/a", "1"), (0, "/b", "2"), (1, "/a", "one"), (1, "/b", "2"), (2, "/a", "one"), (2, "/c", "3")]
    changes = spark.read.parquet(str(out / "changes")).collect()
    assert sorted((r["batch"], r["regex"], r["change"]) for r in changes) == [
        (0, "a", "NEW"), (0, "b", "NEW"), (1, "a", "CHANGED"), (2, "b", "REMOVED"), (2, "c", "NEW")]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    from alertloom.streaming.feeds import match_batch
    uris = spark.createDataFrame([("/a",)], "uri string")
    for _ in range(2):
        match_batch(uris, 0, lambda: frame(spark, [("a", "1")]), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "matches")).count() == 1


def test_series_stream(spark, tmp_path):
    folder = tmp_path / "readings"
    folder.mkdir()
    (folder / "one.csv").write_text("Time,Temperature\n0.0,40.5\n1.0,41.0\n")
    query = stream_series(spark, str(folder)).writeStream.format("memory").queryName("readings") \
        .trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM readings").collect()) == [
        ("one.csv", 0.0, 40.5), ("one.csv", 1.0, 41.0)]


@pytest.mark.parametrize("regex, found", [
    (r"http:\/\/.*\.exe", ["http://"]), (r"[^/]+\.php\?", [".php?"]), ("abc|defg", ["abc", "defg"]), ("abcd*ef", ["abc"]), ("abc+def", ["abc"]),
    ("(?i)HeLLo", ["hello"]), (r"ab\dcdef{2}g", ["cde"]), ("foo(?:bar)?baz", ["foo"]), (r"foo\(bar", ["foo(bar"]), ("abc|de", []), ("(?x)a b c", []),
    (r"\Qabc\E", []), (r"\x41bcd", []), ("", []), ("[]abc]", []), ("(?s:GET.*POST)", []), ("abc{0}", []), ("ab[c[d]e]fgh", ["fgh"])])
def test_required_literals(regex, found):
    assert literals_of(regex) == found


def test_a_match_holds_a_required_literal():
    draw, tried = random.Random(2), 0
    parts = ["a", "b", "abc", "/", ".", "\\.", "\\d", "[ab]", "(a|bc)", "x*", "c+", "d?", "e{2}", "|", "^", "$", ".*", "(?:q)", "[^c]", "\\/", "-"]
    for _ in range(20_000):
        regex = "".join(draw.choices(parts, k=draw.randrange(1, 8)))
        try:
            pattern = re.compile(regex)
        except re.error:
            continue
        text = "".join(draw.choices(["a", "b", "c", "d", "e", "ee", "abc", "/", ".", "1", "x", "q", "-", "bc"], k=14))
        if (needed := literals_of(regex)) and pattern.search(text):
            tried += 1
            assert any(x in text for x in needed), (regex, text)
    assert tried > 100


def test_thousands_of_patterns_equal_trying_each(spark):
    """Patterns with literals meet their URIs by key only; the plan holds no pattern."""
    draw = random.Random(7)
    words = ["".join(draw.choices("abcde", k=draw.randrange(2, 9))) for _ in range(400)]
    rows = list({"/".join(draw.choices(words, k=2)) + draw.choice(["$", "", r"\.php", r"\d+", "|" + draw.choice(words)]): None for _ in range(3000)})
    rows += [*dict.fromkeys("(?i)" + w.upper() for w in words[:50]), "(", None]
    uris = ["/" + "/".join(draw.choices(words, k=4)) + draw.choice(["", ".php", "7", "?Q=" + words[3].upper()]) for _ in range(300)] + [uris_same := "/abc", uris_same, ""]
    feed = frame(spark, [(r, str(i)) for i, r in enumerate(rows)])
    found = W.match_feed(spark.createDataFrame([(u, i) for i, u in enumerate(uris)], "uri string, n int").withColumn("key", W.F.lit("x")), feed)
    got = sorted((r["n"], r["regex"]) for r in found.collect())
    patterns = [(r, re.compile(r)) for r in rows if r not in ("(", None)]
    assert got == sorted((n, r) for n, u in enumerate(uris) for r, p in patterns if p.search(u)) and len(got) > 300


def test_too_many_patterns_without_a_literal_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_WITHOUT_LITERAL", 2)
    monkeypatch.setattr(W, "FEW_PATTERNS", 0)
    with pytest.raises(ValueError, match="without a literal"):
        W.match_feed(spark.createDataFrame([("/a",)], "uri string"), frame(spark, [("a", "1"), ("b", "2"), ("c", "3")]))


def test_change_events_with_state_equal_comparing_snapshots(spark, tmp_path):
    """A replay of versions, stopped and started again from its checkpoint in between."""
    import json

    from alertloom.streaming.feeds import stream_changes

    draw = random.Random(4)
    versions = [[(f"p{k}", draw.choice("ab")) for k in range(12) if draw.random() < 0.6] or [("p0", "a")] for _ in range(6)]
    versions[3] = versions[2]
    folder = tmp_path / "versions"
    folder.mkdir()

    def replay(upto):
        for n in range(upto):
            if not (folder / f"{n}.json").exists():
                (folder / f"{n}.json").write_text("\n".join(json.dumps({"version": n + 1, "regex": r, "description": d, "line": i}) for i, (r, d) in enumerate(versions[n])))
                os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read in order of their times
        rows = spark.readStream.schema("version long, regex string, description string, line long").option("maxFilesPerTrigger", 1).json(str(folder))
        query = stream_changes(rows).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")) \
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(240)

    replay(4)
    replay(6)
    got = {(r.version, r.regex, r.description, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    wanted, before = set(), {}
    for n, version in enumerate(versions):
        now = dict(version)
        wanted |= {(n + 1, r, d, "NEW") for r, d in now.items() if r not in before} | {(n + 1, r, d, "CHANGED") for r, d in now.items() if before.get(r, d) != d}
        wanted |= {(n + 1, r, d, "REMOVED") for r, d in before.items() if r not in now}
        before = now
    assert got == wanted and spark.read.parquet(str(tmp_path / "out")).count() == len(wanted)
    first = W.feed_changes(frame(spark, versions[0]), frame(spark, versions[1])).collect()
    assert {(r["regex"], r["description"], r["change"]) for r in first} == {x[1:] for x in wanted if x[0] == 2}


def test_readings_appended_to_a_file_arrive_once(spark, tmp_path):
    """Lines appended between batches, cut in the middle of a line; a batch that is run again; a second file that comes later."""
    from alertloom.streaming.feeds import read_appended

    folder, out = tmp_path / "readings", str(tmp_path / "out")
    folder.mkdir()

    def append(name, text):
        with open(folder / name, "a", newline="") as f:
            f.write(text)

    append("a.csv", "Time,Temperature\n0.0,40.5\n1.0,4")
    read_appended(spark, str(folder), out, 0)
    append("a.csv", "1.5\r\n\n2.0,42\n")
    append("b.csv", "Time")
    read_appended(spark, str(folder), out, 1)
    append("b.csv", ",Temperature\n5.0,9\n")
    append("a.csv", "3.0,43")
    read_appended(spark, str(folder), out, 1)  # run again: what came since belongs to the next batch
    read_appended(spark, str(folder), out, 2)
    append("a.csv", "\n")
    read_appended(spark, str(folder), out, 3)
    read_appended(spark, str(folder), out, 4)
    got = sorted((r["batch"], r["series"], r["x"], r["y"]) for r in spark.read.parquet(f"{out}/rows").collect())
    assert got == [(0, "a.csv", 0.0, 40.5), (1, "a.csv", 1.0, 41.5), (1, "a.csv", 2.0, 42.0), (2, "b.csv", 5.0, 9.0), (3, "a.csv", 3.0, 43.0)]


def test_a_followed_file_goes_on_from_its_checkpoint(spark, tmp_path):
    import time

    from alertloom.streaming.feeds import follow_series

    (tmp_path / "a.csv").write_text("Time,Temperature\n" + "".join(f"{k}.0,{k}\n" for k in range(5)))
    out = str(tmp_path / "out")
    for upto in (5, 8):
        with open(tmp_path / "a.csv", "a") as f:
            f.write("".join(f"{k}.0,{k}\n" for k in range(5, upto)))
        query = follow_series(spark, str(tmp_path / "a.csv"), out, str(tmp_path / "state"), "1 second")
        for _ in range(120):
            time.sleep(1)
            if os.path.isdir(f"{out}/rows") and spark.read.option("recursiveFileLookup", "true").schema("series string, x double, y double").parquet(f"{out}/rows").count() >= upto:
                break
        query.stop()
    assert sorted(r["x"] for r in spark.read.parquet(f"{out}/rows").collect()) == [float(k) for k in range(8)]


@pytest.mark.parametrize("parts", [None, 3])
def test_pages_of_a_stream_are_a_file_or_a_folder_of_files(spark, tmp_path, parts):
    from alertloom.plans.files import uri_feed_stream

    rows = [(k, f"http://m.a.org/de/{k}") for k in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    target = str(tmp_path / "pages.parquet")
    if parts:
        pages.repartition(parts).write.parquet(target)
    else:
        pages.coalesce(1).write.parquet(str(tmp_path / "made"))
        shutil.copy(next((tmp_path / "made").glob("part-*.parquet")), target)
    found = uri_feed_stream(spark, str(tmp_path)).where("description = 'mobile without encryption'")
    assert sorted((r.page_id, r.url) for r in found.collect()) == rows
