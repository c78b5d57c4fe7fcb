"""Detection signatures as text: clean, validate, parse, split, match against flows."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from alertloom.functions.once import evaluated_once
from alertloom.functions.text import strip
from alertloom.session import package_on_workers, stored

# The signature language.
NAMED_BLOCK = r"(?U)signature\s+([\w-]+)\s*\{([^}]+)\}"
FIRST_LINE = r"(?U)^signature\s+[\w-]+\s*\{"
PLAIN_FIELDS = {
    "ip-proto": r"(?U)ip-proto\s*==\s*(\w+)",
    "src-ip": r"(?U)src-ip\s*==\s*([^\n]+)",
    "dst-ip": r"(?U)dst-ip\s*==\s*([^\n]+)",
    "src-port": r"(?U)src-port\s*==\s*([^\n]+)",
    "dst-port": r"(?U)dst-port\s*==\s*([^\n]+)",
    "event": r'(?U)event\s+"([^"]+)"',
    "tcp-state": r"(?U)tcp-state\s+([^\n]+)",
}
# A pattern ends at its first slash, even an escaped one.
PATTERN_FIELDS = {
    name: rf"(?U){name}\s+/([^/]+)/([gimsx]*)" for name in ("payload", "http-request", "http-reply")
}
FIELDS = (*PLAIN_FIELDS, *PATTERN_FIELDS)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def clean_signature(text: Column) -> Column:
    """Without code fences, the word a fence leaves behind, indentation and blank lines."""
    unfenced = F.regexp_replace(F.regexp_replace(text, r"(?U)```\w*\n?", ""), "```", "")
    plain = F.regexp_replace(unfenced, r"(?Umd)^\s*plaintext\s*\n", "")
    return F.array_join(_lines(plain), "\n")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def signature_fault(cleaned: Column, original: Column) -> Column:
    """Why a cleaned model reply is no signature, null if it is one. The first rule broken counts."""
    has_field = reduce(lambda a, b: a | b, [cleaned.contains(f) for f in FIELDS])
    first = F.substring_index(cleaned, "\n", 1)
    foreign = cleaned.contains("rule ") | cleaned.contains("condition =")
    return (
        F.when(strip(original) == "", "empty")
        .when(~cleaned.startswith("signature") & foreign, "other rule language")
        .when(~cleaned.startswith("signature") & cleaned.contains("```"), "code fence")
        .when(~cleaned.startswith("signature"), "no signature keyword")
        .when(~cleaned.contains("{"), "no opening brace")
        .when(~cleaned.contains("}"), "no closing brace")
        .when(_count(cleaned, "{") != _count(cleaned, "}"), "unbalanced braces")
        .when(~first.rlike(FIRST_LINE), "bad name")
        .when(~has_field, "no known field")
    )


def validate_signatures(df: DataFrame, col: str) -> DataFrame:
    """Adds ``cleaned``, ``reason`` and ``valid`` for model replies."""
    blank = strip(F.col(col)) == ""
    return (
        df.withColumn("cleaned", F.when(blank, "").otherwise(clean_signature(F.col(col))))
        .withColumn("reason", signature_fault(F.col("cleaned"), F.col(col)))
        .withColumn("valid", F.col("reason").isNull())
    )


def text_fault(text: Column) -> Column:
    """The looser check of a signature taken as it is: keyword, balanced braces, a named block."""
    bare = strip(text)
    return (
        F.when(bare == "", "empty")
        .when(~bare.startswith("signature"), "no signature keyword")
        .when(~text.contains("{") | ~text.contains("}"), "missing braces")
        .when(_count(text, "{") != _count(text, "}"), "unbalanced braces")
        .when(~bare.rlike(NAMED_BLOCK), "does not parse")
    )


def _parts(name: Column, body: Column) -> Column:
    """struct<name, body, fields map, patterns array>, null without a name."""
    def found(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))

    fields = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(f) for f in PLAIN_FIELDS]),
                          F.array(*[found(p, 1) for p in PLAIN_FIELDS.values()])),
        lambda _, values: F.size(values) > 0,
    )

    def typed(kind: str, pattern: str) -> Column:
        return F.zip_with(found(pattern, 1), found(pattern, 2), lambda regex, flags: F.struct(
            F.lit(kind).alias("type"), regex.alias("pattern"), flags.alias("flags")))

    patterns = F.flatten(F.array(*[typed(kind, p) for kind, p in PATTERN_FIELDS.items()]))
    whole = F.struct(name.alias("name"), body.alias("body"), fields.alias("fields"),
                     patterns.alias("patterns"))
    return F.when(name != "", whole)


def parse_signatures(df: DataFrame, col: str) -> DataFrame:
    """Adds ``parsed``: struct<name, body, fields map, patterns array> of the first named block,
    else null. The block is found once and its body then searched for each field."""
    block = evaluated_once(df, {
        "_name": F.regexp_extract(F.col(col), NAMED_BLOCK, 1),
        "_body": strip(F.regexp_extract(F.col(col), NAMED_BLOCK, 2)),
    })
    return block.withColumn("parsed", _parts(F.col("_name"), F.col("_body"))).drop("_name", "_body")


def split_replies(df: DataFrame, col: str, strategy: str = "mixed") -> DataFrame:
    """Valid signatures of replies that hold several, numbered within their reply.

    A signature starts at a line beginning with the keyword; words before the first one make a
    block of their own, which fails the check and is not counted.
    """
    parts = F.split(F.array_join(_lines(F.col(col)), "\n"), r"\n(?=signature )")
    valid = F.filter(parts, lambda block: text_fault(block).isNull())
    rest = [c for c in df.columns if c != col]
    found = df.select(*rest, F.posexplode(valid).alias("_at", "signature"))
    return parse_signatures(found, "signature").select(
        *rest, "signature", F.col("parsed.name").alias("name"), F.lit(strategy).alias("strategy"),
        (F.col("_at") + 1).alias("index"), F.col("parsed.patterns").alias("modifiable_patterns"),
        F.lit(True).alias("valid"))


def training_example(df: DataFrame, signature_col: str = "cleaned") -> DataFrame:
    """instruction, input and output of the accepted signatures."""
    return df.where("valid").select("instruction", "input", F.col(signature_col).alias("output"))


# The conditions of the signature language that flows can be tested for.
COMPARED = re.compile(r"(src-ip|dst-ip|src-port|dst-port|ip-proto|payload-size)\s*(==|!=|<=|>=|<|>)\s*([\w.:/-]+(?:\s*,\s*[\w.:/-]+)*)")
CONTENT = re.compile(
    r"(payload|http-request-header|http-request-body|http-reply-header|http-reply-body|http-request|http-reply|ftp|finger)"
    r"\s+/((?:[^/\\]|\\.)*)/([gimsx]*)")
STATE = re.compile(r"(tcp-state|udp-state)\s+(\w+(?:\s*,\s*\w+)*)")
SAME = re.compile(r"same-ip\b")
EVENT = re.compile(r'event\s+"([^"]*)"')
CONTENT_COLUMNS = {
    "payload": "payload", "http-request": "uri", "http-reply": "reply",
    "http-request-header": "request_header", "http-request-body": "request_body",
    "http-reply-header": "reply_header", "http-reply-body": "reply_body", "ftp": "ftp", "finger": "finger",
}
HEADER_COLUMNS = {"src-ip": "src_ip", "dst-ip": "dst_ip", "src-port": "src_port", "dst-port": "dst_port",
                  "ip-proto": "proto", "payload-size": "payload", "tcp-state": "tcp_state", "udp-state": "udp_state"}


def ipv4_number(address: Column) -> Column:
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p)
    return F.when(F.size(parts) == 4, number)


def ipv6_digits(address: Column) -> Column:
    """The 32 hex digits of an IPv6 address; null for other texts."""
    halves = F.split(F.lower(address), "::", 2)

    def groups(text: Column) -> Column:
        return F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")

    head, tail = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    gap = 8 - F.size(head) - F.size(tail)
    whole = F.concat(head, F.array_repeat(F.lit("0"), F.when(F.size(halves) == 2, F.greatest(gap, F.lit(0))).otherwise(0)), tail)
    sound = (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(address.contains(":") & sound, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def _address(address: Column) -> Column:
    """An address as hex digits: 8 of IPv4, 32 of IPv6; null for other texts."""
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4_number(address)), 8, "0")), ipv6_digits(address))


def _prefix_key(kind: str, digits: Column, length: Column, bits: int) -> Column:
    """The key of the network of ``bits`` bits around an address of as many digits as ``length`` says."""
    key = F.concat(F.lit(f"{kind}/"), length.cast("string"), F.lit(f"/{bits}/"), F.substring(digits, 1, bits // 4))
    if bits % 4:
        digit = F.conv(F.substring(digits, bits // 4 + 1, 1), 16, 10).cast("int")
        key = F.concat(key, F.lit("/"), F.shiftright(digit, 4 - bits % 4).cast("string"))
    return key


def _network_key(kind: str, network) -> str:
    digits = f"{int(network.network_address):0{network.max_prefixlen // 4}x}"
    bits = network.prefixlen
    part = f"/{int(digits[bits // 4], 16) >> 4 - bits % 4}" if bits % 4 else ""
    return f"{kind}/{len(digits)}/{bits}/{digits[:bits // 4]}{part}"


def _dyadic_keys(kind: str, ranges: list[tuple[int, int]]) -> list[str]:
    """Keys of the fewest aligned blocks of ports that make up disjoint ranges."""
    keys = []
    for low, high in ranges:
        low, high = max(low, 0), min(high, 65535)
        while low <= high:
            level = 16 if low == 0 else (low & -low).bit_length() - 1
            while (1 << level) > high - low + 1:
                level -= 1
            keys.append(f"{kind}/{level}/{low >> level}")
            low += 1 << level
    return keys


def _joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


NETWORKS, NUMBERS = ("src-ip", "dst-ip"), ("src-port", "dst-port", "payload-size")
_FIELD = {kind: kind.replace("-", "_") for kind in (*NETWORKS, *NUMBERS)}


def _need(kind: str, sign: str, values: list[str]) -> tuple[dict, float, list[str]]:
    """One header line as data, the share of flows that it may let through, and its keys. No share, no keys: not for an index."""
    positive = sign == "=="
    if kind == "ip-proto":
        names = sorted({v.lower() for v in values})
        return {"not": sign == "!=", "values": names}, 0.3 * len(names) if positive else 2.0, [f"proto/{n}" for n in names]
    if sign not in ("==", "!=") and (kind in NETWORKS or len(values) != 1):
        raise ValueError(f"{kind} {sign} needs one number")
    if kind in NETWORKS:
        networks = [ipaddress.ip_network(v, strict=False) for v in values]
        merged = [n for version in (4, 6) for n in ipaddress.collapse_addresses(n for n in networks if n.version == version)]
        ranges = [{"low": f"{int(n.network_address):0{n.max_prefixlen // 4}x}", "high": f"{int(n.broadcast_address):0{n.max_prefixlen // 4}x}"} for n in merged]
        return {"not": sign == "!=", "ranges": ranges}, sum(2.0 ** -n.prefixlen for n in merged) if positive else 2.0, [_network_key(kind, n) for n in merged]
    numbers = [[int(n) for n in v.split("-")] for v in values]
    least, most = -2**62, 2**62
    bound = numbers[0][0]
    ranges = {"<": [(least, bound - 1)], "<=": [(least, bound)], ">": [(bound + 1, most)], ">=": [(bound, most)]}.get(
        sign, _joined_ranges([(r[0], r[-1]) for r in numbers]))
    covered = sum(max(0, min(high, 65535) - max(low, 0) + 1) for low, high in ranges) / 65536
    indexed = positive and kind != "payload-size"
    return ({"not": sign == "!=", "ranges": [{"low": low, "high": high} for low, high in ranges]}, covered if indexed else 2.0,
            _dyadic_keys(kind, ranges) if indexed else [])


def signature_needs(body: str, kinds: set[str]) -> dict:
    """What a flow must fulfil, each line of a signature's body as data, its event message, and the keys it is found by.

    ``kinds``: the conditions that the flows have a column for. A line that can't be tested for gives ``reason`` and its number.
    """
    out: dict = {"message": "", "contents": [], "proto": [], "tcp_state": [], "udp_state": [], "same_ip": False, "reason": None, "line": 0, "keys": ["all"]}
    out |= {name: [] for name in _FIELD.values()}
    at, line, best = 0, 0, 1.0
    try:
        while rest := body[at:].lstrip():
            at, line = len(body) - len(rest), line + 1

            def needed(kind: str) -> str:
                if kind not in kinds:
                    raise ValueError(f"no column for {kind}")
                return kind

            if m := COMPARED.match(rest):
                kind, sign, values = m.groups()
                need, share, keys = _need(needed(kind), sign, [v.strip() for v in values.split(",")])
                out["proto" if kind == "ip-proto" else _FIELD[kind]].append(need)
                if share < best:
                    best, out["keys"] = share, keys
            elif m := CONTENT.match(rest):
                kind, pattern, flags = m.groups()
                kept = "".join(f for f in flags if f in "imsx")
                out["contents"].append({"line": line, "kind": needed(kind), "regex": f"(?{kept})^(?:{pattern})" if kept else f"^(?:{pattern})",
                                        "reason": f"bad pattern /{pattern}/"})
            elif m := STATE.match(rest):
                out[needed(m[1]).replace("-", "_")] += [s.strip() for s in m[2].split(",")]
            elif m := SAME.match(rest):
                out["same_ip"] = bool(needed("src-ip") and needed("dst-ip"))
            elif m := EVENT.match(rest):
                out["message"] = m[1]
            else:
                raise ValueError(f"unsupported line: {rest.splitlines()[0].strip()}")
            at += m.end()
    except ValueError as fault:
        out |= {"reason": str(fault), "line": line}
    return out


def _range(kind: str) -> str:
    return f"array<struct<not:boolean,ranges:array<struct<low:{kind},high:{kind}>>>>"


NEEDS = ("struct<message:string,contents:array<struct<line:int,kind:string,regex:string,reason:string>>,proto:array<struct<not:boolean,values:array<string>>>,"
         "tcp_state:array<string>,udp_state:array<string>,same_ip:boolean,reason:string,line:int,keys:array<string>,"
         + ",".join(f"{_FIELD[k]}:{_range('string' if k in NETWORKS else 'bigint')}" for k in _FIELD) + ">")


def _columns(flows: DataFrame, content_cols: dict[str, str] | None) -> dict[str, str]:
    """The columns of the conditions that these flows can be tested for."""
    named = HEADER_COLUMNS | (content_cols or CONTENT_COLUMNS)
    return {kind: col for kind, col in named.items() if col in flows.columns}


def read_needs(flows: DataFrame, signatures: DataFrame, content_cols: dict[str, str] | None = None) -> DataFrame:
    """``name``, ``needs`` (the conditions as data) and ``reason`` (why it can't be matched, or null) of each parsed signature.

    A signature is read by a small function, row by row in the tasks; none comes to the driver. Whether its
    patterns compile, the JVM says, which will match them.
    """
    package_on_workers(flows.sparkSession)
    kinds = set(_columns(flows, content_cols))
    kind = T.StructType.fromDDL(f"name string, needs {NEEDS}")
    target = to_arrow_schema(kind)

    def read(batches):
        for batch in batches:
            needs = [signature_needs(b.as_py() or "", kinds) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(needs, target.field("needs").type)], ["name", "needs"])

    rows = signatures.where(F.col("parsed").isNotNull()).select("parsed.name", "parsed.body").mapInArrow(read, kind)
    broken = F.filter("needs.contents", lambda c: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), c["regex"]).isNull())
    first = F.get(broken, F.lit(0))
    reason = F.when(first.isNotNull() & (F.col("needs.reason").isNull() | (first["line"] < F.col("needs.line"))), first["reason"]).otherwise(F.col("needs.reason"))
    return rows.withColumn("reason", reason)


def _fits(columns: dict[str, str]) -> Column:
    """Whether the flow ``f`` fulfils the needs ``s`` of a signature."""
    def flow(kind: str) -> Column:
        return F.col("f")[columns[kind]]

    def all_of(needs: Column, among: Callable[[Column], Column], there: Column) -> Column:
        return F.forall(needs, lambda n: F.coalesce(F.when(n["not"], there & ~F.coalesce(among(n), F.lit(False))).otherwise(among(n)), F.lit(False)))

    def within(value: Column) -> Callable[[Column], Column]:
        return lambda n: F.exists(n["ranges"], lambda r: value.between(r["low"], r["high"]))

    def inside(digits: Column) -> Callable[[Column], Column]:
        return lambda n: F.exists(n["ranges"], lambda r: (F.length(r["low"]) == F.length(digits)) & digits.between(r["low"], r["high"]))

    def states(kind: str) -> Column:
        return F.forall(F.col("s")[kind.replace("-", "_")], lambda x: F.coalesce(F.array_contains(flow(kind), x), F.lit(False)))

    def contents(kind: str) -> Column:
        return F.forall(F.filter("s.contents", lambda c: c["kind"] == kind), lambda c: F.coalesce(F.rlike(flow(kind), c["regex"]), F.lit(False)))

    tests = []
    for kind in columns:
        if kind in NETWORKS:
            tests.append(all_of(F.col("s")[_FIELD[kind]], inside(F.col("_" + _FIELD[kind])), flow(kind).isNotNull()))
        elif kind in NUMBERS:
            number = F.octet_length(flow(kind)).cast("long") if kind == "payload-size" else flow(kind).cast("long")
            tests.append(all_of(F.col("s")[_FIELD[kind]], within(number), number.isNotNull()))
        elif kind == "ip-proto":
            tests.append(all_of(F.col("s.proto"), lambda n: F.array_contains(n["values"], F.lower(flow("ip-proto"))), flow(kind).isNotNull()))
        elif kind in ("tcp-state", "udp-state"):
            tests.append(states(kind))
        else:
            tests.append(contents(kind))
    if "src-ip" in columns and "dst-ip" in columns:
        tests.append(~F.col("s.same_ip") | F.coalesce(flow("src-ip") == flow("dst-ip"), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _flow_keys(shapes: list[Row], columns: dict[str, str]) -> Column:
    """The keys under which signatures may wait for a flow: one for each shape of key that signatures have."""
    keys = []
    for shape in shapes:
        kind, parts = shape["kind"], shape["parts"]
        if kind == "all":
            keys.append(F.lit("all"))
        elif kind == "proto":
            keys.append(F.concat(F.lit("proto/"), F.lower(F.col("f")[columns["ip-proto"]])))
        elif kind in NETWORKS:
            digits = F.col("_" + _FIELD[kind])
            keys.append(F.when(F.length(digits) == int(parts[0]), _prefix_key(kind, digits, F.lit(int(parts[0])), int(parts[1]))))
        else:
            port = F.col("f")[columns[kind]].cast("long")
            keys.append(F.concat(F.lit(f"{kind}/{parts[0]}/"), F.shiftright(port, int(parts[0])).cast("string")))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def match_signatures(flows: DataFrame, signatures: DataFrame,
                     content_cols: dict[str, str] | None = None) -> DataFrame:
    """Flows with each signature they fulfil, once per connection and signature.

    ``flows``: proto, src_ip, src_port, dst_ip, dst_port, payload and any other columns; ``tcp_state`` and
    ``udp_state`` are arrays of what holds (established, originator, responder). Signatures that need anything
    else (header bytes, other signatures, policy calls, file magic) or can't be read match nothing;
    ``signature_rejects`` lists them.

    Each signature waits under the keys of its narrowest condition: networks by prefix length, port ranges as
    aligned blocks, protocols, else under one key that every flow has. Networks and ranges are merged
    first, so that a flow meets a signature once. The conditions, as data, are tested on what meets. The
    index is a stored table, which Spark sends to the tasks if it sees that it is small.
    """
    columns = _columns(flows, content_cols)
    ready = read_needs(flows, signatures, content_cols).where("reason IS NULL")
    index = stored(ready.select("name", F.col("needs").alias("s"), F.explode("needs.keys").alias("key")))
    # Shapes are few whatever the signatures: kinds, prefix lengths and block sizes.
    parts = F.split("key", "/")
    shape = F.when(parts[0].isin(*NETWORKS), F.slice(parts, 2, 2)).when(parts[0].isin("src-port", "dst-port"), F.slice(parts, 2, 1)).otherwise(F.slice(parts, 1, 0))
    shapes = index.select(parts[0].alias("kind"), shape.alias("parts")).distinct().collect()
    rows = flows.select(F.struct("*").alias("f"))
    rows = evaluated_once(rows, {"_" + _FIELD[k]: _address(F.col("f")[columns[k]]) if k in columns else F.lit(None).cast("string") for k in NETWORKS})
    met = rows.select("*", F.explode(_flow_keys(shapes, columns)).alias("key")).join(index, "key").where(_fits(columns))
    return met.select("f.*", F.col("name").alias("signature"), F.col("s.message").alias("message"))


def signature_rejects(flows: DataFrame, signatures: DataFrame,
                      content_cols: dict[str, str] | None = None) -> DataFrame:
    """Signatures that can't be matched against these flows, with the reason."""
    return read_needs(flows, signatures, content_cols).where("reason IS NOT NULL").select(F.col("name").alias("signature"), "reason")


def signature_hits(matches: DataFrame) -> DataFrame:
    """Matches per signature, the most frequent first."""
    return matches.groupBy("signature").agg(F.count(F.lit(1)).alias("matches")) \
        .orderBy(F.desc("matches"), "signature")
