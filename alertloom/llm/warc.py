"""WARC derivatives: metadata and plain-text conversion records of captured responses."""

from __future__ import annotations

import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.once import evaluated_once

# Names of character references that pages use most, looked up first.
FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "apos;", "copy;", "reg;", "middot;", "hellip;", "ndash;", "mdash;", "lsquo;",
            "rsquo;", "ldquo;", "rdquo;", "bull;", "euro;", "laquo;", "raquo;")
#: All names of HTML 5 with their characters, some without a semicolon. A no-break space reads as a space.
NAMES = {f"&{name}": html5[name].replace("\xa0", " ") for name in dict.fromkeys([*FREQUENT, *html5])}
#: Names that need no semicolon, longest first: what follows them is text.
BARE = sorted((name[1:] for name in NAMES if not name.endswith(";")), key=lambda name: (-len(name), name))
#: Numbers that stand for a character of code page 1252, as pages of its time meant them; 160 is the no-break space.
NUMBERED = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160) if bytes([n]).decode("cp1252", "ignore")} | {160: " "}
REFERENCE = r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*[;=]?)"
UNREAD = ("script", "style", "noscript", "template", "title")
BREAKS = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|main|aside|header|footer|blockquote|pre|form|hr"
#: A tag behind its name: quoted values may hold its closing sign. No other way to read it is tried; RE2 does so by itself.
INSIDE = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>"""
INSIDE_RE2 = r"""(?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*>"""
ATTRIBUTE = r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)"""


def record_id(*parts: Column) -> Column:
    """A record identifier that a rerun gives again: a UUID URN of a hash of the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cuts = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def labelled_digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


_REFERENCE, _ATTRIBUTE = re.compile(REFERENCE), re.compile(ATTRIBUTE.encode())
_BARE = re.compile(f"&(?:{'|'.join(BARE)})")
_COMMENT = re.compile(rb"(?s)<!--.*?-->")
_UNREAD = re.compile(rf"(?is)<({'|'.join(UNREAD)})\b{INSIDE}.*?</\1\s*>".encode())
_BREAK = re.compile(rf"(?i)</?(?:{BREAKS})\b{INSIDE}".encode())
_TAG = re.compile(rf"<[a-zA-Z/!?]{INSIDE}".encode())
_TITLE = re.compile(rf"(?is)<title\b{INSIDE}(.*?)</title\s*>".encode())
_PAGE = re.compile(rf"(?i)<html(?=[\s>]){INSIDE}".encode())
_ANCHOR = re.compile(rf"(?i)<a(?=\s){INSIDE}".encode())


def _code_point(reference: str) -> str:
    """The character of a numeric reference; of numbers that are none, the replacement character."""
    digits, base = (reference[3:], 16) if reference[2] in "xX" else (reference[2:], 10)
    digits = digits.rstrip(";").lstrip("0")
    number = int(digits or "0", base) if len(digits) < 8 else 0
    if number in NUMBERED:
        return NUMBERED[number]
    return chr(number) if 0 < number < 0xD800 or 0xDFFF < number <= 0x10FFFF else "\ufffd"


def _read(reference: str, in_attribute: bool) -> str:
    """What a reference stands for, or itself. In text a name without semicolon may be followed by anything; in an
    attribute a letter, digit or equals sign behind it makes it part of an address."""
    if reference[1] == "#":
        return _code_point(reference)
    body = reference.rstrip("=")
    if in_attribute:
        return reference if body != reference else NAMES.get(body, body)
    named = NAMES.get(body)
    if named is None:
        bare = _BARE.match(body)
        named = NAMES[bare[0]] + body[bare.end():] if bare else body
    return named + reference[len(body):]


def unescaped(text: str, in_attribute: bool = False) -> str:
    """Character references replaced: the names of HTML 5, decimal and hexadecimal ones, each read once."""
    return _REFERENCE.sub(lambda m: _read(m[0], in_attribute), text) if "&" in text else text


def attribute(tag: bytes, name: bytes) -> bytes | None:
    """The value of a tag's first attribute of that name. Quoted values are read whole, so that nothing inside them
    counts as an attribute."""
    for own, value in _ATTRIBUTE.findall(tag):
        if own.lower() == name:
            return value[1:-1] if value[:1] in (b'"', b"'") and len(value) > 1 else value
    return None


def plain_text(html: bytes) -> str:
    """What a reader sees of a page, a line for each block.

    Comments, scripts, styles and the title are left out, tags of blocks end a line, other tags go,
    character references are read, runs of ASCII blanks and of line ends become one.
    """
    text = _UNREAD.sub(b" ", _COMMENT.sub(b" ", html))
    text = _TAG.sub(b"", _BREAK.sub(b"\n", b" ".join(text.split())))
    lines = (b" ".join(line.split()) for line in unescaped(text.decode()).encode().split(b"\n"))
    return b"\n".join(line for line in lines if line).decode()


def page_fields(html: bytes) -> tuple[str, str, str, list[str]]:
    """Text, title, declared language and the addresses of the links of a page."""
    title, page = _TITLE.search(html), _PAGE.search(html)
    links = [link for tag in _ANCHOR.findall(html) if (link := attribute(tag, b"href")) is not None]
    heading = b" ".join(unescaped(title[1].decode()).encode().split()).decode() if title else ""
    language = attribute(page[0], b"lang") if page else None
    return plain_text(html), heading, (language or b"").decode(), [unescaped(link.decode(), True) for link in links]


def with_page_fields(pages: DataFrame) -> DataFrame:
    """The columns before ``payload``, and what was read of it: ``_text``, ``_title``, ``_lang``, ``_links``.

    In Python, in Arrow batches: each page goes there once, and the steps take a fifth of the time of as many
    columns of regular expressions (README).
    """
    kept = [c for c in pages.columns if c != "payload"]

    def read(batches):
        for batch in batches:
            found = [page_fields(html.as_buffer().to_pybytes()) for html in batch.column(len(kept))]
            text, title, lang, links = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(text, pa.string()), pa.array(title, pa.string()), pa.array(lang, pa.string()), pa.array(links, pa.list_(pa.string()))],
                [*kept, "_text", "_title", "_lang", "_links"])

    schema = T.StructType([*[pages.schema[c] for c in kept], *[T.StructField(c, T.StringType()) for c in ("_text", "_title", "_lang")],
                           T.StructField("_links", T.ArrayType(T.StringType()))])
    return pages.select(*kept, "payload").mapInArrow(read, schema)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Captured pages (``page_id``, ``url``, ``html``) as response records.

    The table has no captured headers or times: every record gets ``date`` and the headers of an
    HTML page. Null addresses and pages count as empty.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                       F.octet_length(html).cast("string"), F.lit("\r\n"))
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html.cast("binary"))).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("headers"), html.alias("payload"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: its metadata and its conversion to plain text.

    ``records``: ``record_id``, ``target_uri``, ``warc_date``, ``headers`` (as captured) and ``payload``;
    ``page_id`` and other columns are kept or not read. Both derivatives name the response in
    ``refers_to`` and each other in ``concurrent_to``, keep the response's address, date, headers and
    payload digest, and carry their own block with length (bytes) and digest. The metadata block is
    lines ``name: value``: title, language, numbers of links and characters, and a line for each link.

    Map-only: no row is shuffled. Identifiers follow from the response's, so a rerun gives the same
    records; rows that repeat a response give its derivatives again. Null fields count as empty
    and give empty blocks' digests; an empty table gives no rows.
    """
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "target_uri", "warc_date", "headers", "payload")}
    base = records.select(F.col("page_id"), *[c.alias(n) for n, c in named.items()])
    base = with_page_fields(base.withColumn("_digest", labelled_digest(F.col("payload"))))
    lines = F.concat_ws(
        "", F.lit("title: "), F.col("_title"), F.lit("\r\nlanguage: "), F.col("_lang"), F.lit("\r\nlinks: "),
        F.size("_links").cast("string"), F.lit("\r\ncharacters: "), F.char_length("_text").cast("string"), F.lit("\r\n"),
        F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))
    ids = {kind: record_id(F.lit(kind), F.col("record_id")) for kind in ("metadata", "conversion")}

    def derived(kind: str, other: str, content_type: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), ids[kind].alias("record_id"), ids[other].alias("concurrent_to"),
                        F.lit(content_type).alias("content_type"), block.alias("block"))

    base = evaluated_once(base, {"_lines": lines})
    both = F.array(derived("metadata", "conversion", "application/warc-fields", F.col("_lines")),
                   derived("conversion", "metadata", "text/plain; charset=UTF-8", F.col("_text")))
    return base.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
                       F.col("headers").alias("source_headers"), F.col("_digest").alias("source_digest"),
                       F.explode(both).alias("d")).select(
        "page_id", "d.record_type", "d.record_id", "refers_to", "d.concurrent_to", "target_uri", "warc_date", "d.content_type",
        F.octet_length("d.block").cast("long").alias("content_length"), labelled_digest(F.col("d.block")).alias("block_digest"),
        "source_digest", "source_headers", "d.block")


def record_text(records: DataFrame) -> DataFrame:
    """Derivatives as WARC/1.1 records, one string each in ``record``."""
    fields = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
              ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
              ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Digest", "source_digest"),
              ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    source = F.transform(F.filter(F.split("source_headers", "\r\n"), lambda x: x != ""),
                         lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit("\r\n")))
    head = [x for name, column in fields for x in (F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))]
    return records.select("page_id", "record_type", F.concat(
        F.lit("WARC/1.1\r\n"), *head, F.array_join(source, ""), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))
