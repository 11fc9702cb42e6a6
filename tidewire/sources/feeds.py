"""Feed bodies to items (title, text, url, domain, published_ts): RSS, Atom, listings in JSON, and push frames.

Each parser takes a frame of bodies with a ``body`` column and returns one row
for each item, with the other columns of its body.  A body that doesn't parse
gives no items.
"""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import domain_of, plain_html, strip
from tidewire.functions.time import parse_timestamp

ITEM = ["title", "text", "url", "domain", "published_ts"]
# Name spaces of feeds, the keys that push frames use, and what an encyclopedia edit must mention.
ATOM, CONTENT, DC = "{http://www.w3.org/2005/Atom}", "{http://purl.org/rss/1.0/modules/content/}", "{http://purl.org/dc/elements/1.1/}"
TITLE_KEYS = ["title", "headline", "summary", "text", "body", "message"]
URL_KEYS = ["url", "link", "href", "uri", "permalink", "source_url"]
BODY_KEYS = ["body", "text", "summary", "description", "content"]
ENVELOPES = ["data", "payload", "message"]
#: Items that a task of ``parse_xml_feed`` holds before it passes them on.
ITEMS_A_BATCH = 1000


def _first(*tries: Column) -> Column:
    """The first that isn't null or blank, stripped."""
    return F.get(F.filter(F.transform(F.array(*tries), strip), lambda x: x != ""), 0)


def _unescaped(x: Column) -> Column:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _items(rows: DataFrame, bodies: DataFrame) -> DataFrame:
    kept = [c for c in bodies.columns if c != "body" and c not in ITEM]
    return rows.select(*kept, *ITEM)


def parse_articles(bodies: DataFrame, fallback: str = "") -> DataFrame:
    """``{"articles": [{url, title, seendate, domain}]}``: no text, so the title is both; a missing title is the URL."""
    schema = "articles array<struct<url:string,title:string,seendate:string,domain:string>>"
    a = bodies.withColumn("a", F.explode(F.from_json("body", schema)["articles"]))
    url = strip(F.col("a.url"))
    title = F.coalesce(_first(_unescaped(F.col("a.title"))), url)
    rows = a.filter(F.coalesce(url, F.lit("")) != "").withColumns({"title": title, "text": title, "url": url, "domain": F.coalesce(_first(F.lower("a.domain")), domain_of(url, F.lit(fallback))), "published_ts": parse_timestamp(F.col("a.seendate"))})
    return _items(rows, bodies)


def parse_listing(bodies: DataFrame, base: str = "https://www.reddit.com", domain: str = "reddit.com") -> DataFrame:
    """``{"data": {"children": [{"data": {title, permalink, selftext, created_utc}}]}}``; posts without text repeat their title."""
    schema = "data struct<children:array<struct<data:struct<title:string,permalink:string,selftext:string,created_utc:double>>>>"
    c = bodies.withColumn("c", F.explode(F.from_json("body", schema)["data"]["children"])).withColumn("c", F.col("c.data"))
    title, link = _first(F.col("c.title")), _first(F.col("c.permalink"))
    rows = c.filter(title.isNotNull() & link.isNotNull()).withColumns({"title": title, "text": F.coalesce(_first(F.col("c.selftext")), title), "url": F.concat(F.lit(base), link), "domain": F.lit(domain), "published_ts": F.timestamp_seconds("c.created_utc")})
    return _items(rows, bodies)


def parse_hits(bodies: DataFrame, item_url: str = "https://news.ycombinator.com/item?id=", item_domain: str = "news.ycombinator.com") -> DataFrame:
    """``{"hits": [{title, story_title, url, story_url, objectID, created_at_i, created_at}]}``; without a URL the discussion page is linked."""
    schema = "hits array<struct<title:string,story_title:string,url:string,story_url:string,objectID:string,created_at_i:bigint,created_at:string>>"
    h = bodies.withColumn("h", F.explode(F.from_json("body", schema)["hits"]))
    title, url, own = _first(F.col("h.title"), F.col("h.story_title")), _first(F.col("h.url"), F.col("h.story_url")), _first(F.col("h.objectID"))
    link = F.coalesce(url, F.concat(F.lit(item_url), own))
    when = F.coalesce(F.timestamp_seconds("h.created_at_i"), parse_timestamp(F.col("h.created_at")))
    rows = h.filter(title.isNotNull() & link.isNotNull()).withColumns({"title": title, "text": title, "url": link, "domain": F.coalesce(domain_of(url), F.lit(item_domain)), "published_ts": when})
    return _items(rows, bodies)


def parse_push(bodies: DataFrame, fallback: str = "ws.local") -> DataFrame:
    """One JSON frame: an envelope is opened, title, link and body are the first keys that hold text; a missing link is made from the title."""
    fields = sorted({*TITLE_KEYS, *URL_KEYS, *BODY_KEYS, *ENVELOPES})
    top = F.from_json("body", T.StructType([T.StructField(k, T.StringType()) for k in fields]))
    rows = bodies.withColumn("f", top).filter(F.col("body").startswith("{") & F.col("f").isNotNull())
    inner = F.lit(None).cast("string")
    for k in reversed(ENVELOPES):
        holds = F.coalesce(*(F.get_json_object(F.col(f"f.{k}"), f"$.{x}") for x in (*TITLE_KEYS, *URL_KEYS))).isNotNull()
        inner = F.when(F.col(f"f.{k}").startswith("{") & holds, F.col(f"f.{k}")).otherwise(inner)
    rows = rows.withColumn("f", F.when(inner.isNotNull(), F.from_json(inner, T.StructType([T.StructField(k, T.StringType()) for k in fields]))).otherwise(F.col("f")))
    probe = lambda keys: _first(*(F.when(~F.col(f"f.{k}").startswith("{"), F.col(f"f.{k}")) for k in keys))
    # Behind a generator these are computed once: no filter on what follows from them is pushed below it.
    plain = lambda keys: plain_html(F.coalesce(probe(keys), F.lit("")))
    rows = rows.withColumn("_x", F.explode(F.array(F.struct(plain(BODY_KEYS).alias("body"), plain(TITLE_KEYS).alias("title"), probe(URL_KEYS).alias("url")))))
    rows = rows.withColumns({"_body": F.col("_x.body"), "_url": F.col("_x.url"), "_head": _first(F.col("_x.title"), F.col("_x.body"))}).filter("_head is not null")
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower("_head"), r"[^\p{L}\p{N}]", "-"), 1, 80), "^-+|-+$", "")
    rows = rows.withColumn("_slug", slug)
    rows = rows.withColumn("_link", F.coalesce("_url", F.concat(F.lit(f"https://{fallback}/ws/"), F.when(F.col("_slug") == "", "item").otherwise(F.col("_slug")))))
    rows = rows.withColumns({"title": F.col("_head"), "text": F.coalesce(_first(F.col("_body")), F.col("_head")), "url": F.col("_link"), "domain": domain_of(F.col("_link"), F.lit(fallback)), "published_ts": F.lit(None).cast("timestamp")})
    return _items(rows, bodies)


def parse_edits(bodies: DataFrame, keywords: list[str]) -> DataFrame:
    """Encyclopedia edits ``{title, wiki, meta: {uri, dt}}``: English ones whose title holds a keyword."""
    e = F.from_json("body", "title string, wiki string, meta struct<uri:string,dt:string>")
    rows = bodies.withColumn("e", e).filter("e.wiki = 'enwiki'")
    name = _first(F.col("e.title"))
    wanted = F.lit(False)
    for k in keywords:
        wanted = wanted | F.contains(F.lower(name), F.lit(k.lower()))
    link = F.coalesce(_first(F.col("e.meta.uri")), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(name, F.lit(" "), F.lit("_"))))
    title = F.concat(F.lit("Wikipedia edit: "), name)
    rows = rows.filter(name.isNotNull() & wanted).withColumns({"title": title, "text": title, "url": link, "domain": domain_of(link, F.lit("en.wikipedia.org")), "published_ts": parse_timestamp(F.col("e.meta.dt"))})
    return _items(rows, bodies)


def _plain(text: str | None) -> str:
    out, depth = [], 0
    for part in (text or "").split("<"):
        head, closed, tail = part.partition(">") if depth else ("", "", part)
        out.append(tail if closed or not depth else "<" + head)
        depth = 1
    return " ".join(html.unescape(" ".join(out)).split())


def _feed_items(body: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """(title, text, link, source URL, date text) of the items and entries of a feed; nothing from broken XML."""
    try:
        root = ET.fromstring(body.encode())
    except (ET.ParseError, ValueError):
        return
    for node in root.iter():
        find = lambda tag, node=node: (node.findtext(tag) or "").strip()
        if node.tag == "item":
            source = node.find("source")
            name = (source.text or "").strip() if source is not None else ""
            title = find("title")
            text = _plain(find(CONTENT + "encoded") or find("description")) or title
            if name and title.endswith(f" - {name}"):
                title = title[: -len(name) - 3].rstrip()
            title = title or text[:120].rstrip()
            yield title, text, find("link"), source.get("url", "") if source is not None else "", find("pubDate") or find(DC + "date") or None
        elif node.tag == ATOM + "entry":
            links = node.findall(ATOM + "link")
            best = next((x for x in links if x.get("rel") in (None, "", "alternate")), links[0] if links else None)
            link = (best.get("href") or best.text or "").strip() if best is not None else ""
            title = find(ATOM + "title")
            yield title, _plain(find(ATOM + "content") or find(ATOM + "summary")) or title, link, "", find(ATOM + "updated") or find(ATOM + "published") or None


def parse_xml_feed(bodies: DataFrame, fallback: str = "") -> DataFrame:
    """RSS items and Atom entries; an aggregator's items take the domain of their source."""
    kept = [c for c in bodies.columns if c != "body" and c not in ITEM]
    raw = ["title", "text", "link", "source_url", "date"]
    schema = T.StructType([*(bodies.schema[c] for c in kept), *(T.StructField(c, T.StringType()) for c in raw)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch holds thousands of bodies, and a body many items: neither is held whole as Python's own strings.
            taken, found = [], []

            def out(batch=batch) -> pa.RecordBatch:
                columns = [batch.column(k).take(pa.array(taken, pa.int64())) for k in range(len(kept))]
                made = pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in found], pa.string()) for k in range(5))], names=[*kept, *raw])
                taken.clear()
                found.clear()
                return made

            for i, body in enumerate(batch.column(len(kept))):
                for item in _feed_items(body.as_py() or ""):
                    if item[0] and item[1] and item[2]:
                        taken.append(i)
                        found.append(item)
                        if len(found) >= ITEMS_A_BATCH:
                            yield out()
            if found:
                yield out()

    rows = bodies.select(*kept, F.col("body").cast("string")).mapInArrow(run, schema)
    own = domain_of(F.col("link"), F.lit(fallback))
    source = domain_of(F.col("source_url"))
    return rows.withColumns({"url": F.col("link"), "domain": F.when((own == "news.google.com") & source.isNotNull(), source).otherwise(own), "published_ts": parse_timestamp(F.col("date"))}).select(*kept, *ITEM)


def parse_mirror_feed(bodies: DataFrame, host: str = "x.com") -> DataFrame:
    """A mirror's RSS with links moved to the original host, without fragments."""
    items = parse_xml_feed(bodies, host)
    url = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"^(https?)://[^/]+", f"https://{host}")
    return items.withColumn("url", url).withColumn("domain", F.lit(host))


#: Parsers by name; a deployment adds its own.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rss": parse_xml_feed, "twitter": parse_mirror_feed, "gdelt": parse_articles, "gdelt_gkg": parse_articles, "reddit": parse_listing, "hn": parse_hits, "push": parse_push,
}


def parse(bodies: DataFrame, parser: str) -> DataFrame:
    return PARSERS[parser](bodies)
