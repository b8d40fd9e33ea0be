"""Parsers of collected pages: feeds, papers, posts, videos, books and laws. Fetching is left to the landing job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions import text as tx

MIN_CHARS = {"news": 100, "encyclopedia": 200, "books": 1000, "academic": 100, "social_media": 50, "videos": 100, "legal": 50}
BOOK_CHARS, LAW_CHARS = 50_000, 100_000
GUTENBERG_START = r"(?s)^.*?\*\*\* ?START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\n"
GUTENBERG_END = r"(?s)\*\*\* ?END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*$"
ARTICLE = r"(?s)(Art\.?\s*\d+[ºo°]?.*?)(?=\bArt\.?\s*\d+[ºo°]?|\z)"


RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"
ATOM = "entry array<struct<title: string, link: array<struct<_href: string>>, updated: string, published: string, summary: string, content: string>>"


def feed_items(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row an RSS item or Atom entry: title, link, published, text (markup removed), from 100 characters on. Feeds that
    are null or no XML have no items; an item's missing parts are null."""
    kept = [c for c in df.columns if c != xml]
    rss = F.transform(F.from_xml(xml, RSS)["channel"]["item"], lambda i: F.struct(i["title"].alias("title"), i["link"].alias("link"), i["pubDate"].alias("published"), i["description"].alias("text")))
    atom = F.transform(
        F.from_xml(xml, ATOM)["entry"],
        lambda e: F.struct(e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), F.coalesce(e["published"], e["updated"]).alias("published"), F.coalesce(e["content"], e["summary"]).alias("text")),
    )
    rows = df.select(*kept, F.explode(F.coalesce(rss, atom)).alias("i")).select(*kept, "i.*")
    cleaned = rows.withColumn("text", F.trim(tx.strip_html(F.col("text")))).withColumn("published", dates.parse_date(F.col("published")))
    return cleaned.where(F.length("text") >= MIN_CHARS["news"])


def posts(df: DataFrame, json: str = "json", least_score: int = 10) -> DataFrame:
    """Posts of a listing: not removed, long enough, scored; title and body joined."""
    schema = "struct<data:struct<children:array<struct<data:struct<id:string,title:string,selftext:string,score:int,created_utc:double,author:string>>>>>"
    rows = df.select(F.explode(F.from_json(json, schema)["data"]["children"]).alias("c")).select("c.data.*")
    kept = rows.where((~F.col("selftext").isin("[removed]", "[deleted]")) & (F.length("selftext") >= MIN_CHARS["social_media"]) & (F.col("score") >= least_score))
    return kept.select("id", "title", F.concat_ws("\n\n", "title", "selftext").alias("text"), "score", "author", F.timestamp_seconds("created_utc").alias("published"))


def videos(df: DataFrame, json: str = "json") -> DataFrame:
    schema = "struct<items:array<struct<id:string,snippet:struct<title:string,description:string,publishedAt:string>,statistics:struct<viewCount:string,likeCount:string>,contentDetails:struct<duration:string>>>>"
    rows = df.select(F.explode(F.from_json(json, schema)["items"]).alias("v")).select("v.*")
    return rows.where(F.length("snippet.description") >= MIN_CHARS["videos"]).select(
        "id", "snippet.title", F.col("snippet.description").alias("text"), dates.parse_date(F.col("snippet.publishedAt")).alias("published"), F.col("statistics.viewCount").try_cast("long").alias("views"), dates.iso_duration_seconds(F.col("contentDetails.duration")).alias("seconds")
    )


def papers(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries of an Atom feed of papers; formulas removed, at most three authors named."""
    entries = F.arrays_zip(F.xpath(xml, F.lit("/feed/entry/id/text()")).alias("id"), F.xpath(xml, F.lit("/feed/entry/title/text()")).alias("title"), F.xpath(xml, F.lit("/feed/entry/summary/text()")).alias("text"))
    rows = df.select(F.explode(entries).alias("e")).select("e.*")
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"\$[^$]+\$", ""), r"\s+", " "))
    return rows.withColumn("text", plain).where(F.length("text") >= MIN_CHARS["academic"])


def news_articles(df: DataFrame, json: str = "json") -> DataFrame:
    """Articles of a news service's answer: content, or else the description; those with neither are left out."""
    schema = "struct<articles:array<struct<source:struct<name:string>,author:string,title:string,description:string,url:string,publishedAt:string,content:string>>>"
    rows = df.select(F.explode(F.from_json(json, schema)["articles"]).alias("a")).select("a.*")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    text = F.coalesce(some("content"), some("description"))
    return rows.withColumn("text", text).where("text is not null").select(
        F.left(F.md5(F.concat_ws(":", "url", "title")), F.lit(16)).alias("id"), F.col("source.name").alias("publisher"), "title", "url", "author", "text", dates.parse_date(F.col("publishedAt")).alias("published")
    )


def wiki_text(text: Column) -> Column:
    """Page text without section headers, reference marks and runs of blank lines."""
    out = F.regexp_replace(text, r"={2,}[^=]+={2,}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\[\d+\]", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def wiki_pages(df: DataFrame, json: str = "json") -> DataFrame:
    """Pages of an encyclopedia's answer, cleaned, from 200 characters on; one row a page id (the first by title)."""
    schema = "struct<query:struct<pages:map<string,struct<pageid:long,title:string,extract:string>>>>"
    rows = df.select(F.explode(F.map_values(F.from_json(json, schema)["query"]["pages"])).alias("p")).select("p.*")
    cleaned = rows.select("pageid", "title", wiki_text(F.col("extract")).alias("text")).where(F.length("text") >= MIN_CHARS["encyclopedia"])
    first = cleaned.groupBy("pageid").agg(F.min(F.struct("title", "text")).alias("p"))
    return first.select(F.left(F.md5(F.concat_ws(":", F.lit("wikipedia"), F.col("pageid").cast("string"), "p.title")), F.lit(16)).alias("id"), "pageid", "p.title", "p.text")


def first_authors(authors: Column) -> Column:
    return F.array_join(F.slice(authors, 1, 3), ", ")


def book_text(text: Column) -> Column:
    """Without the licence around it, at most BOOK_CHARS characters and "..."."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, GUTENBERG_START, ""), GUTENBERG_END, ""))
    return F.when(F.length(bare) > BOOK_CHARS, F.concat(F.left(bare, F.lit(BOOK_CHARS)), F.lit("..."))).otherwise(bare)


def law_articles(df: DataFrame, text: str = "text") -> DataFrame:
    """One row an article of a law, numbered, longer than 50 characters; laws without articles are one row."""
    found = F.filter(F.regexp_extract_all(text, F.lit(ARTICLE), F.lit(1)), lambda a: F.length(F.trim(a)) > MIN_CHARS["legal"])
    whole = F.array(F.left(F.col(text), F.lit(LAW_CHARS)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("number", "article")).withColumn("number", F.col("number") + 1).withColumn("article", F.trim("article"))
