"""Source records to articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge.functions import regex as rx
from specforge.functions import text

# --- fixed values: field aliases in order of preference ---------------------
ID_ALIASES = ["ID", "Id", "id", "Article ID", "ArticleID"]
TITLE_ALIASES = ["Title", "title", "Headline", "Name"]
CONTENT_ALIASES = ["Content", "content", "Text", "Article", "Body"]
DATE_ALIASES = ["Created", "Date", "Published", "Time created", "date"]
LINK_ALIASES = ["Article link", "URL", "Link", "Source", "url"]
NESTED_URL_ALIASES = ["URL", "Link", "Source", "Source URL", "FeedUrl", "feed_url"]


def pick(fields: Column, aliases: Sequence[str]) -> Column:
    """First non-null of an ordered alias list, exact names."""
    return F.coalesce(*[F.try_element_at(fields, F.lit(a)) for a in aliases])


def pick_ci(fields: Column, aliases: Sequence[str]) -> Column:
    """Alias match by trimmed, lower-cased key; the first present key counts."""
    key = lambda k: text.trim(F.lower(k))
    entries = F.map_entries(fields)

    def one(alias):
        hit = F.filter(entries, lambda e: key(e["key"]) == alias.strip().lower())
        return F.get(hit, F.lit(0))["value"]
    return F.coalesce(*[one(a) for a in aliases])


def pick_normalized(fields: Column, aliases: Sequence[str], fallback: Column | None = None) -> Column:
    """Key match without case, blanks, '_' and '-'; first non-empty candidate.

    A JSON array value becomes its items joined by blanks.
    """
    flat = lambda k: F.regexp_replace(F.lower(k), rf"[{rx.BLANK}_\-]", "")
    entries = F.map_entries(fields)

    def value(v):
        items = F.from_json(v, "array<string>")
        joined = F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), " ")
        return F.when(F.startswith(text.trim(v), F.lit("[")), F.nullif(joined, F.lit(""))
                      ).otherwise(v)

    def one(alias):
        want = "".join(ch for ch in alias.lower() if ch not in " \t\n_-")
        hit = F.filter(entries, lambda e: (flat(e["key"]) == want) & ~text.is_blank(e["value"]))
        return value(F.get(hit, F.lit(0))["value"])
    out = [one(a) for a in aliases]
    return F.coalesce(*out, fallback) if fallback is not None else F.coalesce(*out)


def map_records(df: DataFrame, fields: str = "fields", source_id: str = "id") -> DataFrame:
    """Records (id, fields map) to articles; rows lacking id, title or content drop."""
    mapped = text.let(F.col(fields), lambda f: F.struct(
        text.to_positive_int(pick(f, ID_ALIASES)).alias("doc_id"),
        text.norm_str(pick(f, TITLE_ALIASES)).alias("title"),
        text.norm_str(pick(f, CONTENT_ALIASES)).alias("content"),
        text.norm_str(pick(f, DATE_ALIASES)).alias("date"),
        text.norm_str(pick(f, LINK_ALIASES)).alias("link")))
    return df.select(F.col(source_id).alias("source_id"), mapped.alias("_m")).select(
        "_m.doc_id", "source_id", "_m.title", "_m.content", "_m.date", "_m.link").filter("doc_id is not null and title is not null and content is not null")


def record_outcomes(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Records with the reason they would be dropped for, or `ok`."""
    f = F.col(fields)
    return df.withColumn("outcome", F.when(
        text.to_positive_int(pick(f, ID_ALIASES)).isNull(), "no_id")
        .when(text.norm_str(pick(f, TITLE_ALIASES)).isNull(), "no_title")
        .when(text.norm_str(pick(f, CONTENT_ALIASES)).isNull(), "no_content").otherwise("ok"))


def scan_articles(df: DataFrame, doc_id: str, title: str, content: str, published: str,
                  limit: int | None = None) -> DataFrame:
    """Article table: content present, newest first, optional top-k."""
    out = (df.select(doc_id, title, content, published).filter(F.col(content).isNotNull())
           .orderBy(F.col(published).desc(), F.col(doc_id)))
    if limit:
        out = out.limit(limit)
    n = text.to_positive_int(F.col(doc_id))
    return out.select(
        n.alias("doc_id"), n.cast("string").alias("source_id"),
        text.norm_str(F.col(title)).alias("title"), text.norm_str(F.col(content)).alias("content"),
        text.norm_str(F.col(published)).alias("date"), F.lit(None).cast("string").alias("link"),
    ).filter("doc_id is not null and title is not null and content is not null")


def nested_url(value: Column) -> Column:
    """A URL out of a JSON text: string, array of strings or objects, object."""
    v = F.try_parse_json(value)
    get = lambda path: F.try_variant_get(v, path, "string")
    shape = F.schema_of_variant(v)
    found = (F.when(F.startswith(shape, F.lit("ARRAY")),
                    F.coalesce(get("$[0].url"), F.when(~F.startswith(
                        get("$[0]"), F.lit("{")), get("$[0]"))))
             .when(F.startswith(shape, F.lit("OBJECT")), get("$.url"))
             .when(shape == "STRING", get("$")))
    plain = F.when(v.isNull() & ~F.startswith(text.trim(value), F.lit("{"))
                   & ~F.startswith(text.trim(value), F.lit("[")), value)
    return text.norm_str(F.coalesce(found, plain))


def date_chain(*candidates: Column, now: Column) -> Column:
    """First parsable stamp of a chain, else the given time."""
    return F.coalesce(*[c.cast("string").try_cast("timestamp") for c in candidates],
                      now.cast("timestamp"))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def only_new(df: DataFrame, status: str, value: str = "New") -> DataFrame:
    return df.filter(F.col(status) == value)


def mark_synced(df: DataFrame, synced_ids: DataFrame, key: str, status: str,
                value: str = "Synced") -> DataFrame:
    """Next version of the source: the status of synced rows rewritten."""
    flag = synced_ids.select(key).distinct().withColumn("_s", F.lit(True))
    return df.join(flag, key, "left").withColumn(
        status, F.when(F.col("_s"), F.lit(value)).otherwise(F.col(status))).drop("_s")
