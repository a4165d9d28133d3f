"""Landed files: JSON envelopes, search items and directories of report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.functions.report_rows import file_date, report_type
from newsignal.functions.rules import is_uuid, normal_id
from newsignal.functions.text import clean_report_text, let, strip

TEXT_KEYS = ["text", "value", "content", "body", "summary", "html"]
HEADLINE_PATHS = ["data.headline", "data.title", "headline", "title", "package.title"]
DATE_PATHS = ["data.updatedDate", "data.publishedDate", "updatedDate", "publishedDate",
              "properties.coverDate", "properties.updatedDate"]
URL_PATHS = ["data.documentUrl", "data.downloadUrl", "documentUrl", "downloadUrl"]
BODY_PATHS = ["data.body", "data.bodyText", "data.content", "data.summary", "body", "bodyText", "content",
              "summary"]


def flat_text(value: Column) -> Column:
    """JSON value to text: lists joined by newlines, objects by their first text-like key."""

    def plain(v: Column) -> Column:
        keys = F.coalesce(*[F.nullif(strip(F.get_json_object(v, f"$.{k}")), F.lit("")) for k in TEXT_KEYS], v)
        return F.when(v.startswith("{"), keys).otherwise(strip(v))

    def flat(v: Column) -> Column:
        parts = F.transform(F.from_json(v, "array<string>"), plain)
        joined = F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
        return F.when(v.startswith("["), strip(joined)).otherwise(plain(v))

    return let(F.coalesce(value, F.lit("")), flat)


def first_path(envelope: Column, paths: list[str]) -> Column:
    """First non-empty value among alternative paths of the envelope."""
    return F.coalesce(*[F.nullif(F.get_json_object(envelope, f"$.{p}"), F.lit("")) for p in paths])


def normalise_envelopes(landed: DataFrame, column: str = "json") -> DataFrame:
    """(id, raw JSON) to article columns; bodies of up to 100 characters count as none."""
    raw = F.col(column)
    envelope = F.coalesce(F.get_json_object(raw, "$.envelope"), raw)
    rows = landed.withColumn("_e", envelope)
    body = let(flat_text(first_path(F.col("_e"), BODY_PATHS)),
               lambda b: F.when(F.length(b) > 100, clean_report_text(b)).otherwise(""))
    return rows.select(
        normal_id(F.col("id")).alias("id"),
        flat_text(first_path(F.col("_e"), HEADLINE_PATHS)).alias("headline"),
        F.substring(F.coalesce(first_path(F.col("_e"), DATE_PATHS), F.lit("")), 1, 19).alias("published"),
        F.coalesce(first_path(F.col("_e"), URL_PATHS), F.nullif(F.get_json_object(raw, "$.documentUrl"),
                                                                F.lit("")), F.lit("")).alias("url"),
        body.alias("body_text"))


def read_documents(spark: SparkSession, path: str, lines: bool = False, glob: str = "*") -> DataFrame:
    """JSON documents of a landing folder: file_name, id, json, document (variant) and ``problem``.

    One document per file, or per line with ``lines``. Every document is accounted for: a blank one, one that does not
    parse, one that is no object and one without an id (its field ``id``; for whole files, else the name of the file)
    have a problem, and a null document unless it is parsed.
    """
    read = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True, pathGlobFilter=glob)
    files = read.select(F.col("value").alias("json"), F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("file_name"))
    parsed = files.withColumn("document", F.try_parse_json("json"))
    own = F.nullif(strip(F.try_variant_get("document", "$.id", "string")), F.lit(""))
    named = F.lit(None).cast("string") if lines else F.regexp_replace("file_name", r"\.[^.]*$", "")
    identity = F.when(F.col("document").isNotNull(), F.coalesce(own, named))
    problem = (F.when(strip(F.col("json")) == "", "empty").when(F.col("document").isNull(), "broken")
               .when(~strip(F.col("json")).startswith("{"), "no object").when(identity.isNull(), "no id"))
    return parsed.select("file_name", identity.alias("id"), "json", "document", problem.alias("problem"))


def quarantine(documents: DataFrame) -> DataFrame:
    """Documents that cannot become articles, as they landed, with the reason."""
    return documents.filter("problem is not null").select("file_name", "problem", "json")


def _first_of(document: Column, *paths: str) -> Column:
    """First non-empty value among paths of a variant, as text (JSON if it is a list or an object)."""
    return F.coalesce(*[F.nullif(F.try_variant_get(document, f"$.{p}", "string"), F.lit("")) for p in paths])


def normalise_documents(documents: DataFrame) -> DataFrame:
    """Readable documents to article columns, as :func:`normalise_envelopes`; data of the envelope, if it is an object,
    stands for the whole envelope."""
    good = documents.filter("problem is null").withColumn(
        "_e", F.coalesce(F.try_variant_get("document", "$.envelope", "variant"), F.col("document")))
    data = F.try_variant_get("_e", "$.data", "variant")
    inner = F.when(F.try_variant_get("_e", "$.data", "string").startswith("{"), data).otherwise(F.col("_e"))
    rows = good.withColumn("_i", inner)
    i, e = F.col("_i"), F.col("_e")
    empty = F.lit("")
    body = let(flat_text(_first_of(i, "body", "bodyText", "content", "summary")),
               lambda b: F.when(F.length(b) > 100, clean_report_text(b)).otherwise(""))
    return rows.select(
        normal_id(F.col("id")).alias("id"),
        flat_text(F.coalesce(_first_of(i, "headline", "title"), _first_of(e, "package.title"))).alias("headline"),
        F.substring(F.coalesce(_first_of(i, "updatedDate", "publishedDate"), _first_of(e, "properties.coverDate", "properties.updatedDate"), empty),
                    1, 19).alias("published"),
        F.coalesce(_first_of(i, "documentUrl", "downloadUrl"), _first_of(F.col("document"), "documentUrl"), empty).alias("url"),
        body.alias("body_text"))


def normalise_items(items: DataFrame, query: str, first, last) -> DataFrame:
    """Search items to article columns: UUID ids only, inside the window, headline never empty."""
    published = F.coalesce(F.nullif("updatedDate", F.lit("")), F.nullif("publishedDate", F.lit("")), F.lit(""))
    day = F.substring(published, 1, 10)
    rows = items.withColumn("_published", published).filter(
        is_uuid(F.col("id")) & ((published == "") | day.between(F.lit(str(first)), F.lit(str(last)))))
    given = F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in ("title", "headline", "noteName")])
    mime = F.coalesce(F.nullif(strip(F.col("mimeType")), F.lit("")), F.lit("package"))
    fallback = strip(F.concat(F.lit(f"{query} ["), mime, F.lit("] "), F.substring("_published", 1, 10)))
    return rows.select(
        normal_id(F.col("id")).alias("id"), F.coalesce(given, fallback).alias("headline"),
        F.substring("_published", 1, 19).alias("published"),
        F.coalesce(F.nullif("documentUrl", F.lit("")), F.nullif("url", F.lit("")), F.lit("")).alias("url"),
        F.lit(query).alias("report_name"))


def read_report_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A directory of report texts, one report per file; files without a date in the name are skipped.

    A report may also be a folder named after it that holds one part file.
    """
    files = (spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
             .select("value", F.col("_metadata.file_path").alias("_path")))
    parts = F.split(F.url_decode("_path"), "/")
    last, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    name = F.when(last.startswith("part-"), F.regexp_replace(folder, "^[^=]*=", "")).otherwise(last)
    return files.select(name.alias("file_name"), F.col("value").alias("body_text")).withColumns({
        "report_date": file_date(F.col("file_name")), "report_type": report_type(F.col("file_name"))}) \
        .filter("report_date is not null")
