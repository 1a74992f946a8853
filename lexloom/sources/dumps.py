"""Dumps of a code library's JSON answers as tables: product lists, jobs, content envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCTS = "array<struct<productName:string,productId:int,publicationId:int,latestUpdatedDate:string>>"
ENVELOPE = "struct<Docs:array<struct<Id:string,Title:string,Content:string,NodeDepth:int,DocOrderId:int,TitleHtml:string,IsAmended:boolean,IsUpdated:boolean>>,PdfUrl:string,ShowToc:boolean>"


def product(codes: Column, pattern: str | None = None) -> Column:
    """The first product of a list whose name matches ``pattern``, or without one the first; null
    when there is none."""
    return F.get(F.filter(codes, lambda c: c["productName"].rlike(pattern)) if pattern else codes, 0)


def choose_products(clients: DataFrame, pattern: str | None = None) -> DataFrame:
    """``(client, product_id, product_name)`` of ``clients (client, body)``, body being the JSON list of
    products; clients without a fitting product, or with another body, give nothing."""
    x = clients.select("client", product(F.from_json("body", PRODUCTS), pattern).alias("p")).where("p is not null")
    return x.select("client", F.col("p.productId").alias("product_id"), F.col("p.productName").alias("product_name"))


def latest_jobs(jobs: DataFrame, order: list[Column]) -> DataFrame:
    """Of ``jobs (product_id, job_id, name, ...)`` the last of each product."""
    return jobs.groupBy("product_id").agg(F.max_by(F.struct("job_id", "name"), F.struct(*order)).alias("j")).select("product_id", "j.*")


def with_placeholder(pages: DataFrame, note: str) -> DataFrame:
    """Pages whose text did not come as an empty page that says so; blank text counts as none."""
    empty = F.lit(f"<html><body><!-- {note} --></body></html>")
    return pages.withColumn("html", F.when(F.trim(F.coalesce("html", F.lit(""))) == "", empty).otherwise(F.col("html")))


def envelope_docs(envelopes: DataFrame) -> DataFrame:
    """Documents of ``envelopes (page, node_ord, node_id, node_heading, body)``, body being the JSON of a
    content envelope, as ``markup.fragments`` takes them. A document that several envelopes of a
    page bring comes once, under the first node; documents without content stay out, and so do
    bodies that are no envelope."""
    docs = envelopes.select("page", "node_ord", "node_id", "node_heading", F.explode(F.from_json("body", ENVELOPE)["Docs"]).alias("x")).where("coalesce(x.Content, '') != ''")
    once = docs.groupBy("page", F.col("x.Id").alias("doc_id")).agg(F.min_by(F.struct("node_ord", "node_id", "node_heading", "x"), F.struct("node_ord", "x.DocOrderId")).alias("d"))
    return once.select("page", "d.node_ord", "d.node_id", "d.node_heading", F.col("d.x.DocOrderId").alias("doc_ord"), "doc_id", F.col("d.x.Title").alias("title"), F.col("d.x.Content").alias("content"))
