"""Payloads of four job boards as title, place, company and text.

Shapes: A {title, content, company_name, location, offices}, B {text, description(Plain), additional(Plain), categories, lists},
C {organizationName, jobs[...]} or {data.jobPosting}, D {name, company, location, jobAd.sections}. HTML becomes text by the K5 pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.html_text import html_text

_SECTION = "struct<title:string,text:string>"
SCHEMAS = {
    "board_a": "title string, content string, company_name string, location struct<name:string>, offices array<struct<name:string>>",
    "board_b": "text string, description string, descriptionPlain string, additional string, additionalPlain string, categories struct<location:string,allLocations:array<string>>, lists array<struct<text:string,content:string>>",
    "board_c": "organizationName string, jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,isRemote:boolean,descriptionHtml:string,descriptionPlain:string>>,"
    " data struct<jobPosting:struct<title:string,locationName:string,descriptionHtml:string,descriptionPlainText:string,organization:struct<name:string>>>",
    "board_d": f"name string, company struct<name:string>, location struct<city:string,region:string,country:string,remote:boolean>, jobAd struct<sections:struct<companyDescription:{_SECTION},jobDescription:{_SECTION},qualifications:{_SECTION},additionalInformation:{_SECTION}>>",
}


def _filled(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))


def parse_payloads(df: DataFrame, board: str, id_col: str = "id", payload_col: str = "payload", job_col: str | None = None) -> DataFrame:
    """id, title, place, company, text and ok (the payload could be read and has a text). Board C picks the job whose id is in ``job_col``."""
    p = df.withColumn("p", F.from_json(payload_col, SCHEMAS[board]))
    blank = F.lit(None).cast("string")
    if board == "board_a":
        offices = F.array_join(F.transform("p.offices", lambda o: o["name"]), "; ")
        shown = p.select(id_col, F.col("p.title").alias("title"), F.coalesce(F.nullif(F.col("p.location.name"), F.lit("")), F.nullif(offices, F.lit(""))).alias("place"), F.col("p.company_name").alias("company"), F.array(F.col("p.content")).alias("html"), blank.alias("plain"))
    elif board == "board_b":
        lists = F.coalesce(F.transform("p.lists", lambda x: F.concat_ws("", F.lit("<h3>"), x["text"], F.lit("</h3><ul>"), x["content"], F.lit("</ul>"))), F.array())
        html = F.concat(F.array("p.description"), lists, F.array("p.additional"))
        every = F.array_join(F.coalesce("p.categories.allLocations", F.array()), "; ")
        shown = p.select(
            id_col, F.col("p.text").alias("title"), F.coalesce(F.nullif(every, F.lit("")), F.col("p.categories.location")).alias("place"), blank.alias("company"), html.alias("html"),
            F.when(F.size(lists) == 0, F.nullif(F.array_join(_filled(F.col("p.descriptionPlain"), F.col("p.additionalPlain")), "\n\n"), F.lit(""))).alias("plain"),
        )
    elif board == "board_c":
        job = F.try_element_at(F.filter("p.jobs", lambda j: j["id"] == F.col(job_col)), F.lit(1)) if job_col else F.try_element_at("p.jobs", F.lit(1))
        q = p.withColumn("j", job).withColumn("d", F.col("p.data.jobPosting"))
        others = F.coalesce(F.transform("j.secondaryLocations", lambda x: x["location"]), F.array())
        place = F.array_join(F.concat(_filled(F.col("j.location")), others, F.when(F.col("j.isRemote"), F.array(F.lit("Remote"))).otherwise(F.array())), "; ")
        shown = q.select(
            id_col, F.coalesce("j.title", "d.title").alias("title"), F.coalesce(F.nullif(place, F.lit("")), F.col("d.locationName")).alias("place"), F.coalesce("p.organizationName", "d.organization.name").alias("company"),
            F.array(F.coalesce("j.descriptionHtml", "d.descriptionHtml")).alias("html"), F.coalesce("j.descriptionPlain", "d.descriptionPlainText").alias("plain"),
        )
    else:
        s = "p.jobAd.sections"
        parts = [F.when(F.coalesce(F.trim(f"{s}.{n}.text"), F.lit("")) != "", F.concat_ws("", F.lit("<h3>"), F.col(f"{s}.{n}.title"), F.lit("</h3>"), F.col(f"{s}.{n}.text"))) for n in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]
        place = F.array_join(F.concat(_filled(*(F.col(f"p.location.{x}") for x in ("city", "region", "country"))), F.when(F.col("p.location.remote"), F.array(F.lit("Remote"))).otherwise(F.array())), ", ")
        shown = p.select(id_col, F.col("p.name").alias("title"), F.nullif(place, F.lit("")).alias("place"), F.col("p.company.name").alias("company"), F.array(*parts).alias("html"), blank.alias("plain"))
    joined = shown.withColumn("html", F.array_join(F.array_compact("html"), "\n"))
    text = html_text(joined, "html", "from_html")
    return text.withColumn("text", F.coalesce(F.nullif(F.trim("plain"), F.lit("")), "from_html")).select(id_col, F.trim("title").alias("title"), "place", "company", "text", (F.coalesce(F.trim("text"), F.lit("")) != "").alias("ok"))
