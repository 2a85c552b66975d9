"""Board payloads to postings: one column transform for each platform over landed JSON.

Bronze rows are (platform, board, company, body, status); what was never fetched,
failed or has the wrong shape gives no posting.  A transform names the array of
postings in the payload, the schema of its items and the posting's columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import html_text, norm_title, posted_date
from postlake.operators.store import union_all

COLUMNS = ("job_id", "title", "company", "url", "location", "description", "posted_raw", "remote_hint")


@dataclass(frozen=True)
class Board:
    """prefix of job ids; DDL of the payload; the array of items in it; posting columns from an item ``j``."""

    prefix: str
    schema: str
    items: Callable[[Column], Column]
    columns: Callable[[Column], dict[str, Column]]


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _place(*parts: Column) -> Column:
    """Non-empty parts joined by commas."""
    return F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda x: F.trim(x) != ""), ", ")


def _remote(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "remote")


def _unescaped(c: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _names(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x["name"])), lambda x: x != "")), "; ")


BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "gh",
        "jobs array<struct<id:bigint,title:string,absolute_url:string,location:struct<name:string>,updated_at:string,first_published:string,content:string,departments:array<struct<name:string>>,offices:array<struct<name:string>>>>",
        lambda p: p["jobs"],
        lambda j: {
            "id": j["id"].cast("string"), "title": j["title"], "url": j["absolute_url"], "location": F.coalesce(j["location"]["name"], F.lit("Unknown")),
            "description": F.concat_ws("\n", html_text(_unescaped(F.coalesce(j["content"], F.lit("")))), _names(j["departments"]), _names(j["offices"])),
            "posted_raw": F.coalesce(j["first_published"], j["updated_at"]), "remote_hint": F.when(F.exists(F.coalesce(j["offices"], F.array()), lambda o: F.lower(o["name"]).contains("remote")), "office"),
        },
    ),
    "lever": Board(
        "lv",
        "items array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,categories:struct<team:string,location:string,allLocations:array<string>>,descriptionPlain:string,additionalPlain:string>>",
        lambda p: p["items"],
        lambda j: {
            "id": j["id"], "title": j["text"], "url": j["hostedUrl"], "location": F.array_join(F.array_distinct(F.array_compact(F.concat(F.array(j["categories"]["location"]), F.coalesce(j["categories"]["allLocations"], F.array().cast("array<string>"))))), "; "),
            "description": F.concat_ws("\n", j["descriptionPlain"], j["additionalPlain"]), "posted_raw": j["createdAt"].cast("string"), "remote_hint": _remote(F.lower(j["workplaceType"]) == "remote"),
        },
    ),
    "ashby": Board(
        "ashby",
        "jobs array<struct<id:string,title:string,location:string,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,descriptionPlain:string>>, jobPostings array<struct<id:string,title:string,location:string,publishedAt:string,isListed:boolean,isRemote:boolean,workplaceType:string,jobUrl:string,descriptionPlain:string>>",
        lambda p: F.coalesce(p["jobs"], p["jobPostings"]),
        lambda j: {"id": j["id"], "title": j["title"], "url": j["jobUrl"], "location": j["location"], "description": j["descriptionPlain"], "posted_raw": j["publishedAt"], "remote_hint": _remote(F.coalesce(j["isRemote"], F.lit(False)) | F.coalesce(F.lower(j["workplaceType"]) == "remote", F.lit(False)))},
    ),
    "bamboohr": Board(
        "bamboo",
        "result array<struct<id:string,jobOpeningName:string,departmentLabel:string,isRemote:boolean,locationType:string,location:struct<city:string,state:string>>>",
        lambda p: p["result"],
        lambda j: {"id": j["id"], "title": j["jobOpeningName"], "url": _nothing(), "location": _place(j["location"]["city"], j["location"]["state"]), "description": j["departmentLabel"], "posted_raw": _nothing(), "remote_hint": _remote(F.coalesce(j["isRemote"], F.lit(False)) | (F.coalesce(j["locationType"], F.lit("")) == "1"))},
    ),
    "adp": Board(
        "adp",
        "jobRequisitions array<struct<itemID:string,requisitionTitle:string,postDate:string,requisitionLocations:array<struct<nameCode:struct<shortName:string>>>>>",
        lambda p: p["jobRequisitions"],
        lambda j: {"id": j["itemID"], "title": j["requisitionTitle"], "url": _nothing(), "location": F.array_join(F.transform(j["requisitionLocations"], lambda x: x["nameCode"]["shortName"]), "; "), "description": _nothing(), "posted_raw": j["postDate"], "remote_hint": _nothing()},
    ),
    "paylocity": Board(
        "paylocity",
        "Jobs array<struct<JobId:bigint,JobTitle:string,PublishedDate:string,IsRemote:boolean,JobLocation:struct<City:string,State:string>>>",
        lambda p: p["Jobs"],
        lambda j: {"id": j["JobId"].cast("string"), "title": j["JobTitle"], "url": _nothing(), "location": _place(j["JobLocation"]["City"], j["JobLocation"]["State"]), "description": _nothing(), "posted_raw": j["PublishedDate"], "remote_hint": _remote(j["IsRemote"])},
    ),
    "rippling": Board(
        "rippling",
        "items array<struct<uuid:string,name:string,url:string,department:struct<label:string>,workLocation:struct<label:string>>>",
        lambda p: p["items"],
        lambda j: {"id": j["uuid"], "title": j["name"], "url": j["url"], "location": j["workLocation"]["label"], "description": j["department"]["label"], "posted_raw": _nothing(), "remote_hint": _remote(F.lower(j["workLocation"]["label"]).contains("remote"))},
    ),
    "ultipro": Board(
        "ultipro",
        "opportunities array<struct<Id:string,Title:string,PostedDate:string,BriefDescription:string,Locations:array<struct<LocalizedDescription:string>>>>",
        lambda p: p["opportunities"],
        lambda j: {"id": j["Id"], "title": j["Title"], "url": _nothing(), "location": F.array_join(F.transform(j["Locations"], lambda x: x["LocalizedDescription"]), "; "), "description": html_text(F.coalesce(j["BriefDescription"], F.lit(""))), "posted_raw": j["PostedDate"], "remote_hint": _nothing()},
    ),
    "workday": Board(
        "wd",
        "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>>>",
        lambda p: p["jobPostings"],
        lambda j: {"id": F.substring_index(j["externalPath"], "/", -1), "title": j["title"], "url": j["externalPath"], "location": j["locationsText"], "description": j["postedOn"], "posted_raw": j["postedOn"], "remote_hint": _remote(F.lower(j["locationsText"]).contains("remote"))},
    ),
    "smartrecruiters": Board(
        "sr",
        "content array<struct<id:string,name:string,releasedDate:string,location:struct<city:string,region:string,country:string,remote:boolean>>>",
        lambda p: p["content"],
        lambda j: {"id": j["id"], "title": j["name"], "url": _nothing(), "location": _place(j["location"]["city"], j["location"]["region"], j["location"]["country"]), "description": _nothing(), "posted_raw": j["releasedDate"], "remote_hint": _remote(j["location"]["remote"])},
    ),
    "wpjson": Board(
        "wpjson",
        "items array<struct<id:bigint,link:string,date:string,title:struct<rendered:string>,content:struct<rendered:string>>>",
        lambda p: p["items"],
        lambda j: {"id": j["id"].cast("string"), "title": html_text(j["title"]["rendered"]), "url": j["link"], "location": _nothing(), "description": html_text(j["content"]["rendered"]), "posted_raw": j["date"], "remote_hint": _nothing()},
    ),
    "remoteok": Board(
        "remoteok",
        "items array<struct<id:string,position:string,company:string,url:string,location:string,description:string,date:string,tags:array<string>>>",
        lambda p: F.filter(p["items"], lambda x: x["id"].isNotNull()),
        lambda j: {"id": j["id"], "title": j["position"], "company": j["company"], "url": j["url"], "location": F.coalesce(F.nullif(j["location"], F.lit("")), F.lit("Remote")), "description": F.concat_ws("\n", html_text(F.coalesce(j["description"], F.lit(""))), F.array_join(j["tags"], " ")), "posted_raw": j["date"], "remote_hint": F.lit("remote board")},
    ),
    "remotive": Board(
        "remotive",
        "jobs array<struct<id:bigint,title:string,company_name:string,url:string,candidate_required_location:string,description:string,publication_date:string,category:string,tags:array<string>>>",
        lambda p: p["jobs"],
        lambda j: {"id": j["id"].cast("string"), "title": j["title"], "company": j["company_name"], "url": j["url"], "location": j["candidate_required_location"], "description": F.concat_ws("\n", html_text(F.coalesce(j["description"], F.lit(""))), j["category"], F.array_join(j["tags"], " ")), "posted_raw": j["publication_date"], "remote_hint": F.lit("remote board")},
    ),
    "discourse": Board(
        "discourse",
        "topic_list struct<topics:array<struct<id:bigint,title:string,slug:string,excerpt:string,created_at:string,posts_count:int,reply_count:int>>>",
        lambda p: F.filter(p["topic_list"]["topics"], lambda t: ~((t["posts_count"] == 1) & (t["reply_count"] == 0))),
        lambda j: {"id": j["id"].cast("string"), "title": j["title"], "url": F.concat(F.lit("/t/"), j["slug"]), "location": _nothing(), "description": j["excerpt"], "posted_raw": j["created_at"], "remote_hint": _nothing()},
    ),
}


def _payload(board: Board) -> Column:
    """The body by the board's schema; a bare array is read as its ``items``."""
    body = F.trim("body")
    wrapped = F.when(body.startswith("["), F.concat(F.lit('{"items":'), body, F.lit("}"))).otherwise(body)
    return F.from_json(wrapped, board.schema)


def parse(bronze: DataFrame, platform: str) -> DataFrame:
    """Postings of one platform's landed payloads."""
    board = BOARDS[platform]
    rows = bronze.where((F.col("platform") == platform) & (F.col("status") == 200)).withColumn("p", _payload(board))
    items = rows.select("board", F.col("company").alias("employer"), F.explode(board.items(F.col("p"))).alias("j"))
    found = board.columns(F.col("j"))
    found["job_id"] = F.concat_ws("_", F.lit(board.prefix), "board", found.pop("id"))
    found.setdefault("company", F.col("employer"))
    return items.select(F.lit(platform).alias("platform"), *[found[c].alias(c) for c in COLUMNS]).where(F.coalesce("title", F.lit("")) != "")


def parse_all(bronze: DataFrame, today: Column, local: str | None = None) -> DataFrame:
    """Postings of all platforms, with posted_at; with ``local``, those of matching locations."""
    rows = union_all([parse(bronze, platform) for platform in BOARDS]).withColumn("posted_at", posted_date("posted_raw", today))
    return rows if local is None else rows.where(F.lower(F.coalesce("location", F.lit(""))).rlike(local))


def hydrated(postings: DataFrame, details: DataFrame) -> DataFrame:
    """Fill missing descriptions from detail pages (job_id, description), then by title within the company's board.

    The second step needs company_id and title on both sides.  Of several details
    the longest counts, and of two equally long ones the last in order.
    """
    longest = F.max(F.struct(F.length("description").alias("n"), F.col("description").alias("d")))["d"]
    out = postings.join(details.groupBy("job_id").agg(longest.alias("_detail")), "job_id", "left")
    known = [F.nullif("description", F.lit("")), F.col("_detail")]
    if {"company_id", "title"} <= {*postings.columns} & {*details.columns}:
        titled = details.withColumn("_title", norm_title("title")).where("_title <> ''")
        titled = titled.groupBy(F.col("company_id").alias("_company"), "_title").agg(longest.alias("_alike"))
        out = out.join(titled, (F.col("company_id") == F.col("_company")) & (norm_title("title") == F.col("_title")), "left")
        known.append(F.col("_alike"))
    return out.withColumn("description", F.coalesce(*known)).select(*postings.columns)
