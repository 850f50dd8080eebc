"""Collections of job platforms read from recorded answers: parsing of pages, and a Python data source over a folder.

Network access is a collector's business; what it fetched lies as files of JSON lines (source_id, kind, tenant,
run_id, page_no, cursor, body). Pages become one row a job, with what the platform says of paging and totals.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from factloom.sources.html import job_posting, json_ld, links, location_text, parse

ROW = (
    "source_id string, run_id string, page_no int, is_last_page boolean, next_cursor string, provider_total long, row_source_id string, stable_key string, "
    "external_id string, url string, title string, company string, location string, published string, raw string, error string"
)
#: Bytes of objects that a writing task holds before it writes them out.
PACK_BYTES = 32 << 20
#: Rows of a full page, where paging is by offset.
PAGE_SIZE = {"smartrecruiters": 100, "lever": 100, "workday": 20}
#: The path of one job on platforms that list jobs as links; T is the tenant.
RECORD_PATHS = {"hrmos": r"^/pages/T/jobs/([^/]+)", "herp": r"^/v1/T/([^/]+)$", "jobcan": r"^/T/job_offers/(\d+)", "airwork": r"^/recruit/T/(\d+)/?$", "engage": r"^/T/work_(\d+)/?$", "talentio": r"^/r/1/c/T/pages/(\d+)/?$"}
LINK_HOSTS = {"hrmos": "https://hrmos.co", "herp": "https://herp.careers", "jobcan": "https://recruit.jobcan.jp", "airwork": "https://arwrk.net", "engage": "https://en-gage.net", "talentio": "https://open.talentio.com"}


def _text(value: object) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def _strings(value: object) -> list[str]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, str) and v]


def _dig(value: object, *keys: str) -> object:
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def fields(kind: str, job: dict) -> dict[str, str | None]:
    """Identity, title, company, place and date as each platform names them."""
    if kind == "greenhouse":
        return {"external_id": str(job.get("id")), "url": job.get("absolute_url"), "title": _text(job.get("title")), "company": None, "location": _text(_dig(job, "location", "name")), "published": _text(job.get("first_published"))}
    if kind == "smartrecruiters":
        place = job.get("location") if isinstance(job.get("location"), dict) else {}
        return {"external_id": str(job.get("id")), "url": job.get("postingUrl") or job.get("ref"), "title": _text(job.get("name")), "company": _text(_dig(job, "company", "name")), "location": ", ".join(s for k in ("fullLocation", "city", "region", "country") for s in _strings(place.get(k))) or None, "published": _text(job.get("releasedDate"))}
    if kind == "lever":
        created = job.get("createdAt")
        import datetime

        when = datetime.datetime.fromtimestamp(created / 1000, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z") if isinstance(created, int | float) else None
        return {"external_id": str(job.get("id")), "url": job.get("hostedUrl"), "title": _text(job.get("text")), "company": None, "location": ", ".join([*_strings(_dig(job, "categories", "location")), *_strings(_dig(job, "categories", "allLocations"))]) or None, "published": when}
    if kind == "ashby":
        more = [s for x in job.get("secondaryLocations") or [] if isinstance(x, dict) for s in _strings(x.get("location"))]
        return {"external_id": str(job.get("id")), "url": job.get("jobUrl"), "title": _text(job.get("title")), "company": None, "location": ", ".join([*_strings(job.get("location")), *more]) or None, "published": _text(job.get("publishedAt"))}
    if kind == "workday":
        info = job.get("jobPostingInfo") if isinstance(job.get("jobPostingInfo"), dict) else job
        place = [s for k in ("location", "locations", "locationsText", "additionalLocations") for s in _strings(info.get(k))]
        path = job.get("externalPath") or ""
        return {"external_id": _text(info.get("jobReqId")) or path.rsplit("/", 1)[-1] or None, "url": info.get("externalUrl") or path or None, "title": _text(info.get("title")), "company": _text(_dig(job, "hiringOrganization", "name")), "location": ", ".join(place) or None, "published": _text(info.get("startDate"))}
    return {"external_id": _text(_dig(job, "identifier", "value")) or _text(job.get("url")), "url": _text(job.get("url")), "title": _text(job.get("title")), "company": _text(_dig(job, "hiringOrganization", "name")), "location": location_text(job) or None, "published": _text(job.get("datePosted"))}


def collection(kind: str, tenant: str, body: str, cursor: str | None) -> tuple[list[dict], str | None, bool, int | None]:
    """(jobs, next cursor, whether the page is the last, the platform's total) of one page. Raises ValueError at a page of another form."""
    if kind in RECORD_PATHS:
        return _linked(kind, tenant, body, int(cursor or 1))
    if kind == "schema_org":
        found = next((p for v in json_ld(parse(body)) if (p := job_posting(v))), None)
        if not found:
            raise ValueError("no JobPosting on the page")
        return [found], None, True, 1
    page, at = json.loads(body), int((cursor or "0").split(":")[0])
    if kind == "greenhouse":
        jobs = page["jobs"]
        return jobs, None, True, _dig(page, "meta", "total") if isinstance(_dig(page, "meta", "total"), int) else len(jobs)
    if kind == "ashby":
        kept = {j["id"]: j for j in page["jobs"] if j.get("isListed") is not False}
        return list(kept.values()), None, True, len(kept)
    if kind == "lever":
        return page, str(at + PAGE_SIZE[kind]) if len(page) >= PAGE_SIZE[kind] else None, len(page) < PAGE_SIZE[kind], None
    jobs = page["content"] if kind == "smartrecruiters" else page["jobPostings"]
    total = page["totalFound"] if kind == "smartrecruiters" else page.get("total") or int((cursor or "0:0").split(":")[1])
    if not jobs and at < total:
        raise ValueError("an empty page before the end")
    last = at + len(jobs) >= total
    return jobs, None if last else f"{at + len(jobs)}" + (f":{total}" if kind == "workday" else ""), last, total


def _linked(kind: str, tenant: str, body: str, page: int) -> tuple[list[dict], str | None, bool, int | None]:
    pattern, jobs = re.compile(RECORD_PATHS[kind].replace("T", re.escape(tenant), 1)), {}
    for url, label in links(body, LINK_HOSTS[kind]):
        if url.startswith(LINK_HOSTS[kind] + "/") and (m := pattern.match(urlsplit(url).path)):
            jobs.setdefault(m[1], {"identifier": {"value": m[1]}, "url": LINK_HOSTS[kind] + urlsplit(url).path, "title": label or None})
    if kind == "talentio":  # it also names its pages in escaped JSON
        at = f"{LINK_HOSTS[kind]}/r/1/c/{tenant}/pages/"
        for found in re.findall(re.escape(at) + r"(\d+)", unescape(body)):
            jobs.setdefault(found, {"identifier": {"value": found}, "url": at + found, "title": None})
    if kind != "hrmos":
        return list(jobs.values()), None, True, None
    root = parse(body)
    counter = next((n.attrs.get("value") or n.text() for n in root.walk() if n.attrs.get("id") == "jsi-total-count" or "pg-count" in n.attrs.get("class", "").split()), "")
    total = re.search(r"\d+", counter)
    if not total:
        raise ValueError("the page has no total")
    inside = (n for box in root.walk() if "pg-pagenation" in box.attrs.get("class", "").split() for n in box.find("a"))
    later = sorted(int(x) for n in inside if (x := n.text().strip()).isdigit() and int(x) > page)
    return list(jobs.values()), str(later[0]) if later else None, not later, int(total[0])


def category_urls(record: dict) -> Iterator[tuple[str, str, str]]:
    """(source, run, URL) of the pages by category that the first page of a jobcan collection links to, each once."""
    if record["kind"] == "jobcan":
        start = f"{LINK_HOSTS['jobcan']}/{record['tenant']}/list?"
        yield from ((record["source_id"], record["run_id"], url) for url, _ in links(record["body"] or "", LINK_HOSTS["jobcan"]) if url.startswith(start))


def page_rows(record: dict) -> Iterator[tuple]:
    """Rows of one recorded page; an empty page and a page in error have one row without a job."""
    source, kind = record["source_id"], record["kind"]
    start = (source, record["run_id"], int(record["page_no"]))
    try:
        jobs, following, last, total = collection(kind, record["tenant"], record["body"], record.get("cursor"))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        yield (*start, False, None, None, None, None, None, None, None, None, None, None, None, f"schema_changed: {e}"[:200])
        return
    for job in jobs or [None]:
        f = fields(kind if kind not in RECORD_PATHS else "schema_org", job) if job else {}
        key = f"{kind}:{record['tenant']}:{f['external_id']}" if f.get("external_id") else None
        yield (*start, last, following, total, source if job else None, key, *[f.get(c) for c in ("external_id", "url", "title", "company", "location", "published")], json.dumps(job, ensure_ascii=False, sort_keys=True) if job else None, None)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[_File]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return [_File(f.path) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith((".jsonl", ".json"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_stream(partition.path) as f:
            for line in f.read().splitlines():
                if line.strip():
                    yield from page_rows(json.loads(line))


class _StreamReader(DataSourceStreamReader):
    """Recorded files in the order of their times; an offset is the last file's time and path, so that a stream that starts again goes on behind it.

    A file counts once it has lain for `settle` seconds, as others of its time may still come.
    """

    def __init__(self, uri: str, settle: float):
        self.uri, self.settle = uri, settle

    def _files(self) -> list[tuple[int, str]]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted((f.mtime_ns, f.path) for f in found if f.is_file and f.base_name.endswith((".jsonl", ".json")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        ready = [f for f in self._files() if f[0] <= time.time_ns() - self.settle * 1e9]
        return {"time": str(ready[-1][0]), "path": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_File]:
        after, last = ((int(o["time"]), o["path"]) for o in (start, end))
        return [_File(p) for t, p in self._files() if after < (t, p) <= last]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _Reader(self.uri).read(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordedPages(DataSource):
    """spark.read or readStream.format("recorded_pages").option("path", uri): one partition a file of recorded pages; option settle for streams."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        uri = self.options["path"]
        return _Reader(uri if "://" in uri else f"file://{uri}")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        uri = self.options["path"]
        return _StreamReader(uri if "://" in uri else f"file://{uri}", float(self.options.get("settle", "5")))


@dataclass
class _Pack(WriterCommitMessage):
    """The file that a task wrote; none where it had no rows."""

    name: str | None


class _PackWriter(DataSourceWriter):
    """Each task writes its objects into a file of its own; a commit names the files that count, an abort removes the others.

    What no commit names is no object. Tasks that are still at work when a job is given up may leave such files; `sweep_objects` removes them.
    """

    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name

    def write(self, iterator: Iterator[Row]) -> _Pack:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        found: dict[str, bytes] = {}
        name, out = f"objects/{uuid.uuid4().hex}.parquet", None
        kinds = pa.schema([("hash", pa.string()), ("key", pa.string()), ("bytes", pa.binary())])

        def flush() -> None:
            rows = sorted(found.items())
            out.write_table(pa.table([[h for h, _ in rows], [f"raw/sha256/{h[:2]}/{h}" for h, _ in rows], [b for _, b in rows]], schema=kinds))
            found.clear()

        held = 0
        try:
            for row in iterator:
                raw = bytes(row["bytes"])
                if out is None:
                    fs.create_dir(f"{root}/objects", recursive=True)
                    out = pq.ParquetWriter(fs.open_output_stream(f"{root}/{name}"), kinds)
                found[hashlib.sha256(raw).hexdigest()] = raw
                held += len(raw)
                if held > PACK_BYTES:
                    flush()
                    held = 0
            if out:
                flush()
        except BaseException:
            if out:
                out.close()
                fs.delete_file(f"{root}/{name}")
            raise
        if out:
            out.close()
        return _Pack(name if out else None)

    def _commit(self, name: str, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        path = f"{root}/commits/{name}.json"
        if fs.get_file_info(path).type != pafs.FileType.NotFound:  # this batch has been committed before
            return self._abort(messages)
        fs.create_dir(f"{root}/commits", recursive=True)
        with fs.open_output_stream(f"{root}/commits/.{name}") as f:
            f.write(json.dumps([m.name for m in messages if m and m.name]).encode())
        fs.move(f"{root}/commits/.{name}", path)

    def _abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m and m.name and fs.get_file_info(f"{root}/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{root}/{m.name}")

    def commit(self, messages: list) -> None:
        self._commit(self.name, messages)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class _StreamPackWriter(_PackWriter, DataSourceStreamWriter):
    """The same for a stream, whose batches are committed once by their numbers, however often they run."""

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(f"{self.name}-{batchId}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._abort(messages)


class ContentObjects(DataSource):
    """write or writeStream.format("content_objects").option("path", uri): stores the column bytes of rows under the SHA-256 of each.

    option name: of the writer, so that several may share a folder. `content_objects` reads what has been committed.
    """

    @classmethod
    def name(cls) -> str:
        return "content_objects"

    def _uri(self) -> str:
        uri = self.options["path"]
        return uri if "://" in uri else f"file://{uri}"

    def schema(self) -> str:
        return "bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PackWriter(self._uri(), uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamPackWriter(self._uri(), self.options.get("name", "stream"))


def sweep_objects(path: str, older_s: float = 86_400) -> int:
    """Removes files of that age that no commit names; returns how many."""
    fs, root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    listed = lambda folder: fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", allow_not_found=True))
    files = [f for f in listed("objects") if f.is_file and f.mtime_ns <= time.time_ns() - older_s * 1e9]
    named = {n for f in listed("commits") if f.base_name.endswith(".json") for n in json.loads(fs.open_input_stream(f.path).read())}
    gone = [f.path for f in files if f"objects/{f.base_name}" not in named]
    for f in gone:
        fs.delete_file(f)
    return len(gone)


def content_objects(spark: SparkSession, path: str) -> DataFrame:
    """hash, key, bytes of each object that has been committed, once, however many tasks stored it."""
    uri = path if "://" in path else f"file://{path}"
    fs, root = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(f"{root}/commits").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], "hash string, key string, bytes binary")
    names = [n for r in spark.read.text(f"{uri}/commits/*.json", wholetext=True).collect() for n in json.loads(r[0])]
    files = spark.read.schema("hash string, key string, bytes binary")
    return (files.parquet(*[f"{uri}/{n}" for n in names]) if names else spark.createDataFrame([], "hash string, key string, bytes binary")).dropDuplicates(["hash"])


def recorded_pages(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").option("path", path).load()


def whole_collections(rows: DataFrame) -> DataFrame:
    """Jobs of collections that came in several pages (rows as `page_rows` makes them): a job once, as its last page has it, and provider_total the number of a collection's jobs.

    Pages in error and without jobs add nothing. Aggregates are partial, so that a large collection is not gathered.
    """
    values = [c for c in rows.columns if c not in ("source_id", "run_id", "stable_key", "provider_total")]
    last = F.max_by(F.struct(*values), F.struct("page_no", "raw")).alias("_last")
    jobs = rows.where("stable_key is not null and error is null").groupBy("source_id", "run_id", "stable_key").agg(last)
    totals = jobs.groupBy("source_id", "run_id").agg(F.count(F.lit(1)).alias("provider_total"))
    return jobs.join(totals, ["source_id", "run_id"]).select("source_id", "run_id", "stable_key", "provider_total", "_last.*")


def sitemap_records(sitemaps: DataFrame, body: str, tenants: DataFrame | None = None) -> DataFrame:
    """tenant, external_id, url of the job pages that talentio's sitemap names, each once, of these tenants or of all. Nulls and other pages have none."""
    loc = F.explode(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1))
    url = sitemaps.select(loc.alias("url"))
    path = F.try_parse_url("url", F.lit("PATH"))
    form = RECORD_PATHS["talentio"].replace("T", "([^/]+)", 1)
    found = url.where((F.try_parse_url("url", F.lit("HOST")) == LINK_HOSTS["talentio"].removeprefix("https://")) & path.rlike(form))
    tenant, number = F.regexp_extract(path, form, 1), F.regexp_extract(path, form, 2)
    records = found.select(tenant.alias("tenant"), number.alias("external_id"), F.concat(F.lit(LINK_HOSTS["talentio"] + "/r/1/c/"), tenant, F.lit("/pages/"), number).alias("url")).distinct()
    return records if tenants is None else records.join(tenants.select("tenant").distinct(), "tenant", "left_semi")


#: Columns of a seed file: platforms' tenants that are known from elsewhere.
SEED = "kind string, tenantKey string, companyName string"


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a JSON file (an array of objects); none where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SEED)
    return spark.read.schema(SEED).json(path, multiLine=True)


def company_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct names of a CSV file with quoted fields: those under the heading that speaks of a company's or an issue's
    name, of three characters or more with a letter among them. Without such a heading there are none."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    heading = next((c for c in rows.columns if re.search(r"(?:issue|company).*name|name.*(?:issue|company)", c, re.I)), None)
    if heading is None:
        return spark.createDataFrame([], "name string")
    name = F.trim(F.col(f"`{heading}`"))
    return rows.select(name.alias("name")).where((F.char_length("name") >= 3) & F.col("name").rlike("[A-Za-z\u3000-\u30ff\u3400-\u9fff]")).distinct()
