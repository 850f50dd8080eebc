"""What collectors find: sitemaps, robots rules, candidate links, leads, tenants in texts, and proof by backlinks."""

from __future__ import annotations

import gzip
import json
import re
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.urls import detect_source, same_site
from factloom.sources.html import clean, job_posting, json_ld, links, location_text, parse

#: Hosts in code search, kinds with all query shards, and links that stand in scripts.
SEARCH_HOSTS = {"greenhouse": "boards.greenhouse.io", "smartrecruiters": "jobs.smartrecruiters.com", "lever": "jobs.lever.co", "ashby": "jobs.ashbyhq.com", "workday": "myworkdayjobs.com", "hrmos": "hrmos.co/pages", "herp": "herp.careers/v1", "talentio": "open.talentio.com"}
EMBEDDED = r"(https?://(?:(?:jobs|careers)\.smartrecruiters\.com|jobs\.lever\.co|jobs\.ashbyhq\.com|[A-Za-z0-9-]+\.wd[0-9a-z-]*\.myworkdayjobs\.com)/[A-Za-z0-9._~!$&'()*+,;=:@%/-]+)"
URL = r"""(https?://[^\s"'<>\\)\]]+)"""


def sitemap(data: bytes, host: str) -> tuple[list[tuple[str, str | None]], list[str]]:
    """(pages with their dates, further sitemaps) of one host over https; gzip is told by its first bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    pages, more = [], []
    for e in ElementTree.fromstring(data):
        parts = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in e}
        u = urlsplit(parts.get("loc", ""))
        if u.scheme == "https" and u.hostname == host:
            if e.tag.endswith("sitemap"):
                more.append(parts["loc"])
            elif e.tag.endswith("url"):
                pages.append((parts["loc"], parts.get("lastmod") or None))
    return pages, more


def robots_allow(text: str, path: str, agent: str = "*", only: str | None = None) -> bool:
    """Whether robots.txt lets an agent read a path: the longest matching rule, allow before disallow, else yes. Outside `only`, never."""
    if only and not re.search(only, path):
        return False
    groups: list[tuple[set, list]] = []
    for raw in text.splitlines():
        key, colon, value = re.sub(r"\s+#.*$", "", raw).strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not groups or groups[-1][1]:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
        elif colon and key in ("allow", "disallow") and groups and value:
            groups[-1][1].append((value, key == "allow"))

    def fits(rule: str) -> bool:
        body = ".*".join(map(re.escape, rule.removesuffix("$").split("*")))
        return re.match(body + ("$" if rule.endswith("$") else ""), path) is not None

    rules = [r for agents, own in groups if agent in agents for r in own if fits(r[0])]
    return max(rules, key=lambda r: (len(r[0]), r[1]))[1] if rules else True


def listing_leads(markup: str, page_url: str, host: str, detail: str, paging: str) -> tuple[list[dict], list[str]]:
    """(leads, further pages) of an aggregator's list: its postings on the host with a detail path, and its links of paging."""
    root, leads = parse(markup), []
    for value in json_ld(root):
        for item in value if isinstance(value, list) else value.get("itemListElement") or [value] if isinstance(value, dict) else []:
            posting = job_posting(item)
            if not posting or not isinstance(posting.get("url"), str):
                continue
            url = urljoin(page_url, posting["url"])
            found = re.search(detail, urlsplit(url).path)
            if found and urlsplit(url).hostname == host:
                organisation = posting.get("hiringOrganization")
                leads.append({"external_id": found[1], "detail_url": url, "title": posting.get("title"), "company": organisation.get("name") if isinstance(organisation, dict) else organisation, "location": location_text(posting), "published": posting.get("datePosted")})
    boxes = (n for n in root.find("nav") if "pagination" in n.attrs.get("class", "").split())
    further = [u for n in boxes for a in n.find("a") if "href" in a.attrs and urlsplit(u := urljoin(page_url, a.attrs["href"])).hostname == host and re.search(paging, urlsplit(u).path)]
    return leads, list(dict.fromkeys(further))


def detail_lead(markup: str, url: str, detail: str) -> dict | None:
    """The lead of a detail page: the posting whose URL has the page's id, else the first."""
    found = re.search(detail, urlsplit(url).path)
    postings = [p for v in json_ld(parse(markup)) if (p := job_posting(v))]
    if not found or not postings:
        return None
    p = next((x for x in postings if f"/{found[1]}" in str(x.get("url"))), postings[0])
    organisation = p.get("hiringOrganization")
    return {"external_id": found[1], "detail_url": url, "title": p.get("title"), "company": organisation.get("name") if isinstance(organisation, dict) else organisation, "location": location_text(p), "published": p.get("datePosted")}


def embedded_projects(markup: str, tenant: str) -> list[dict]:
    """Projects of a company page that carries its data: all declared ones must be there; only ordinary, dated ones count."""
    box = next((n for n in parse(markup).walk() if n.attrs.get("id") == "ssr-app-data"), None)
    body = json.loads(box.text())["body"] if box else {}
    company, projects = body.get("company", {}), body.get("projects", [])
    if company.get("company_path") != f"/companies/{tenant}" or company.get("project_count") != len(projects):
        raise ValueError("another company's page, or an incomplete one")
    return [{"external_id": str(p["id"]), "title": p["title"].strip(), "location": p.get("location") or "", "published": p["published_at"]} for p in projects if p.get("category") == "normal" and isinstance(p.get("id"), int) and p.get("title") and p.get("published_at")]


def directory_rows(markup: str, base: str, detail: str) -> list[dict]:
    """Companies of a directory's table: name, link and the alternative texts of its icons."""
    out = []
    for row in parse(markup).find("tr"):
        cell = row.first("th")
        link = next((a for a in cell.find("a") if re.search(detail, a.attrs.get("href", ""))), None) if cell else None
        if link and clean(link.text()):
            out.append({"external_key": re.search(detail, link.attrs["href"])[1], "name": clean(link.text()), "url": urljoin(base, link.attrs["href"]), "signals": [n.attrs["alt"] for n in row.find("img") if n.attrs.get("alt")], "labels": [clean(n.text()) for n in row.find("li") if clean(n.text())]})
    return out


def candidate_links(markup: str, base: str, most: int = 100) -> list[str]:
    """Links whose text or path speaks of jobs."""
    return [u for u, label in links(markup, base) if re.search("job|career|recruit|採用|求人|募集|entry", f"{label} {urlsplit(u).path}", re.I)][:most]


def tenants_in_text(text: Column) -> Column:
    """array of struct(kind, tenant, url, collection) of the platform URLs in a text, each tenant once."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    urls = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(f"(?i){URL}"), 1), lambda u: F.regexp_replace(u, "[.,;:]+$", "")))
    return F.array_distinct(F.array_compact(F.transform(urls, detect_source)))


def search_queries(shards: DataFrame, seed: int = 0, most: int = 30) -> DataFrame:
    """place, query: code searches for each platform's host in each shard (the first three of them but for one platform), the first
    `most`, begun at seed modulo their number. shards has place (from 0) and shard; only `most` rows are numbered together."""
    hosts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.lit(h).alias("host")) for i, (k, h) in enumerate(SEARCH_HOSTS.items())])
    each = shards.select(F.col("place").alias("j"), "shard", F.explode(hosts).alias("h")).select("h.*", "j", "shard").where((F.col("kind") == "workday") | (F.col("j") < 3))
    few = each.orderBy("i", "j").limit(most)
    at = F.row_number().over(Window.orderBy("i", "j")) - 1
    numbered = few.select(at.alias("at"), F.format_string('"%s" in:file %s', "host", "shard").alias("query"))
    return numbered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).select(F.pmod(F.col("at") - seed, F.col("n")).cast("int").alias("place"), "query")


def harvest(pages: DataFrame, budget: int, deadline: float, full: int = 100) -> tuple[DataFrame, DataFrame]:
    """(summary: kind, candidates; state: requests_used, truncated) of recorded searches under a budget and a deadline.

    pages: query_no, page_no, n_items, incomplete, ended_at (seconds), candidates array<struct<kind, tenant>>. A query
    stops after a page that is not full; requests go on in order until the budget is used or a page ends after the
    deadline. Only requests within the budget are numbered, so one task holds no more rows than that.
    """
    ends = pages.where(F.col("n_items") < full).groupBy("query_no").agg(F.min("page_no").alias("_last"))
    asked = pages.join(ends, "query_no", "left").where(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last"))).drop("_last")
    first = asked.orderBy("query_no", "page_no").limit(budget)
    late = F.max(F.col("ended_at") >= deadline).over(Window.orderBy("query_no", "page_no").rowsBetween(Window.unboundedPreceding, -1))
    done = first.withColumn("_late", F.coalesce(late, F.lit(False))).where("not _late")
    state = done.agg(F.count(F.lit(1)).alias("requests_used"), F.coalesce(F.bool_or(F.col("incomplete") | (F.col("ended_at") >= deadline)), F.lit(False)).alias("_cut"))
    summary = done.select(F.explode("candidates").alias("c")).select("c.kind", "c.tenant").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"))
    return summary, state.select("requests_used", (F.col("_cut") | (F.col("requests_used") >= budget)).alias("truncated"))


def deepest_sources(found: DataFrame) -> DataFrame:
    """One row of found (company, kind, tenant, url, collection, place) for each source of a company: a collection is
    one whatever its URL, other sources are one a URL; the URL with the deepest path counts, then the first by place.
    A posting page that is really one of a known platform is left to that platform."""
    depth = F.size(F.split(F.parse_url("url", F.lit("PATH")), "/"))
    real = detect_source(F.col("url"))
    usable = found.where(~((F.col("kind") == "schema_org") & F.coalesce(real["kind"] == "hrmos", F.lit(False))))
    own = usable.groupBy("company", "kind", "tenant", F.when(~F.col("collection"), F.col("url")).alias("_single"))
    return own.agg(F.max_by("url", F.struct(depth, -F.col("place"))).alias("url")).drop("_single")


def link_priority(url: Column) -> Column:
    rules = ((r"recruit/search|career/jobs|採用.*募集", 3), (r"recruit|career|採用|求人|募集", 2), (r"job|search", 1))
    return F.coalesce(*[F.when(url.rlike(f"(?i){p}"), n) for p, n in rules], F.lit(0))


def verified_by_backlink(sites: DataFrame, graph: DataFrame, depth: int = 3, pages: int = 12) -> DataFrame:
    """company, kind, tenant of sites (company, url, kind, tenant) whose own pages lead to exactly that tenant.

    graph: url, link. Each round follows the links of a company's pages inside its site, best priority first, until
    so many pages; a round is one join for all companies.
    """
    from factloom.operators.ranking import kept, top_one

    reached = sites.select("company", F.col("url").alias("root"), "url").distinct()
    frontier = reached
    for _ in range(depth):
        step = frontier.join(graph, "url").select("company", "root", F.col("link").alias("url")).where(same_site(F.col("url"), F.col("root"))).distinct()
        new = step.join(reached, ["company", "root", "url"], "left_anti").withColumns({"_new": F.lit(1), "_p": link_priority(F.col("url"))})
        pages_now = kept(top_one(reached.withColumns({"_new": F.lit(0), "_p": F.lit(0)}).unionByName(new), ["company"], "_new", F.desc("_p"), "url", k=pages))
        frontier = pages_now.where("_new = 1").drop("_new", "_p")
        reached = pages_now.drop("_new", "_p")
    out = reached.join(graph, "url").select("company", detect_source(F.col("link")).alias("s")).where("s is not null")
    return sites.join(out.select("company", F.col("s.kind").alias("kind"), F.col("s.tenant").alias("tenant")).distinct(), ["company", "kind", "tenant"], "left_semi").select("company", "kind", "tenant").distinct()

