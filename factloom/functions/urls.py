"""URLs: normal form, parts, the platform a URL belongs to, and the guard against private addresses."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.rules import once

#: Parameters that say where a visitor came from.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid yclid _gl source ref referrer".split()
#: Platforms as (kind, host, path pattern, tenant, collection URL, whether a collection); $1, $2 are the pattern's groups and $0 the URL.
PLATFORMS = (
    ("hrmos", r"hrmos\.co", r"^/pages/([^/]+)", "$1", "https://hrmos.co/pages/$1/jobs", True),
    ("schema_org", r"public\.n-ats\.hrmos\.co", r"^/([^/]+)/jobs/([^/]+)", "n-ats:$1:$2", "$0", False),
    ("greenhouse", r"(?:boards-api|job-boards|boards)\.greenhouse\.io", r"/(?:v1/boards/)?([^/]+)/jobs", "$1", "https://boards-api.greenhouse.io/v1/boards/$1/jobs", True),
    ("herp", r"herp\.careers", r"^/v1/([^/]+)", "$1", "https://herp.careers/v1/$1", True),
    ("talentio", r"open\.talentio\.com", r"^(/r/\d+/c/([^/]+)/homes/\d+)", "$2", "https://open.talentio.com$1", True),
    ("talentio", r"open\.talentio\.com", r"^/r/\d+/c/([^/]+)", "$1", "https://open.talentio.com/r/1/c/$1", True),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com", r"^/([^/]+)", "$1", "https://jobs.smartrecruiters.com/$1", True),
    ("smartrecruiters", r"careers\.smartrecruiters\.com", r"^/([^/]+)", "$1", "https://api.smartrecruiters.com/v1/companies/$1/postings", True),
    ("smartrecruiters", r"api\.smartrecruiters\.com", r"^/v1/companies/([^/]+)/postings", "$1", "https://api.smartrecruiters.com/v1/companies/$1/postings", True),
    ("lever", r"jobs\.lever\.co", r"^/([^/]+)", "$1", "https://jobs.lever.co/$1", True),
    ("lever", r"jobs\.eu\.lever\.co", r"^/([^/]+)", "$1", "https://jobs.eu.lever.co/$1", True),
    ("ashby", r"jobs\.ashbyhq\.com", r"^/([^/]+)", "$1", "https://jobs.ashbyhq.com/$1", True),
    ("workday", r"[a-z0-9-]+\.wd[0-9a-z-]*\.myworkdayjobs\.com", r"^(?:/[^/]+)*?/(?!job(?:/|$))([^/]+)/job(?:/|$)", "$host/$1", "https://$host/en-US/$1", True),
    ("workday", r"[a-z0-9-]+\.wd[0-9a-z-]*\.myworkdayjobs\.com", r"^/(?:[a-z]{2}(?:-[A-Z]{2})?/)*(?![a-z]{2}(?:-[A-Z]{2})?(?:/|$))(?!wday(?:/|$))([^/]+)", "$host/$1", "https://$host/en-US/$1", True),
    ("jobcan", r"recruit\.jobcan\.jp", r"^/([^/]+)", "$1", "https://recruit.jobcan.jp/$1", True),
    ("airwork", r"arwrk\.net", r"^/recruit/([^/]+)", "$1", "https://arwrk.net/recruit/$1", True),
    ("engage", r"en-gage\.net", r"^/([^/]+)", "$1", "https://en-gage.net/$1/", True),
    ("jobposting", r"([^.]+)\..*jbplt\.jp", r"^", "$label", "$origin", True),
    ("wantedly", r"www\.wantedly\.com", r"^/companies/([^/]+)", "$1", "https://www.wantedly.com/companies/$1", True),
)


def normalise(url: str | None) -> str | None:
    """No fragment, tracking parameters or default port; parameters sorted by name; no slashes at the end of a path. Null if it is no URL."""
    try:
        u = urlsplit((url or "").strip())
        if not u.scheme or not u.hostname:
            return None
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    host = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    default = {"https": 443, "http": 80}.get(scheme)
    user = u.netloc.rpartition("@")[0]
    place = (user + "@" if user else "") + host + (f":{port}" if port and port != default else "")
    kept = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING), key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
    path = u.path.rstrip("/") if len(u.path) > 1 else u.path
    return urlunsplit((scheme, place, path or "/", "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in kept), ""))


def _normalise_all(s: pd.Series) -> pd.Series:
    return s.map(normalise)


def normalise_url(url: Column) -> Column:
    """Any URL, in Python batches, for its escaping rules."""
    return F.pandas_udf(_normalise_all, "string")(url)


def normalise_plain_url(url: Column) -> Column:
    """http(s) URLs without user names, ports or escapes in the query, by built-in functions only."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1), r":(?:80|443)$", ""))
    path = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(TRACKING))
    kept = F.array_join(F.array_sort(F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(trimmed == "", "/").otherwise(trimmed), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def detect_source(url: Column) -> Column:
    """struct(kind, tenant, url, collection) of a URL on a known platform, else null."""
    origin = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), host(url))
    parts = F.struct(url.alias("url"), host(url).alias("host"), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")).alias("path"), origin.alias("origin"))
    return once(parts, _detect)


def _detect(parts: Column) -> Column:
    h, path, cases = parts["host"], parts["path"], []
    for kind, host_pattern, path_pattern, tenant, to, collection in PLATFORMS:
        groups = path_pattern.replace(r"\(", "").replace("(?", "").count("(")
        values = {"$host": h, "$label": F.element_at(F.split(h, r"\."), 1), "$origin": parts["origin"], "$0": parts["url"]} | {f"${i}": F.regexp_extract(path, path_pattern, i) for i in range(1, groups + 1)}

        def fill(template: str, values: dict[str, Column] = values) -> Column:
            out: Column = F.lit(template)
            for name, value in values.items():
                if name in template:
                    out = F.replace(out, F.lit(name), value)
            return out

        found = h.rlike(f"^{host_pattern}$") & path.rlike(path_pattern)
        cases.append(F.when(found, F.struct(F.lit(kind).alias("kind"), fill(tenant).alias("tenant"), fill(to).alias("url"), F.lit(collection).alias("collection"))))
    return F.coalesce(*cases)


def is_public_address(address: str) -> bool:
    """Neither private, loopback, link-local, multicast nor reserved; addresses of IPv4 inside IPv6 count as what they are."""
    try:
        a = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_global and not a.is_multicast


def _public(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x is not None and is_public_address(x))


def public_address(address: Column) -> Column:
    return F.pandas_udf(_public, "boolean")(address)


def is_safe_url(url: Column, https_only: bool = True) -> Column:
    """https (or http too), without credentials, with a host that is no local name; its addresses are for public_address."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    named = ~host(url).rlike(r"^localhost$|\.localhost$|\.local$|\.internal$")
    return F.coalesce(scheme.isin("https") if https_only else scheme.isin("https", "http"), F.lit(False)) & F.try_parse_url(url, F.lit("USERINFO")).isNull() & F.coalesce(named, F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    """The same host, or one a subdomain of the other, www aside."""
    x, y = (F.regexp_replace(host(c), r"^www\.", "") for c in (a, b))
    return F.coalesce((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)), F.lit(False))
