"""Identifiers and URLs of papers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how identifiers look
ARXIV_URL, ARXIV_ID = r"(?i)arxiv\.org/(?:abs|html|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)", r"(?i)(?:^|arxiv[.:/]*)(\d{4}\.\d{4,5}(?:v\d+)?)"
PMC_ID = r"(?i)(PMC\d{5,9})"
ACL_URL, ACL_ID = r"(?i)aclanthology\.org/([A-Za-z0-9._-]+)/?", r"(?i)(\d{4}\.(?:acl|emnlp|naacl|eacl|findings|tacl|cl)-[a-z]+\.\d+)"
DOI_ID = r"(10\.\d{4,9}/[^\s]+)"
_API = "https://api.semanticscholar.org/graph/v1/paper/{}?fields=title,authors,year,citationCount,references,abstract"


def _first(t: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns))


def resolve(c: Column) -> Column:
    """kind (arxiv, pmc, acl, url, doi, unknown; first that fits), identifier, and the URLs of its HTML, PDF, landing page
    and metadata, where they follow from it."""
    t = F.trim(c)
    arxiv, pmc, acl = _first(t, ARXIV_URL, ARXIV_ID), F.upper(_first(t, PMC_ID)), _first(t, ACL_URL, ACL_ID)
    doi = F.regexp_replace(_first(t, DOI_ID), r"[.,;)]+$", "")
    url = t.rlike("(?i)^https?://")
    to_doi = F.contains(F.lower(t), F.lit("doi.org/"))
    kind = F.when(arxiv.isNotNull(), "arxiv").when(pmc.isNotNull(), "pmc").when(acl.isNotNull(), "acl").when(url & ~(to_doi & doi.isNotNull()), "url").when(doi.isNotNull(), "doi").otherwise("unknown")
    base = F.regexp_replace(arxiv, r"v\d+$", "")
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    api = lambda name, v: cat(_API.split("{}")[0] + name, v, _API.split("{}")[1])
    by = lambda **of: F.coalesce(*(F.when(kind == k, v) for k, v in of.items()))
    return F.struct(
        kind.alias("kind"), F.coalesce(by(arxiv=arxiv, pmc=pmc, acl=acl, doi=doi), t).alias("identifier"),
        by(arxiv=cat("https://arxiv.org/html/", base), pmc=cat("https://www.ncbi.nlm.nih.gov/pmc/articles/", pmc, "/"), acl=cat("https://aclanthology.org/", acl, "/"), doi=cat("https://doi.org/", doi), url=t).alias("html_url"),
        by(arxiv=cat("https://arxiv.org/pdf/", arxiv), pmc=cat("https://www.ncbi.nlm.nih.gov/pmc/articles/", pmc, "/pdf/"), acl=cat("https://aclanthology.org/", acl, ".pdf"), url=pdf_url(t)).alias("pdf_url"),
        by(arxiv=cat("https://arxiv.org/abs/", arxiv), pmc=cat("https://www.ncbi.nlm.nih.gov/pmc/articles/", pmc, "/"), acl=cat("https://aclanthology.org/", acl, "/"), doi=cat("https://doi.org/", doi), url=t).alias("landing_url"),
        by(
            arxiv=F.array(api("arXiv:", base), cat("https://api.openalex.org/works?filter=ids.openalex:arXiv:", base)), pmc=F.array(api("PMCID:", pmc)), acl=F.array(api("ACL:", acl)),
            doi=F.array(cat("https://api.crossref.org/works/", doi), cat("https://api.openalex.org/works/doi:", doi), api("DOI:", doi)),
        ).alias("api_urls"),
    )


def identifier_kind(c: Column) -> Column:
    return resolve(c).getField("kind")


def pdf_url(url: Column) -> Column:
    """PDF that follows from a publisher's URL; null where none does."""
    host, path = F.lower(F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)), F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    at = lambda name: F.contains(host, F.lit(name))
    asked = F.nullif(F.regexp_extract(url, r"[?&]id=([^&#]*)", 1), F.lit(""))
    page, stem = F.regexp_extract(path, r"^(.*)/([^/]*)\.html$", 1), F.regexp_extract(path, r"^(.*)/([^/]*)\.html$", 2)
    volume, slug = F.regexp_extract(path, r"/papers/v(\d+)/(\w+)\.html$", 1), F.regexp_extract(path, r"/papers/v(\d+)/(\w+)\.html$", 2)
    return (
        F.when(F.endswith(F.lower(path), F.lit(".pdf")), url)
        .when((at("biorxiv.org") | at("medrxiv.org")) & F.contains(path, F.lit("/content/")) & ~F.endswith(path, F.lit(".full.pdf")), F.concat(F.regexp_replace(url, "/+$", ""), F.lit(".full.pdf")))
        .when(at("frontiersin.org") & F.endswith(path, F.lit("/full")), F.concat(F.regexp_replace(url, ".{4}$", ""), F.lit("pdf")))
        .when(at("ojs.aaai.org") & F.contains(path, F.lit("/article/download/")), url)
        .when(at("openreview.net") & asked.isNotNull(), F.concat(F.lit("https://openreview.net/pdf?id="), asked))
        .when(at("proceedings.mlr.press") & F.endswith(path, F.lit(".html")), F.concat(F.lit("https://"), host, page, F.lit("/"), stem, F.lit("/"), stem, F.lit(".pdf")))
        .when(at("jmlr.org") & (volume != ""), F.concat(F.lit("https://www.jmlr.org/papers/volume"), volume, F.lit("/"), slug, F.lit("/"), slug, F.lit(".pdf")))
        .when(at("journals.plos.org") & F.contains(path, F.lit("/article")) & asked.isNotNull(), F.concat(F.lit("https://journals.plos.org/plosone/article/file?id="), asked, F.lit("&type=printable")))
    )


# fixed values: parts of URLs and the layout that pages behind them have
LAYOUTS = (("arxiv.org", "arxiv"), ("pmc.ncbi.nlm.nih.gov", "pmc"), ("aclanthology.org", "acl"))


def layout(url: Column, kind: Column | None = None) -> Column:
    """Layout of a page by the kind of its identifier, else by its URL; publishers without one of their own are generic."""
    low = F.lower(F.coalesce(url, F.lit("")))
    by_url = F.coalesce(*(F.when(F.contains(low, F.lit(part)), name) for part, name in LAYOUTS), F.lit("generic"))
    return by_url if kind is None else F.when(kind.isin("arxiv", "pmc", "acl"), kind).otherwise(by_url)


def safe_id(c: Column) -> Column:
    """File-safe form; long ones keep 60 characters and a digest."""
    s = F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.when(F.length(s) > 80, F.concat(F.substring(s, 1, 60), F.lit("_"), F.substring(F.sha2(c, 256), 1, 16))).otherwise(s)
