"""The REST services: how each is asked, and what is kept of its answers.

A lookup takes one key (a DOI, or a name) and gives a plain dict, or None if
there is no such thing; page readers give what ``sources.paged`` asks for.
``lookup_table`` runs lookups on the executors and keeps each outcome with a
status, so that only finds and known absences go into the cache table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions.pubmed import articles
from quillmill.sources.transport import BudgetExhausted, NotFound, Policy, Transport, TransportError

#: Hosts, paces and where keys go, as the services publish them.
POLICIES = {
    p.key: p
    for p in (
        Policy("openalex", "api.openalex.org", 0.1, key_variable="OPENALEX_API_KEY", key_parameter="api_key"),
        Policy("crossref", "api.crossref.org", 0.2, key_variable="OPENALEX_EMAIL", key_parameter="mailto"),
        Policy("semantic_scholar", "api.semanticscholar.org", 4.0, 1.0, key_variable="SEMANTIC_SCHOLAR_API_KEY", key_header="x-api-key"),
        Policy("europepmc", "www.ebi.ac.uk", 0.2),
        Policy("unpaywall", "api.unpaywall.org", 0.1, key_variable="OPENALEX_EMAIL", key_parameter="email"),
        Policy("pubmed", "eutils.ncbi.nlm.nih.gov", 0.34, 0.1, key_variable="NCBI_API_KEY", key_parameter="api_key"),
        Policy("clinicaltrials", "clinicaltrials.gov", 0.5),
        Policy("pubchem", "pubchem.ncbi.nlm.nih.gov", 0.2),
    )
}
SEARCH_PAGE, TRIAL_PAGE, ID_PAGE, FETCH_BATCH, SYNONYMS = 200, 100, 500, 200, 50


def ask(t: Transport, source: str, path: str, params: dict | None = None) -> dict:
    found = json.loads(t.get(source, path, params))
    return found if isinstance(found, dict) else {}


def works_filter(query: str, first: str, last: str) -> str:
    return f"title_and_abstract.search:{query},from_publication_date:{first},to_publication_date:{last}"


def works_page(t: Transport, query: str, first: str, last: str, cursor: str) -> dict:
    page = ask(t, "openalex", "/works", {"filter": works_filter(query, first, last), "per-page": SEARCH_PAGE, "cursor": cursor})
    found = page.get("results") or []
    return {"results": found, "next_cursor": (page.get("meta") or {}).get("next_cursor") if found else None, "total": (page.get("meta") or {}).get("count")}


def works_by_year(t: Transport, query: str, first: int, last: int) -> list[tuple[int, int]]:
    """Counts a year, ascending, in one request."""
    page = ask(t, "openalex", "/works", {"filter": works_filter(query, f"{first}-01-01", f"{last}-12-31"), "group_by": "publication_year", "per-page": SEARCH_PAGE})
    return sorted((int(g["key"]), g.get("count") or 0) for g in page.get("group_by") or [] if str((g or {}).get("key", "")).isdigit())


def trials_page(t: Transport, query: str, token: str) -> dict:
    params = {"query.term": query, "pageSize": TRIAL_PAGE, "countTotal": "true"} | ({"pageToken": token} if token != "*" else {})
    page = ask(t, "clinicaltrials", "/api/v2/studies", params)
    found = page.get("studies") or []
    return {"results": found, "next_cursor": page.get("nextPageToken") if found else None}


def pmids(t: Transport, term: str, start: int, count: int, first: str | None = None, last: str | None = None) -> tuple[list[str], int]:
    """Ids of one page, and the number of all matches."""
    dated = {"mindate": first, "maxdate": last, "datetype": "pdat"} if first and last else {}
    page = ask(t, "pubmed", "/entrez/eutils/esearch.fcgi", {"db": "pubmed", "term": term, "retmax": count, "retstart": start, "retmode": "json"} | dated)
    found = page.get("esearchresult") or {}
    total = str(found.get("count") or 0)
    return [i for i in found.get("idlist") or [] if isinstance(i, str)], int(total) if total.isdigit() else 0


def pubmed_articles(t: Transport, ids: list[str]) -> list[dict]:
    """Articles by id, in batches."""
    found = []
    for at in range(0, len(ids), FETCH_BATCH):
        found += articles(t.get("pubmed", "/entrez/eutils/efetch.fcgi", {"db": "pubmed", "id": ",".join(ids[at : at + FETCH_BATCH]), "retmode": "xml"}))
    return found


def month_page(t: Transport, term: str, cursor: str) -> dict:
    """Records of a month; the cursor is ``YYYY-MM`` or ``YYYY-MM@start``."""
    month, _, start = cursor.partition("@")
    at = int(start or 0)
    year, number = month.split("-")
    days = pd.Period(month).days_in_month
    ids, total = pmids(t, term, at, ID_PAGE, f"{year}/{number}/01", f"{year}/{number}/{days}")
    records = [a | {"month_bucket": month, "provider": "pubmed"} for a in pubmed_articles(t, ids)] if ids else []
    more = ids and at + len(ids) < total
    return {"results": records, "next_cursor": f"{month}@{at + len(ids)}" if more else None, "total": total}


def crossref(t: Transport, key: str) -> dict | None:
    return ask(t, "crossref", f"/works/{quote(key, safe='/')}").get("message")


def semantic_scholar(t: Transport, key: str) -> dict | None:
    found = ask(t, "semantic_scholar", f"/graph/v1/paper/DOI:{quote(key, safe='/')}", {"fields": "title,abstract,tldr,citationCount,venue,year,isOpenAccess"})
    tldr = found.get("tldr")
    return {"title": found.get("title"), "abstract": found.get("abstract"), "tldr": tldr.get("text") if isinstance(tldr, dict) else tldr, "citation_count": found.get("citationCount"), "journal": found.get("venue")} if found else None


def europepmc(t: Transport, key: str) -> dict | None:
    """By DOI, or by title where the key doesn't look like one."""
    field, value = ("DOI", key) if key.startswith("10.") else ("TITLE", " ".join(key.replace('"', " ").split()))
    page = ask(t, "europepmc", "/europepmc/webservices/rest/search", {"query": f'{field}:"{value}"', "format": "json", "resultType": "core", "pageSize": 1})
    hits = (page.get("resultList") or {}).get("result") or []
    if not hits:
        return None
    words = (hits[0].get("keywordList") or {}).get("keyword")
    journal = (hits[0].get("journalInfo") or {}).get("journal") or {}
    return {"title": hits[0].get("title"), "abstract": hits[0].get("abstractText"), "journal": journal.get("title"), "keywords": [w for w in words if isinstance(w, str)] if isinstance(words, list) else []}


def pubmed(t: Transport, key: str) -> dict | None:
    ids, _ = pmids(t, f"{key}[DOI]", 0, 1)
    found = pubmed_articles(t, ids[:1]) if ids else []
    return found[0] if found else None


def unpaywall(t: Transport, key: str) -> dict | None:
    return ask(t, "unpaywall", f"/v2/{quote(key, safe='/')}")


def pubchem(t: Transport, key: str) -> dict | None:
    """A compound by name: its number and all its names."""
    ids = (ask(t, "pubchem", f"/rest/pug/compound/name/{quote(key, safe='')}/cids/JSON").get("IdentifierList") or {}).get("CID") or []
    if not ids:
        return None
    page = ask(t, "pubchem", f"/rest/pug/compound/cid/{ids[0]}/synonyms/JSON")
    about = (page.get("InformationList") or {}).get("Information") or []
    return {"cid": ids[0], "synonyms": (about[0].get("Synonym") or []) if about else []}


LOOKUPS: dict[str, Callable[[Transport, str], dict | None]] = {f.__name__: f for f in (crossref, semantic_scholar, europepmc, pubmed, unpaywall, pubchem)}


def online() -> Transport:
    import requests

    return Transport(requests.Session(), POLICIES)


def made(factory: str) -> Transport:
    """From ``module:name``, or ``module:name?argument``."""
    name, given, argument = factory.partition("?")
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)(*([argument] if given else []))


def openalex_pages(options: dict) -> Callable[[str], dict]:
    """For the ``pages`` option of ``works_pages``."""
    t = made(options.get("transport", "quillmill.sources.rest:online"))
    return lambda cursor: works_page(t, options["query"], options["from"], options["to"], cursor)


def trial_pages(options: dict) -> Callable[[str], dict]:
    """For the ``pages`` option of ``works_pages``: studies with their number as id."""
    t = made(options.get("transport", "quillmill.sources.rest:online"))

    def fetch(cursor: str) -> dict:
        page = trials_page(t, options["query"], cursor)
        number = lambda s: ((s.get("protocolSection") or {}).get("identificationModule") or {}).get("nctId")
        return page | {"results": [s | {"id": number(s)} for s in page["results"]]}

    return fetch


def pubmed_pages(options: dict) -> Callable[[str], dict]:
    """For the ``pages`` option of ``monthly_records``."""
    t = made(options.get("transport", "quillmill.sources.rest:online"))
    return lambda cursor: month_page(t, options["query"], cursor)


NOTES = "array<struct<source: string, url: string, status: int, elapsed: double>>"


def lookup_table(keys: DataFrame, source: str, transport: str = "quillmill.sources.rest:online", tasks: int = 1, notes: bool = False) -> DataFrame:
    """(source, key, status, response) of each distinct non-empty ``key``, and with ``notes`` the requests that it took.

    Services limit requests a host, so ``tasks`` stays small. Once a budget is
    spent the rest of a task is left out, with the status ``budget``.
    """
    columns = ["source", "key", "status", "response", *(["notes"] if notes else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, spent, noted = made(transport), False, []
        t.observer = noted.append
        for batch in batches:
            rows = []
            for key in batch["key"]:
                status, found = "budget", None
                if not spent:
                    try:
                        found = LOOKUPS[source](t, key)
                        status = "ok"
                    except NotFound:
                        status = "not_found"
                    except BudgetExhausted:
                        spent = True
                    except (TransportError, ValueError) as error:
                        status = type(error).__name__
                asked = [{"source": n["source"], "url": n["url"], "status": n["status"], "elapsed": n["elapsed"]} for n in noted]
                noted.clear()
                rows.append((source, key, status, None if found is None else json.dumps(found, ensure_ascii=False), asked)[: len(columns)])
            yield pd.DataFrame(rows, columns=columns)

    wanted = keys.select("key").where(F.coalesce("key", F.lit("")) != "").distinct().repartition(tasks)
    return wanted.mapInPandas(run, "source string, key string, status string, response string" + (f", notes {NOTES}" if notes else ""))
