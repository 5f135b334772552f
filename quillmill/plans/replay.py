"""Services that answer from tables or by rule, so that readers and lookups run anywhere.

``Tables`` pages through the driver's tables: ``works``, ``trials`` and
``months`` write them to a folder as pages of records, or as records by month,
and readers are pointed at it. ``Service`` has an answer for every key that ends
in an even digit; odd ones are unknown.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote, urlsplit

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import partitions
from quillmill.sources import files, rest
from quillmill.sources.transport import Transport

#: Pages of a table at least, and rows of a page at most.
PAGES, PAGE_ROWS = 6, 5000


@dataclass
class Answer:
    text: str
    status_code: int = 200
    headers: dict = field(default_factory=dict)


def given(found: object) -> Answer:
    return Answer(json.dumps(found))


def listed(name: str, lines: list[str], rest: dict) -> Answer:
    """A list of records that are text already, and what else is said."""
    return Answer(f'{{"{name}": [{",".join(lines)}], {json.dumps(rest)[1:]}' if rest else f'{{"{name}": [{",".join(lines)}]}}')


def dated(line: str) -> str:
    """The publication date of a line, as ``to_json`` writes it."""
    return line.partition('"publication_date":"')[2][:10]


class Service:
    def get(self, url: str, headers: dict) -> Answer:
        at = urlsplit(url)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        path = unquote(at.path)
        if path.endswith("esearch.fcgi"):
            key = q["term"].removesuffix("[DOI]")
            return given({"esearchresult": {"idlist": [key] if self.known(key) else [], "count": "1"}})
        if path.endswith("efetch.fcgi"):
            each = "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>P {i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for i in q["id"].split(","))
            return Answer(f"<PubmedArticleSet>{each}</PubmedArticleSet>")
        if path.endswith("/search"):
            key = q["query"].split('"')[1]
            return given({"resultList": {"result": [{"title": f"E {key}"}] if self.known(key) else []}})
        if "/synonyms/" in path:
            return given({"InformationList": {"Information": [{"Synonym": ["a name", "1314-13-2"]}]}})
        key = path.removesuffix("/cids/JSON").rpartition("/")[2].removeprefix("DOI:")
        if not self.known(key):
            return Answer("{}", 404)
        if "/cids/" in path:
            return given({"IdentifierList": {"CID": [int(key.lstrip("d"))]}})
        if path.startswith("/works/"):
            return given({"message": {"title": [f"C {key}"]}})
        return given({"title": f"T {key}", "doi": key, "is_oa": True})

    @staticmethod
    def known(key: str) -> bool:
        return key[-1:].isdigit() and int(key[-1]) % 2 == 0


def transport() -> Transport:
    return Transport(Service(), rest.POLICIES, sleep=lambda s: None)


def write_pages(rows: DataFrame, number: Column, folder: str) -> str:
    """Writes the text column ``line`` as pages, dealt by ``number`` in turn; as many as PAGES and PAGE_ROWS ask for."""
    total = rows.count()
    pages = max(PAGES, -(-total // PAGE_ROWS))
    dealt = rows.select("line", F.pmod(number, F.lit(pages)).alias("page"), number.alias("__n"))
    dealt.repartition(min(pages, partitions(rows.sparkSession, total)), "page").sortWithinPartitions("page", "__n").drop("__n").write.partitionBy("page").text(folder)
    files.write_text(rows.sparkSession, f"{folder}/_meta.json", json.dumps({"pages": pages, "total": total}))
    return folder


def write_month_pages(rows: DataFrame, number: Column, folder: str) -> str:
    """Writes (month, line) as pages of a month each, dealt by ``number``; some PAGE_ROWS lines a page, so no task holds a month."""
    counts = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect() if r["month"]}  # a row a month
    chunks, total = {m: -(-n // PAGE_ROWS) for m, n in counts.items()}, sum(counts.values())
    spark = rows.sparkSession
    sizes = spark.createDataFrame(list(chunks.items()), "month string, chunks long")
    dealt = rows.select("line", "month", number.alias("__n")).join(F.broadcast(sizes), "month").select("line", "month", F.pmod("__n", "chunks").alias("chunk"))
    dealt.repartition(partitions(spark, total), "month", "chunk").write.partitionBy("month", "chunk").text(folder)
    files.write_text(spark, f"{folder}/_meta.json", json.dumps({"months": chunks, "total": total}))
    return folder


def write_months(rows: DataFrame, folder: str) -> str:
    """Writes (month, line) as a folder for each month, in chunks of PAGE_ROWS, and how many lines each has."""
    place = F.row_number().over(Window.partitionBy("month").orderBy("line")) - 1
    placed = rows.select("line", "month", place.alias("__n")).withColumn("chunk", F.floor(F.col("__n") / PAGE_ROWS))
    placed.sortWithinPartitions("month", "chunk", "__n").drop("__n").write.partitionBy("month", "chunk").text(folder)
    counts = {r["month"]: r["count"] for r in rows.groupBy("month").count().collect()}  # a row a month
    files.write_text(rows.sparkSession, f"{folder}/_meta.json", json.dumps(counts))
    return folder


class Tables(Service):
    """Answers from a folder that ``write_pages`` or ``write_months`` has written, wherever it lies."""

    def __init__(self, folder: str):
        self.read, self.known = ("", []), None
        self.fs, self.top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def _lines(self, part: str) -> list[str]:
        """The lines of a folder; those of the last one are kept."""
        if part == self.read[0]:
            return self.read[1]
        found = []
        for f in sorted(self.fs.get_file_info(fs.FileSelector(f"{self.top}/{part}", allow_not_found=True)), key=lambda f: f.path):
            if f.base_name.startswith("part-"):
                with self.fs.open_input_stream(f.path) as stream:
                    found += [x for x in stream.read().decode().split("\n") if x]
        self.read = part, found
        return found

    def _meta(self) -> dict:
        if self.known is None:
            with self.fs.open_input_stream(f"{self.top}/_meta.json") as stream:
                self.known = json.loads(stream.read())
        return self.known

    def get(self, url: str, headers: dict) -> Answer:
        at = urlsplit(url)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        if at.path == "/works" and "cursor" in q:
            return self.works(q)
        if at.path == "/works":
            return self.years(q)
        if at.path == "/api/v2/studies":
            page, pages = int(q.get("pageToken", 0)), self._meta()["pages"]
            return listed("studies", self._lines(f"page={page}"), {"nextPageToken": str(page + 1)} if page + 1 < pages else {})
        if at.path.endswith("esearch.fcgi"):
            month, start = q["mindate"][:7].replace("/", "-"), int(q.get("retstart", 0))
            total = self._meta().get(month, 0)
            end, held = min(start + int(q["retmax"]), total), []
            for chunk in range(start // PAGE_ROWS, -(-end // PAGE_ROWS)):
                held += self._lines(f"month={month}/chunk={chunk}")[max(start - chunk * PAGE_ROWS, 0) : end - chunk * PAGE_ROWS]
            return given({"esearchresult": {"idlist": [json.loads(x)["pmid"] for x in held], "count": str(total)}})
        return super().get(url, headers)

    def _dated(self, q: dict) -> tuple[str, str]:
        asked = dict(x.partition(":")[::2] for x in q["filter"].split(","))
        return asked["from_publication_date"], asked["to_publication_date"]

    def works(self, q: dict) -> Answer:
        """The next page that has works of the dates asked for."""
        first, last = self._dated(q)
        parts, page, held = self._parts(first, last), 0 if q["cursor"] == "*" else int(q["cursor"]), []
        while not held and page < len(parts):
            held = [w for w in self._lines(parts[page]) if first <= dated(w) <= last]
            page += 1
        return listed("results", held, {"meta": {"next_cursor": str(page) if page < len(parts) else None, "count": self._meta()["total"]}})

    def _parts(self, first: str, last: str) -> list[str]:
        """Folders of the pages that may have works of these dates."""
        meta = self._meta()
        if "months" in meta:
            return [f"month={m}/chunk={c}" for m, n in sorted(meta["months"].items()) if first[:7] <= m <= last[:7] for c in range(n)]
        return [f"page={p}" for p in range(meta["pages"])]

    def years(self, q: dict) -> Answer:
        first, last = self._dated(q)
        counts: dict[str, int] = {}
        for page in range(self._meta()["pages"]):
            for date in map(dated, self._lines(f"page={page}")):
                if first <= date <= last:
                    counts[date[:4]] = counts.get(date[:4], 0) + 1
        return given({"group_by": [{"key": k, "count": n} for k, n in counts.items()]})


def tables(folder: str) -> Transport:
    return Transport(Tables(folder), rest.POLICIES, sleep=lambda s: None)


class Failing(Tables):
    """Refuses the articles of a month's first id, which the folder's name ends with."""

    def __init__(self, folder: str):
        super().__init__(folder.rpartition("!")[0])
        self.refused = folder.rpartition("!")[2]

    def get(self, url: str, headers: dict) -> Answer:
        if "efetch" in url and any(i.startswith(self.refused) for i in parse_qs(urlsplit(url).query)["id"][0].split(",")):
            return Answer("{}", 400)
        return super().get(url, headers)


def failing(folder: str) -> Transport:
    return Transport(Failing(folder), rest.POLICIES, sleep=lambda s: None)
