"""Remote sources: pages of JSON as a data source, answers to queries, and files that are fetched in tasks.

Everything is asked for again, a few times and ever later, when a server fails, cuts an answer short or answers for
something else; what a retried task asks for again gives the same rows.
"""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusflow.runtime import ship

#: Tries of a request, the pause before the second in seconds (it doubles), and the longest wait for an answer.
TRIES, PAUSE, TIMEOUT = 5, 0.5, 60

#: Bytes that are read at a time.
BLOCK = 1 << 16


def attempt(action: Callable, tries: int = TRIES, pause: float = PAUSE):
    """What ``action`` returns, after up to ``tries`` tries; requests that can never succeed (4xx but 408 and 429) fail at once."""
    for k in range(tries):
        try:
            return action()
        except urllib.error.HTTPError as e:
            if k + 1 == tries or (400 <= e.code < 500 and e.code not in (408, 429)):
                raise
        except (OSError, ValueError, http.client.HTTPException):  # no connection, or an answer that is not what was asked for
            if k + 1 == tries:
                raise
        time.sleep(pause * 2**k)


def request(url: str, data: bytes | None = None, headers: dict[str, str] | None = None, timeout: float = TIMEOUT) -> bytes:
    """The whole answer; one that is shorter than announced raises OSError."""
    with urllib.request.urlopen(urllib.request.Request(url, data, headers or {}), timeout=timeout) as answer:
        body, said = answer.read(), answer.headers.get("Content-Length")
        if said is not None and len(body) != int(said):
            raise OSError(f"{url}: {len(body)} bytes of {said}")
        return body


@dataclass
class Pages(InputPartition):
    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.items, self.total = options["url"], options.get("items", "items"), options.get("total", "total")
        self.param, self.number = options.get("pageparam", "page"), options.get("number", "page")
        self.size, self.splits = int(options.get("pagesize", "100")), int(options.get("splits", "64"))
        self.size_param, self.pause = options.get("sizeparam", "page_size"), float(options.get("pause", str(PAUSE)))

    def page(self, number: int) -> dict:
        asked = urllib.parse.urlencode({self.param: number, self.size_param: self.size})
        url = f"{self.url}{'&' if '?' in self.url else '?'}{asked}"

        def once() -> dict:
            got = json.loads(request(url))
            if got.get(self.number, number) != number:
                raise ValueError(f"{url}: the answer is page {got[self.number]}")
            if not isinstance(got.get(self.items), list):
                raise ValueError(f"{url}: no list {self.items}")
            full = min(self.size, max(0, got[self.total] - (number - 1) * self.size)) if self.total in got else None
            if full is not None and len(got[self.items]) < full:
                raise ValueError(f"{url}: {len(got[self.items])} of {full} rows")
            return got

        return attempt(once, pause=self.pause)

    def partitions(self) -> list[Pages]:
        pages = max(1, -(-int(self.page(1)[self.total]) // self.size))
        each = -(-pages // self.splits)
        return [Pages(k, min(pages, k + each - 1)) for k in range(1, pages + 1, each)]

    def read(self, partition: Pages) -> Iterator[tuple[int, int, str]]:
        for number in range(partition.first, partition.last + 1):
            for k, item in enumerate(self.page(number)[self.items]):
                yield number, k, json.dumps(item, sort_keys=True, ensure_ascii=False)


class PagedJson(DataSource):
    """Format ``paged_json``: (page, ord, value) of the rows that a server gives page by page, each as JSON.

    Options: url; items, total, number (the answer's keys of its rows, of the count of all, and of its page); pageParam,
    pageSize and sizeParam (of the request); splits (partitions at most); pause.  A page that is short, or another than
    the one that was asked for, is asked for again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, ord int, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, url: str, schema: str, key: tuple[str, ...] = (), **options) -> DataFrame:
    """Rows of a paged server by ``schema``; of rows with the same ``key``, as pages that shifted bring them, the first."""
    ship(spark)
    spark.dataSource.register(PagedJson)
    got = spark.read.format("paged_json").options(url=url, **options).load()
    rows = got.select("page", "ord", F.from_json("value", schema).alias("row")).where("row is not null")
    if key:
        rows = rows.groupBy(F.struct(*[F.col(f"row.{k}") for k in key]).alias("k")).agg(F.min_by("row", F.struct("page", "ord")).alias("row"))
    return rows.select("row.*")


def ask(queries: DataFrame, endpoint: str, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """(id, ord, binding map, error) of SPARQL queries (id, query): a row for each solution, or one with the error.

    Queries are posted, as a long sequence makes an address too long; one without a solution gives no row.  Tasks ask
    for their own rows, so deal ``queries`` over as many partitions as the server should see at once.
    """
    ship(queries.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        headers = {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"}
        for batch in batches:
            out = []
            for key, query in zip(batch["id"], batch["query"], strict=True):
                try:
                    body = urllib.parse.urlencode({"query": query, "format": "json"}).encode()
                    found = attempt(lambda body=body: json.loads(request(endpoint, body, headers))["results"]["bindings"], tries, pause)
                    out += [(key, k, {n: v["value"] for n, v in b.items()}, None) for k, b in enumerate(found)]
                except (OSError, ValueError, KeyError, http.client.HTTPException) as e:
                    out.append((key, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "ord", "binding", "error"])

    rows = queries.select(F.col("id").cast("string").alias("id"), "query")
    return rows.mapInPandas(run, "id string, ord int, binding map<string,string>, error string")


def exact_protein_query(protein: Column) -> Column:
    """The query for entries with exactly this protein: submitted and recommended names of the entry, label of the sequence."""
    text = F.concat(F.lit('"'), F.regexp_replace(protein, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.concat(
        F.lit("PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX up: <http://purl.uniprot.org/core/> SELECT ?seq ?fname ?sname2 ?label WHERE { { ?body a up:Simple_Sequence ; rdf:value "),
        text,
        F.lit(" . ?seq up:sequence ?body . OPTIONAL { ?seq up:submittedName/up:fullName ?sname2 } OPTIONAL { ?seq up:recommendedName/up:fullName ?fname } } UNION { ?seq a up:Sequence ; rdfs:label ?label ; rdf:value "),
        text,
        F.lit(" } }"),
    )


def remote_names(proteins: DataFrame, endpoint: str, at_once: int = 8, **retry) -> tuple[DataFrame, DataFrame]:
    """((id, name, ord, url) of all entries, (id, error) of failed queries) for (id, protein): a query for each distinct protein.

    A name is the recommended one, else the submitted one, else the label; lookup_names() of annotate picks among them.
    """
    from locusflow.runtime import Stage

    keyed = proteins.select("id", F.sha2("protein", 256).alias("h"), "protein")
    distinct = keyed.groupBy("h").agg(F.first("protein").alias("protein")).repartition(at_once, "h")
    got = Stage(proteins.sparkSession).write(ask(distinct.select(F.col("h").alias("id"), exact_protein_query(F.col("protein")).alias("query")), endpoint, **retry), "answers")
    b = F.col("binding")
    name = F.coalesce(b["fname"], b["sname2"], b["label"])
    named = got.where("error is null").select(F.col("id").alias("h"), name.alias("name"), "ord", b["seq"].alias("url")).where("name is not null")
    ids = keyed.select("id", "h")
    return ids.join(named, "h").drop("h"), ids.join(got.where("error is not null").select(F.col("id").alias("h"), "error"), "h").drop("h")


def proteome_urls(proteomes: DataFrame, base: str) -> DataFrame:
    """(name, url) of the compressed reference proteomes in (proteome, taxon, kingdom), as the archive lays them out."""
    name = F.concat("proteome", F.lit("_"), "taxon", F.lit(".fasta.gz"))
    kingdom = F.concat(F.upper(F.substring("kingdom", 1, 1)), F.expr("substring(kingdom, 2)"))
    return proteomes.select(name.alias("name"), F.concat_ws("/", F.lit(base.rstrip("/")), kingdom, "proteome", name).alias("url"))


def _fetch(url: str, files: FileSystem, part: str, pause: float) -> tuple[int, int]:
    """(bytes, requests): the file at ``url``, written to ``part``; a broken transfer goes on where it broke."""
    asked = 0
    with files.open_output_stream(part) as out:

        def once() -> None:
            nonlocal asked
            asked += 1
            at = out.tell()
            wanted = urllib.request.Request(url, headers={"Range": f"bytes={at}-"} if at else {})
            with urllib.request.urlopen(wanted, timeout=TIMEOUT) as answer:
                said = answer.headers.get("Content-Length")
                skip = at if at and answer.status != 206 else 0  # the server began anew: what is there already is passed over
                end = None if said is None else int(said) + at - skip
                while block := answer.read(BLOCK):
                    out.write(block[skip:])
                    skip = max(0, skip - len(block))
            if end is not None and out.tell() != end:
                raise OSError(f"{url}: {out.tell()} bytes of {end}")

        attempt(once, pause=pause)
        return out.tell(), asked


def download(urls: DataFrame, folder: str, at_once: int = 8, pause: float = PAUSE) -> DataFrame:
    """(name, path, size, requests, error) of files (name, url) that tasks fetch into a shared folder, in blocks.

    A file appears under its name when it is whole; a task that runs again replaces it by the same.  Write the result
    before use: reading it is what fetches.  Of rows with the same name the one with the least url is fetched.
    """
    ship(urls.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = folder.startswith("file:") or "://" not in folder
        files, root = (LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, url in zip(batch["name"], batch["url"], strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                try:
                    size, asked = _fetch(url, files, part, pause)
                    files.move(part, f"{root}/{name}")
                    out.append((name, f"{folder.rstrip('/')}/{name}", size, asked, None))
                except (OSError, http.client.HTTPException) as e:
                    files.delete_file(part)
                    out.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "path", "size", "requests", "error"]).astype({"size": "Int64", "requests": "Int64"})

    first = F.row_number().over(Window.partitionBy("name").orderBy("url"))
    dealt = urls.withColumn("_n", first).where("_n = 1").select("name", "url").repartition(at_once, "name")
    return dealt.mapInPandas(run, "name string, path string, size long, requests long, error string")
