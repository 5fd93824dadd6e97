import gzip
import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from locusflow import cli
from locusflow.operators import annotate
from locusflow.sources import fasta, remote

SPECIES = [{"species": f"s{i % 2}", "schema": f"x{i}", "nr_loci": i, "nr_alleles": 10 * i} for i in range(5)]
ALLELES = [{"locus": "l", "allele_id": str(i), "is_local": False, "dna": "ATG", "inserted_at": f"2020-0{i}-01 00:00:00"} for i in range(1, 6)]
ROWS = [{"id": i, "name": f"sp{i}é"} for i in range(57)]
FILE = gzip.compress(b"".join(b">sp|P%d|X 5'->3' exonuclease\nMKV\n" % i for i in range(30_000)), mtime=0)


class Server(BaseHTTPRequestHandler):
    """Fails, cuts short, answers with other pages and repeats rows: each once for an address, then behaves."""

    seen: Counter = Counter()

    def log_message(self, *args):
        pass

    def answer(self, body, code=200, said=None):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body) if said is None else said))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        url = urllib.parse.urlsplit(self.path)
        asked = dict(urllib.parse.parse_qsl(url.query))
        Server.seen[self.path] += 1
        first = Server.seen[self.path] == 1
        if url.path.startswith("/files/"):
            at = int((self.headers.get("Range") or "bytes=0-").split("=")[1][:-1])
            if "anew" in url.path:
                return self.answer(FILE[: len(FILE) // 2 if first else None], said=len(FILE))
            if "none" in url.path:
                return self.answer(b"", 404)
            rest = FILE[at:]
            return self.answer(rest[: len(rest) // 2 if Server.seen[self.path] < 4 else None], 206 if at else 200, len(rest))
        page, size = int(asked["page"]), int(asked["page_size"])
        table = {"/species": SPECIES, "/alleles": ALLELES}.get(url.path, ROWS)
        lists = table[max(0, (page - 1) * size - ("shift" in url.path)) : page * size]
        if url.path == "/none":
            lists = []
        total = 0 if url.path == "/none" else len(table)
        body = json.dumps({"page": page - (first and page == 3), "total": total, "items": lists[: -1 if first and page == 2 else None]}).encode()
        if first and page == 4:
            return self.answer(b"", 503)
        self.answer(body[: len(body) // 2 if first and page == 5 else None], said=len(body))

    def do_POST(self):
        query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        Server.seen[query] += 1
        if Server.seen[query] == 1:
            return self.answer(b"", 500)
        if '"MBAD"' in query:
            return self.answer(b"", 400)
        value = lambda x: {"type": "literal", "value": x}
        found = [] if '"MNONE"' in query else [{"seq": value("u/1"), "sname2": value("hypothetical protein")}, {"seq": value("u/2"), "fname": value("Kinase"), "label": value("x")}]
        self.answer(json.dumps({"results": {"bindings": found}}).encode())


@pytest.fixture()
def server():
    Server.seen = Counter()
    got = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=got.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{got.server_port}"
    got.shutdown()
    got.server_close()


@pytest.mark.parametrize("path", ["rows", "shift"])
def test_pages(spark, server, path):
    got = remote.read_pages(spark, f"{server}/{path}?kind=all", "id int, name string", key=("id",), pageSize=10, splits=3, pause=0.01)
    assert sorted(map(tuple, got.collect())) == [(r["id"], r["name"]) for r in ROWS]
    assert spark.read.format("paged_json").options(url=f"{server}/rows", pageSize=10, splits=3, pause=0.01).load().rdd.getNumPartitions() == 3


def test_pages_empty_and_missing(spark, server):
    assert remote.read_pages(spark, f"{server}/none", "id int", pause=0.01).count() == 0
    with pytest.raises(Exception, match="HTTP Error 404|404"):
        remote.read_pages(spark, f"{server}/files/none", "id int", pause=0.01).count()


def test_names_of_proteins(spark, server):
    proteins = spark.createDataFrame([("a", "MK"), ("b", "MK"), ("c", "MNONE"), ("d", "MBAD")], "id string, protein string")
    names, failed = remote.remote_names(proteins, f"{server}/sparql", pause=0.01)
    best = annotate.informative_name(names, by="id")
    assert sorted(map(tuple, best.collect())) == [("a", "Kinase"), ("b", "Kinase")]
    assert [r["id"] for r in failed.collect()] == ["d"]
    asked = Server.seen[next(q for q in Server.seen if '"MK"' in q)]
    assert asked == 2  # one query for both rows, asked again once


def test_query_text(spark):
    row = spark.createDataFrame([('M"\\',)], "p string").select(remote.exact_protein_query(remote.F.col("p"))).first()
    assert row[0].count('"M\\"\\\\"') == 2


def test_download(spark, server, tmp_path):
    urls = spark.createDataFrame([("x.fasta.gz", f"{server}/files/x"), ("y.fasta.gz", f"{server}/files/anew"), ("z", f"{server}/files/none")], "name string, url string")
    for _ in range(2):
        got = {r["name"]: r for r in remote.download(urls, f"file:{tmp_path}/in", pause=0.01).collect()}
    assert (tmp_path / "in/x.fasta.gz").read_bytes() == FILE == (tmp_path / "in/y.fasta.gz").read_bytes()
    assert got["z"]["path"] is None and "404" in got["z"]["error"] and got["x.fasta.gz"]["size"] == len(FILE)
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == ["x.fasta.gz", "y.fasta.gz"]
    assert fasta.read_fasta(spark, got["x.fasta.gz"]["path"]).where("header like '%5''->3''%'").count() == 30_000


def test_download_resumes(spark, server, tmp_path):
    urls = spark.createDataFrame([("x", f"{server}/files/x")], "name string, url string")
    row = remote.download(urls, str(tmp_path), pause=0.01).first()
    assert row["requests"] == 4 and (tmp_path / "x").read_bytes() == FILE


def test_proteome_urls(spark):
    rows = spark.createDataFrame([("UP1", 5, "bacteria")], "proteome string, taxon int, kingdom string")
    assert tuple(remote.proteome_urls(rows, "https://x/y/").first()) == ("UP1_5.fasta.gz", "https://x/y/Bacteria/UP1/UP1_5.fasta.gz")


def test_command_line(spark, server, tmp_path):
    assert cli.main(["NSStats", "-i", f"{server}/species", "-o", f"{tmp_path}/stats"]) == 0
    assert sorted(map(tuple, fasta.read_table(spark, f"{tmp_path}/stats").collect())) == [("s0", "3", "6", "60"), ("s1", "2", "4", "40")]
    assert cli.main(["DownloadSchema", "-i", f"{server}/alleles", "--date", "2020-03-01", "-o", f"{tmp_path}/alleles"]) == 0
    assert sorted(r["allele_id"] for r in spark.read.parquet(f"{tmp_path}/alleles").collect()) == ["1", "2", "3"]
