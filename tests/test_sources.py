import http.server
import io
import os
import re
import tarfile
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from filingspark import cli
from filingspark.operators.compare import assert_agree
from filingspark.operators.extract import extract
from filingspark.sources import archives as A
from filingspark.sources import http as H
from filingspark.sources import names as N
from filingspark.sources.datasource import read_binary_files, read_filings
from filingspark.sources.tables import read_facts, write_facts

DOC = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:c="urn:c"><ix:nonNumeric name="c:A">{}</ix:nonNumeric></html>'


def doc(x) -> bytes:
    return DOC.format(x).encode()


@pytest.mark.parametrize("source,kind", [("a.ZIP?x=1", N.ZIP), ("a.tar.zst", N.TAR_ZST), ("b.zst", N.TAR_ZST), ("x.tar", N.TAR), ("http://h/f.xhtml#a", N.INSTANCE), ("http://h/get?f=a.zip", N.ZIP), ("plain", N.UNKNOWN)])
def test_format(source, kind):
    assert N.detect_format(source) == kind


@pytest.mark.parametrize("head,kind", [(b"\x1f\x8b", N.UNKNOWN), (b"\x28\xb5\x2f\xfd", N.TAR_ZST), (b"PK\x03\x04", N.ZIP), (b"PK\x09\x04", N.UNKNOWN), (b"\0" * 257 + b"ustar", N.TAR), (b"\xef\xbb\xbf \n<a", N.INSTANCE), (b"", N.UNKNOWN), (b"abc", N.UNKNOWN)])
def test_sniff(head, kind):
    assert N.sniff(head) == kind


PACKAGES = [
    (["Prod1_html.html", "b.xml"], N.BULK, [], False),
    (["META-INF/reportPackage.json", "reports/x.xhtml", "reports/x.svg"], N.REPORT, ["reports/x.xhtml"], True),
    (["STLD/META-INF/t.xml", "STLD/reports/r.xhtml"], N.REPORT, ["STLD/reports/r.xhtml"], True),
    (["S/reports/top.xhtml", "S/reports/e/no.xhtml"], N.REPORT, ["S/reports/top.xhtml"], True),
    (["S/reports/set/a.xhtml", "S/reports/set/b.html", "S/reports/set/n.txt"], N.REPORT, ["S/reports/set/a.xhtml", "S/reports/set/b.html"], True),
    (["S/reports/set/a.xhtml", "S/reports/set/b.xbrl", "S/reports/d/e/f.xhtml"], N.REPORT, [], True),
    (["META-INF/reportPackage.json", "reports/data.json"], N.REPORT, [], True),
    (["CIC-10878733/accounts/f.xhtml", "CIC-10878733/cic34/c.xhtml"], N.FILING, ["CIC-10878733/accounts/f.xhtml"], False),
    (["AUDITEXEMPT-13515245/consolidated-accounts/g.html", "AUDITEXEMPT-13515245/subsidiary-accounts/s.html"], N.FILING, ["AUDITEXEMPT-13515245/subsidiary-accounts/s.html"], False),
    (["OVERSEAS-FC041186/english-accounts/e.xhtml", "OVERSEAS-FC041186/accounts/o.xhtml"], N.FILING, ["OVERSEAS-FC041186/english-accounts/e.xhtml"], False),
    (["CIC-05016384/Accounts/o.html", "CIC-05016384/parent-accounts/p.xhtml"], N.FILING, ["CIC-05016384/Accounts/o.html"], False),
    (["CIC-00000001/cic34/only.xhtml"], N.FILING, [], False),
]


@pytest.mark.parametrize("names,kind,files,ukfrs", PACKAGES)
def test_packages(names, kind, files, ukfrs):
    got = N.select_package(names)
    assert (got.kind, got.files, got.only_ukfrs) == (kind, files, ukfrs)


def zip_of(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("filings")
    os.makedirs(root / "docs/sub")
    files = {f"Prod100_1_0000000{i}_20240101.html": doc(i) for i in range(7)}
    for n, d in files.items():
        (root / "docs" / n).write_bytes(d)
    (root / "docs/.hidden.html").write_bytes(doc("no"))
    (root / "docs/sub/deep.html").write_bytes(doc("no"))
    (root / "docs/note.txt").write_bytes(b"no")
    A.pack_zip(files, str(root / "all.zip"), prefix="./x/")
    A.pack_tar_zst({"./" + n: d for n, d in files.items()}, str(root / "all.tar.zst"))
    with tarfile.open(root / "all.tar", "w") as t:
        for n in files:
            t.add(root / "docs" / n, arcname=n)
    return root


def test_same_facts_by_every_route(spark, folder):
    routes = {n: extract(read_filings(spark, str(folder / p))) for n, p in (("dir", "docs"), ("zip", "all.zip"), ("tar", "all.tar"), ("tarzst", "all.tar.zst"))}
    routes["binary"] = extract(read_binary_files(spark, str(folder / "docs")))
    assert assert_agree(routes).first().status.startswith("ok")
    with pytest.raises(Exception, match="mismatch"):
        assert_agree({"dir": routes["dir"], "less": routes["zip"].where("value <> '3'")}).collect()


def test_nested_zips_and_limits(spark, folder):
    inner = zip_of({"CIC-10878733/accounts/f.xhtml": doc("pack"), "CIC-10878733/cic34/c.xhtml": doc("no")})
    members = {"pkg.zip": inner, "ixbrl.zip": doc("named zip"), "bad.zip": b"junk", "loose.zip": zip_of({"accounts/a.html": doc("acc"), "b.html": doc("no")}), "none.zip": zip_of({"META-INF/reportPackage.json": b"{}"}),
               "__MACOSX/x.html": doc("no"), "big.html": doc("x" * 5000), "ok.html": doc("ok")}
    path = folder / "nested.zip"
    path.write_bytes(zip_of(members))
    rows = {(r.source_file, r.error) for r in read_filings(spark, str(path), limit="3000", rangeBytes="400").collect()}
    assert rows == {("pkg.zip", None), ("ixbrl.zip", None), ("bad.zip", A.BAD_ZIP), ("loose.zip", None), ("none.zip", A.NO_REPORTS), ("big.html", A.TOO_BIG), ("ok.html", None)}
    report = folder / "report.zip"
    report.write_bytes(zip_of({"META-INF/reportPackage.json": b"{}", "reports/r.xhtml": doc("r")}))
    assert [(r.source_file, r.only_ukfrs) for r in read_filings(spark, str(report)).collect()] == [("report.zip", True)]


def test_corrupt_member_stops_the_read(spark, folder):
    data = bytearray(zip_of({"a.html": doc("x" * 50)}))
    data[45] ^= 0xFF
    (folder / "corrupt.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="read a.html|checksum|inflate"):
        read_filings(spark, str(folder / "corrupt.zip")).collect()


def test_range_batches():
    e = [A.Entry(f"{i}", s, f, f - s, 0, 0, 0) for i, (s, f) in enumerate([(0, 10), (10, 30), (500, 510), (510, 600), (600, 700)])]
    assert [[x.name for x in b] for b in A.batches(e, target=100, most=150, gap=50)] == [["0", "1"], ["2", "3"], ["4"]]


class Handler(http.server.BaseHTTPRequestHandler):
    files: dict[str, bytes] = {}
    failures: list[int] = []
    requests: list[str] = []

    def do_HEAD(self):
        self.do_GET(body=False)

    def do_GET(self, body=True):
        type(self).requests.append(f"{self.command} {self.headers.get('Range')}")
        if self.failures:
            self.send_error(self.failures.pop(0))
            return
        data = self.files.get(self.path)
        if data is None:
            self.send_error(404)
            return
        m = re.match(r"bytes=(\d+)-(\d+)", self.headers.get("Range") or "")
        part = data[int(m[1]) : int(m[2]) + 1] if m else data
        self.send_response(206 if m else 200)
        if m:
            self.send_header("Content-Range", f"bytes {m[1]}-{m[2]}/{len(data)}")
        if self.path == "/named":
            self.send_header("Content-Disposition", 'attachment; filename="served.html"')
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        if body:
            self.wfile.write(part)

    def log_message(self, *a):
        pass


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(H, "FIRST_DELAY", 0.001)
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Handler.failures, Handler.requests = [], []
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_remote(spark, folder, server):
    Handler.files = {"/all.zip": (folder / "all.zip").read_bytes(), "/one.html": doc("one"), "/named": doc("n"), "/t.tar.zst": (folder / "all.tar.zst").read_bytes()}
    assert {r.source_file for r in read_filings(spark, f"{server}/all.zip").collect()} == set(os.listdir(folder / "docs")) - {".hidden.html", "sub", "note.txt"}
    assert len(Handler.requests) <= 6
    assert [r.source_file for r in read_filings(spark, f"{server}/one.html").collect()] == ["one.html"]
    assert [r.source_file for r in read_filings(spark, f"{server}/named").collect()] == ["served.html"]
    assert read_filings(spark, f"{server}/t.tar.zst").count() == 7


def test_retries(server):
    Handler.files = {"/x": b"abc"}
    Handler.failures = [429, 503]
    assert H.request(f"{server}/x")[0] == b"abc"
    Handler.failures, Handler.requests = [403], []
    with pytest.raises(Exception, match="403"):
        H.request(f"{server}/x")
    assert len(Handler.requests) == 1
    Handler.failures = [500] * 9
    with pytest.raises(ConnectionError):
        H.request(f"{server}/x")


def test_csv_round_trip(spark, tmp_path):
    rows = [("2020-01-01", "", "A", 'x "q", y\nz', "", "", "", "f.html", "0")]
    df = spark.createDataFrame(rows, ["period_start", "period_end", "concept", "value", "unit", "dimensions", "namespace", "source_file", "decimals"])
    write_facts(df, str(tmp_path / "f"), single=True)
    assert [r.value for r in read_facts(spark, str(tmp_path / "f")).collect()] == ['x "q", y\nz']


CODES = [(10, 0, None, False, 0), (9, 1, None, False, 1), (0, 3, None, False, 1), (0, 0, None, False, 1), (10, 0, ValueError(), False, 1), (4, 0, KeyboardInterrupt(), False, 130), (9, 1, None, True, 0), (0, 3, None, True, 1), (0, 0, None, True, 1), (10, 0, ValueError(), True, 1), (4, 0, KeyboardInterrupt(), True, 130)]


@pytest.mark.parametrize("ok,err,error,go_on,want", CODES)
def test_exit_code(ok, err, error, go_on, want):
    assert cli.exit_code(ok, err, error, go_on) == want


def test_command_line(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda workers=None: spark)
    out = tmp_path / "facts.csv"
    assert cli.main(["extract", "-o", str(out), str(folder / "all.zip")]) == 0
    assert len(out.read_text().splitlines()) == 8
    (tmp_path / "empty").mkdir()
    assert cli.main(["extract", "-o", str(out), str(tmp_path / "empty")]) == 1
    assert out.read_text() == ""
    assert cli.main(["pack", "-dir", str(folder / "docs"), "-out", str(tmp_path / "p.tar.zst")]) == 0
    args = cli.parser().parse_args(["extract", "-o", str(out), "-"])
    assert cli.extract(args, stdin=io.BytesIO((tmp_path / "p.tar.zst").read_bytes())) == 0
    assert cli.extract(args, stdin=io.BytesIO((folder / "all.zip").read_bytes())) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["extract"])
    assert e.value.code == cli.USAGE


def test_streaming(spark, folder, tmp_path):
    from filingspark.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    for i in range(3):
        (src / f"d{i}.html").write_bytes(doc(i))
    run = lambda: ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    run()
    (src / "d3.html").write_bytes(doc(3))
    run()
    assert spark.read.parquet(str(tmp_path / "out/facts")).select(F.count_distinct("source_file"), F.count("value")).first()[:] == (4, 4)
