"""The command line over small files, and a remote parser over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from almanac.__main__ import arguments, main
from almanac.operators import query

OUTLINE = "Course No. : CS F111\nCourse Title : Programming\n3. Evaluation Scheme:\nComponent   Duration   Weightage   Remarks\nMid-Semester Test   90 min   40   Closed Book\nComprehensive Exam   3 h   60   Open Book\n"
strict = bytes.decode

def test_arguments():
    assert arguments(["outlines", "--root", "x", "--limit", "2"]).limit == 2
    for wrong in (["outlines", "--root", "x", "--limit", "0"], ["build"], []):
        with pytest.raises(SystemExit):
            arguments(wrong)


def test_outlines_with_a_broken_file(spark, tmp_path, capsys):
    for name, content in {"a.pdf": OUTLINE.encode(), "b.PDF": b"\xff", "c.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    main(["outlines", "--root", str(tmp_path)], spark, strict)
    assert json.loads(capsys.readouterr().out) == {"records": 1, "components": 2, "rules": 0, "quarantine": 1}
    assert spark.read.json(f"{tmp_path}/tables/quarantine").first()["source_file"] == "b.PDF"
    main(["outlines", "--root", str(tmp_path), "--limit", "1"], spark, strict)
    assert json.loads(capsys.readouterr().out)["quarantine"] == 0


def test_build(spark, tmp_path, capsys):
    texts = {"bulletin.pdf": "CS F111 Computer Programming   4", "Academic-Regulations-2023.pdf": "rule   1.01\nx", "timetable.pdf": "1001 CS F111  COMPUTER PROGRAMMING I   3 - - - 3  L1   M 2"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    main(["build", "--root", str(tmp_path)], spark, strict)
    counts = json.loads(capsys.readouterr().out)
    assert (counts["catalogue"], counts["offerings"], counts["regulation_clauses"], counts["equivalent_course_groups"]) == (1, 1, 1, 0)
    assert spark.read.json(f"{tmp_path}/tables/catalogue").first()["title"] == "COMPUTER PROGRAMMING I"


def test_http_parser(spark):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["x-key"]))
            wanted = asked[-1][0]["q"] != "fail"
            self.send_response(200 if wanted else 503)
            self.end_headers()
            fields = {"category": None, "keywords": ["robots"], "free_day": "Mon"} | {f: False for f in query.FLAGS}
            self.wfile.write(json.dumps({"text": json.dumps(fields)}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote = query.http_parser(f"http://127.0.0.1:{server.server_port}/", lambda q: {"q": q}, lambda body: body["text"], {"x-key": "k"}, 5)
        row = query.understand(spark, "open-book DELs", remote).first()
        assert (row["provider"], row["preferences"]["category"], row["preferences"]["open_book"], row["preferences"]["free_day"]) == ("remote", "del", True, "Mon")
        row = query.understand(spark, "fail", remote).first()
        assert row["provider"] == "deterministic" and "503" in row["warning"]
        lost = query.http_parser(f"http://127.0.0.1:{server.server_port}/", lambda q: {"q": q}, lambda body: body["absent"])
        assert query.understand(spark, "x", lost).first()["provider"] == "deterministic"
    finally:
        server.shutdown()
    assert asked[0] == ({"q": "open-book DELs"}, "k")
