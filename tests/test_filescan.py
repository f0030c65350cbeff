"""A folder of files: what is read and what is found where."""

from maskloom.operators import filescan

PATTERNS = {"key": "(?i)api[_-]?key", "url": "https?://[^\\s\"'`)<>\\]]+"}


def test_hits_with_places(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.js").write_text('let x = 1;\r\né😀 API_KEY "https://w3.org/x" https://evil.example/a api-key\n')
    (tmp_path / "deep" / "b.html").write_bytes(b"\xff apikey\n\n  http://b.example")
    (tmp_path / "c.png").write_text("api_key")
    (tmp_path / "big.md").write_text("api_key " * 100)
    (tmp_path / "empty.md").write_text("")
    files = filescan.text_files(spark, str(tmp_path), most_bytes=500)
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.column, r.name, r.found) for r in filescan.scan(files, PATTERNS, {"url": "https?://(www\\.)?w3\\.org/"}).collect())
    assert got == [
        ("a.js", 2, 4, "key", "API_KEY"),
        ("a.js", 2, 31, "url", "https://evil.example/a"),
        ("a.js", 2, 54, "key", "api-key"),
        ("b.html", 1, 3, "key", "apikey"),
        ("b.html", 3, 3, "url", "http://b.example"),
    ]
    assert filescan.scan(filescan.text_files(spark, str(tmp_path)), PATTERNS).filter("path LIKE '%big.md'").count() == 100
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,500)" in plan
