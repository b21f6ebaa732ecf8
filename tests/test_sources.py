from heddle.sources import io


def test_jsonl_with_a_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": "no number"}\nnot json\n{"id": 2}\n')
    good, bad = io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted(r["id"] for r in good.collect()) == [1, 2] and bad.count() == 2


def test_export_with_manifest(spark, tmp_path):
    manifest = io.export_with_manifest({"spans": spark.range(3), "calls": spark.range(0)}, str(tmp_path))
    assert {r["table"]: r["rows"] for r in manifest.collect()} == {"spans": 3, "calls": 0}
    assert spark.read.json(f"{tmp_path}/spans").count() == 3


def test_prices_listing_and_texts(spark, tmp_path):
    (tmp_path / "p.toml").write_text('[[price]]\nprovider = "p"\nmodel = "m"\noperation = "o"\neffective_from = 2024-01-01T00:00:00\ninput_per_million = 5\noutput_per_million = 6\nper_call = 1\n')
    row = io.read_prices(spark, str(tmp_path / "p.toml")).first()
    assert (row["model"], row["input_per_million"], row["cached_per_million"]) == ("m", 5, None)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"\xef\xbb\xbftext")
    (tmp_path / "d" / "b.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d" / "c.bin").write_bytes(b"x")
    assert io.list_documents(spark, str(tmp_path / "d")).count() == 2
    texts = {r["path"][-4:]: r["text"] for r in io.read_texts(spark, str(tmp_path / "d" / "*.{md,txt}")).collect()}
    assert texts == {"a.md"[-4:]: "text", ".txt": None}


def test_upgraded_evidence(spark):
    df = spark.createDataFrame([("b1", ["x", "y"]), ("b2", ["z"])], "block_id string, items array<string>")
    out = io.upgraded_evidence(df, spark.createDataFrame([("b1", 4)], "block_id string, page_start int")).collect()
    assert sorted((r["text"], r["page_start"]) for r in out if r["page_start"]) == [("x", 4), ("y", 4)] and len({r["evidence_id"] for r in out}) == 3
