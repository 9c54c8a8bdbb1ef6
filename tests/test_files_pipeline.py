from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quillgraph import cli
from quillgraph.operators.graph import Graph
from quillgraph.plans.pipeline import Config, Pipeline, Truncated, estimate, estimate_totals, extract, summary_text
from quillgraph.sources import files, schema
from quillgraph.streaming import ingest


def put(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in named.items():
        (folder / name.replace("__dot__", ".")).write_text(text)


def test_pdf_listing(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "c.txt", "sub/d.pdf", ".hidden/e.pdf", "_kept/f.Pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    assert [r.relative for r in files.list_pdfs(spark, str(tmp_path)).collect()] == ["a.PDF", "b.pdf"]
    assert [r.relative for r in files.list_pdfs(spark, str(tmp_path), True).collect()] == ["_kept/f.Pdf", "a.PDF", "b.pdf", "sub/d.pdf"]
    with pytest.raises(NotADirectoryError):
        files.list_pdfs(spark, str(tmp_path / "none"))


def test_stems(spark):
    df = spark.createDataFrame([("a/b c.pdf",), ("a__b c.pdf",), ("x:y.v2.pdf",)], "relative string")
    assert [r.s for r in df.select(files.cache_stem(F.col("relative")).alias("s")).collect()] == ["a__b_c", "a__b_c", "x_y.v2"]
    assert [(r.stem, r.n) for r in files.stem_collisions(df).collect()] == [("a__b_c", 2)]


def _convert(path, ocr):
    if "bad" in path:
        raise OSError("unreadable")
    return "scanned text " * 40 if ocr else ("<!-- image -->" if "scan" in path else "typed text " * 40)


def test_conversion_isolates_failures_and_skips_what_is_there(spark, tmp_path):
    pdfs, out = tmp_path / "pdfs", tmp_path / "out"
    put(pdfs, a__dot__pdf="x", scan__dot__pdf="x", bad__dot__pdf="x")
    line = Pipeline(spark, str(out))
    assert line.convert(str(pdfs), _convert, "auto") == 2
    assert (out / "markdown/scan.md").read_text().startswith("scanned") and (out / "markdown/a.md").read_text().startswith("typed")
    again = files.convert_directory(spark, str(pdfs), str(out / "markdown"), _convert).collect()
    assert [(r.source_file, r.content, r.error) for r in again] == [("bad.md", None, "OSError: unreadable")]
    put(pdfs / "sub", a__dot__pdf="x")
    put(pdfs, sub__a__dot__pdf="x")
    with pytest.raises(ValueError, match="share the stem"):
        files.convert_directory(spark, str(pdfs), str(out), _convert, recursive=True)


def test_lists_in_cells(spark):
    cells = ['["A, B.", "C"]', "['Jane Doe', \"O'Brien\"]", "A; B ;", "Solo", "", None, "[broken", " [ ] "]
    got = [r.l for r in spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").orderBy("k").select(files.parse_list(F.col("c")).alias("l")).collect()]
    assert got == [["A, B.", "C"], ["Jane Doe", "O'Brien"], ["A", "B"], ["Solo"], [], [], ["[broken"], []]


@pytest.mark.parametrize("suffix", [".csv", ".parquet"])
def test_tables_round_trip(spark, tmp_path, suffix):
    rows = [('Say "hi", they\nsaid', ["Lee, A.", "O'Brien, B."], "J", 2000, "Lee, A., O'Brien, B.", "p-1"), ("T", [], "", 0, "", "p-2")]
    path = str(tmp_path / f"t{suffix}")
    files.write_table(spark.createDataFrame(rows, schema.RAW_REFERENCES), path)
    assert sorted(map(tuple, files.read_table(spark, path, schema.RAW_REFERENCES).select("Title", "Authors_List", "Year", "citing_id").collect())) == sorted((r[0], r[1], r[3], r[5]) for r in rows)
    with pytest.raises(files.StageNotReady):
        files.read_table(spark, str(tmp_path / "none"), schema.EDGES)


def test_aliases_file(spark, tmp_path):
    put(tmp_path, al__dot__csv="cluster_id,canonical_id\n# a comment\na,b # why\na , c\n,x\nlonely\n")
    assert [tuple(r) for r in files.read_aliases(spark, str(tmp_path / "al.csv")).collect()] == [("a", "c")]
    assert files.read_aliases(spark, str(tmp_path / "none")).collect() == []


def test_reports_are_absent_when_clean(spark, tmp_path):
    bad = spark.createDataFrame([("a.md", "metadata", "E", "m")], schema.FAILURES)
    assert files.write_failures(bad, str(tmp_path / "f")) == 1 and (tmp_path / "f").exists()
    assert files.write_failures(bad.limit(0), str(tmp_path / "f")) == 0 and not (tmp_path / "f").exists()
    assert files.write_sidecar(bad, str(tmp_path / "s.json")) == 1 and json.loads((tmp_path / "s.json").read_text())[0]["source_file"] == "a.md"
    assert files.write_sidecar(bad.limit(0), str(tmp_path / "s.json")) == 0 and not (tmp_path / "s.json").exists()


def test_json_cache(spark, tmp_path):
    put(tmp_path, one__dot__json='{"Title": "T", "Year": 2000}')
    got = files.read_json_cache(spark, str(tmp_path), schema.RECORD)
    assert [(r.stem, r.Title, r.Year) for r in got.collect()] == [("one", "T", 2000)]
    items = spark.createDataFrame([("one",), ("two",)], "stem string")
    assert [r.stem for r in files.uncached(items, got, "stem").collect()] == ["two"]
    assert files.read_json_cache(spark, str(tmp_path / "none"), schema.RECORD).collect() == []


def test_ordinals_without_a_global_window(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS k")
    assert all(r.ord == r.k for r in files.numbered(df.repartition(5), "k").collect())
    assert files.numbered(df.limit(0), "k").collect() == []


def test_estimates(spark):
    docs = spark.createDataFrame([("a.md", "x" * 20_000), ("b.md", "y" * 3_000 + "\n## References\n" + "z" * 986)], "source_file string, content string")
    got = {r.source_file: tuple(r)[1:] for r in estimate(docs).collect()}
    assert got == {"a.md": (3140, 5265, 114, False), "b.md": (1141, 515, 5, True)}
    done = spark.createDataFrame([("a.md",)], "source_file string")
    cached = {r.source_file: tuple(r)[1:4] for r in estimate(docs, done, done).collect()}
    assert cached["a.md"] == (0, 0, 0)
    t = estimate_totals(estimate(docs)).first()
    assert tuple(t) == (2, 2, 3140 + 5265 + 1141 + 515, 119, 2 * 300 + 75 * 119)
    assert "$" in summary_text(estimate_totals(estimate(docs))) and "unknown" in summary_text(estimate_totals(estimate(docs)), "nobody")


def _metadata(text):
    if "BROKEN" in text:
        raise ValueError("no metadata")
    return [{"Title": text.split("\n")[0], "Authors_List": ["Roe, Jane"], "Journal": "J", "Year": "2020"}]


def _references(text):
    return [{"Title": t, "Authors_List": [a], "Journal": "J", "Year": y} for t, a, y in (x.split("|") for x in text.splitlines() if "|" in x)]


@pytest.fixture
def out(tmp_path):
    put(tmp_path / "markdown", a__dot__md="First paper\n\n## References\nGoverning things|Lee, Ann|1990\nTrust at work|Kim, Bo|2001", b__dot__md="Second paper\n\n## References\nGoverning things.|Lee, A.|1990", c__dot__md="Third\nnothing", d__dot__md="BROKEN")
    return tmp_path


def test_the_whole_pipeline(spark, out):
    r = Pipeline(spark, str(out), metadata=_metadata, references=_references).run()
    assert r.papers.count() == 3 and r.references.count() == 2 and r.graph.count() == 3
    assert sorted(x.id for x in r.references.collect()) == ["r-kim-2001-trust-at-work", "r-lee-1990-governing-things"]
    assert sum("Lee" in x.surname for x in r.authors.collect()) == 1
    assert [json.loads(x)["source_file"] for p in (out / "metadata_failures.jsonl").glob("*.json") for x in p.read_text().splitlines()] == ["d.md"]
    assert not (out / "reference_failures.jsonl").exists()
    assert [x["source_file"] for x in json.loads((out / "reports/papers_without_references.json").read_text())] == ["c.md"]
    summary = json.loads((out / "run_summary.json").read_text())
    assert summary["papers"] == 3 and json.loads((out / "manifest.json").read_text())["stage"] == "run"
    g = Graph.load(spark, str(out))
    assert [(x.id, x.n_citations) for x in g.top_cited(1).collect()] == [("r-lee-1990-governing-things", 2)] and g.has_authors

    def never(text):
        raise AssertionError("cached records must not be extracted again")

    again = Pipeline(spark, str(out), metadata=lambda t: _metadata(t) if "BROKEN" not in t else [{"Title": "Mended"}], references=never)
    assert again.extract_metadata().count() == 4 and not (out / "metadata_failures.jsonl").exists()


def test_stages_need_their_inputs(spark, tmp_path):
    with pytest.raises(files.StageNotReady):
        Pipeline(spark, str(tmp_path)).extract_metadata()
    with pytest.raises(files.StageNotReady):
        Pipeline(spark, str(tmp_path)).deduplicate()
    with pytest.raises(ValueError):
        Config(concurrency=0)
    with pytest.raises(ValueError, match="Nope"):
        schema.require_columns(spark.range(1), ["id", "Nope"])


def test_command_line(spark, out, capsys):
    Pipeline(spark, str(out), metadata=_metadata, references=_references).run()
    assert cli.main(["status", str(out)]) == 0 and "papers: 3" in capsys.readouterr().out
    assert cli.main(["estimate", str(out)]) == 0 and "tokens in" in capsys.readouterr().out
    assert cli.main(["dedup", str(out), "--threshold", "99"]) == 0 and "references" in capsys.readouterr().out
    assert cli.main(["authors", str(out), "--mode", "loose"]) == 0
    raw = out / "raw.csv"
    raw.write_text("Title,Authors_List,Journal,Year,Authors,citing_id\nA work,\"['Lee, A.']\",J,2000,\"Lee, A.\",p-1\nA work,\"['Lee, A.']\",J,2000,\"Lee, A.\",p-2\nOther,\"['Kim, B.']\",J,2001,\"Kim, B.\",p-1\n")
    capsys.readouterr()
    assert cli.main(["dedup", str(out), "--raw", str(raw)]) == 0 and "2 references, 3 edges" in capsys.readouterr().out
    assert cli.main(["estimate", str(out / "none")]) == 2 and "error" in capsys.readouterr().err
    assert cli.main(["convert", str(out)]) == 2 and cli.main(["enrich", str(out)]) == 2


def test_stream_ingest(spark, tmp_path):
    row = lambda t, c: (t, ["A"], "J", 2000, "A", c)
    source = tmp_path / "in"
    spark.createDataFrame([row("T", "p-1"), row("T", "p-1"), row("U", "p-2")], schema.RAW_REFERENCES).coalesce(1).write.parquet(str(source))
    for expected in (2, 3):
        ingest.ingest(ingest.stream_records(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        spark.createDataFrame([row("V", "p-3")], schema.RAW_REFERENCES).coalesce(1).write.mode("append").parquet(str(source))
    assert Path(tmp_path / "cp").exists()
    counts = ingest.citation_counts(spark.read.parquet(str(source)))
    assert {r.Title: r.n_citations for r in counts.collect()}["T"] == 2


def _cut_off(text, max_tokens):
    n = len(text.split())
    if n * 1000 > max_tokens:
        raise Truncated([{"Title": t, "Year": 2000} for t in text.split()[: max_tokens // 1000]])
    return [{"Title": t, "Year": 2000} for t in text.split()]


def test_answers_that_are_cut_off_are_asked_for_once_more(spark):
    docs = spark.createDataFrame([(f"{n}.md", " ".join(f"w{k}" for k in range(n))) for n in (3, 30, 50)] + [("x.md", "one")], "source_file string, content string")
    rows = extract(docs, _cut_off, concurrency=3).collect()
    n = {k: [r for r in rows if r.source_file == f"{k}.md"] for k in (3, 30, 50)}
    assert {k: (len(v), {r.truncated for r in v}) for k, v in n.items()} == {3: (3, {False}), 30: (30, {False}), 50: (40, {True})}
    assert [r.Title for r in sorted(n[30], key=lambda r: r.position)] == [f"w{k}" for k in range(30)]


def _enough(text):
    cited = text.split("## References")[0] if "## References" in text else text
    return [{"Title": t, "Authors_List": ["Lee, A."], "Journal": "J", "Year": "19x9" if t == "odd" else 1990} for t in text.split() if t.startswith("t")] if cited is not None else []


def test_run_with_everything(spark, tmp_path):
    """Conversion, undercounts, order of files, enrichment with its cache and sidecars, the summary, and estimates after it."""
    from pyspark.sql import Row

    from quillgraph.operators import enrich as en

    pdfs, out = tmp_path / "pdfs", tmp_path / "out"
    put(pdfs, a__dot__pdf="x", b__dot__pdf="x", scan__dot__pdf="x")

    def convert(path, ocr):
        if "scan" in path:
            return "<!-- image -->"
        name = Path(path).stem
        return f"Paper {name}\n" + "text " * 60 + "".join(f" [{k}]" for k in range(1, 21)) + "\n## References\n" + ("Trust at work|Kim, Bo|2001" if name == "a" else "Trust at Work.|Kim, B.|2001")

    catalogue = en.crossref(spark.createDataFrame([Row(ref_id="r-kim-2001-trust-at-work", pos=0, raw=json.dumps({"title": ["Trust at work"], "issued": {"date-parts": [[2001]]}, "DOI": "10.1/t", "container-title": ["Found"]}))]))
    nothing = en.openalex(spark.createDataFrame([], "ref_id string, pos int, raw string"))
    line = Pipeline(spark, str(out), metadata=_metadata, references=_references)
    before = estimate_totals(line.estimate()).first() if (out / "markdown/a.md").exists() else None
    r = line.run(pdfs=str(pdfs), converter=convert, catalogues=(catalogue, nothing))
    assert before is None and [(x.id, x.doi, x.Journal, x.Title) for x in r.references.collect()] == [("r-kim-2001-trust-at-work", "10.1/t", "Found", "Trust at work")]
    s = json.loads((out / "run_summary.json").read_text())
    names = "n_papers n_references_raw n_references_dedup n_edges n_authors n_author_citations n_author_review_flags n_metadata_failures n_references_failures n_source_duplicates n_papers_no_references n_conversion_warnings model enrich dedup_config author_config"
    assert set(names.split()) <= set(s)
    assert [s[k] for k in ("n_papers", "n_references_raw", "n_references_dedup", "n_edges", "n_metadata_failures", "n_conversion_warnings", "n_papers_no_references", "enrich")] == [3, 2, 1, 2, 0, 1, 1, True]
    assert json.loads((out / "enrichment_summary.json").read_text())["match_rate"] == 1.0
    low = [json.loads(x) for p in (out / "reference_undercounts.jsonl").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["source_file"], x["estimate"], x["extracted"]) for x in low) == [("a.md", 20, 1), ("b.md", 20, 1)]
    t = estimate_totals(line.estimate()).first()
    # What is cached costs nothing; the scan has no cached reference, so its references would be asked for again.
    assert (t.n_metadata, t.n_references, t.estimated_references) == (0, 1, 1)
    assert Graph.of(r).counts().first().n_edges == 2
    again = line.enrich(en.crossref(spark.createDataFrame([], "ref_id string, pos int, raw string")), nothing)  # the cache answers
    assert [x.doi for x in again.collect()] == ["10.1/t"]
    line.evaluate(str(out / "markdown"))


def test_unreadable_years_fail(spark, tmp_path):
    """In an extracted record it is the paper's failure; in a table of raw references it fits no other year."""
    docs = spark.createDataFrame([("a.md", "todd odd"), ("b.md", "tx ty")], "source_file string, content string")
    bad = lambda text: [{"Title": t, "Year": "n.d." if t == "odd" else "1990"} for t in text.split()]
    rows = extract(docs, bad).collect()
    assert sorted((r.source_file, r.error_class) for r in rows) == [("a.md", "ValueError"), ("b.md", None), ("b.md", None)]
    head = "Title,Authors,Year,citing_id\n"
    for years, n in ((("1990", "abc"), 2), (("1990", ""), 1), (("abc", "abc"), 2), (("1990", "0"), 1)):
        at = tmp_path / "-".join(years)
        at.mkdir()
        (at / "raw.csv").write_text(head + f'A work of trust,"Lee, A.",{years[0]},p-1\nA work of trust,"Lee, A.",{years[1]},p-2\n')
        assert cli.main(["dedup", str(at / "out"), "--raw", str(at / "raw.csv"), "--threshold", "80"]) == 0
        assert spark.read.parquet(str(at / "out/references.parquet")).count() == n


def test_the_first_of_a_file_leads(spark, tmp_path):
    """Clusters follow the order of files and of records in them, not that of their content."""
    rows = [("Trust at work", ["Kim, Bo"], "J", 2001, "Kim, Bo", "p-z", "a.md", 1, True), ("TRUST AT WORK", ["Kim, Bo"], "J", 2002, "Kim, Bo", "p-a", "b.md", 0, True), ("Trust at work", ["Kim, Bo"], "J", 2000, "Kim, Bo", "p-z", "a.md", 0, True)]
    line = Pipeline(spark, str(tmp_path))
    files.write_table(spark.createDataFrame(rows, schema.RAW_PLACED).repartition(3), line.at.at("raw"))
    # 2000 leads: 2001 is within a year of it, 2002 is not and leads its own. By content 2001 or 2002 would have come first.
    assert sorted(r.Year for r in line.deduplicate()[0].collect()) == [2000, 2002]
